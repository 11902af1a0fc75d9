"""Embedding near-duplicates by NN-descent on unit vectors, with threshold edges kept.

Rows with equal vectors are one node. A neighbour graph starts from random hyperplane buckets and is refined by
neighbours-of-neighbours joins: around every node its neighbours (both directions; a hub's are cut into pieces) are
compared with each other, and each node keeps its best ``NEIGHBOURS``. Rounds go on until a round adds hardly any link.

A node whose whole list is above the threshold is saturated. Its list, like that of everything in its component, is
enlarged to the component: members are ordered by their angle to one pivot member. Two members whose angles sum to less
than the threshold angle are linked by the triangle inequality, two whose angles differ by more are not; only the bins
between are compared, in tiles of bounded size that emit one count per member. So a tight group of any size costs counts
of bins, not pairs.

Recall is audited node by node against all rows: nodes outside the enlarged components, until ``AUDIT`` of them have
links or all are compared, and ``AUDIT`` nodes within. While nodes with one link, nodes with more, or nodes within have less
than ``RECALL`` of their links found on average, lists double and refinement goes on from further buckets; after ``STARTS``
starts all nodes are compared with all, in blocks of bounded size (quadratic in the nodes; a dense component gives one
link to another node). Rounds settle by the new links of lists that are not saturated.

Links are decided by the cosine in double precision (>= threshold). Edge cases: vectors that are null, zero or hold null
or non-finite components, and those of another length than the most frequent one, link with nothing and are their own
component; rows with a null vec_id take part with a component like any others, and component_id is null only where no member has an
id; repeated rows are linked rows. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstat.llm.common import Scratch, small
from loomstat.llm.graph import connected_components
from loomstat.llm.vectors import dimension, dots, matrix, usable

THRESHOLD = 0.95
NEIGHBOURS = 12
TREES = 4
BUCKET = 128
PIECE = 48  # neighbours compared with each other around one node
SETTLED = 0.002
AUDIT = 200
STARTS = 3
QUERIES = 4096  # nodes compared with all others in one job
ROWS = 256  # of them at once
RECALL = 0.97
SLACK = 1e-4  # of single precision in the search; links are confirmed in double
BIN = math.radians(0.5)
TILE = 1024


def _pairs_above(ids: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its k best other rows whose cosine is above the row's ``least``."""
    s = x @ x.T
    s[ids[:, None] == ids] = -2
    m = min(k, len(ids))
    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
    v = np.take_along_axis(s, best, axis=1)
    r, c = np.nonzero(v > least[:, None])
    return ids[r], ids[best[r, c]], v[r, c]


def _start(nodes: DataFrame, n: int, dim: int, k: int, round_: int) -> DataFrame:
    """Edges (u, v, s) within buckets of random hyperplanes."""
    bits = max(0, math.ceil(math.log2(max(1, n / BUCKET))))
    planes = np.random.default_rng(100 + round_).normal(size=(TREES, dim, bits)).astype(np.float32)

    def coded(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                x = np.stack(b["x"])
                for t in range(TREES):
                    code = ((x @ planes[t]) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pd.DataFrame({"tree": t, "code": code.astype(np.int64), "cid": b["cid"], "x": b["x"]})

    def near(b: pd.DataFrame) -> pd.DataFrame:
        u, v, s = _pairs_above(b["cid"].to_numpy(), np.stack(b["x"]), np.full(len(b), -2.0), k)
        return pd.DataFrame({"u": u, "v": v, "s": s})

    code = nodes.select("cid", "x").mapInPandas(coded, "tree int, code long, cid long, x array<float>")
    sizes = code.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / (4 * BUCKET)).alias("m"))
    dealt = code.join(sizes, ["tree", "code"]).withColumn("piece", F.pmod(F.xxhash64("cid", "tree", F.lit(round_)), "m"))
    return dealt.groupBy("tree", "code", "piece").applyInPandas(near, "u long, v long, s float")


def _trim(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("u").orderBy(F.col("s").desc(), "v")
    return edges.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _refine(nodes: DataFrame, graph: DataFrame, k: int, round_: int) -> DataFrame:
    """New edges among each node's neighbours, where they improve a list; each round cuts a hub's into other pieces."""
    both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    degree = both.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("m"))
    least = graph.groupBy(F.col("u").alias("v")).agg(F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(F.lit(-2.0)).alias("least"))
    side = nodes.select(F.col("cid").alias("v"), "x").join(least, "v", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    around = (both.join(degree, "u").withColumn("piece", F.when(F.col("m") > 1, F.pmod(F.xxhash64("v", "u", F.lit(round_)), "m")).otherwise(0))
              .select("u", "piece", "v").join(side, "v"))

    def near(b: pd.DataFrame) -> pd.DataFrame:
        u, v, s = _pairs_above(b["v"].to_numpy(), np.stack(b["x"]), b["least"].to_numpy(), k)
        return pd.DataFrame({"u": u, "v": v, "s": s})

    return around.groupBy("u", "piece").applyInPandas(near, "u long, v long, s float")


def _links(nodes: DataFrame, graph: DataFrame, threshold: float, dim: int) -> DataFrame:
    """Undirected edges (a, b) whose cosine in double precision reaches the threshold."""
    close = graph.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()

    def sure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            if len(p):
                yield p.loc[_cosine(matrix(p["va"], dim), matrix(p["vb"], dim)) >= threshold, ["a", "b"]]

    both = close.join(nodes.select(F.col("cid").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("cid").alias("b"), F.col("v").alias("vb")), "b")
    return both.mapInPandas(sure, "a long, b long")


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return dots(a, b) / np.sqrt(dots(a, a) * dots(b, b))


def _enlarged(members: DataFrame, threshold: float, dim: int, scratch: Scratch) -> DataFrame:
    """``members(comp, cid, v, w)`` -> (cid, linked): the weight of all other members linked with it."""
    reach = math.acos(threshold)
    pivot = members.groupBy("comp").agg(F.min_by("v", "cid").alias("p"))

    def angled(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                turn = np.arccos(np.clip(_cosine(matrix(b["v"], dim), matrix(b["p"], dim)), -1, 1))
                yield b.drop(columns="p").assign(bin=(turn / BIN).astype(np.int32))

    kind = dict(members.dtypes)["v"]
    m = members.join(small(pivot), "comp").mapInPandas(angled, f"comp long, cid long, v {kind}, w long, bin int")
    m = scratch.pin(m)
    bins = scratch.pin(m.groupBy("comp", "bin").agg(F.sum("w").alias("w"), F.ceil(F.count(F.lit(1)) / TILE).alias("tiles")))
    a, b = bins.alias("a"), bins.alias("b")
    eps = 1e-6
    sure = (F.col("a.bin") + F.col("b.bin") + 2) * BIN <= reach - eps
    never = (F.abs(F.col("a.bin") - F.col("b.bin")) - 1) * BIN > reach + eps
    met = a.join(b, F.col("a.comp") == F.col("b.comp")).select(
        F.col("a.comp").alias("comp"), F.col("a.bin").alias("bin"), F.col("b.bin").alias("other"), F.col("b.w").alias("w"),
        F.col("a.tiles").alias("tiles"), F.col("b.tiles").alias("other_tiles"), sure.alias("sure"), never.alias("never"))
    certain = met.where("sure").groupBy("comp", "bin").agg(F.sum("w").alias("sure_w"))
    base = m.join(certain, ["comp", "bin"], "left").select(
        "cid", (F.coalesce("sure_w", F.lit(0)) - F.when(F.col("sure_w").isNotNull() & (2 * (F.col("bin") + 1) * BIN <= reach - eps), F.col("w")).otherwise(0)).alias("linked"))
    open_ = scratch.pin(met.where("NOT sure AND NOT never").select("comp", "bin", "other", "tiles", "other_tiles"))
    if open_.isEmpty():
        return base
    tile = lambda t: F.pmod(F.xxhash64("cid"), t)
    left = (m.join(open_, ["comp", "bin"]).withColumn("tile", tile("tiles")).withColumn("other_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_tiles") - 1)))
            .select("comp", "bin", "tile", "other", "other_tile", "cid", "v"))
    right = (m.withColumnRenamed("bin", "other").join(open_, ["comp", "other"]).withColumn("other_tile", tile("other_tiles"))
             .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
             .select(*[F.col(c).alias(c) for c in ("comp", "bin", "tile", "other", "other_tile", "cid", "v", "w")]))  # columns of their own

    def count(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"cid": [], "linked": []})
        p, q = matrix(x["v"], dim), matrix(y["v"], dim)
        cos = (p @ q.T) / np.sqrt(np.outer(dots(p, p), dots(q, q)))
        edge = np.argwhere(np.abs(cos - threshold) < 1e-12)  # decide these in the one fixed order
        if len(edge):
            cos[edge[:, 0], edge[:, 1]] = _cosine(p[edge[:, 0]], q[edge[:, 1]])
        hit = (cos >= threshold) & (x["cid"].to_numpy()[:, None] != y["cid"].to_numpy())
        return pd.DataFrame({"cid": x["cid"], "linked": hit @ y["w"].to_numpy()})

    keys = ["comp", "bin", "tile", "other", "other_tile"]
    counted = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(count, "cid long, linked long")
    return base.unionByName(counted).groupBy("cid").agg(F.sum("linked").alias("linked"))


def _saturated(graph: DataFrame, k: int, threshold: float) -> DataFrame:
    """Nodes (id) whose whole list is above the threshold."""
    return graph.groupBy("u").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("s")).where((F.col("c") >= k) & (F.col("s") >= threshold - SLACK)).select(F.col("u").alias("id"))


def _blocks(nodes: DataFrame, size: int) -> Iterator[DataFrame]:
    """``nodes`` in random blocks of about ``size``."""
    m = math.ceil(nodes.count() / size)
    for i in range(m):
        yield nodes.where(F.pmod(F.xxhash64(F.lit(3), "cid"), F.lit(m)) == i)


def _recall(nodes: DataFrame, part: DataFrame, found: DataFrame, threshold: float, dim: int) -> list[tuple[int, int, float]]:
    """(1 link or 2 for more, nodes, sum of the shares of a node's links that were found) of the nodes of ``part`` that have links."""
    got = part.select("cid", "v").toPandas()
    if not len(got):
        return []
    q = nodes.sparkSession.sparkContext.broadcast((got["cid"].to_numpy(), matrix(got["v"], dim)))

    def links(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, p = q.value
        total = np.zeros(len(ids), np.int64)
        for b in it:
            if len(b):
                x, other, w = matrix(b["v"], dim), b["cid"].to_numpy(), b["w"].to_numpy()
                for i in range(0, len(ids), ROWS):
                    y = p[i : i + ROWS]
                    cos = (y @ x.T) / np.sqrt(np.outer(dots(y, y), dots(x, x)))
                    total[i : i + ROWS] += ((cos >= threshold) & (ids[i : i + ROWS, None] != other)) @ w
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"cid": ids[seen], "true": total[seen]})

    true = nodes.select("cid", "v", "w").mapInPandas(links, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true"))
    share = F.least("true", F.coalesce("linked", F.lit(0))) / F.col("true")
    r = true.join(found, "cid", "left").groupBy(F.least("true", F.lit(2)).alias("kind")).agg(F.count(F.lit(1)), F.sum(share)).collect()
    q.unpersist()
    return [tuple(x) for x in r]


def _audit(nodes: DataFrame, members: DataFrame, found: DataFrame, threshold: float, dim: int) -> float:
    """Least mean recall of: nodes outside ``members`` with one link, those with more, and nodes of ``members``."""
    seen: dict[int, list[float]] = {}
    for part in _blocks(nodes.join(members.select("cid"), "cid", "left_anti"), QUERIES):
        for kind, n, share in _recall(nodes, part, found, threshold, dim):
            so = seen.setdefault(kind, [0, 0.0])
            so[0], so[1] = so[0] + n, so[1] + share
        if sum(n for n, _ in seen.values()) >= AUDIT:
            break
    within = next(_blocks(members.select("cid", "v"), AUDIT), None)
    inner = _recall(nodes, within, found, threshold, dim) if within is not None else []
    if inner:
        seen[0] = [sum(n for _, n, _ in inner), sum(share for _, _, share in inner)]
    return min((share / n for n, share in seen.values()), default=1.0)


def _all_pairs(nodes: DataFrame, members: DataFrame, threshold: float) -> Iterator[DataFrame]:
    """Edges (u, v, s) at the threshold from comparing all nodes with all, a block at a time. Of the links between a dense
    component and another node or component, a task gives one a batch: the node or component then is part of it."""
    spark = nodes.sparkSession
    side = nodes.select("cid", "x").join(members.select("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", F.lit(-1).cast("long")))
    for part in _blocks(side, QUERIES):
        got = part.toPandas()
        if not len(got):
            continue
        q = spark.sparkContext.broadcast((got["cid"].to_numpy(), got["comp"].to_numpy(), np.stack(got["x"])))

        def near(it: Iterator[pd.DataFrame], q=q) -> Iterator[pd.DataFrame]:
            ids, comps, p = q.value
            for b in it:
                if len(b):
                    x, other, theirs = np.stack(b["x"]), b["cid"].to_numpy(), b["comp"].to_numpy()
                    for i in range(0, len(ids), ROWS):
                        s = p[i : i + ROWS] @ x.T
                        r, c = np.nonzero(s >= threshold - SLACK)
                        e = pd.DataFrame({"u": ids[i + r], "v": other[c], "s": s[r, c], "cu": comps[i + r], "cv": theirs[c]})
                        e = e[(e["u"] < e["v"]) & ((e["cu"] != e["cv"]) | (e["cu"] < 0))]
                        if not len(e):
                            continue
                        dense = (e["cu"] >= 0) | (e["cv"] >= 0)
                        # cids are not negative; components are named -2 and below here
                        a, z = e["u"].where(e["cu"] < 0, -2 - e["cu"]), e["v"].where(e["cv"] < 0, -2 - e["cv"])
                        first = ~pd.DataFrame({"a": a, "z": z}).duplicated()
                        yield e.loc[first | ~dense, ["u", "v", "s"]]

        yield side.mapInPandas(near, "u long, v long, s float")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    scratch = Scratch(vectors.sparkSession, "nnd")
    rows = scratch.pin(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")))
    fit = usable(rows, "v")
    dim = dimension(fit, "v")
    fit = fit.where(F.size("v") == dim)
    classes = fit.groupBy("v").agg(F.min("rid").alias("cid"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("w"))

    def unit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                x = matrix(b["v"], dim)
                yield b.assign(x=[*(x / np.sqrt(dots(x, x))[:, None]).astype(np.float32)])

    kind = dict(rows.dtypes)["v"]
    nodes = scratch.pin(classes.mapInPandas(unit, f"v {kind}, cid long, low long, w long, x array<float>"))
    n, k, start = nodes.count(), NEIGHBOURS, 0
    graph = scratch.pin(_trim(_start(nodes, n, dim, k, start), k)) if n else None
    round_, more = 0, None
    while n:
        while more is None:
            round_ += 1
            new = scratch.pin(_trim(graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")).unionByName(_refine(nodes, graph, k, round_)), k))
            close = F.col("s") >= threshold - SLACK
            open_ = new.where(close).select("u", "v").join(_saturated(new, k, threshold).withColumnRenamed("id", "u"), "u", "left_anti")
            grown, now = open_.join(graph.where(close).select("u", "v"), ["u", "v"], "left_anti").count(), open_.count()
            scratch.drop(graph)
            graph = new
            if grown <= SETTLED * now:
                break
        close = graph if more is None else graph.unionByName(more)
        links = scratch.pin(_links(nodes, close, threshold, dim))
        comp = scratch.pin(connected_components(links, scratch))
        dense = scratch.pin(comp.join(_saturated(graph, k, threshold), "id").select("component").distinct())
        inside = comp.join(small(dense), "component").select(F.col("component").alias("comp"), F.col("id").alias("cid"))
        members = scratch.pin(nodes.select("cid", "v", "w").join(inside, "cid").select("comp", "cid", "v", "w"))
        weight = nodes.select(F.col("cid").alias("o"), "w")
        ends = links.select(F.col("a").alias("cid"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("cid"), F.col("a").alias("o")))
        degree = ends.join(weight, "o").groupBy("cid").agg(F.sum("w").alias("linked")).join(members.select("cid"), "cid", "left_anti")
        found = degree.unionByName(_enlarged(members, threshold, dim, scratch)) if not members.isEmpty() else degree
        found = scratch.pin(found)
        if more is not None or _audit(nodes, members, found, threshold, dim) >= RECALL:
            break
        start += 1
        if start < STARTS:
            k *= 2
            graph = scratch.pin(_trim(graph.unionByName(_start(nodes, n, dim, k, start)), k))
        else:
            for part in _all_pairs(nodes, members, threshold):
                part = scratch.pin(part)
                more = part if more is None else more.unionByName(part)

    bare = rows.join(fit.select("rid"), "rid", "left_anti") if n else rows
    out = bare.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if n:
        named = nodes.select("cid", "low", "w", "v").join(comp.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
        label = named.join(lowest, "component").join(found, "cid", "left").select(
            "cid", (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
        out = _placed(fit, nodes).join(label, "cid").select("vec_id", "n_links", "component_id").unionByName(out)
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _placed(fit: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each row with its node."""
    key = lambda c: F.xxhash64(c)
    n = nodes.select(key("v").alias("h"), F.col("v").alias("nv"), "cid")
    return fit.select("vec_id", "v", key("v").alias("h")).join(n, "h").where(F.col("v") == F.col("nv")).select("vec_id", "cid")


#: Links by comparing all pairs, for small tables; the search finds them all there.
ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, len(embedding) = (SELECT mode(len(embedding)) FROM embeddings)
    AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0 AS fine FROM embeddings),
e AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.fine AND b.fine WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r(i, j) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)
SELECT c.i AS vec_id, (SELECT count(*) FROM e WHERE e.i = c.i) AS n_links, c.component_id, c.i = c.component_id AS kept
FROM (SELECT i, min(j) AS component_id FROM r GROUP BY i) c
"""
