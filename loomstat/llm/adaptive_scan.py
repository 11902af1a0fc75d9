"""Approximate nearest neighbours: inverted lists scanned dimension by dimension, with early abandonment.

Largest inner product becomes smallest distance by one more coordinate (sqrt(max norm^2 - norm^2), 0 for queries). All
vectors are rotated by one random orthogonal matrix and dealt to lists by their nearest centre (k-means on a bounded
sample). Within a list, candidates are read in blocks of ``BLOCK_DIMS`` rotated columns: the distance over the first d
columns, scaled by D/d, estimates the whole one, and a candidate is abandoned as soon as the hypothesis that it lies
within the query's threshold is rejected (estimate above threshold * (1 + EPSILON / sqrt(d))^2). Survivors are scored on
their original vectors in double precision. The threshold is the distance to the query's k-th nearest sample vector in
the lists it probes, so it holds for every list at once.

The number of probed lists is calibrated: ``CALIBRATE`` vectors are searched exactly over all rows, and enough lists
are probed to hold ``RECALL`` of their neighbours. All rows are indexed. Lists and their queries are cut into blocks of
bounded size, so a list with a third of all rows is many tasks.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id or of
another length than the most frequent one; of rows with equal ids the one with the smallest vector stands for the id; a
query's own id is never its neighbour; with fewer candidates than k all are returned; ties go to the smaller id; without
queries or candidates the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstat.llm.common import Scratch
from loomstat.llm.vectors import dimension, dots, matrix, usable

K = 20
SAMPLE_ROWS = 16_384
MOST_LISTS = 4096
SINGLE_LIST_ROWS = 1000
BLOCK_DIMS = 16
EPSILON = 2.1
CALIBRATE = 64
RECALL = 0.98
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
CHUNK = 64  # queries compared at once


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds if k > 1 else 1):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Index:
    """Rotation, list centres and the sample with its lists: what every task needs, of bounded size."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, top: float, lists: int):
        d = sample.shape[1] + 1
        q, r = np.linalg.qr(np.random.default_rng(13).normal(size=(d, d)))
        self.rotation, self.top2 = q * np.sign(np.diag(r)), top * top
        self.ids, self.sample = ids, sample
        turned = self.stored(sample)
        self.centres = _kmeans(turned, lists)
        self.sample_list = _nearest(turned, self.centres)

    def stored(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top2 - (x * x).sum(axis=1), 0))
        return np.c_[x, rest] @ self.rotation

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.zeros(len(x))] @ self.rotation

    def order(self, turned: np.ndarray) -> np.ndarray:
        """Lists by distance from each query."""
        return np.argsort((self.centres * self.centres).sum(axis=1) / 2 - turned @ self.centres.T, axis=1, kind="stable")


def scan(q: np.ndarray, c: np.ndarray, limit2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of rotated rows that no test abandons; limit2: squared thresholds of the queries."""
    dims = q.shape[1]
    out_q, out_c = [], []
    for a in range(0, len(q), CHUNK):
        qs, lim = q[a : a + CHUNK], limit2[a : a + CHUNK]
        first, part = c[:, :BLOCK_DIMS], qs[:, :BLOCK_DIMS]
        dist = (part * part).sum(axis=1)[:, None] + (first * first).sum(axis=1) - 2 * part @ first.T
        d = min(BLOCK_DIMS, dims)
        i, j = np.nonzero(dist * (dims / d) <= (lim * (1 + EPSILON / math.sqrt(d)) ** 2 if d < dims else lim)[:, None])
        s = dist[i, j]
        while d < dims and len(i):
            e = min(d + BLOCK_DIMS, dims)
            diff = qs[i, d:e] - c[j, d:e]
            s, d = s + (diff * diff).sum(axis=1), e
            slack = (1 + EPSILON / math.sqrt(d)) ** 2 if d < dims else 1 + 1e-9
            keep = s * (dims / d) <= lim[i] * slack + (1e-9 if d == dims else 0)
            i, j, s = i[keep], j[keep], s[keep]
        out_q.append(i + a)
        out_c.append(j)
    return np.concatenate(out_q), np.concatenate(out_c)


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return frame.groupby("query_id", sort=False).head(k)


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> query_id, rank, vec_id, score: each query's k nearest by inner product."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable(vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    dim = dimension(rows)
    rows = scratch.pin(rows.where(F.size("embedding") == dim).withColumnRenamed("embedding", "v"))
    n, distinct, top2 = rows.agg(F.count(F.lit(1)), F.countDistinct("vec_id"),
                                 F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    if distinct < n:
        rows, n = scratch.pin(rows.groupBy("vec_id").agg(F.min("v").alias("v"))), distinct
    kind = dict(rows.dtypes)["v"]
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)

    part = F.pmod(F.xxhash64(F.lit(17), "vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE_ROWS / n)))
    got = rows.where(part).limit(2 * SAMPLE_ROWS).toPandas().sort_values("vec_id")
    if not len(got):
        got = rows.limit(1).toPandas()
    lists = 1 if n < SINGLE_LIST_ROWS else min(MOST_LISTS, round(math.sqrt(n)), len(got))
    index = Index(got["vec_id"].to_numpy(), matrix(got["v"], dim), math.sqrt(top2), lists)
    shared = spark.sparkContext.broadcast(index)

    def listed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                x = shared.value
                yield b.assign(list=_nearest(x.stored(matrix(b["v"], dim)), x.centres).astype(np.int32))

    stored = scratch.pin(rows.mapInPandas(listed, f"vec_id long, v {kind}, list int"))
    probes = lists if lists == 1 else _calibrated(stored, shared, dim, k, lists, recall)

    queries = scratch.pin(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v"))

    def probing(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for b in it:
            for a in range(0, len(b), 256):
                p = b.iloc[a : a + 256]
                q = matrix(p["v"], dim)
                near = x.order(x.query(q))[:, :probes]
                allowed = np.zeros((len(p), lists), bool)
                np.put_along_axis(allowed, near, True, axis=1)
                ip = q @ x.sample.T
                ip[~allowed[:, x.sample_list] | (x.ids == p["query_id"].to_numpy()[:, None])] = -np.inf
                m = min(k, ip.shape[1])
                best = np.argpartition(-ip, m - 1, axis=1)[:, :m]
                worst = np.take_along_axis(ip, best, axis=1).min(axis=1) if m == k else np.full(len(p), -np.inf)
                limit = np.where(np.isfinite(worst), (q * q).sum(axis=1) + x.top2 - 2 * worst, np.inf)
                fine = np.isfinite(np.take_along_axis(ip, best, axis=1))
                yield pd.DataFrame({"query_id": p["query_id"].to_numpy(), "v": p["v"].to_numpy(), "limit2": limit, "probe": [*near.astype(np.int32)],
                                    "seen": [x.ids[r[f]] for r, f in zip(best, fine, strict=True)],
                                    "seen_score": [dots(np.broadcast_to(q[i], (f.sum(), dim)), x.sample[r[f]]) for i, (r, f) in enumerate(zip(best, fine, strict=True))]})

    probed = scratch.pin(queries.mapInPandas(
        probing, f"query_id long, v {kind}, limit2 double, probe array<int>, seen array<long>, seen_score array<double>"))
    # sizes of lists and of their query sets: one row a list
    size = {r[0]: r[1] for r in stored.groupBy("list").count().collect()}
    asked = {r[0]: r[1] for r in probed.select(F.explode("probe").alias("list")).groupBy("list").count().collect()}
    blocks = F.array(*[F.lit(max(1, -(-size.get(i, 0) // BLOCK_ROWS))) for i in range(lists)])
    splits = F.array(*[F.lit(max(1, -(-asked.get(i, 0) // BLOCK_QUERIES))) for i in range(lists)])
    salt = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    upto = lambda m: F.sequence(F.lit(0), m - 1)
    left = (probed.select("query_id", "v", "limit2", F.explode("probe").alias("list"))
            .withColumn("split", salt("query_id", F.get(splits, F.col("list")))).withColumn("block", F.explode(upto(F.get(blocks, F.col("list"))))))
    right = (stored.withColumn("block", salt("vec_id", F.get(blocks, F.col("list"))))
             .withColumn("split", F.explode(upto(F.get(splits, F.col("list"))))))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q, c = shared.value, matrix(a["v"], dim), matrix(b["v"], dim)
        i, j = scan(x.query(q), x.stored(c), a["limit2"].to_numpy())
        qid, vid = a["query_id"].to_numpy()[i], b["vec_id"].to_numpy()[j]
        own = qid == vid
        i, j = i[~own], j[~own]
        score = np.concatenate([dots(q[i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536)]) if len(i) else np.empty(0)
        return _best(pd.DataFrame({"query_id": qid[~own], "vec_id": vid[~own], "score": score}), k)

    keys = ["list", "block", "split"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    seen = probed.select("query_id", F.explode(F.arrays_zip("seen", "seen_score")).alias("s")).select("query_id", F.col("s.seen").alias("vec_id"), F.col("s.seen_score").alias("score"))
    each = found.unionByName(seen).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(stored: DataFrame, shared, dim: int, k: int, lists: int, recall: float) -> int:  # noqa: ANN001
    """Lists to probe so that ``recall`` of the neighbours of CALIBRATE sample vectors, searched exactly, are in them."""
    x = shared.value
    pick = np.linspace(0, len(x.ids) - 1, min(CALIBRATE, len(x.ids))).astype(int)

    def exact(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        q, own = x.sample[pick], x.ids[pick]
        for b in it:
            if not len(b):
                continue
            ids, where = b["vec_id"].to_numpy(), b["list"].to_numpy()
            ip = q @ matrix(b["v"], dim).T
            ip[own[:, None] == ids] = -np.inf
            m = min(k, len(ids))
            best = np.argpartition(-ip, m - 1, axis=1)[:, :m]
            yield pd.DataFrame({"query_id": np.repeat(own, m), "vec_id": ids[best].ravel(), "list": where[best].ravel(),
                                "score": np.take_along_axis(ip, best, axis=1).ravel()})

    near = stored.mapInPandas(exact, "query_id long, vec_id long, list int, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    true = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "list").toPandas()  # CALIBRATE * k rows
    place = np.argsort(x.order(x.query(x.sample[pick])), axis=1)
    row = {i: r for r, i in enumerate(x.ids[pick])}
    ranks = np.sort([place[row[q], c] for q, c in zip(true["query_id"], true["list"], strict=True)])
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1 if len(ranks) else lists
