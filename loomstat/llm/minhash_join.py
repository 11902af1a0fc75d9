"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

Every text becomes a set of distinct five-word shingles. Texts with equal sets form one class, so exact copies cost one
row each and no pair. A class has a signature of ``POSITIONS`` b-bit minima. The signature is cut into ``CHUNKS`` chunks;
two signatures that differ in at most ``MAX_DISTANCE`` positions agree, by the pigeonhole principle, in at least one
chunk up to ``MAX_DISTANCE // CHUNKS`` positions. Each class therefore emits, for every chunk, one key per allowed set of
wrong positions (those left out), and every pair within the distance shares a key: the join is exact for signatures.

Buckets are never expanded into pairs. First each member meets only its bucket's smallest class, then one more class of
its bucket's choice; confirmed pairs are merged into components. Members of one bucket that are still in different
components are then compared in tiles of bounded size: a task holds the signatures of two pieces of a bucket and passes on
only the members that are near one of another component, and a second pass over those tiles confirms them on their full
sets and returns at most one link for each component that it joins. Every link that can change a component is kept.

At a Jaccard similarity of 0.75 a position differs with probability 1/4; with 48 positions and a distance of up to 23 a
pair on the threshold itself is missed with probability 0.0002, a closer pair far less. Links are confirmed on full sets.

Edge cases: null and empty texts (and texts of white space) have the empty set, n_shingles 0, and are their own
component; fewer than five words are one shingle; repeated rows and ids are separate rows, linked by their text like any
others; a null doc_id never is a component's smallest id unless the component has no other (component_id is then null).
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import Scratch, small, tidy, tokens, with_row_id
from loomstat.llm.graph import connected_components

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
POSITIONS = 48
CHUNKS = 12
MAX_DISTANCE = 23  # below CHUNKS * (ERRORS + 1)
ERRORS = MAX_DISTANCE // CHUNKS
#: Members and shingles of a piece of a bucket; a tile holds two pieces.
TILE_MEMBERS = 1024
TILE_SHINGLES = 400_000
COLUMNS = 4096

_R = np.random.default_rng(20_011)
_MUL = _R.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = tokens(text)
    if not w:
        return np.empty(0, np.uint64)
    k = min(SHINGLE_WORDS, len(w))
    it = [w[i:] for i in range(k)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(s)) for s in zip(*it, strict=False)), np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """POSITIONS minima, each mixed and cut to 16 bits."""
    low = np.full(POSITIONS, np.uint64(2**64 - 1))
    for a in range(0, len(shingles), 8192):
        part = shingles[a : a + 8192, None] * _MUL + _ADD
        np.minimum(low, part.min(axis=0), out=low)
    low ^= low >> np.uint64(29)
    return ((low * _GOLD) >> np.uint64(48)).astype(np.uint16)


def _signed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in rows:
        n, dig, sig = [], [], []
        for t in b["text"]:
            s = shingle_set(t)
            n.append(len(s))
            dig.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        tidy()
        yield pd.DataFrame({"rid": b["_rid"], "doc_id": b["doc_id"], "n": n, "digest": dig, "sig": sig})


def _keyed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key for every chunk and every set of ERRORS positions left out of it."""
    from itertools import combinations

    width = POSITIONS // CHUNKS
    left_out = list(combinations(range(width), ERRORS))
    for b in rows:
        if not len(b):
            continue
        sig = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(len(b), POSITIONS).astype(np.uint64)
        for c in range(CHUNKS):
            for j, out in enumerate(left_out):
                key = np.full(len(b), np.uint64(c * len(left_out) + j))  # below 2^16
                for p in range(width):
                    if p not in out:
                        key = (key << np.uint64(16)) | sig[:, c * width + p]
                if width - len(out) > 3:  # does not fit 64 bits: mix
                    key = key * _GOLD
                yield pd.DataFrame({"key": key.view(np.int64), "cid": b["cid"].to_numpy()})
    tidy()


def _close(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose signatures differ in at most MAX_DISTANCE positions."""
    for p in rows:
        if len(p):
            a, b = (np.frombuffer(b"".join(p[c]), np.uint16).reshape(len(p), POSITIONS) for c in ("sig_a", "sig_b"))
            yield p.loc[(a != b).sum(axis=1) <= MAX_DISTANCE, ["a", "b"]]


def _sets(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in rows:
        yield pd.DataFrame({"cid": b["cid"], "s": [shingle_set(t).view(np.int64) for t in b["text"]]})
    tidy()


def _sets_of(wanted: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``wanted(cid)`` -> pinned (cid, s): the classes' shingle sets, from the texts."""
    return scratch.pin(docs.select(F.col("_rid").alias("cid"), "text").join(small(wanted), "cid", "left_semi").mapInPandas(_sets, "cid long, s array<long>"))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Of candidate pairs (a, b) of classes, those whose full sets are similar enough."""
    sig = classes.select("cid", "sig")
    near = (pairs.join(sig.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sig.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
            .mapInPandas(_close, "a long, b long"))
    near = scratch.pin(near)
    wanted = scratch.pin(near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct())
    sets = _sets_of(wanted, docs, scratch)
    both = (near.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - common
    out = scratch.pin(both.where(100 * common >= SIMILAR_PERCENT * union).select("a", "b"))
    for t in (near, wanted, sets):
        scratch.drop(t)
    return out


def _labelled(shared: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``shared(key, cid)`` of the buckets that still hold several components, with the component of each member."""
    merged = connected_components(links, scratch)
    member = (shared.join(merged.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("comp")))
    apart = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return scratch.pin(member.join(apart, "key"))


def _facing(tile: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of a tile's two pieces (twice the same for a piece with itself)."""
    a, b = tile["a"].iloc[0], tile["b"].iloc[0]
    p = tile["p"].to_numpy()
    return np.flatnonzero(p == a), np.flatnonzero(p == b)


def _near_in_tile(tile: pd.DataFrame) -> pd.DataFrame:
    """Members whose signature is near that of a member of another component."""
    sig = np.frombuffer(b"".join(tile["sig"]), np.uint16).reshape(len(tile), POSITIONS)
    comp = tile["comp"].to_numpy()
    left, right = _facing(tile)
    hit = np.zeros(len(tile), bool)
    for s in range(0, len(left), 64):
        part = left[s : s + 64]
        near = np.zeros((len(part), len(right)), np.int16)
        for k in range(POSITIONS):
            near += sig[part, k][:, None] != sig[right, k]
        i, j = np.nonzero((near <= MAX_DISTANCE) & (comp[part][:, None] != comp[right]))
        hit[part[i]] = hit[right[j]] = True
    if len(tile) > 256:
        tidy()
    return tile.loc[hit, ["key", "a", "b", "p", "cid", "comp"]]


def _linked_in_tile(tile: pd.DataFrame) -> pd.DataFrame:
    """Links between components of a tile, decided on full sets; one for each pair of components that it joins."""
    sets, comp, cid = list(tile["s"]), tile["comp"].to_numpy(), tile["cid"].to_numpy()
    n = np.array([len(s) for s in sets])
    left, right = _facing(tile)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = np.cumsum(counts > 1) - 1
    keep = counts[column] > 1
    row, column = row[keep], shared[column[keep]]
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1
        common += m[left] @ m[right].T
    common = common.astype(np.int64)
    i, j = np.nonzero((100 * common >= SIMILAR_PERCENT * (n[left][:, None] + n[right] - common)) & (comp[left][:, None] != comp[right]))
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for x, y in zip(left[i], right[j], strict=True):
        u, v = root(comp[x]), root(comp[y])
        if u != v:
            top[u] = v
            out.append((cid[x], cid[y]))
    if len(tile) > 256:
        tidy()
    return pd.DataFrame(out, columns=["a", "b"])


def _remaining(shared: DataFrame, links: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between members of one bucket that ``links`` leaves in different components."""
    member = _labelled(shared, links, scratch).join(classes.select("cid", "sig", "n"), "cid")
    sizes = member.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("which"), F.sum("n").alias("weight"))
    # buckets with the same members are compared once
    sizes = sizes.groupBy("members", "which").agg(F.min("key").alias("key"), F.first("weight").alias("weight"))
    pieces = F.ceil(F.greatest(F.col("members") / TILE_MEMBERS, F.col("weight") / TILE_SHINGLES))
    member = scratch.pin(member.join(sizes.select("key", pieces.alias("m")), "key"))
    p = F.pmod(F.xxhash64("cid", "key"), "m")
    tiles = member.withColumn("p", p).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).select(
        "key", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "p", "cid", "comp", "sig")
    near = scratch.pin(tiles.groupBy("key", "a", "b").applyInPandas(_near_in_tile, "key long, a long, b long, p long, cid long, comp long"))
    sets = _sets_of(near.select("cid").distinct(), docs, scratch)
    return near.join(sets, "cid").groupBy("key", "a", "b").applyInPandas(_linked_in_tile, "a long, b long")


def near_duplicates(documents: DataFrame, scratch: Scratch | None = None, row_id: str | None = None) -> DataFrame:
    """``documents(doc_id, text)`` -> one row per row: ``rid`` (``row_id`` if named, else a row number), ``doc_id``, ``n_shingles``,
    ``component_id``, ``kept`` (doc_id = component_id) and ``first`` (true for exactly one row of each component)."""
    scratch = scratch or Scratch(documents.sparkSession, "minhash")
    if row_id is None:
        documents, row_id = with_row_id(documents.select("doc_id", "text"), scratch), "_rid"
    docs = documents.select(F.col(row_id).alias("_rid"), "doc_id", "text")
    # ids travel as text: pandas has no nullable long without loss
    signed = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        _signed, "rid long, doc_id string, n long, digest binary, sig binary")
    signed = scratch.pin(signed.withColumn("doc_id", F.col("doc_id").cast("long")))
    classes = scratch.pin(signed.where("n > 0").groupBy("n", "digest").agg(
        F.min("rid").alias("cid"), F.min("doc_id").alias("low"), F.first("sig").alias("sig")))

    keyed = scratch.pin(classes.select("cid", "sig").mapInPandas(_keyed, "key long, cid long"))
    buckets = keyed.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub < last").select("key", "hub")
    shared = scratch.pin(keyed.join(buckets, "key"))
    scratch.drop(keyed)
    links = _confirmed(shared.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(),
                       classes, docs, scratch)
    member = _labelled(shared.select("key", "cid"), links, scratch)
    other = member.groupBy("key").agg(F.min_by(F.struct("cid", "comp"), F.xxhash64("cid", "key")).alias("o")).select(
        "key", F.col("o.cid").alias("hub"), F.col("o.comp").alias("hub_comp"))
    second = member.join(other, "key").where("comp <> hub_comp").select(F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b")).distinct()
    links = scratch.pin(links.unionByName(_confirmed(second, classes, docs, scratch)))
    links = links.unionByName(scratch.pin(_remaining(shared.select("key", "cid"), links, classes, docs, scratch)))
    merged = scratch.pin(connected_components(links, scratch))

    named = classes.join(merged.withColumnRenamed("id", "cid"), "cid", "left").select(
        "n", "digest", "cid", "low", F.coalesce("component", "cid").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"), F.min_by("cid", F.struct(F.col("low").isNull(), "low")).alias("first_cid"))
    labels = named.join(lowest, "comp").select("n", "digest", "component_id", "first_cid")
    # the row that stays: of the class with the smallest id, the first row with that id
    firsts = signed.where("n > 0").groupBy("n", "digest").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first_rid"),
                                                              F.min("rid").alias("cid"))
    labels = labels.join(firsts, ["n", "digest"])
    full = (signed.where("n > 0").join(labels, ["n", "digest"])
            .select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id",
                    ((F.col("cid") == F.col("first_cid")) & (F.col("rid") == F.col("first_rid"))).alias("first")))
    bare = signed.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                        F.lit(True).alias("first"))
    return full.unionByName(bare).select("rid", "doc_id", "n_shingles", "component_id",
                                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "first")


def deduplicate(documents: DataFrame) -> DataFrame:
    """``documents`` without the rows of a component other than its first; all columns stay as they are."""
    scratch = Scratch(documents.sparkSession, "dedup")
    rid = "_rid" + "_" * max(map(len, documents.columns))  # clashes with no column
    docs = with_row_id(documents, scratch, rid)
    found = near_duplicates(docs, scratch, rid)
    gone = scratch.pin(found.where(~F.col("first")).select(F.col("rid").alias(rid)))
    return docs.join(small(gone), rid, "left_anti").drop(rid)


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
d AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= {SHINGLE_WORDS} THEN list_transform(range(1, len(ws) - {SHINGLE_WORDS - 2}),
    lambda i: array_to_string(ws[i : i + {SHINGLE_WORDS - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM d),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {SIMILAR_PERCENT} * (a.n + b.n - count(*))),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
