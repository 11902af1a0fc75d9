"""Merkle manifest of a data set, kept as a postorder append log.

Each row is a leaf (``row_digest``: every field with its length). The leaves of a tree (here: of a language) ascend by id;
every FAN consecutive nodes of a level, the last run with fewer, become their parent until one node, the subroot, remains.
Subroots, in the order of their keys, are the leaves of one more tree, whose last node is the root.

* Aligned builders. Leaves are numbered by a distributed sort and dealt to builders by aligned blocks of BLOCK = FAN**3
  leaves, so no builder holds more than BLOCK rows whatever a key's share. A builder appends nodes in completion order: a
  leaf, then every ancestor that this leaf completes. Its log is written as one segment (digests back to back). Blocks'
  top nodes are the leaves of the next round, which is BLOCK times smaller.
* Positions. In completion order the last leaf below a node is leaf ``last = min((index + 1) * FAN**level, n) - 1``, and
  ``last + sum(last // FAN**t, t >= 1)`` nodes are complete before it, so the node stands at that number plus ``level``.
  ``position`` computes it from subtree sizes alone; proofs read siblings at these places of the log, no tree is walked.
* Proofs go from the top round to the leaves: a segment gets the path above its top node from the segment above it
  (one row to one row, no hot key), each of its leaves the siblings inside the segment and that path.

A path is binary: subroot, root, then for each level the own slot in the run, the number of siblings and their digests.

Edge cases: null fields count as ``-``; null keys are a tree of their own, first; null ids come first; repeated rows are
leaves of their own beside each other (their order does not matter, their digests are the same; equal ids with different
fields are ordered by digest); a lone leaf is its tree's subroot; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm.common import Scratch, bounded_bytes, small, tidy

FAN_BITS, ROUND = 3, 3
FAN = 1 << FAN_BITS
BLOCK = FAN**ROUND
WIDTH = 32  # bytes of a digest
ROWS_PER_TASK = 500_000
MOST_LEVELS = 21  # FAN**21 rows exceed a long

_SEGMENT = "tree long, n long, block long, ids array<string>, changed array<binary>, nodes binary, top binary"


def position(level: int, index: int, n: int) -> int:
    """Place of a node in the completion order of a tree (or aligned block) with n leaves."""
    last = min((index + 1) << FAN_BITS * level, n) - 1
    place, rest = last + level, last >> FAN_BITS
    while rest:
        place, rest = place + rest, rest >> FAN_BITS
    return place


def height(n: int) -> int:
    """Levels above the leaves."""
    return next(h for h in range(MOST_LEVELS + 1) if FAN**h >= n)


def joined(digests: list[bytes]) -> bytes:
    """Digest of digests, which enter as hexadecimal text."""
    return sha256(b"".join(digests).hex().encode()).digest()


def append_all(leaves: list[bytes], levels: int) -> list[bytes]:
    """Log of one aligned block: every leaf, followed by the nodes up to ``levels`` that it completes."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        node = joined(runs[level])
        runs[level] = []
        log.append(node)
        runs[level + 1].append(node)

    for leaf in leaves:
        log.append(leaf)
        runs[0].append(leaf)
        level = 0
        while level < levels and len(runs[level]) == FAN:
            close(level)
            level += 1
    for level in range(levels):  # the end of the tree completes what is open
        if runs[level]:
            close(level)
    return log


def row_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) over the fields: ``-`` for null, else UTF-8 byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def _numbered(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with ``at``: 0-based place in the total order, by range partitions written once and their offsets."""
    parts = max(1, -(-rows.count() // ROWS_PER_TASK))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    pinned = scratch.pin(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return pinned.join(small(offsets), "_part").withColumn("at", F.col("_off") + F.col("_at")).drop("_part", "_at", "_off")


def _builder(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Builder of one aligned block whose leaves are nodes of ``level`` of their tree."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n = int(rows["n"].iat[0])
        log = append_all(list(rows["digest"]), min(ROUND, height(n) - level))
        return pd.DataFrame({"tree": rows["tree"].iloc[:1].to_numpy(), "n": [n], "block": rows["block"].iloc[:1].to_numpy(),
                             "ids": [list(rows["id"])], "changed": [list(rows["changed"])], "nodes": [b"".join(log)], "top": [log[-1]]})

    return build


def _rounds(leaves: DataFrame, most: int, scratch: Scratch) -> list[DataFrame]:
    """Segments of all rounds, from leaves (tree, n, at, id, digest, changed); ``most`` is the largest n."""
    out, level = [], 0
    while True:
        dealt = leaves.withColumn("block", F.shiftright("at", FAN_BITS * ROUND))
        out.append(scratch.pin(dealt.groupBy("tree", "block").applyInPandas(_builder(level), _SEGMENT)))
        level += ROUND
        if FAN**level >= most:
            return out
        nothing = [F.lit(None).cast("string").alias("id"), F.lit(None).cast("binary").alias("changed")]
        leaves = out[-1].where(F.col("n") > FAN**level).select("tree", "n", F.col("block").alias("at"), F.col("top").alias("digest"), *nothing)


def _last_round(r: int) -> Column:
    """Whether a tree ends in round r."""
    n = F.col("n")
    return (n <= FAN ** (ROUND * (r + 1))) & (n > FAN ** (ROUND * r) if r else F.lit(True))


def _own_levels(nodes: bytes, leaves: int) -> list[list[list[bytes]]]:
    """Runs of every level of a segment below its top, read from the log at their computed positions."""
    out, count, level = [], leaves, 0
    while count > 1 or (len(nodes) // WIDTH > position(level, count - 1, leaves) + 1):
        at = [position(level, i, leaves) * WIDTH for i in range(count)]
        level_nodes = [nodes[a : a + WIDTH] for a in at]
        out.append([level_nodes[i : i + FAN] for i in range(0, count, FAN)])
        count, level = -(-count // FAN), level + 1
    return out


def _part(run: list[bytes], slot: int) -> bytes:
    return bytes((slot, len(run) - 1)) + b"".join(run[:slot] + run[slot + 1 :])


def _paths(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Path of every leaf of the segments of an upper round."""
    for batch in rows:
        for tree, block, n, nodes, path in zip(batch["tree"], batch["block"], batch["leaves"], batch["nodes"], batch["path"], strict=True):
            levels = _own_levels(nodes, n)
            own = [b"".join(_part(runs[i >> FAN_BITS * (k + 1)], i >> FAN_BITS * k & FAN - 1) for k, runs in enumerate(levels)) for i in range(n)]
            yield pd.DataFrame({"tree": tree, "block": range(block * BLOCK, block * BLOCK + n), "path": [path[: 2 * WIDTH] + o + path[2 * WIDTH :] for o in own]})
    tidy()


def parts(path: bytes) -> list[tuple[int, list[bytes]]]:
    """Levels of a path: own slot and siblings."""
    out, a = [], 2 * WIDTH
    while a < len(path):
        slot, k = path[a], path[a + 1]
        out.append((slot, [path[a + 2 + WIDTH * i : a + 2 + WIDTH * (i + 1)] for i in range(k)]))
        a += 2 + WIDTH * k
    return out


def fold(digest: bytes, levels: list[tuple[int, list[bytes]]]) -> bytes:
    """Root that a leaf and its siblings give."""
    for slot, others in levels:
        digest = joined([*others[:slot], digest, *others[slot:]])
    return digest


def _proved(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaf, roots, proof and folded root of every leaf of the segments of round 0."""
    for batch in rows:
        for block, ids, changed, nodes, path in zip(batch["block"], batch["ids"], batch["changed"], batch["nodes"], batch["path"], strict=True):
            n = len(ids)
            levels, above = _own_levels(nodes, n), parts(path)
            above_hex = b"".join(b"".join(others) for _, others in above).hex()
            leaves, proofs, folded = [], [], []
            for i in range(n):
                own = []
                for k, runs in enumerate(levels):
                    run, slot = runs[i >> FAN_BITS * (k + 1)], i >> FAN_BITS * k & FAN - 1
                    own.append((slot, run[:slot] + run[slot + 1 :]))
                a = position(0, i, n) * WIDTH
                leaf = nodes[a : a + WIDTH]
                leaves.append(leaf.hex())
                proofs.append(sha256((b"".join(b"".join(o) for _, o in own).hex() + above_hex).encode()).hexdigest())
                folded.append(fold(leaf if changed[i] is None else bytes(changed[i]), own + above).hex())
            first = block * BLOCK
            yield pd.DataFrame({"id": list(ids), "leaf": leaves, "subroot": path[:WIDTH].hex(), "root": path[WIDTH : 2 * WIDTH].hex(),
                                "proof_sha256": proofs, "folded_root": folded, "log_position": [position(0, first + i, 1 << 62) for i in range(n)]})
    tidy()


@dataclass
class Manifest:
    """Trees (key, tree, n, subroot), segments of all rounds, and the root's hexadecimal digest (None without rows)."""

    trees: DataFrame
    rounds: list[DataFrame]
    top: list[DataFrame]
    kind: str
    root: str | None
    size_of_top: int = 0

    def nodes(self) -> DataFrame:
        """The append log of every tree: tree, position, level, index, digest (binary); positions run from 0 without gaps."""
        out = None
        for r, seg in enumerate(self.rounds):
            rows = seg.select("tree", "n", "block", F.size("ids").alias("leaves"), "nodes").mapInPandas(
                lambda it, r=r: _listed(it, r), "tree long, position long, level long, index long, digest binary")
            out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self) -> DataFrame:
        """Per leaf: id, leaf, subroot, root, proof_sha256, folded_root, log_position."""
        head = self._above(self.top, self.trees.sparkSession.createDataFrame([(0, bytes(2 * WIDTH))], "tree long, path binary")
                           .withColumn("n", F.lit(self.size_of_top).cast("long")))
        above = (head.select("tree", "block", "leaves", "nodes", "path").mapInPandas(_paths, "tree long, block long, path binary")
                 .select(F.col("block").alias("tree"), F.expr(f"substring(path, {2 * WIDTH + 1})").alias("rest")))
        paths = self.trees.join(above, "tree").select("tree", "n", F.concat("subroot", F.unhex(F.lit(self.root)), "rest").alias("path"))
        seg = self._above(self.rounds, paths)
        schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, log_position long"
        return seg.select("block", "ids", "changed", "nodes", "path").mapInPandas(_proved, schema).withColumn("id", F.col("id").cast(self.kind))

    @staticmethod
    def _above(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
        """Segments of round 0 with the path above each; ``paths`` (tree, n, path) are those above the trees."""
        below = None
        for r in range(len(rounds) - 1, -1, -1):
            ends = paths.where(_last_round(r)).select("tree", F.lit(0).cast("long").alias("block"), "path")
            path = ends if below is None else ends.unionByName(below)
            seg = rounds[r].join(path, ["tree", "block"]).withColumn("leaves", F.size("ids"))
            below = seg.select("tree", "block", "leaves", "nodes", "path").mapInPandas(_paths, "tree long, block long, path binary") if r else seg
        return below


def _listed(rows: Iterator[pd.DataFrame], r: int) -> Iterator[pd.DataFrame]:
    """Nodes of a round's segments with their places in the whole tree's log; leaves of upper rounds are listed below them."""
    for batch in rows:
        for tree, n, block, leaves, nodes in zip(batch["tree"], batch["n"], batch["block"], batch["leaves"], batch["nodes"], strict=True):
            got, count, k = [], leaves, 0
            while k <= min(ROUND, height(n) - ROUND * r):
                first, level = block << FAN_BITS * (ROUND - k), ROUND * r + k
                got += [(position(level, first + i, n), level, first + i, nodes[(a := position(k, i, leaves) * WIDTH) : a + WIDTH])
                        for i in range(count) if k or not r]
                count, k = -(-count // FAN), k + 1
            if got:
                yield pd.DataFrame(got, columns=["position", "level", "index", "digest"]).assign(tree=tree)[["tree", "position", "level", "index", "digest"]]


def manifest(rows: DataFrame, scratch: Scratch | None = None) -> Manifest:
    """Manifest of ``rows`` (key, id, digest, changed): ``digest`` is the leaf, ``changed`` the leaf that a proof is checked
    with where it is not null."""
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "merkle")
    bounded_bytes(spark)
    kind = rows.schema["id"].dataType.simpleString()
    given = scratch.pin(rows.select("key", "id", "digest", "changed"))
    # rows that are the same in all of these are spread over tasks; their order does not matter
    ordered = _numbered(given.withColumn("_tie", F.monotonically_increasing_id()), [F.col(c) for c in ("key", "id", "digest", "_tie")], scratch)
    sizes = scratch.pin(ordered.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")))
    keys = scratch.pin(_numbered(sizes, [F.col("key")], scratch).withColumnRenamed("at", "tree"))
    most, trees = keys.agg(F.max("n"), F.count(F.lit(1))).first()
    if not trees:
        return Manifest(keys.withColumn("subroot", F.lit(None).cast("binary")), [], [], kind, None)
    leaves = (ordered.join(small(keys), ordered["key"].eqNullSafe(keys["key"]))
              .select("tree", "n", (F.col("at") - F.col("first")).alias("at"), F.col("id").cast("string").alias("id"), "digest", "changed"))
    rounds = _rounds(leaves, most, scratch)
    ends = None
    for r, seg in enumerate(rounds):
        end = seg.where(_last_round(r)).select("tree", F.col("top").alias("subroot"))
        ends = end if ends is None else ends.unionByName(end)
    known = scratch.pin(keys.join(ends, "tree"))
    over = known.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("at"), F.col("tree").cast("string").alias("id"),
                        F.col("subroot").alias("digest"), F.lit(None).cast("binary").alias("changed"))
    top = _rounds(over, trees, scratch)
    root = top[-1].select(F.lower(F.hex("top"))).first()[0]  # one row
    return Manifest(known, rounds, top, kind, root, size_of_top=trees)


def document_leaves(documents: DataFrame) -> DataFrame:
    """Rows for ``manifest`` from documents: trees by lang. Where 3 divides the crc32 of the decimal id, the proof is checked
    with a text whose A-Z are lower-cased."""
    capitals = "".join(map(chr, range(65, 91)))
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.when(tampered & F.col("text").isNotNull(), row_digest([*fields, F.translate("text", capitals, capitals.lower())]))
    return documents.select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), row_digest([*fields, F.col("text")]).alias("digest"), lowered.alias("changed"))


def verified(documents: DataFrame) -> DataFrame:
    """Per document: its leaf, the roots, its proof's hash and whether the (partly tampered) documents verify."""
    spark = documents.sparkSession
    made = manifest(document_leaves(documents))
    if made.root is None:
        return spark.createDataFrame([], f"doc_id {made.kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return made.proofs().select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda acc, b: " \
    "list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"
_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
#: Runs of FAN nodes by one recursive query over both kinds of trees; positions and proofs by joins on the runs.
ORACLE = f"""
WITH RECURSIVE coded AS (
  SELECT *, xor({_CRC}, 4294967295) % 3 = 0 AS hit FROM documents
), leaf0 AS (
  SELECT doc_id, lang, sha256({_FIELDS} || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256({_FIELDS} || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS checked
  FROM coded
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    row_number() OVER () AS one FROM leaf0
), tree AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY tree, level, pos // 8, n
), subroots AS (SELECT tree, digest AS subroot, level AS height FROM tree WHERE n = 1 AND pos = 0),
top AS (
  SELECT 0 AS level, tree AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8, n
), root AS (SELECT digest AS root, level AS height FROM top WHERE n = 1),
runs AS (
  SELECT tree, level, pos // 8 AS run, list(digest ORDER BY pos) AS members FROM tree WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT s.tree, s.height + t.level, t.run, t.members
  FROM subroots s, (SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS members FROM top WHERE n > 1 GROUP BY ALL) t
  WHERE t.run = s.tree // CAST(8 ** (t.level + 1) AS BIGINT)
), climb AS (
  SELECT one, l.tree, 0 AS level, l.pos, l.checked AS digest, '' AS proof, s.height, s.height + r.height AS ends
  FROM leaves l JOIN subroots s USING (tree), root r
  UNION ALL
  SELECT c.one, c.tree, c.level + 1, CASE WHEN c.level + 1 = c.height THEN c.tree ELSE c.here // 8 END,
    sha256(list_aggregate(list_concat(list_concat(members[1 : c.here % 8], [c.digest]), members[c.here % 8 + 2 :]), 'string_agg', '')),
    c.proof || coalesce(list_aggregate(list_concat(members[1 : c.here % 8], members[c.here % 8 + 2 :]), 'string_agg', ''), ''), c.height, c.ends
  FROM (SELECT *, CASE WHEN level = 0 AND height = 0 THEN tree ELSE pos END AS here FROM climb WHERE level < ends) c
  JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.here // 8
)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root, c.digest = r.root AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN climb c ON c.one = l.one AND c.level = c.ends, root r
"""
