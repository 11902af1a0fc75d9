"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every row has a 60-bit hash of its id. A source's budget is met by the rows below a hash threshold: words are summed by
(source, hash bucket), the bucket in which the running sum passes the budget is found, and only that bucket is cut into
finer buckets, until it holds one row. Nothing is sorted; a level handles at most 4096 sums a source, and rows are
filtered against one threshold a source. Thresholds are nested: raising a budget only adds rows.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150% of all words. A target stops
at twice its source's words and the excess is reshared by weight until none is above. A target of S words or more takes
every row once and the rest of the budget as second copies. The row on the boundary is taken if that brings the source
nearer to its target, so a source misses it by at most half of one row.

Edge cases: null and empty texts have size 0 and take 0; a null source is a source of its own; rows with equal ids are
told apart by a second hash of the row number once their common hash is all that is left in a bucket; an empty table
gives an empty result. Extra columns are ignored (``mix``: kept). Reruns give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstat.functions.ranks import global_row_number
from loomstat.llm.common import Scratch, small, with_row_id

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MOST_COPIES = 2
LEVEL_BITS = 12
HASH_LEVELS = 5  # 60 bits of the id's hash, then as many of the row's


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """The first 15 hexadecimal digits of the id's md5 as a number; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _row_hash(rid: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(rid), 4)


def _prefix(level: int, h: Column, g: Column) -> tuple[Column, Column]:
    """The leading bits of (h, g) that ``level`` levels have fixed."""
    bits = 60 - LEVEL_BITS * min(level, HASH_LEVELS)
    more = 60 - LEVEL_BITS * max(0, level - HASH_LEVELS)
    return F.shiftright(h, bits), F.shiftright(g, more)


def targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(source, size)`` -> pinned ``(source, source_size, target)``."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = global_row_number(per, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    per = scratch.pin(per.select("source", "source_size", weight.cast("long").alias("w")))
    most = MOST_COPIES * F.col("source_size")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * BUDGET_PERCENT / 100
    share, full = 0.0, -1
    while True:
        above = most < F.col("w") * F.lit(share) if full >= 0 else F.lit(False)
        spent, weights, n = per.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("w"))), F.count_if(above)).first()
        if n == full or not weights:
            break
        share, full = (total - (spent or 0)) / weights, n
    return per.select("source", "source_size", F.least(most.cast("double"), F.col("w") * F.lit(share)).alias("target"))


def thresholds(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows(source, size, h, g)`` -> one row a source with its base copies and the boundary of its last copy."""
    goal = targets(rows.select("source", "size"), scratch)
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_COPIES - 1))).otherwise(0)
    state = scratch.pin(goal.select(
        "source", "source_size", "target", base.cast("long").alias("base"),
        (F.col("target") - base * F.col("source_size")).alias("need"), F.lit(0).cast("long").alias("p1"),
        F.lit(0).cast("long").alias("p2"), F.lit(True).alias("open")))
    level = 0
    while level < 2 * HASH_LEVELS:
        now, nxt = _prefix(level, F.col("h"), F.col("g")), _prefix(level + 1, F.col("h"), F.col("g"))
        bound = small(state.where("open").select(F.col("source").alias("s"), "p1", "p2", "need"))
        inside = rows.join(bound, F.col("source").eqNullSafe(F.col("s")) & (now[0] == F.col("p1"))
                           & ((now[1] == F.col("p2")) if level > HASH_LEVELS else F.lit(True)))
        sums = inside.groupBy("s", "need", nxt[0].alias("n1"), (nxt[1] if level >= HASH_LEVELS else F.lit(0).cast("long")).alias("n2")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("s").orderBy("n1", "n2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("words").over(w))
        cut = run.where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("words") <= F.col("need"))).select(
            "s", "n1", "n2", (F.col("need") - (F.col("upto") - F.col("words"))).alias("left"), "n")
        new = scratch.pin(state.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "base", F.coalesce("left", "need").alias("need"),
            F.coalesce("n1", "p1").alias("p1"), F.coalesce("n2", "p2").alias("p2"), F.col("n1").isNotNull().alias("open"), "n"))
        most = new.agg(F.max("n")).first()[0]
        scratch.drop(state)
        state, level = new.drop("n"), level + 1
        state._scratch_path = new._scratch_path
        if (most or 0) <= 1:
            break
    return state, level


def _decided(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """``rows(source, size, h, g, ...)`` with source_size, target and ``copies``."""
    k1, k2 = _prefix(level, F.col("h"), F.col("g"))
    k2 = k2 if level > HASH_LEVELS else F.lit(0).cast("long")
    before = (k1 < F.col("p1")) | ((k1 == F.col("p1")) & (k2 < F.col("p2")))
    at = (k1 == F.col("p1")) & (k2 == F.col("p2"))
    extra = F.when(~F.col("open") | before, 1).when(at, (2 * F.col("need") > F.col("size")).cast("int")).otherwise(0)
    bound = small(state.withColumnRenamed("source", "s"))
    return rows.join(bound, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("base") + extra)


def _measured(documents: DataFrame) -> DataFrame:
    return documents.select("_rid", "doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"),
                            _row_hash(F.col("_rid")).alias("g"))


def mixture(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents(doc_id, text, source)``: doc_id, size, source_size, target, taken, copies."""
    scratch = Scratch(documents.sparkSession, "mixture")
    rows = scratch.pin(_measured(documents.select("doc_id", "text", "source").withColumn("_rid", F.monotonically_increasing_id())))
    state, level = thresholds(rows, scratch)
    return _decided(rows, state, level).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(documents: DataFrame) -> DataFrame:
    """The mixed corpus: every row of ``documents`` as often as it is taken (0, 1 or 2 times), with its columns.
    Rows without words are not taken. Texts are filtered in place, not shuffled."""
    scratch = Scratch(documents.sparkSession, "mix")
    top = "_" * (1 + max(map(len, documents.columns)))
    names = documents.columns
    docs = with_row_id(documents, scratch, top)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(top).alias("_rid"), "doc_id", "source", "text")
    state, level = thresholds(scratch.pin(_measured(whole)), scratch)
    keyed = whole.select("row", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"),
                         _row_hash(F.col("_rid")).alias("g"))
    out = _decided(keyed, state, level).where("copies > 0 AND size > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
-- sources by words per weight, as the full ones come first; share: words per unit of weight for those that are not full
c AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights
  FROM s WINDOW before AS (ORDER BY source_size / CAST(w AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE)) AS share FROM c
  WHERE CAST(rest AS DOUBLE) / CAST(weights AS DOUBLE) * w <= 2 * source_size),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * coalesce(share, 1e300)) AS target FROM s, l),
b AS (SELECT *, CASE WHEN source_size > 0 AND target >= source_size THEN 1 ELSE 0 END AS base FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS need,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (base + CASE WHEN before + size <= need THEN 1 WHEN before <= need AND 2 * (need - before) > size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
