"""Global ranks and exact quantiles without a single-partition window.

``ntile``/``percent_rank`` with no PARTITION BY make Spark move every row into one
task (``Exchange SinglePartition``). The helpers here keep the work distributed:

* ``percent_rank_by_value`` – for a bounded value domain (e.g. a score with two
  decimals): count rows per distinct value, rank the (small) table of counts,
  join it back (AQE broadcasts it if its size allows).
* ``global_row_number`` / ``ntile`` – exact global row numbers: range-partition on
  the sort key, materialise with a reliable checkpoint (so a re-run sample cannot
  move rows), number rows inside each partition, add per-partition offsets. The
  offset table has one row per partition (bounded), so it is broadcast.
* ``exact_quantiles`` – continuous percentiles (linear interpolation, as
  ``percentile_cont`` / pandas) from a per-group histogram of a discrete value:
  partial aggregation handles hot groups; only the histogram (distinct values per
  group) is windowed.
* ``order_statistics`` / ``quantile_values`` – exact quantiles of a continuous column by
  histograms that are refined around the wanted places: aggregates only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.session import ensure_checkpoint_dir


#: Rows of a range partition: at most so many (memory of a task); with fewer than LEAST_ROWS each, fewer tasks do.
ROWS_PER_TASK = 2_000_000
LEAST_ROWS = 20_000


def percent_rank_by_value(df: DataFrame, value: str, out: str = "percent_rank") -> DataFrame:
    """PERCENT_RANK() OVER (ORDER BY value) for a value with a bounded number of distinct values.
    (rank - 1) / (n - 1) where rank = 1 + rows with a smaller value; 0 when n = 1."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select(
        value,
        F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_below"),
        F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_n"),
    ).select(value, F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias(out))
    return df.join(ranked, on=value, how="left")


def global_row_number(df: DataFrame, order: list[Column], out: str = "row_number",
                      partitions: int | None = None) -> DataFrame:
    """Exact ROW_NUMBER() OVER (ORDER BY order...) with the work spread over ``partitions`` tasks.
    ``order`` must be a total order (append a unique key)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    base = df.checkpoint(eager=True)  # read three times below: to count, to sample the ranges, to deal
    rows = base.count()
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = partitions or max(-(-rows // ROWS_PER_TASK), min(setting, -(-rows // LEAST_ROWS)), 1)
    ranged = base.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    pinned = ranged.checkpoint(eager=True)
    tagged = pinned.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    per_part = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_first"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", "_first", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_offset"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_offset") + (F.col("_mono") - F.col("_first")) + 1)
            .drop("_pid", "_mono", "_first", "_offset"))


def ntile(df: DataFrame, k: int, order: list[Column], out: str = "ntile") -> DataFrame:
    """Exact NTILE(k) OVER (ORDER BY order...) as a distributed job (see module doc)."""
    numbered = global_row_number(df, order, "_i")
    n = numbered.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    with_n = numbered.withColumn("_n", n)
    q = F.floor(F.col("_n") / F.lit(k))
    r = F.col("_n") - q * F.lit(k)
    i = F.col("_i")
    big = r * (q + 1)
    bucket = F.when(i <= big, F.ceil(i / (q + 1))).otherwise(r + F.ceil((i - big) / F.nullif(q, F.lit(0))))
    return with_n.withColumn(out, bucket.cast("int")).drop("_i", "_n")


def exact_quantiles(df: DataFrame, group_cols: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """percentile_cont(q) per group for a discrete-valued column, from its histogram.
    Returns one row per group having at least one non-NULL value."""
    v = F.col(value)
    hist = df.where(v.isNotNull()).groupBy(*group_cols, value).agg(F.count(F.lit(1)).alias("_c"))
    part = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(1))
    hist = hist.select(*group_cols, value, "_c",
                       F.sum("_c").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
                       F.sum("_c").over(part).alias("_n"))
    aggs = []
    for name, q in qs.items():
        h = (F.col("_n") - 1) * F.lit(q)
        lo, hi = F.floor(h), F.ceil(h)
        v_lo = F.min(F.when(F.col("_cum") > lo, v))
        v_hi = F.min(F.when(F.col("_cum") > hi, v))
        frac = F.first(h - lo)
        aggs.append((v_lo.cast("double") + (v_hi.cast("double") - v_lo.cast("double")) * frac).alias(name))
    return hist.groupBy(*group_cols).agg(*aggs)


#: Buckets of a refinement pass, for each interval that still holds a wanted place.
REFINE_BUCKETS = 512


def order_statistics(df: DataFrame, value: str, places: Callable[[int], list[int]]) -> tuple[int, dict]:
    """The number n of non-NULL values and the values at the 1-based ``places(n)`` of their ascending order: exact, without a
    sort or a range shuffle.

    Every pass counts the values of each interval that holds a wanted place in ``REFINE_BUCKETS`` buckets of equal width, with
    the least and largest value of each; the bucket that holds the place is the next interval, bounded by values that occur.
    An interval of a single value ends its search. A pass is one aggregate (partial in every task) and brings at most
    ``REFINE_BUCKETS`` rows an interval to the driver; widths shrink by that factor, so money takes three or four passes."""
    v = F.col(value)
    vals = df.select(value).where(v.isNotNull()).persist()  # read once a pass; recomputed where an executor is lost
    try:
        n, low, high = vals.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
        wanted = sorted({p for p in places(n) if 1 <= p <= n})
        todo, found = ([(low, high, 0, wanted)] if wanted else []), {}
        while todo:
            found.update({p: lo for lo, hi, _, ps in todo if lo == hi for p in ps})
            todo = [t for t in todo if t[0] != t[1]]
            if not todo:
                break
            number, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
            for i, (lo, hi, _, _) in enumerate(todo):
                inside = v.between(F.lit(lo), F.lit(hi))
                # halves, as the difference of two large values may overflow; next to equal ones keep to whole values
                wide = float(hi) / 2 - float(lo) / 2
                at = F.floor((v.cast("double") / 2 - float(lo) / 2) / wide * REFINE_BUCKETS).cast("long") if wide else F.when(v == F.lit(lo), 0).otherwise(1)
                number, bucket = F.when(inside, i).otherwise(number), F.when(inside, F.least(at, F.lit(REFINE_BUCKETS - 1))).otherwise(bucket)
            rows = vals.select(number.alias("i"), bucket.alias("b"), v.alias("v")).where("i IS NOT NULL")
            counted: dict[int, list] = {}
            for r in rows.groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                counted.setdefault(r["i"], []).append((r["b"], r["n"], r["lo"], r["hi"]))
            following = []
            for i, (_, _, below, ps) in enumerate(todo):
                for _, count, lo, hi in sorted(counted[i]):
                    held = [p for p in ps if below < p <= below + count]
                    if held:
                        following.append((lo, hi, below, held))
                    below += count
            todo = following
        return n, found
    finally:
        vals.unpersist()


def quantile_values(df: DataFrame, value: str, qs: list[float]) -> list[float] | None:
    """percentile_cont of a whole (continuous-valued) column at ``qs``; None without values. Only the values at the places
    around (n - 1)·q reach the driver."""
    n, at = order_statistics(df, value, lambda n: [f((n - 1) * q) + 1 for q in qs for f in (math.floor, math.ceil)] if n else [])
    if not n:
        return None

    def one(q: float) -> float:
        h = (n - 1) * q
        low, high = float(at[math.floor(h) + 1]), float(at[math.ceil(h) + 1])
        return low + (high - low) * (h - math.floor(h))

    return [one(q) for q in qs]


def global_quantiles(df: DataFrame, value: str, qs: dict[str, float]) -> DataFrame:
    """``quantile_values`` as a one-row DataFrame; NULL without values."""
    got = quantile_values(df, value, list(qs.values()))
    return df.sparkSession.createDataFrame([tuple(got or [None] * len(qs))], ", ".join(f"{name} double" for name in qs))


def grouped_row_number(df: DataFrame, group_cols: list[str], order: list[Column], out: str = "row_number") -> DataFrame:
    """Exact ROW_NUMBER() OVER (PARTITION BY group ORDER BY order...) without putting a group
    in one task: a global row number over (group, order), minus the first number of the
    group (an aggregate and a key join; AQE splits a hot group on the large side).
    NULL group keys are numbered as their own group, as in a window."""
    numbered = global_row_number(df, [F.col(g) for g in group_cols] + order, "_grn")
    firsts = numbered.groupBy(*[F.col(g).alias(f"_gk{i}") for i, g in enumerate(group_cols)]).agg(F.min("_grn").alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_gk{i}")) for i, g in enumerate(group_cols)]
    return (numbered.join(firsts, same).withColumn(out, F.col("_grn") - F.col("_first") + 1)
            .drop("_grn", "_first", *[f"_gk{i}" for i in range(len(group_cols))]))
