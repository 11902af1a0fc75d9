"""A3/Q6 at scale: mergeable distinct sketches by day and column.

Exact distinct counts over sliding windows re-read and re-shuffle every distinct value of the window. A sketch (HyperLogLog,
``LG_K`` bits of registers) has a fixed size, is built in one partial aggregate, stored once per day and column, and merged:
any window's distinct count is a merge of its days' sketches, without the events.

The relative standard error of a merged sketch is at most 1.04 / sqrt(2**LG_K) (1.7 % at 12); ``BOUND`` is four of them.
Exact counts stay available (A3 in the models, Q6); ``rolling_audit`` puts both side by side.

NULL values are not counted, a day without a value of a column has an estimate of 0, days without events have no row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.sources.binding import Marketplace

LG_K = 12
BOUND = 4 * 1.04 / math.sqrt(1 << LG_K)


def _text(column: str) -> F.Column:
    """Sketches take whole numbers, text and binary; other types enter as text."""
    return F.col(f"`{column}`").cast("string")


def daily_sketches(events: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """(dia, column_name, n_rows, sketch) for every day and column, in one aggregate over the events."""
    per_day = events.groupBy(F.to_date(day).alias("dia")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.hll_sketch_agg(_text(c), LG_K).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return per_day.select("dia", "n_rows", F.explode(rows).alias("x")).select("dia", "x.column_name", "n_rows", "x.sketch")


def store(sketches: DataFrame, path: str) -> None:
    """Write sketches by day; days that are written again are replaced, others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dia").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("column_name string, n_rows long, sketch binary, dia date").parquet(path)


def _merged(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "column_name").agg(F.sum("n_rows").alias("n_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def rolling(sketches: DataFrame, days: int = 7) -> DataFrame:
    """(dia, column_name, n_rows, n_distinct): estimates over the ``days`` days that end with ``dia``, for days with events.
    Every sketch goes to the windows that hold its day; windows are merged by partial aggregation, no window sort."""
    known = sketches.select("dia").distinct()
    ends = sketches.withColumn("dia", F.explode(F.sequence("dia", F.date_add("dia", days - 1))))
    return _merged(ends.join(known, "dia", "left_semi"), "dia")


def by_month(sketches: DataFrame) -> DataFrame:
    """(mes, column_name, n_rows, n_distinct): estimates by month."""
    return _merged(sketches.withColumn("mes", F.trunc("dia", "month")), "mes")


def profile(df: DataFrame) -> DataFrame:
    """Q6's distinct counts as estimates: (column_name, null_count, n_distinct) from one aggregate, no value is shuffled."""
    names = df.columns
    wide = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(_text(c), LG_K)).alias(f"d{i}") for i, c in enumerate(names)],
                  *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"z{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"z{i}").alias("null_count"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(names)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def within(estimate: F.Column, exact: F.Column) -> F.Column:
    """Whether an estimate keeps the bound (small counts may be off by one)."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * BOUND)


def rolling_audit(m: Marketplace, days: int = 7) -> DataFrame:
    """Per day: exact distinct users of the last ``days`` days and whether the merged sketches keep their bound."""
    events = m.eventos_plataforma.select(F.to_date("created_at").alias("dia"), "usuario_id").where("usuario_id IS NOT NULL")
    estimates = rolling(daily_sketches(events, "dia", ["usuario_id"]), days).select("dia", "n_distinct")
    pairs = events.distinct()
    windows = pairs.withColumn("dia", F.explode(F.sequence("dia", F.date_add("dia", days - 1))))
    exact = windows.distinct().groupBy("dia").agg(F.count(F.lit(1)).alias("usuarios"))
    return estimates.join(exact, "dia").select("dia", "usuarios", within(F.col("n_distinct"), F.col("usuarios")).alias("dentro_do_limite"))


def profile_audit(m: Marketplace, tables: list[str]) -> DataFrame:
    """Per source table: number of columns, and how many estimates keep their bound against exact counts."""
    from loomstat.operators.quality import column_profile

    def one(t: str) -> DataFrame:
        exact = column_profile(m, t).select("column_name", F.col("n_distinct").alias("exact"))
        j = profile(getattr(m, t)).join(exact, "column_name")
        return j.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n_columns"), F.count_if(within(F.col("n_distinct"), F.col("exact"))).alias("n_within"))

    return reduce(lambda a, b: a.unionByName(b), [one(t) for t in tables])
