"""Typed scans, timestamp normalisation, output typing and publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Explicit schemas of the relational input tables; never inferred. Timestamps are
# stored without zone and are read as such, then converted at scan (see ``scan``).
SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I), ("c_acctbal", _D),
                        ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S), ("p_size", _I),
                    ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S), ("o_totalprice", _D),
                      ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L), ("l_linenumber", _I),
                        ("l_quantity", _D), ("l_extendedprice", _D), ("l_discount", _D), ("l_tax", _D),
                        ("l_returnflag", _S), ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S), ("value", _D),
                      ("props", _S)),
    "conversations": _schema(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
}

TABLES = tuple(SCHEMAS)


#: How tables and models are written: sorted keys and identifiers that share a beginning take little room.
STORED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of an input table, from the file system that Spark reads it with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getLen() for f in fs.listStatus(p)) if fs.exists(p) else 0


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Typed Parquet scan. Column pruning and filter pushdown reach the file reader
    because every later step is declarative; zone-less timestamps become session
    timestamps (UTC) so that interval arithmetic, ``unix_micros`` and watermarks work."""
    df = spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))
    cols = [F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def finalize(df: DataFrame) -> DataFrame:
    """Publishable column types, identical to what the SQL oracle emits:
    integers widen to bigint, decimals (exact up to here) become double,
    session timestamps are emitted zone-less (UTC wall clock)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def between_months(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Closed date-range read on a month column; either bound may be open."""
    c = F.col(column)
    if start is not None:
        df = df.where(c >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.where(c <= F.to_timestamp(F.lit(end)))
    return df


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a mart as Parquet, optionally partitioned (e.g. by month) so that
    report reads prune partitions instead of recomputing the model chain."""
    w = df.write.mode(mode).options(**STORED)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
