"""Helpers shared by the operators: table access, scratch tables in the shared folder, row identity, bounded broadcasts.

``words`` everywhere means ``[^\\x20\\x09-\\x0D]+``: ASCII white space separates, A-Z is lower-cased where a contract
says so. ``bytes.split``/``bytes.lower`` have exactly these semantics on UTF-8.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.session import ensure_checkpoint_dir

#: Largest number of rows that a hinted broadcast may have; the caller counts before it hints.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch that a Python worker gets at once; texts are long.
BATCH_ROWS = 4000
#: Bytes of such a batch, for operators whose rows are large.
BATCH_BYTES = 32 << 20
_OPEN: list[Scratch] = []


def bounded_batches(spark: SparkSession) -> None:
    """Hold the rows of an Arrow batch to BATCH_ROWS, so that a worker's memory is bounded by a few texts' sizes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def bounded_bytes(spark: SparkSession) -> None:
    """Hold an Arrow batch to BATCH_BYTES, for rows that are large each."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy() -> None:
    """Give memory that a Python worker has freed back to the system; workers live on for later tasks."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


class Scratch:
    """Parquet tables under the session's shared checkpoint folder; dropped when superseded or when Python exits."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        bounded_batches(spark)
        _OPEN.append(self)

    def pin(self, df: DataFrame) -> DataFrame:
        """Write and reread: cuts lineage at a table that every executor can read again."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a pinned table that nothing will read again."""
        self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)


def _close_all() -> None:
    for s in _OPEN:
        try:
            s.close()
        except Exception:  # the session is already gone; the folder's owner cleans up
            pass


atexit.register(_close_all)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, equals ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is (AQE then picks the join).
    ``df`` should be cheap to count, such as a pinned narrow table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _only_scans(df: DataFrame) -> bool:
    """Whether the frame is columns and filters over one file scan."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def with_row_id(df: DataFrame, scratch: Scratch, name: str = "_rid") -> DataFrame:
    """``df`` with a long that is unique per row and stays the same when the frame is evaluated again. A frame that
    only scans files is numbered as it is (its splits are planned from sorted files); any other is pinned first."""
    base = df if _only_scans(df) else scratch.pin(df)
    return base.withColumn(name, F.monotonically_increasing_id())


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
