"""Keyed incremental upsert as a ``foreachBatch`` sink over hash buckets.

The snapshot of a table is a set of buckets; a key lives in the bucket of its hash. A manifest names, for every bucket, the
epoch whose files hold it. A micro-batch rewrites only the buckets that its keys fall into, and commits by writing the next
manifest, so a batch costs its own size and the touched buckets, never the table.

* Last writer wins by the time column; a later epoch wins equal times, and within a batch the larger row (column by column,
  as Spark orders structs) does, so the outcome depends on neither arrival order nor partitioning.
* An epoch that is run again after a failure finds its manifest and does nothing, or, without one, rewrites the same files
  from the same predecessor. Files of the last two manifests are kept (a retry needs its predecessor), others are removed.
* Readers list the newest manifest; a bucket whose files are gone is an error that names it.

Layout: ``<base>/data/epoch=<e>/bucket=<b>/part-*`` and ``<base>/manifest/<e>.json``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


@dataclass(frozen=True)
class Snapshot:
    """One manifest: the epoch, the number of buckets, the epoch that wrote each bucket, the buckets of this epoch, the schema."""

    epoch: int
    buckets: int
    written_by: dict[int, int]
    touched: list[int]
    schema: T.StructType

    def to_json(self) -> str:
        return json.dumps({"epoch": self.epoch, "buckets": self.buckets, "written_by": {str(b): e for b, e in sorted(self.written_by.items())},
                           "touched": self.touched, "schema": self.schema.jsonValue()})

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        d = json.loads(text)
        return cls(d["epoch"], d["buckets"], {int(b): e for b, e in d["written_by"].items()}, d["touched"], T.StructType.fromJson(d["schema"]))


class _Files:
    """The few file operations of the sink, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())
        self._spark = spark

    def at(self, name: str):  # noqa: ANN202
        return self._path(f"{self.base}/{name}")

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self.at(name)))

    def listed(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self.at(name))) if self.exists(name) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def read(self, name: str) -> str:
        return "\n".join(r[0] for r in self._spark.read.text(f"{self.base}/{name}").collect())  # one manifest

    def commit(self, name: str, text: str) -> None:
        """Write aside, then rename: a reader sees the whole file or none."""
        aside = self.at(f"{name}.tmp")
        out = self._fs.create(aside, True)
        out.write(text.encode())
        out.close()
        if not self._fs.rename(aside, self.at(name)):
            raise OSError(f"cannot commit {self.base}/{name}")


def _name(epoch: int) -> str:
    return f"manifest/{epoch:010d}.json"


def _folder(epoch: int, bucket: int | None = None) -> str:
    return f"data/epoch={epoch:010d}" + ("" if bucket is None else f"/bucket={bucket}")


def _bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, base: str, epoch: int | None = None) -> Snapshot | None:
    """The manifest of an epoch, or the newest one; None if there is none."""
    files = _Files(spark, base)
    if epoch is None:
        names = [n for n in files.listed("manifest") if n.endswith(".json")]
        return Snapshot.from_json(files.read(f"manifest/{names[-1]}")) if names else None
    return Snapshot.from_json(files.read(_name(epoch))) if files.exists(_name(epoch)) else None


def _read(spark: SparkSession, base: str, of: Snapshot, buckets: list[int]) -> DataFrame:
    """Rows of some buckets of a snapshot."""
    files = _Files(spark, base)
    paths = [(b, _folder(of.written_by[b], b)) for b in buckets if b in of.written_by]
    for b, p in paths:
        if not files.exists(p):
            raise FileNotFoundError(f"bucket {b} of {base} is gone ({p}, written by epoch {of.written_by[b]})")
    if not paths:
        return spark.createDataFrame([], of.schema)
    return spark.read.schema(of.schema).parquet(*[f"{files.base}/{p}" for _, p in paths])


def latest_snapshot(spark: SparkSession, base: str) -> DataFrame:
    """The table as of the newest manifest."""
    newest = manifest(spark, base)
    if newest is None:
        raise FileNotFoundError(f"no snapshot in {base}")
    return _read(spark, base, newest, sorted(newest.written_by))


def _winners(rows: DataFrame, columns: list[str], keys: list[str], by: Column) -> DataFrame:
    """One whole row of each key: the one with the largest ``by``."""
    return rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*columns), by).alias("_row")).select("_row.*", "bucket")


def upsert_snapshot(base: str, keys: list[str], ts_col: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """The sink: ``write(batch, epoch)``. Epochs follow each other from 0; all batches have the columns of the first."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        if manifest(spark, base, epoch_id) is not None:  # committed before a failure
            return
        before = manifest(spark, base, epoch_id - 1) if epoch_id else None
        if epoch_id and before is None:
            raise FileNotFoundError(f"manifest {epoch_id - 1} in {base} is gone: epoch {epoch_id} has nothing to merge into")
        schema = before.schema if before else batch.schema
        columns, count = schema.names, before.buckets if before else buckets
        placed = batch.select(*columns).withColumn("bucket", _bucket_of(keys, count))
        tie = F.struct(F.col(ts_col), F.struct(*columns))
        latest = _winners(placed, columns, keys, tie).checkpoint()  # read twice; a stream's batch may not come back the same
        touched = sorted(r[0] for r in latest.select("bucket").distinct().collect())  # at most one row a bucket
        if touched:
            merged = latest.withColumn("_epoch", F.lit(1))
            if before:
                old = _read(spark, base, before, touched)
                merged = merged.unionByName(old.select("*", _bucket_of(keys, count).alias("bucket"), F.lit(0).alias("_epoch")))
            # one shuffle: rows of a bucket meet in one task, which merges and writes it
            dealt = merged.repartition(len(touched), "bucket")
            newest = _winners(dealt, columns, keys, F.struct(F.col(ts_col), F.col("_epoch")))
            newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{base.rstrip('/')}/{_folder(epoch_id)}")
        made = Snapshot(epoch_id, count, {**(before.written_by if before else {}), **{b: epoch_id for b in touched}}, touched, schema)
        files = _Files(spark, base)
        files.commit(_name(epoch_id), made.to_json())
        _clean(files, made, before)

    return write


def _clean(files: _Files, made: Snapshot, before: Snapshot | None) -> None:
    """Remove what neither the newest manifest nor its predecessor names."""
    kept = {(e, b) for m in (made, before) if m for b, e in m.written_by.items()}
    epochs = {e for e, _ in kept} | {made.epoch}
    for name in files.listed("data"):
        epoch = int(name.split("=")[1])
        if epoch not in epochs:
            files.remove(f"data/{name}")
            continue
        for part in files.listed(f"data/{name}"):
            if part.startswith("bucket=") and (epoch, int(part.split("=")[1])) not in kept:
                files.remove(f"data/{name}/{part}")
    for name in files.listed("manifest"):
        if name.endswith(".json") and int(name.split(".")[0]) < made.epoch - 1:
            files.remove(f"manifest/{name}")
