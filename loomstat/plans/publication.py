"""Incremental publication of the models under a manifest.

The manifest names, for every model, the digests of what it was built from and, for every partition (a month, or the whole
table), its digest, its rows and the run that wrote it. A run

1. returns at once if the input stamp (files, sizes, times, clock) is the one of the manifest;
2. digests the source tables that are read (row count and an order-free sum of row hashes);
3. goes through the models, parents before children. A model whose inputs have the recorded digests is not built; another
   one is built, digested by partition, and only partitions that differ are written (a model that is not published yet is
   written first and digested from its files, so that it is computed once);
4. commits by renaming the new manifest into place. Readers of the old one are not disturbed, a run that fails leaves it.

Three things bound the disk that a run takes beside what it publishes. Shuffle files go when the query that wrote them ends, not
when the driver happens to collect its garbage. The models that shuffle most come as soon as their parents are there, while little
else is written. And a staging model of a source table that lies in the buckets of the order key is published by month or whole,
but the models after it project that source table again and so meet by order without a shuffle.

A changed month therefore writes one partition of every dependent whose months are independent (cumulative marts also
rewrite the months after it), and a second run over the same input writes nothing.

Layout: ``<out>/data/<model>/<run>/_part=<key>/part-*`` and ``<out>/manifest/<number>.json``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.plans.pipeline import BY_NAME, Model, build_order
from loomstat.sources.binding import Marketplace
from loomstat.sources.io import STORED

WHOLE = "all"
NO_MONTH = "none"
KEEP_MANIFESTS = 2
FIRST = ("stg_pedido_items", "int_pedidos_enriched", "int_match_pairs")  # the models that shuffle most
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Entry:
    """One model in a manifest: what it was built from, its schema, and partition -> [digest, rows, run]."""

    inputs: dict[str, str]
    schema: dict
    partitions: dict[str, list] = field(default_factory=dict)

    @property
    def digest(self) -> str:
        return ";".join(f"{k}={d}" for k, (d, _, _) in sorted(self.partitions.items()))


class Store:
    """Manifests and partitions below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.base = spark, out_dir.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        p = self._path(f"{self.base}/{name}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def numbers(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._listed("manifest") if n.endswith(".json")]

    def load(self, number: int | None = None) -> tuple[str | None, dict[str, Entry]]:
        """Input stamp and entries of a manifest (the newest one); empty if there is none."""
        found = self.numbers()
        if not found:
            return None, {}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.base}/manifest/{number or found[-1]:08d}.json").collect())  # one manifest
        d = json.loads(text)
        return d["stamp"], {k: Entry(**e) for k, e in d["models"].items()}

    def commit(self, stamp: str | None, models: dict[str, Entry]) -> None:
        number = (self.numbers() or [0])[-1] + 1
        name = f"{self.base}/manifest/{number:08d}.json"
        out = self._fs.create(self._path(name + ".tmp"), True)
        out.write(json.dumps({"stamp": stamp, "models": {k: asdict(e) for k, e in models.items()}}).encode())
        out.close()
        if not self._fs.rename(self._path(name + ".tmp"), self._path(name)):
            raise OSError(f"cannot commit {name}")
        self._clean()

    def _clean(self) -> None:
        """Remove old manifests and partitions that no kept manifest names."""
        numbers = self.numbers()
        for old in numbers[:-KEEP_MANIFESTS]:
            self._fs.delete(self._path(f"{self.base}/manifest/{old:08d}.json"), False)
        held = {(m, run, key) for n in numbers[-KEEP_MANIFESTS:] for m, e in self.load(n)[1].items() for key, (_, _, run) in e.partitions.items()}
        for model in self._listed("data"):
            for run in self._listed(f"data/{model}"):
                for part in self._listed(f"data/{model}/{run}"):
                    if part.startswith("_part=") and (model, run, part[6:]) not in held:
                        self._fs.delete(self._path(f"{self.base}/data/{model}/{run}/{part}"), True)

    def write(self, df: DataFrame, model: str, run: str) -> None:
        df.write.options(**STORED).partitionBy("_part").parquet(f"{self.base}/data/{model}/{run}")

    def written(self, model: str, run: str, schema: T.StructType) -> DataFrame:
        """What a run wrote of a model, with the partition's key as ``_part``."""
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("_part", T.StringType())])).parquet(f"{self.base}/data/{model}/{run}")

    def read(self, model: str, entry: Entry, first: str | None = None, last: str | None = None) -> DataFrame:
        """A published model; with bounds ("YYYY-MM", closed) only those months are opened."""
        keys = [k for k in sorted(entry.partitions) if (first is None or k >= first) and (last is None or k <= last)]
        schema = T.StructType.fromJson(entry.schema)
        if not keys:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/data/{model}/{entry.partitions[k][2]}/_part={k}" for k in keys])


def _digests(df: DataFrame, key: Column) -> dict[str, tuple[str, int]]:
    """Partition -> (digest, rows): the row count and the sum of row hashes, whatever the order of rows."""
    rows = df.select(key.alias("_part"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != "_part"]).cast("decimal(20,0)").alias("_h"))
    got = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_h").alias("s")).collect()  # one row a month
    return {r["_part"]: (f"{r['n']}:{r['s']}", r["n"]) for r in got}


def _key(model: Model) -> Column:
    return F.coalesce(F.date_format(model.month, "yyyy-MM"), F.lit(NO_MONTH)) if model.month else F.lit(WHOLE)


def _dealt(part: DataFrame, model: Model) -> DataFrame:
    """Months are dealt to tasks by size: a large month is split, small ones share a task."""
    return part.hint("rebalance", "_part") if model.month else part


@contextmanager
def _shuffles_end_with_queries(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query are removed when it ends; no query here reads those of another."""
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if old is None else spark.conf.set(SHUFFLE_CLEANUP, old)


def _order(only: list[str] | None) -> list[str]:
    """Parents before children, and the models that shuffle most as early as that allows."""
    names = only or list(BY_NAME)
    return build_order([n for n in FIRST if n in names] + [n for n in names if n not in FIRST])


def _met_by_order(m: Marketplace, model: Model) -> bool:
    """Whether a model is a projection of source tables in the buckets of the order key: later models project them again."""
    return not model.deps and bool(model.reads) and all(m.in_buckets(s) for s in model.reads)


def publish(m: Marketplace, out_dir: str, stamp: str | None = None, only: list[str] | None = None) -> dict[str, list[str]]:
    """Bring the published models up to date; model -> the partitions that were written.

    ``stamp`` identifies the input as a whole (``None``: look at the tables). ``m.models`` reads the published tables after."""
    with _shuffles_end_with_queries(m.spark):
        return _publish(m, out_dir, stamp, only)


def _publish(m: Marketplace, out_dir: str, stamp: str | None, only: list[str] | None) -> dict[str, list[str]]:
    store, run = Store(m.spark, out_dir), uuid.uuid4().hex[:12]
    known, entries = store.load()
    order = _order(only)
    fresh = stamp is not None and stamp == known and all(n in entries for n in order)
    written: dict[str, list[str]] = {n: [] for n in order}
    sources: dict[str, str] = {}
    for name in [] if fresh else order:
        model, old = BY_NAME[name], entries.get(name)
        if _met_by_order(m, model):
            m.models.pop(name, None)
        inputs = {"as_of": str(m.as_of), **{d: entries[d].digest for d in model.deps}}
        for s in model.reads:
            if s not in sources:
                sources[s] = _digests(getattr(m, s), F.lit(WHOLE)).get(WHOLE, ("0", 0))[0]
            inputs["source " + s] = sources[s]
        if old is None or old.inputs != inputs:
            df = model.build(m)
            before = old.partitions if old and old.schema == df.schema.jsonValue() else {}
            part = df.withColumn("_part", _key(model))
            if not before:  # all is new: computed once, digested as written
                store.write(_dealt(part, model), name, run)
                part = store.written(name, run, df.schema)
            now = _digests(part, F.col("_part")) or ({} if model.month else {WHOLE: ("0:None", 0)})
            changed = [k for k, (d, _) in sorted(now.items()) if k not in before or before[k][0] != d]
            if before and changed:
                if len(changed) < len(now):
                    part = part.where(F.col("_part").isin(changed))
                store.write(_dealt(part, model), name, run)
            entries[name] = Entry(inputs, df.schema.jsonValue(), {k: [d, n, run] if k in changed else [d, n, before[k][2]] for k, (d, n) in now.items()})
            written[name] = [k for k in changed if now[k][1]]
            if not all(now[k][1] for k in changed):  # an empty table has no files to read
                entries[name].partitions = {k: p for k, p in entries[name].partitions.items() if p[1]}
        if not _met_by_order(m, model):
            m.models[name] = store.read(name, entries[name])
    for name in order:
        if fresh or _met_by_order(m, BY_NAME[name]):
            m.models[name] = store.read(name, entries[name])
    if not fresh:
        store.commit(stamp, entries)
    return written


def published(spark: SparkSession, out_dir: str, name: str, first: str | date | None = None, last: str | date | None = None) -> DataFrame:
    """A model as of the newest manifest, of the months ``first`` to ``last`` if given."""
    store = Store(spark, out_dir)
    _, entries = store.load()
    if name not in entries:
        raise FileNotFoundError(f"{name} is not published in {out_dir}")
    month = lambda x: None if x is None else str(x)[:7]
    return store.read(name, entries[name], month(first), month(last))


def summary(spark: SparkSession, out_dir: str, names: list[str] | None = None) -> DataFrame:
    """Per published model: rows counted in its files and number of partitions."""
    store = Store(spark, out_dir)
    _, entries = store.load()
    out = None
    for name in names or sorted(entries):
        counts = store.read(name, entries[name]).agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"),
                                                     F.lit(len(entries[name].partitions)).cast("long").alias("n_partitions"))
        out = counts if out is None else out.unionByName(counts)
    return out
