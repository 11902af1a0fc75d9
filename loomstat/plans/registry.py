"""Query registry: one entry per inventory row, each with its SQL oracle when one exists.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``.
Every query reads the given tables (through the binding), so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstat.plans import oracle as O
from loomstat.session import apply_defaults
from loomstat.sources.binding import PublishedMarketplace
from loomstat.sources.io import finalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PUBLISHED: dict[tuple, PublishedMarketplace] = {}


#: "Now" of the registered queries: the day up to which the given tables (orders until 1998) are observed.
AS_OF = "2001-08-02 00:00:00"


def _stamp(spark: SparkSession, path: str) -> tuple:
    """Bytes, files and latest change of a table, from the file system that Spark reads it with."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return (path, None)
    files = list(fs.listStatus(p))
    return (path, len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0))


def stamp(spark: SparkSession, sf_dir: str) -> str:
    """Identity of the input tables and the clock."""
    import hashlib

    from loomstat.sources.io import TABLES, table_path

    return hashlib.sha1(repr((AS_OF, [_stamp(spark, table_path(sf_dir, t)) for t in TABLES])).encode()).hexdigest()


def sources(spark: SparkSession, sf_dir: str) -> PublishedMarketplace:
    """Source tables of ``sf_dir`` (S4): each is written under the shared checkpoint folder when a query first needs it,
    once per application and input version; later queries read the written tables."""
    import hashlib
    import uuid

    from loomstat.session import ensure_checkpoint_dir
    from loomstat.sources.io import TABLES, table_path

    key = (spark.sparkContext.applicationId, sf_dir, tuple(_stamp(spark, table_path(sf_dir, t)) for t in TABLES))
    if key not in _PUBLISHED:
        tag = hashlib.sha1(repr(key).encode()).hexdigest()[:12]
        path = ensure_checkpoint_dir(spark).rstrip("/") + f"/sources/{tag}-{uuid.uuid4().hex[:8]}"
        _PUBLISHED[key] = PublishedMarketplace(spark, sf_dir, AS_OF, path)
    return _PUBLISHED[key]


def parents(m: PublishedMarketplace, name: str) -> None:
    """Write the intermediate models that ``name`` reads (staging models are single scans and are not written)."""
    from loomstat.plans.pipeline import BY_NAME

    for dep in BY_NAME[name].deps:
        if not dep.startswith("stg_"):
            mart(m, dep)


def mart(m: PublishedMarketplace, name: str) -> DataFrame:
    """A published model (S7): written beside the source tables when a report first asks for it, after the models that it
    reads, and read from there after."""
    from loomstat.plans.pipeline import write_model

    if name not in m.models:
        parents(m, name)
        write_model(m, name, f"{m.published_path}/models/{name}")
    return m.models[name]


def register(name: str, oracle_final: str | None = None):
    """Decorator: ``fn(marketplace) -> DataFrame`` becomes ``(spark, sf_dir) -> DataFrame``."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)  # UTC session time zone, AQE
            return finalize(fn(sources(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle_final is not None:
            ORACLES[name] = O.sql(oracle_final)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from loomstat.plans import queries  # noqa: F401
