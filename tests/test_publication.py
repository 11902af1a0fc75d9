"""What a publication writes when nothing, one month or one table has changed."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loomstat.plans import publication as P
from loomstat.plans.registry import QUERIES, load_all
from loomstat.sources.binding import bind

SOME = ["int_pedidos_enriched", "marts_cohort_analysis"]


def fresh(spark, **tables):
    m = bind(spark, SF_SMALL, "2001-08-02 00:00:00")
    m.__dict__.update(tables)
    return m


def _files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{base}/data") for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("pub"))
    written = P.publish(fresh(spark), out, "one", SOME)
    return out, written


def test_first_run_writes_all_and_reads_back(spark, base):
    out, written = base
    m = fresh(spark)
    from loomstat.plans.pipeline import BY_NAME

    for name in written:
        want, got = BY_NAME[name].build(m), P.published(spark, out, name)
        assert got.schema.simpleString() == want.schema.simpleString() and got.count() == want.count() and got.exceptAll(want).count() == 0
    months = {r[0] for r in P.published(spark, out, "stg_pedidos").select(F.date_format("dt_criacao", "yyyy-MM")).distinct().collect()}
    assert set(written["stg_pedidos"]) == months and written["stg_empresas"] == ["all"]


def test_unchanged_input_writes_nothing(spark, base):
    out, _ = base
    old = _files(out)
    assert not any(P.publish(fresh(spark), out, "one", SOME).values())  # by the stamp
    assert not any(P.publish(fresh(spark), out, "two", SOME).values())  # by the digests
    assert _files(out) == old


def test_one_changed_month_writes_one_partition_of_each_dependent(spark, base):
    out, _ = base
    p = fresh(spark).pedidos
    month = "1995-03"
    changed = p.withColumn("quantidade_total", F.when(F.date_format("created_at", "yyyy-MM") == month, F.col("quantidade_total") + 1).otherwise(F.col("quantidade_total")))
    written = P.publish(fresh(spark, pedidos=changed), out, "three", SOME)
    assert {k: v for k, v in written.items() if v} == {"stg_pedidos": [month], "int_pedidos_enriched": [month]}
    assert P.published(spark, out, "int_pedidos_enriched").where(F.date_format("dt_criacao", "yyyy-MM") == month).agg(F.sum("quantidade_total")).first()[0] == \
        changed.where(F.date_format("created_at", "yyyy-MM") == month).agg(F.sum("quantidade_total")).first()[0]
    back = P.publish(fresh(spark), out, "four", SOME)
    assert back["int_pedidos_enriched"] == [month]
    assert len(P.Store(spark, out).numbers()) == P.KEEP_MANIFESTS


def test_a_vanished_month_and_bounds(spark, tmp_path):
    out, p = str(tmp_path), fresh(spark).pedidos
    P.publish(fresh(spark), out, None, ["stg_pedidos"])
    cut = p.where(F.date_format("created_at", "yyyy-MM") != "1996-01")
    assert not P.publish(fresh(spark, pedidos=cut), out, None, ["stg_pedidos"])["stg_pedidos"]  # no rows to write
    got = P.published(spark, out, "stg_pedidos")
    assert got.where(F.date_format("dt_criacao", "yyyy-MM") == "1996-01").count() == 0 and got.count() < p.count()
    some = P.published(spark, out, "stg_pedidos", "1995-11-01", "1996-02-29")
    assert {f.split("_part=")[1][:7] for f in some.inputFiles()} == {"1995-11", "1995-12", "1996-02"}
    assert P.published(spark, out, "stg_pedidos", "2050-01").count() == 0
    with pytest.raises(FileNotFoundError, match="not published"):
        P.published(spark, out, "marts_platform_kpis")


def test_a_failed_run_leaves_the_old_one(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    P.publish(fresh(spark), out, "a", ["stg_empresas"])
    old = P.published(spark, out, "stg_empresas").count()
    with monkeypatch.context() as broken:
        broken.setattr(P.Store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            P.publish(fresh(spark, empresas=fresh(spark).empresas.limit(3)), out, "b", ["stg_empresas"])
    assert P.published(spark, out, "stg_empresas").count() == old
    assert P.publish(fresh(spark, empresas=fresh(spark).empresas.limit(0)), out, "c", ["stg_empresas"]) == {"stg_empresas": []}
    assert P.published(spark, out, "stg_empresas").count() == 0  # an empty table is a table


def test_a_mart_writes_its_parents_first(spark):
    load_all()
    from loomstat.plans.registry import sources

    QUERIES["M6_marts_match_quality"](spark, SF_SMALL)
    m = sources(spark, SF_SMALL)
    assert "int_match_pairs" in m.models and all("/models/int_match_pairs" in f for f in m.models["int_match_pairs"].inputFiles())


def test_a_new_model_is_digested_from_its_files(spark, tmp_path, monkeypatch):
    """It is computed once: what is digested is what was written, months and whole tables alike."""
    out, seen = str(tmp_path), []
    plain = P._digests
    monkeypatch.setattr(P, "_digests", lambda df, key: (seen.append(df.inputFiles()), plain(df, key))[1])
    written = P.publish(fresh(spark), out, "one", SOME)
    own = [files for files in seen if files and all(f"{out}/data/" in f for f in files)]
    assert len(own) == len(written)
    assert not any(P.publish(fresh(spark), out, "two", SOME).values())


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size())}


def test_shuffle_files_go_with_their_queries(spark, tmp_path):
    """Nothing that a publication shuffled stays on disk, whenever the driver collects its garbage; the setting is put back."""
    import time

    old, before = spark.conf.get(P.SHUFFLE_CLEANUP, None), _shuffle_files(spark)
    P.publish(fresh(spark), str(tmp_path), None, SOME)
    for _ in range(50):  # they are removed in the background
        left = {f for f in _shuffle_files(spark) - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(P.SHUFFLE_CLEANUP, None) == old


def test_models_that_shuffle_most_come_first(spark):
    from loomstat.plans.pipeline import BY_NAME

    order = P._order(None)
    at = {n: i for i, n in enumerate(order)}
    assert sorted(order) == sorted(BY_NAME) and all(at[d] < at[n] for n in order for d in BY_NAME[n].deps)

    def parents(name):
        return {name}.union(*[parents(d) for d in BY_NAME[name].deps])

    ahead = set().union(*[parents(n) for n in P.FIRST])
    assert set(order[:len(ahead)]) == ahead
    assert P._order(["marts_cohort_analysis"]) == ["stg_empresas", "stg_pedidos", "marts_cohort_analysis"]


def test_models_meet_by_order_in_the_buckets_of_the_sources(spark, tmp_path, monkeypatch):
    """The published orders lie by month; models after them project the bucketed source table, and readers get the published one."""
    from dataclasses import replace

    from loomstat.sources.binding import PublishedMarketplace

    m, read = PublishedMarketplace(spark, SF_SMALL, "2001-08-02 00:00:00", str(tmp_path / "sources")), []
    for name in ("int_pedidos_enriched", "marts_cohort_analysis"):
        model = P.BY_NAME[name]
        monkeypatch.setitem(P.BY_NAME, name, replace(model, build=lambda x, f=model.build: read.append(f(x)) or read[-1]))
    out = str(tmp_path / "out")
    written = P.publish(m, out, None, SOME)
    for df in read:
        assert any("/sources/pedidos/" in f for f in df.inputFiles()) and not any("/data/stg_pedidos/" in f for f in df.inputFiles())
    assert any("/data/stg_empresas/" in f for f in read[0].inputFiles())  # other models are read as published
    assert all(f"{out}/data/stg_pedidos/" in f for f in m.models["stg_pedidos"].inputFiles())
    assert set(m.models) == set(written) and not any(P.publish(m, out, None, SOME).values())
    for name in SOME:
        want, got = P.BY_NAME[name].build(fresh(spark)), P.published(spark, out, name)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < got.count()
