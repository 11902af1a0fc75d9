"""Dependency-ordered model build and publication."""

import pytest

from conftest import SF_SMALL

from loomstat.operators import marts as M
from loomstat.plans import pipeline as P
from loomstat.sources import io
from loomstat.sources.binding import bind


def test_build_order_is_topological():
    order = P.build_order()
    pos = {n: i for i, n in enumerate(order)}
    assert len(order) == len(P.MODELS)
    for m in P.MODELS:
        for d in m.deps:
            assert pos[d] < pos[m.name]
    assert P.build_order(["marts_customer_journey"])[-1] == "marts_customer_journey"


def fresh(spark):
    return bind(spark, SF_SMALL, "2001-08-02 00:00:00")


def test_run_subset_publishes(spark, tmp_path):
    out = str(tmp_path)
    done = P.run_all(fresh(spark), out_dir=out, only=["marts_cohort_analysis"])
    assert [n for n, _ in done] == ["stg_empresas", "stg_pedidos", "marts_cohort_analysis"]
    back = P.published(spark, out, "marts_cohort_analysis")
    assert back.count() == spark.table("marts_cohort_analysis").count() > 0


def test_later_models_read_the_written_ones(spark, tmp_path):
    m = fresh(spark)
    P.run_all(m, out_dir=str(tmp_path), only=["marts_customer_journey"], gate=False)
    assert all(str(tmp_path) in f for f in m.models["int_funnel_stages"].inputFiles())
    assert all(str(tmp_path) in f for f in M.marts_customer_journey(m).inputFiles())


def test_pointer_moves_and_old_runs_go(spark, tmp_path):
    out = str(tmp_path)
    for _ in range(3):
        P.run_all(fresh(spark), out_dir=out, only=["stg_empresas"], gate=False, keep=2)
    runs = sorted(p.name for p in (tmp_path / "runs").iterdir())
    assert len(runs) == 2 and (tmp_path / "current").read_text() == runs[-1]


def test_gate_stops_a_load_with_orphans(spark, tmp_path):
    m = fresh(spark)
    m.__dict__["oficinas"] = m.oficinas.limit(3)
    with pytest.raises(P.QualityGate, match="oficinas"):
        P.run_all(m, out_dir=str(tmp_path), only=["stg_empresas"])
    assert not (tmp_path / "current").exists()


def test_month_filter_prunes_partitions(spark, tmp_path):
    m = fresh(spark)
    df = P.write_model(m, "marts_revenue_analytics", f"{tmp_path}/x")
    some = io.between_months(df, "mes", "1996-01-01", "1996-03-01")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(mes" in plan and some.count() == 3


def test_stops_on_first_error(market, monkeypatch):
    def boom(m):
        raise ValueError("broken model")

    monkeypatch.setitem(P.BY_NAME, "stg_empresas", P.Model("stg_empresas", boom))
    with pytest.raises(RuntimeError, match="stg_empresas"):
        P.run_all(market, only=["marts_cohort_analysis"])
