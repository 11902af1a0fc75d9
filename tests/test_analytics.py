"""Ports of the reference's analytics assertions on small in-test fixtures (FIXTURES.md A1–A3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomstat.operators import analytics as A


@pytest.fixture(scope="module")
def funnel_df(spark):
    rows = []
    stages = [1, 1, 1, 2, 2, 3, 4, 5]
    names = ["registered", "activated", "matched", "converted", "retained"]
    for i, s in enumerate(stages):
        rows.append((f"e{i}", "moda" if i % 2 == 0 else "uniformes", "medio", "SC", names[s - 1], s, 5 + i,
                     3 + i if s >= 3 else None, 10 + i if s >= 4 else None, 20 + i if s >= 5 else None,
                     dt.datetime(2024, 1, 1), max(0, s - 1), float(s * 1000)))
    schema = ("empresa_id string, segmento string, porte string, estado string, current_stage string, stage_num int, "
              "dias_signup_para_ativacao int, dias_ativacao_para_match int, dias_match_para_conversao int, "
              "dias_conversao_para_retencao int, cohort_mes timestamp, total_pedidos int, gmv_total double")
    return spark.createDataFrame(rows, schema)


def test_funnel_summary(funnel_df):
    out = {r["stage"]: r for r in A.funnel_summary(funnel_df).collect()}
    assert [out[s]["count"] for s in A.STAGES] == [8, 5, 3, 2, 1]
    assert [out[s]["pct_of_top"] for s in A.STAGES] == [100.0, 62.5, 37.5, 25.0, 12.5]
    assert out["registered"]["conversion_from_prev"] is None
    assert [out[s]["conversion_from_prev"] for s in A.STAGES[1:]] == [62.5, 60.0, 66.7, 50.0]


def test_time_to_convert(funnel_df):
    rows = {r["transicao"]: r for r in A.time_to_convert(funnel_df).collect()}
    assert len(rows) == 4
    first = rows["signup → ativação"]
    assert first["n"] == 8 and first["mediana_dias"] == 8.5 and first["p25_dias"] == 6.8


def test_segment_and_dropoff(funnel_df):
    seg = A.funnel_by_segment(funnel_df).collect()
    assert len(seg) == 2 * 5
    drops = A.drop_off_analysis(funnel_df).collect()
    assert len(drops) == 4
    assert {r["transition"] for r in drops} == {"registered → activated", "activated → matched",
                                                "matched → converted", "converted → retained"}
    gmv = {r["current_stage"]: r for r in A.gmv_by_stage(funnel_df).collect()}
    assert set(gmv) == {"converted", "retained"}


@pytest.fixture(scope="module")
def cohort_df(spark):
    rows = []
    for ci, d in enumerate([2, 4, 6]):
        month = dt.datetime(2024, ci + 1, 1)
        for n in range(6):
            active = max(1, 20 - n * d)
            rows.append((month, month.strftime("%Y-%m"), 20, n, active, round(active / 20 * 100, 1), float(active * 500)))
    schema = ("cohort_mes timestamp, cohort_label string, cohort_size int, mes_n int, n_ativos int, "
              "retention_rate_pct double, receita_cohort double")
    return spark.createDataFrame(rows, schema).withColumn("receita_cohort", F.col("receita_cohort").cast("decimal(18,2)"))


def test_cohort_matrix_and_summary(cohort_df):
    m = A.retention_matrix(cohort_df)
    rows = m.collect()
    assert len(rows) == 3 and len(m.columns) == 1 + 6
    assert all(r["0"] == 100.0 for r in rows)
    curve = A.average_retention_curve(cohort_df).collect()
    assert len(curve) == 6
    bw = A.best_and_worst_cohorts(cohort_df).collect()[0]
    assert bw["best"] == "2024-01" and bw["worst"] == "2024-03"
    summ = {r["cohort"]: r for r in A.cohort_summary(cohort_df).collect()}
    assert summ["2024-01"]["retention_m3"] == 70.0 and summ["2024-01"]["retention_m6"] is None
    ltv = A.ltv_by_cohort(cohort_df, 3).collect()
    assert all(float(r["ltv_per_empresa"]) > 0 for r in ltv)


@pytest.fixture(scope="module")
def perf_df(spark):
    rows = []
    for i in range(1, 8):
        rated = 2 * i >= 3
        rows.append((f"o{i}", f"Oficina {i}", "SC", "Blumenau", "premium" if i % 3 == 0 else "standard", 500 + 100 * i,
                     10 + 5 * i, 8 + 4 * i, 2 * i,
                     3.5 + .1 * i if rated else None, 3.2 + .1 * i if rated else None, 3.8 + .05 * i if rated else None,
                     3.5 + .1 * i, 3.2 + .1 * i, 3.8 + .05 * i, 40.0 + 5 * i, 85.0 + i, 80.0 + 2 * i,
                     max(0.5, 12.0 - i), i % 4, float(i % 4), i % 3 == 0, i % 5 == 0, True))
    schema = ("oficina_id string, nome_fantasia string, estado string, cidade string, tier string, "
              "capacidade_mensal_pecas int, total_pedidos int, pedidos_finalizados int, total_avaliacoes int, "
              "nota_qualidade_media double, nota_pontualidade_media double, nota_comunicacao_media double, "
              "score_qualidade_media double, score_pontualidade_media double, score_comunicacao_media double, "
              "win_rate_pct double, taxa_aprovacao_media_pct double, pct_entrega_no_prazo double, "
              "tempo_medio_resposta_h double, total_certificacoes int, score_certificacoes double, tem_abvtex boolean, "
              "tem_cert_premium boolean, ativo_recente boolean")
    return spark.createDataFrame(rows, schema)


def test_scores(perf_df):
    s = A.compute_scores(perf_df).collect()
    assert len(s) == 7
    assert all(0 <= r["score_composto"] <= 10 for r in s)
    assert {r["ranking_tier"] for r in s} <= set(A.TIER_ORDER)
    ex = A.explain_score(perf_df, "o3").collect()
    assert len(ex) == 6
    assert abs(sum(r["contribution"] for r in ex) - ex[0]["score_composto"]) < 0.1
    with pytest.raises(ValueError):
        A.explain_score(perf_df, "missing")
    with pytest.raises(ValueError):
        A.ScoringWeights(qualidade=0.9)
    tiers = A.tier_distribution(perf_df).collect()
    assert len(tiers) == 4 and sum(r["n_oficinas"] for r in tiers) == 7
    assert A.ranked_oficinas(perf_df, estado="SP").count() == 0
    cmp = A.compare_weights(perf_df, A.ScoringWeights(0.2, 0.2, 0.2, 0.2, 0.1, 0.1)).collect()
    assert len(cmp) == 7
