"""Registered queries (inventory rows of the blueprint), each with its SQL oracle."""

from __future__ import annotations

from loomstat.operators import staging as S
from loomstat.plans.registry import mart, parents, register, stamp

# ---------------------------------------------------------------- P: staging
# The array columns of P2 are compared as joined text (the arrays themselves are kept
# by the library function ``stg_oficinas``).


@register("P1_stg_empresas", "SELECT * FROM stg_empresas")
def p1(m):
    return S.stg_empresas(m)


@register("P2_stg_oficinas", "SELECT * REPLACE (array_to_string(especialidades, '|') AS especialidades, "
                             "array_to_string(maquinario, '|') AS maquinario) FROM stg_oficinas")
def p2(m):
    from pyspark.sql import functions as F

    lists = {c: F.array_join(c, "|") for c in ("especialidades", "maquinario")}  # compared element by element, as text
    return S.stg_oficinas(m).withColumns(lists)


@register("P3_stg_usuarios", "SELECT * FROM stg_usuarios")
def p3(m):
    return S.stg_usuarios(m)


@register("P4_stg_pedidos", "SELECT * FROM stg_pedidos")
def p4(m):
    return S.stg_pedidos(m)


@register("P5_stg_pedido_items", "SELECT * FROM stg_pedido_items")
def p5(m):
    return S.stg_pedido_items(m)


@register("P6_stg_propostas", "SELECT * FROM stg_propostas")
def p6(m):
    return S.stg_propostas(m)


@register("P7_stg_producao", "SELECT * FROM stg_producao")
def p7(m):
    return S.stg_producao(m)


@register("P8_stg_avaliacoes", "SELECT * FROM stg_avaliacoes")
def p8(m):
    return S.stg_avaliacoes(m)


@register("P9_stg_certificacoes", "SELECT * FROM stg_certificacoes")
def p9(m):
    return S.stg_certificacoes(m)


@register("P10_stg_pagamentos", "SELECT * FROM stg_pagamentos")
def p10(m):
    return S.stg_pagamentos(m)


@register("P11_stg_eventos_plataforma", "SELECT * FROM stg_eventos")
def p11(m):
    return S.stg_eventos_plataforma(m)


# ---------------------------------------------------------------- I: intermediate
from loomstat.operators import intermediate as I  # noqa: E402


@register("I1_int_pedidos_enriched", "SELECT * FROM int_pedidos_enriched")
def i1(m):
    return I.int_pedidos_enriched(m)


@register("I2_int_oficina_performance", "SELECT * FROM int_oficina_performance")
def i2(m):
    return I.int_oficina_performance(m)


@register("I3_int_empresa_activity", "SELECT * FROM int_empresa_activity")
def i3(m):
    return I.int_empresa_activity(m)


@register("I4_int_funnel_stages", "SELECT * FROM int_funnel_stages")
def i4(m):
    return I.int_funnel_stages(m)


@register("I5_int_match_pairs", "SELECT * FROM int_match_pairs")
def i5(m):
    return I.int_match_pairs(m)


@register("I6_int_daily_platform_snapshot", "SELECT * FROM int_daily_platform_snapshot")
def i6(m):
    return I.int_daily_platform_snapshot(m)


# ---------------------------------------------------------------- M: marts
from loomstat.operators import marts as M  # noqa: E402
from loomstat.plans.pipeline import BY_NAME as _MODELS  # noqa: E402

for _name, _fn, _cte in [
    ("M1_marts_platform_kpis", M.marts_platform_kpis, "marts_platform_kpis"),
    ("M2_marts_customer_journey", M.marts_customer_journey, "marts_customer_journey"),
    ("M3_marts_cohort_analysis", M.marts_cohort_analysis, "marts_cohort_analysis"),
    ("M4_marts_oficina_scoring", M.marts_oficina_scoring, "marts_oficina_scoring"),
    ("M5_marts_empresa_clv", M.marts_empresa_clv, "marts_empresa_clv"),
    ("M6_marts_match_quality", M.marts_match_quality, "marts_match_quality"),
    ("M7_marts_revenue_analytics", M.marts_revenue_analytics, "marts_revenue_analytics"),
    ("M8_marts_geographic_analysis", M.marts_geographic_analysis, "marts_geographic_analysis"),
    ("M9_v_platform_summary", M.v_platform_summary, "v_platform_summary"),
    ("M10_demand_supply_by_state", M.demand_supply_by_state, "demand_supply_by_state"),
]:
    def _mart(m, _f=_fn, _n=_cte):
        if _n in _MODELS:
            parents(m, _n)  # the mart reads its parents as written
        return _f(m)

    register(_name, f"SELECT * FROM {_cte}")(_mart)


# ---------------------------------------------------------------- C / K / R: analytics classes
from loomstat.operators import analytics as A  # noqa: E402


def _funnel(m):
    return mart(m, "int_funnel_stages")


#: Columns of the cohort matrices: months since sign-up. The orders span 1992 to 1998 and sign-up is a brand's first order.
MATRIX_MONTHS = list(range(84))


def _matrix_sql(aggregate: str, close: str = "") -> str:
    cells = ", ".join(f'{aggregate} FILTER (WHERE mes_n = {k}){close} AS "{k}"' for k in MATRIX_MONTHS)
    return f"SELECT cohort_label, {cells} FROM marts_cohort_analysis GROUP BY cohort_label"


def _scoring(m):
    mart(m, "int_oficina_performance")
    return A.scoring_input(m)


def _cohorts(m):
    return mart(m, "marts_cohort_analysis")


for _name, _fn, _sql in [
    ("C1_funnel_summary", lambda m: A.funnel_summary(_funnel(m)), "SELECT * FROM c_funnel_summary"),
    ("C2_time_to_convert", lambda m: A.time_to_convert(_funnel(m)), "SELECT * FROM c_time_to_convert"),
    ("C3_funnel_by_segment", lambda m: A.funnel_by_segment(_funnel(m)), "SELECT * FROM c_funnel_by_segment"),
    ("C4_drop_off_analysis", lambda m: A.drop_off_analysis(_funnel(m)), "SELECT * FROM c_drop_off"),
    ("C5_cohort_funnel", lambda m: A.cohort_funnel(_funnel(m)), "SELECT * FROM c_cohort_funnel"),
    ("C6_gmv_by_stage", lambda m: A.gmv_by_stage(_funnel(m)), "SELECT * FROM c_gmv_by_stage"),
    ("K1_retention_matrix", lambda m: A.retention_matrix(_cohorts(m), MATRIX_MONTHS),
     _matrix_sql("max(round(retention_rate_pct, 1))")),
    ("K2_revenue_matrix", lambda m: A.revenue_matrix(_cohorts(m), MATRIX_MONTHS),
     _matrix_sql("coalesce(max(receita_cohort)", ", 0)")),
    ("K3_average_retention_curve", lambda m: A.average_retention_curve(_cohorts(m)),
     "SELECT * FROM k_average_retention_curve"),
    ("K4_cohort_summary", lambda m: A.cohort_summary(_cohorts(m)), "SELECT * FROM k_cohort_summary"),
    ("K5_ltv_by_cohort", lambda m: A.ltv_by_cohort(_cohorts(m), 12), "SELECT * FROM k_ltv_by_cohort"),
    ("K6_best_and_worst_cohorts", lambda m: A.best_and_worst_cohorts(_cohorts(m)), "SELECT * FROM k_best_worst"),
    ("R1_compute_scores", lambda m: A.compute_scores(_scoring(m)), "SELECT * FROM r_scores"),
    ("R2_ranked_oficinas", lambda m: A.ranked_oficinas(_scoring(m), None, 0.0, 50),
     "SELECT * FROM r_scores WHERE score_composto >= 0 ORDER BY score_composto DESC, oficina_id LIMIT 50"),
    ("R2_ranked_oficinas_filtered", lambda m: A.ranked_oficinas(_scoring(m), "NATION_9", 7.1, 20),
     "SELECT * FROM r_scores WHERE estado = 'NATION_9' AND score_composto >= 7.1 ORDER BY score_composto DESC, oficina_id LIMIT 20"),
    ("R3_explain_scores", lambda m: A.explain_scores(_scoring(m)), "SELECT * FROM r_explain"),
    ("R4_compare_weights", lambda m: A.compare_weights(_scoring(m), A.ScoringWeights(0.20, 0.20, 0.20, 0.20,
                                                                                            0.10, 0.10)),
     "SELECT *, rank_current - rank_alt AS rank_delta FROM r_compare"),
    ("R5_tier_distribution", lambda m: A.tier_distribution(_scoring(m)), "SELECT * FROM r_tiers"),
]:
    register(_name, _sql)(_fn)


# ---------------------------------------------------------------- Q: data quality
from loomstat.operators import quality as Q  # noqa: E402
from loomstat.plans import oracle as _O  # noqa: E402

_QSQL = _O.quality_sql()
for _name, _fn, _key in [
    ("Q1_row_counts", Q.row_counts, "Q1"),
    ("Q2_referential_integrity", Q.referential_integrity, "Q2"),
    ("Q3_row_constraints", Q.row_constraints, "Q3"),
    ("Q4_enum_domains", Q.enum_domains, "Q4"),
    ("Q5_lifecycle_invariants", Q.lifecycle_invariants, "Q5"),
    ("Q6_schema_profile", Q.schema_profile, "Q6"),
]:
    register(_name, _QSQL[_key])(lambda m, _f=_fn: _f(m))

# ---------------------------------------------------------------- G4 and reports
from loomstat.operators import reports as D  # noqa: E402
from loomstat.sources import io as _io  # noqa: E402


def _gaps(m):
    return D.supply_demand_gaps(D.open_orders(m), D.available_oficinas(m))


register("G4_supply_demand_gaps", "SELECT * FROM g_gaps")(_gaps)

for _name, _fn, _key in [
    ("D1_headline_totals", lambda m: D.headline_totals(mart(m, "marts_platform_kpis")), "D1"),
    ("D2_latest_vs_previous", lambda m: D.latest_vs_previous(mart(m, "marts_platform_kpis")), "D2"),
    ("D3_order_stages_by_month", lambda m: D.order_stages_by_month(mart(m, "marts_platform_kpis")), "D3"),
    ("D4_last_six_months", lambda m: D.last_months(mart(m, "marts_platform_kpis"), 6), "D4"),
    ("D5_demand_kpis", lambda m: D.demand_kpis(mart(m, "marts_empresa_clv")), "D5"),
    ("D7_recency_frequency", lambda m: D.recency_frequency(mart(m, "marts_empresa_clv")), "D7"),
    ("D13_journey_kpis", lambda m: D.journey_kpis(A.funnel_summary(mart(m, "int_funnel_stages"))), "D13"),
    ("S6_kpis_between_months", lambda m: _io.between_months(mart(m, "marts_platform_kpis"), "mes", "1998-01-01",
                                                           "1999-12-01"), "S6"),
    ("D6_brands_per_segment", lambda m: D.brands_per_segment(mart(m, "marts_empresa_clv")), "D6"),
    ("D8_top_brands_by_clv", lambda m: D.top_brands_by_clv(mart(m, "marts_empresa_clv"), 50), "D8"),
    ("D9_supply_kpis", lambda m: D.supply_kpis(mart(m, "marts_oficina_scoring")), "D9"),
    ("D10_tier_counts", lambda m: D.tier_counts(mart(m, "marts_oficina_scoring")), "D10"),
    ("D11_workshops_by_state", lambda m: D.workshops_by_state(mart(m, "marts_oficina_scoring")), "D11"),
    ("D12_ranked_workshops", lambda m: D.ranked_workshops(mart(m, "marts_oficina_scoring")), "D12"),
    ("D12_ranked_workshops_filtered", lambda m: D.ranked_workshops(
        mart(m, "marts_oficina_scoring"), ["premium", "elite"], (7.02, 7.12), ["NATION_9", "NATION_11", "NATION_19", "NATION_6"], 100), "D12b"),
    ("D14_match_kpis", lambda m: D.match_kpis(mart(m, "marts_match_quality")), "D14"),
    ("D15_matches_by_geo", lambda m: D.matches_by_geo(mart(m, "marts_match_quality")), "D15"),
    ("D16_matched_gmv_by_state", lambda m: D.matched_gmv_by_state(mart(m, "marts_match_quality")), "D16"),
    ("D17_gap_by_state", lambda m: D.gap_by_state(mart(m, "marts_geographic_analysis"), _gaps(m)), "D17"),
    ("D18_financial_kpis", lambda m: D.financial_kpis(mart(m, "marts_revenue_analytics")), "D18"),
    ("D18_gmv_mom", lambda m: D.gmv_mom(mart(m, "marts_revenue_analytics")), "D18b"),
    ("D19_payment_mix", lambda m: D.payment_mix(mart(m, "marts_revenue_analytics")), "D19"),
]:
    register(_name, _O.REPORTS[_key])(_fn)


# ---------------------------------------------------------------- V: lifetime value
from loomstat.operators import clv as V  # noqa: E402

register("V1_rfm_summary", "SELECT * FROM v_rfm")(lambda m: V.rfm_summary(V.transactions(m)))
register("V6_probability_alive", "SELECT * FROM v_prob_alive")(
    lambda m: V.probability_alive(V.rfm_summary(V.transactions(m)), V.BGNBDParams(*_O.V6_PARAMS[:2], *_O.V6_PARAMS[2:])))

# ---------------------------------------------------------------- T: streaming and incremental
from loomstat.streaming import live as T  # noqa: E402

register("T3_order_codes", "SELECT * FROM t_order_codes")(lambda m: T.order_codes(m.pedidos))
register("T4_daily_activity_stream", "SELECT * FROM t_daily_activity")(
    lambda m: T.with_open_days(T.run_available_now(T.daily_activity(T.event_stream(m.spark, m.sf_dir)), m.spark, "t4"),
                               T.event_batch(m.spark, m.sf_dir)))
register("T5_user_sessions_stream", "SELECT * FROM t_sessions")(
    lambda m: T.with_open_sessions(T.run_available_now(T.user_sessions(T.event_stream(m.spark, m.sf_dir)), m.spark, "t5"),
                                   T.event_batch(m.spark, m.sf_dir)))
register("T6_dedup_events_stream", "SELECT * FROM t_dedup")(
    lambda m: T.run_available_now(T.deduplicated_events(T.event_stream(m.spark, m.sf_dir)), m.spark, "t6"))


# ---------------------------------------------------------------- G2: exact top-n recommendations (no pair product)
from loomstat.operators import matching as G  # noqa: E402
from loomstat.operators import recommend as GR  # noqa: E402


@register("G2_recommendations", "SELECT * FROM g_recommendations")
def g2(m):
    regions = G.region_table_from_nations(m.raw("nation"), m.raw("region"))
    return GR.recommendations(D.open_orders(m), D.available_oficinas(m), regions, top_n=5)


from loomstat.operators import assignment as GA  # noqa: E402


def _assignment(m):
    regions = G.region_table_from_nations(m.raw("nation"), m.raw("region"))
    return GA.optimal_assignment(D.open_orders(m), D.available_oficinas(m), regions)


register("G3_optimal_assignment")(_assignment)
register("G3_total", "SELECT * FROM g_assignment_bound")(lambda m: GA.totals(_assignment(m)))


@register("G1_score_bids", "SELECT * FROM g_bid_scores")
def g1(m):
    regions = G.region_table_from_nations(m.raw("nation"), m.raw("region"))
    return G.score_pairs(S.stg_propostas(m), D.open_orders(m), D.available_oficinas(m), regions)


# ---------------------------------------------------------------- V2-V5, V7: CLV model (no SQL form: rows-only checks)
from pyspark.sql import functions as _F  # noqa: E402

_FITS: dict = {}


def _fit_cache(m, what: str):
    """Summary and fitted models, each computed once per session and source version; the two
    fits are separate entries so no single query has to run both optimisations."""
    base = (m.spark.sparkContext.applicationId, m.published_path)
    key = base + (what,)
    if key not in _FITS:
        if what == "rfm":
            _FITS[key] = V.rfm_summary(V.transactions(m)).checkpoint(eager=True)
        elif what == "bg":
            _FITS[key] = V.fit_bgnbd(_fit_cache(m, "rfm"))
        else:
            _FITS[key] = V.fit_gamma_gamma(_fit_cache(m, "rfm"))
    return _FITS[key]


def _v2(m):
    rfm = _fit_cache(m, "rfm")
    bg, f, it, converged = _fit_cache(m, "bg")
    return m.spark.createDataFrame([(bg.r, bg.alpha, bg.a, bg.b, f, it, converged, rfm.count())],
                                   "r double, alpha double, a double, b double, objective double, iterations int, "
                                   "converged boolean, n_customers long")


def _v3(m):
    gg, f, it, converged = _fit_cache(m, "gg")
    return m.spark.createDataFrame([(gg.p, gg.q, gg.v, f, it, converged)],
                                   "p double, q double, v double, objective double, iterations int, converged boolean")


def _v4(m):
    return V.predict_clv(_fit_cache(m, "rfm"), _fit_cache(m, "bg")[0], _fit_cache(m, "gg")[0], months=12,
                         discount_rate=0.01)


register("V2_fit_bgnbd")(_v2)
register("V2_bgnbd_loglik_fixed", "SELECT * FROM v_bgnbd_loglik")(
    lambda m: (lambda rfm: rfm.select("empresa_id", "frequency", "recency", "T", (_F.round(V.bgnbd_loglik(
        _F.col("frequency").cast("int"), _F.col("recency"), _F.col("T"), _F.lit(_O.V6_PARAMS[0]),
        _F.lit(_O.V6_PARAMS[1]), _F.lit(_O.V6_PARAMS[2]), _F.lit(_O.V6_PARAMS[3])) * 1e6) / 1e6).alias("loglik")))(
        V.rfm_summary(V.transactions(m))))
register("V3_fit_gamma_gamma")(_v3)


def _rfm(m):
    return V.rfm_summary(V.transactions(m))


def _clv_fixed(m):
    return V.predict_clv(_rfm(m), V.BGNBDParams(*_O.V6_PARAMS), V.GGParams(*_O.GG_PARAMS), months=12, discount_rate=0.01)


@register("V3_gg_loglik_fixed", "SELECT * FROM v_gg_loglik")
def v3_fixed(m):
    buyers = _rfm(m).where((_F.col("frequency") > 0) & (_F.col("monetary_value") > 0))
    ll = V.gg_loglik(_F.col("frequency"), _F.col("monetary_value"), *[_F.lit(p) for p in _O.GG_PARAMS])
    return buyers.select("empresa_id", (_F.round(ll * 1e6) / 1e6).alias("loglik"))


@register("V5_expected_purchases_fixed", "SELECT * FROM v_expected_30d")
def v5_fixed(m):
    e = V.expected_purchases(_rfm(m), V.BGNBDParams(*_O.V6_PARAMS), 30)
    return e.select("empresa_id", (_F.round(_F.col("expected_purchases") * 1e6) / 1e6).alias("expected_purchases"))


register("V4_predict_clv_fixed", "SELECT * FROM v_clv")(_clv_fixed)
register("V7_segment_by_clv_fixed", "SELECT * FROM v_clv_segments")(lambda m: V.segment_by_clv(_clv_fixed(m), 12, 4))
register("V4_predict_clv")(_v4)
register("V5_expected_purchases_30d")(
    lambda m: V.expected_purchases(_fit_cache(m, "rfm"), _fit_cache(m, "bg")[0], 30))
register("V7_segment_by_clv")(lambda m: V.segment_by_clv(_v4(m), 12, 4))


# ---------------------------------------------------------------- T1/T2: live workshop scores with upsert sink
register("T1_live_workshop_scores", "SELECT * FROM t_live_scores")(
    lambda m: T.run_live_scores(m.spark, m.path_of("avaliacoes")))


# ---------------------------------------------------------------- S2: COPY text bulk format round trip
def _s2(m):
    import uuid

    from loomstat.session import ensure_checkpoint_dir
    from loomstat.sources import copy_text as CT

    src = m.oficinas
    path = ensure_checkpoint_dir(m.spark).rstrip("/") + f"/copy_text/oficinas-{uuid.uuid4().hex}"
    CT.write_copy_text(src, path)
    back = CT.read_copy_text(m.spark, path, src.schema)
    return back.select(
        "id", "razao_social", "nome_fantasia", "cnpj", "email", "telefone", "responsavel", "cidade", "estado", "cep",
        "num_costureiras", "capacidade_mensal", _F.array_join("especialidades", "|").alias("especialidades"),
        _F.size("especialidades").alias("n_especialidades"), _F.array_join("maquinario", "|").alias("maquinario"),
        _F.size("maquinario").alias("n_maquinario"), "tier", "score_qualidade", "score_pontualidade",
        "score_comunicacao", "ativo", "verificado", "created_at")


register("S2_copy_text_roundtrip", "SELECT * FROM s2_roundtrip")(_s2)


# ---------------------------------------------------------------- S4, S5, S7: load and publication
from functools import reduce as _reduce  # noqa: E402

from loomstat.plans import publication as _P  # noqa: E402
from loomstat.sources.binding import SOURCE_TABLES as _TABLES  # noqa: E402


def _loaded(m):
    counts = [m.spark.read.parquet(m.path_of(t)).agg(_F.lit(t).alias("table_name"), _F.count(_F.lit(1)).alias("n_rows")) for t in _TABLES]
    return _reduce(lambda a, b: a.unionByName(b), counts)


def _publication(m):
    """Publish all models, publish again, and count what the second run wrote beside the rows in the files."""
    out = f"{m.published_path}/publication"
    fresh = m.sibling()
    _P.publish(fresh, out, stamp(m.spark, m.sf_dir))
    again = _P.publish(m.sibling(), out)  # without the stamp: every table is digested, no model differs
    rewritten = m.spark.createDataFrame([(k, len(v)) for k, v in again.items()], "model string, rewritten long")
    return _P.summary(m.spark, out).join(rewritten, "model")


register("S4_load_sources", _O.loaded_sql())(_loaded)
register("S5_publish_models", _O.publication_sql())(_publication)


# ---------------------------------------------------------------- A3 at scale: merged sketches beside the exact counts
from loomstat.operators import sketches as _K  # noqa: E402

register("A3_rolling_users_by_sketch", "SELECT * FROM a_rolling_users")(_K.rolling_audit)
