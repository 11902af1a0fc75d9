"""Published marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions import ranks
from loomstat.functions.scalar import as_of_ts, days_between, dround, pct, ratio
from loomstat.operators import intermediate as I
from loomstat.operators import staging as S
from loomstat.operators.intermediate import count_if, money_avg, money_div
from loomstat.session import ensure_checkpoint_dir
from loomstat.operators.model import built
from loomstat.sources.binding import Marketplace

# Fixed values of the scoring mart (weights and bands of the reference).
M4_WEIGHTS = {"qualidade": 0.30, "pontualidade": 0.25, "comunicacao": 0.15,
              "experiencia": 0.15, "certificacoes": 0.10, "velocidade": 0.05}
M4_DEFAULTS = {"qualidade": 3.0, "pontualidade": 3.0, "comunicacao": 3.0,
               "experiencia": 1.0, "certificacoes": 1.0, "velocidade": 3.0}


def _month_label(c):
    return F.date_format(c, "yyyy-MM")


# ------------------------------------------------------------------ M1
@built
def marts_platform_kpis(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """Monthly KPIs. ``liquidez_pct`` follows the glossary definition (published orders
    with at least one bid); the reference computes it with the match-rate formula,
    which stays available as ``match_rate_pct``. All windows run over one row per month."""
    snap = I.int_daily_platform_snapshot(m, as_of)
    now = as_of_ts(as_of or m.as_of)
    mb = snap.where(F.col("dia") <= F.to_date(now)).groupBy(F.date_trunc("month", "dia").alias("mes")).agg(
        F.sum("gmv_dia").alias("gmv"), F.sum("receita_plataforma").alias("receita"),
        F.sum("novos_pedidos").alias("novos_pedidos"), F.sum("pedidos_publicados").alias("pedidos_publicados"),
        F.sum("pedidos_matched").alias("pedidos_matched"), F.sum("pedidos_finalizados").alias("pedidos_finalizados"),
        F.sum("pedidos_cancelados").alias("pedidos_cancelados"), F.sum("propostas_enviadas").alias("propostas_enviadas"),
        F.sum("novas_empresas").alias("novas_empresas"), F.sum("novas_oficinas").alias("novas_oficinas"))
    p = S.stg_pedidos(m)
    bids = S.stg_propostas(m).groupBy(F.col("pedido_id").alias("_b_id")).agg(F.count(F.lit(1)).alias("_nb"))
    published = (F.col("status") == "publicado") | F.col("data_publicacao").isNotNull()
    # orders reduced to (month, brand, matched workshop); from there distinct brands and workshops are row counts
    narrow = (p.join(bids, p.pedido_id == bids._b_id, "left")
              .groupBy(F.date_trunc("month", "dt_criacao").alias("_m"), "empresa_id",
                       F.when(F.col("foi_matched"), F.col("oficina_id")).alias("_of"))
              .agg(count_if(published & (F.col("_nb") >= 1)).alias("n")))
    brands = narrow.groupBy("_m", "empresa_id").agg(F.sum("n").alias("n")).groupBy(F.col("_m").alias("_ma_mes")).agg(
        F.count("empresa_id").alias("empresas_com_pedido"), F.sum("n").alias("publicados_com_proposta"))
    shops = narrow.groupBy("_m", "_of").agg(F.sum("n").alias("n")).groupBy(F.col("_m").alias("_sh_mes")).agg(
        F.count("_of").alias("oficinas_com_pedido"))
    ma = brands.join(shops, brands._ma_mes == shops._sh_mes)  # a row a month
    j = mb.join(ma, mb.mes == ma._ma_mes, "left")
    w = Window.orderBy("mes")
    gmv, prev_gmv = F.col("gmv"), F.lag("gmv").over(w)
    fin, prev_fin = F.col("pedidos_finalizados"), F.lag("pedidos_finalizados").over(w)
    pub = F.col("pedidos_publicados")
    return j.select(
        "mes", _month_label(F.col("mes")).alias("mes_label"),
        F.round(gmv, 2).alias("gmv"), F.round("receita", 2).alias("receita_plataforma"),
        F.when(gmv > 0, dround(ratio(F.col("receita"), gmv) * F.lit(100.0), 2)).alias("take_rate_pct"),
        "novos_pedidos", "pedidos_publicados", "pedidos_matched", "pedidos_finalizados", "pedidos_cancelados",
        F.when(pub > 0, pct(F.coalesce(F.col("publicados_com_proposta"), F.lit(0)), pub)).alias("liquidez_pct"),
        F.when(pub > 0, pct(F.col("pedidos_matched"), pub)).alias("match_rate_pct"),
        F.when(F.col("pedidos_matched") > 0, pct(fin, F.col("pedidos_matched"))).alias("completion_rate_pct"),
        "propostas_enviadas",
        F.when(pub > 0, dround(ratio(F.col("propostas_enviadas"), pub), 2)).alias("propostas_por_pedido"),
        "novas_empresas", "novas_oficinas",
        F.coalesce(F.col("empresas_com_pedido"), F.lit(0)).alias("empresas_ativas"),
        F.coalesce(F.col("oficinas_com_pedido"), F.lit(0)).alias("oficinas_ativas"),
        F.when(fin > 0, money_div(gmv, fin)).alias("gmv_por_pedido"),
        prev_gmv.alias("gmv_mes_anterior"),
        F.when(prev_gmv > 0, dround(ratio(gmv - prev_gmv, prev_gmv) * F.lit(100.0), 2)).alias("gmv_growth_mom_pct"),
        prev_fin.alias("pedidos_mes_anterior"),
        F.when(prev_fin > 0, dround(ratio(fin - prev_fin, prev_fin) * F.lit(100.0), 2)).alias("orders_growth_mom_pct"),
        F.sum(gmv).over(w).alias("gmv_acumulado"),
        (F.col("mes") == F.date_trunc("month", now)).alias("mes_atual"),
    )


# ------------------------------------------------------------------ M2
@built
def marts_customer_journey(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """Funnel per signup cohort. Medians are exact (``percentile_cont``) and computed
    from per-cohort histograms of the day counts, so a large cohort is not one task."""
    fs = I.int_funnel_stages(m, as_of)
    s = F.col("stage_num")
    fc = fs.groupBy("cohort_mes").agg(
        F.countDistinct("empresa_id").alias("n_registered"),
        F.countDistinct(F.when(s >= 2, F.col("empresa_id"))).alias("n_activated"),
        F.countDistinct(F.when(s >= 3, F.col("empresa_id"))).alias("n_matched"),
        F.countDistinct(F.when(s >= 4, F.col("empresa_id"))).alias("n_converted"),
        F.countDistinct(F.when(s >= 5, F.col("empresa_id"))).alias("n_retained"),
        dround(F.avg("dias_signup_para_ativacao"), 1).alias("avg_dias_ativacao"),
        dround(F.avg("dias_ativacao_para_match"), 1).alias("avg_dias_match"),
        dround(F.avg("dias_match_para_conversao"), 1).alias("avg_dias_conversao"),
    )
    # the four medians from one histogram: unpivot (cohort, metric, days), group by (cohort, metric)
    medians = (("dias_signup_para_ativacao", "p50_dias_ativacao"), ("dias_ativacao_para_match", "p50_dias_match"),
               ("dias_match_para_conversao", "p50_dias_conversao"), ("dias_conversao_para_retencao", "p50_dias_retencao"))
    long = fs.where(F.col("cohort_mes").isNotNull()).select("cohort_mes", F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(col).alias("dias")) for col, name in medians])).alias("t")) \
        .select("cohort_mes", "t.metric", "t.dias")
    med = ranks.exact_quantiles(long, ["cohort_mes", "metric"], "dias", {"_p50": 0.5})
    med = med.groupBy("cohort_mes").agg(*[F.max(F.when(F.col("metric") == name, F.col("_p50"))).alias(name)
                                          for _, name in medians])
    fc = fc.join(med, "cohort_mes", "left")
    reg, act, mat, conv, ret = (F.col(c) for c in ("n_registered", "n_activated", "n_matched", "n_converted",
                                                   "n_retained"))
    return fc.select(
        "cohort_mes", _month_label(F.col("cohort_mes")).alias("cohort_label"),
        "n_registered", "n_activated", "n_matched", "n_converted", "n_retained",
        pct(act, reg).alias("pct_ativacao"), pct(mat, reg).alias("pct_match"),
        pct(conv, reg).alias("pct_conversao"), pct(ret, reg).alias("pct_retencao"),
        pct(act, reg).alias("step_signup_to_activation"), pct(mat, act).alias("step_activation_to_match"),
        pct(conv, mat).alias("step_match_to_conversion"), pct(ret, conv).alias("step_conversion_to_retention"),
        (reg - act).alias("dropoff_no_signup"), (act - mat).alias("dropoff_apos_ativacao"),
        (mat - conv).alias("dropoff_apos_match"), (conv - ret).alias("dropoff_apos_conversao"),
        "p50_dias_ativacao", "p50_dias_match", "p50_dias_conversao", "p50_dias_retencao",
        "avg_dias_ativacao", "avg_dias_match", "avg_dias_conversao",
    )


# ------------------------------------------------------------------ M3
@built
def marts_cohort_analysis(m: Marketplace) -> DataFrame:
    """Monthly retention cohorts (the flagship query).

    Plan: non-cancelled orders are aggregated once to (brand, month) with their revenue
    (map-side partial aggregation), joined to the brand's cohort on the brand key with
    the theta condition ``order month >= cohort month`` as a residual, then grouped by
    (cohort, month offset). Each brand contributes one row per active month, so the
    distinct count of the reference is a plain count and no order row is joined twice.
    """
    cb = S.stg_empresas(m).where(F.col("dt_cadastro").isNotNull()).select(
        F.col("empresa_id").alias("_cb_id"), F.date_trunc("month", "dt_cadastro").alias("cohort_mes"))
    sizes = cb.groupBy("cohort_mes").agg(F.count(F.lit(1)).alias("cohort_size"))
    obm = (S.stg_pedidos(m).where(~F.col("foi_cancelado"))
           .groupBy("empresa_id", F.date_trunc("month", "dt_criacao").alias("order_mes"))
           .agg(F.sum("valor_final").alias("_rev")))
    co = obm.join(cb, (obm.empresa_id == cb._cb_id) & (obm.order_mes >= cb.cohort_mes))
    months = (F.year("order_mes") - F.year("cohort_mes")) * 12 + F.month("order_mes") - F.month("cohort_mes")
    g = co.groupBy("cohort_mes", months.alias("mes_n")).agg(
        F.count(F.lit(1)).alias("n_ativos"), F.sum("_rev").alias("_rev"))
    j = g.join(sizes, "cohort_mes")
    return j.select(
        "cohort_mes", _month_label(F.col("cohort_mes")).alias("cohort_label"), "cohort_size", "mes_n", "n_ativos",
        pct(F.col("n_ativos"), F.col("cohort_size")).alias("retention_rate_pct"),
        F.round(F.coalesce(F.col("_rev"), F.lit(0).cast("decimal(22,2)")), 2).alias("receita_cohort"),
    )


# ------------------------------------------------------------------ M4
def m4_composite(prefix: str = "") -> F.Column:
    total = None
    for dim, w in M4_WEIGHTS.items():
        term = F.col(f"{prefix}{dim}") * F.lit(w)
        total = term if total is None else total + term
    return dround(total * F.lit(2.0), 2)


@built
def marts_oficina_scoring(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """Composite workshop score (1–5 dimensions, ×2). Because I2 keeps NULL for
    workshops without ratings or bids, the reference's own defaults apply here
    (3 for rating dimensions, band 1 for an unknown response time).
    PERCENT_RANK runs over the ≤1,001 distinct two-decimal scores (``ranks``)."""
    op = I.int_oficina_performance(m, as_of)
    op = op.where(F.col("nota_qualidade_media").isNotNull() | (F.col("total_avaliacoes") > 0))
    t = F.col("tempo_medio_resposta_h")
    raw = op.select(
        "*",
        F.coalesce(F.col("nota_qualidade_media"), F.lit(M4_DEFAULTS["qualidade"])).alias("d_qualidade"),
        F.coalesce(F.col("nota_pontualidade_media"), F.lit(M4_DEFAULTS["pontualidade"])).alias("d_pontualidade"),
        F.coalesce(F.col("nota_comunicacao_media"), F.lit(M4_DEFAULTS["comunicacao"])).alias("d_comunicacao"),
        F.least(F.lit(5.0), F.lit(1.0) + F.col("total_pedidos").cast("double") / F.lit(12.5)).alias("d_experiencia"),
        F.least(F.lit(5.0), F.lit(1.0) + F.col("score_certificacoes").cast("double") / F.lit(6.0)).alias("d_certificacoes"),
        F.when(t <= 1, 5).when(t <= 4, 4).when(t <= 12, 3).when(t <= 24, 2).otherwise(1).cast("double")
        .alias("d_velocidade"),
    ).withColumn("score_composto", m4_composite("d_"))
    sc = F.col("score_composto")
    scored = raw.select(
        "oficina_id", "nome_fantasia", "estado", "cidade", "tier", "capacidade_mensal_pecas", "score_composto",
        dround(F.col("d_qualidade"), 2).alias("score_qualidade"),
        dround(F.col("d_pontualidade"), 2).alias("score_pontualidade"),
        dround(F.col("d_comunicacao"), 2).alias("score_comunicacao"),
        dround(F.col("d_experiencia"), 2).alias("score_experiencia"),
        dround(F.col("d_certificacoes"), 2).alias("score_certificacoes"),
        F.col("d_velocidade").cast("int").alias("score_velocidade"),
        "total_pedidos", "pedidos_finalizados", "total_avaliacoes", "win_rate_pct", "taxa_aprovacao_media_pct",
        "pct_entrega_no_prazo", "tempo_medio_resposta_h", "total_certificacoes", "tem_abvtex", "tem_cert_premium",
        "ativo_recente",
        F.when(sc >= 8.5, "elite").when(sc >= 7.0, "premium").when(sc >= 5.0, "standard").otherwise("basico")
        .alias("ranking_tier"),
    )
    # the I2 chain runs once: scores are written before they are counted and ranked
    ensure_checkpoint_dir(m.spark)
    out = ranks.percent_rank_by_value(scored.checkpoint(eager=True), "score_composto", "_pr")
    return out.withColumn("percentil_rank", F.col("_pr") * F.lit(100.0)).drop("_pr")


# ------------------------------------------------------------------ M5
@built
def marts_empresa_clv(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """RFM + heuristic CLV. The three quintiles are exact NTILE(5) computed as
    distributed global row numbers (ties broken by brand id)."""
    p = S.stg_pedidos(m)
    now = as_of_ts(as_of or m.as_of)
    fin = F.col("foi_finalizado")
    rfm = p.groupBy("empresa_id").agg(
        days_between(now, F.max("dt_criacao")).alias("recency_days"),
        count_if(fin).alias("frequency"),
        money_avg(F.when(fin, F.col("valor_final"))).alias("monetary_avg"),
        F.round(F.sum(F.when(fin, F.col("valor_final"))), 2).alias("total_spend"),
        F.min(F.when(fin, F.col("dt_criacao"))).alias("first_order_date"),
        F.max(F.when(fin, F.col("dt_criacao"))).alias("last_order_date"),
        (days_between(F.max("dt_criacao"), F.min("dt_criacao")) / F.lit(30.0)).alias("age_months"),
    ).where(F.col("frequency") > 0)
    ensure_checkpoint_dir(m.spark)
    rfm = rfm.checkpoint(eager=True)
    rs = rfm
    for column, order, score in (("recency_days", F.col("recency_days").desc(), "r_score"), ("frequency", F.col("frequency").asc(), "f_score"),
                                 ("monetary_avg", F.col("monetary_avg").asc_nulls_last(), "m_score")):
        # only (value, id) is sorted; the score meets the summary by the id
        part = ranks.ntile(rfm.select(column, "empresa_id"), 5, [order, F.col("empresa_id").asc()], score)
        rs = rs.join(part.select(F.col("empresa_id").alias("_" + score), score), F.col("empresa_id") == F.col("_" + score))
    r, f_, mo = F.col("r_score"), F.col("f_score"), F.col("m_score")
    rec, freq, age = F.col("recency_days"), F.col("frequency"), F.col("age_months")
    rfm_score = dround(r * F.lit(0.3) + f_ * F.lit(0.4) + mo * F.lit(0.3), 2)
    disc = F.when(rec <= 30, 0.85).when(rec <= 90, 0.65).when(rec <= 180, 0.40).otherwise(0.15)
    clv = F.when((age > 0.5) & (freq > 0), dround(
        F.col("monetary_avg").cast("double") * (freq.cast("double") / F.nullif(age, F.lit(0.0))) * F.lit(12.0) * disc, 2))
    cc = rs.select("*", rfm_score.alias("rfm_score"), clv.alias("clv_12m_estimate"),
                   F.when((freq > 1) & (age > 0), dround(age * F.lit(30.0) / (freq - 1).cast("double"), 1))
                   .alias("avg_days_between_orders"))
    e = S.stg_empresas(m).select(F.col("empresa_id").alias("_e_id"), "nome_fantasia", "segmento", "porte", "estado")
    j = cc.join(e, cc.empresa_id == e._e_id)
    rs_ = F.col("rfm_score")
    return j.select(
        "empresa_id", "nome_fantasia", "segmento", "porte", "estado",
        dround(rec, 0).alias("recencia_dias"), F.col("frequency").alias("frequencia"),
        F.col("monetary_avg").alias("ticket_medio"), F.col("total_spend").alias("gasto_total"),
        "r_score", "f_score", "m_score", "rfm_score",
        F.col("clv_12m_estimate").alias("clv_12m_estimado"), F.col("total_spend").alias("clv_historico"),
        F.col("avg_days_between_orders").alias("intervalo_medio_pedidos_dias"),
        "first_order_date", "last_order_date",
        dround(age, 1).alias("antiguidade_meses"),
        F.when(rs_ >= 4.0, "champions").when(rs_ >= 3.5, "loyal_customers")
        .when((rs_ >= 3.0) & (r >= 4), "potential_loyalists").when((rs_ >= 3.0) & (r <= 2), "at_risk")
        .when((r <= 2) & (f_ <= 2), "lost").otherwise("need_attention").alias("rfm_segment"),
        F.when(rec <= 30, 0.05).when(rec <= 90, 0.20).when(rec <= 180, 0.50).otherwise(0.80)
        .alias("prob_churn_estimada"),
    )


# ------------------------------------------------------------------ M6
@built
def marts_match_quality(m: Marketplace) -> DataFrame:
    mp = I.int_match_pairs(m)
    ps = mp.groupBy("empresa_estado", "oficina_estado", "tipo_match_geografico", "empresa_segmento",
                    "oficina_tier").agg(
        F.count(F.lit(1)).alias("total_matches"),
        count_if(F.col("foi_finalizado")).alias("matches_finalizados"),
        money_avg(F.col("match_quality_score")).alias("avg_match_quality"),
        dround(F.avg("avaliacao_nota_geral"), 2).alias("avg_satisfaction"),
        dround(F.avg("quantidade_total"), 0).alias("avg_qty_matched"),
        F.round(F.sum("valor_final"), 2).alias("gmv_matched"),
        count_if(F.col("numero_match_no_par") > 1).alias("repeat_pairs"),
        dround(F.avg("numero_match_no_par"), 2).alias("avg_ordens_por_par"),
    )
    return ps.select(
        "empresa_estado", "oficina_estado", "tipo_match_geografico", "empresa_segmento", "oficina_tier",
        "total_matches", "matches_finalizados",
        pct(F.col("matches_finalizados"), F.col("total_matches")).alias("pct_finalizado"),
        "avg_match_quality", "avg_satisfaction", "avg_qty_matched", "gmv_matched", "repeat_pairs",
        pct(F.col("repeat_pairs"), F.col("total_matches")).alias("pct_repeat"),
        "avg_ordens_por_par",
    )


# ------------------------------------------------------------------ M7
@built
def marts_revenue_analytics(m: Marketplace, as_of: str | None = None, reference_quirks: bool = False) -> DataFrame:
    """Revenue by payment month. Two-level aggregation: (month, method) then month;
    the monthly take rate is the unweighted mean over methods, as in the reference.
    The reference multiplies an already-percent rate by 100 again; that is corrected
    unless ``reference_quirks``."""
    pg = S.stg_pagamentos(m, as_of).where(F.col("foi_pago"))
    rate = F.col("pct_taxa") * F.lit(100) if reference_quirks else F.col("pct_taxa")
    mes = F.date_trunc("month", F.coalesce(F.col("data_pagamento"), F.col("dt_criacao")))
    bruto, met = F.col("valor_bruto"), F.col("metodo")
    mr = pg.groupBy(mes.alias("mes"), "metodo").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bruto).alias("gmv"), F.sum("taxa_plataforma").alias("receita"),
        F.sum("valor_liquido").alias("pago"),
        F.round(F.sum(rate).cast("decimal(28,4)") / F.count(rate).cast("decimal(20,0)"), 8).alias("taxa_media"),
        F.sum(F.when(met == "pix", bruto)).alias("gmv_pix"),
        F.sum(F.when(met == "boleto", bruto)).alias("gmv_boleto"),
        F.sum(F.when(met == "transferencia", bruto)).alias("gmv_transferencia"))
    ma = mr.groupBy("mes").agg(
        F.sum("n").alias("n_pagamentos"), F.sum("gmv").alias("gmv"), F.sum("receita").alias("receita"),
        F.sum("pago").alias("pago"),
        F.round(F.sum("taxa_media") / F.count("taxa_media").cast("decimal(20,0)"), 2).alias("take_rate_real_pct"),
        F.max("gmv_pix").alias("gmv_pix"), F.max("gmv_boleto").alias("gmv_boleto"),
        F.max("gmv_transferencia").alias("gmv_transferencia"))
    ue = S.stg_usuarios(m, as_of).groupBy(F.date_trunc("month", "dt_cadastro").alias("_ue_mes")).agg(
        count_if((F.col("tipo_entidade") == "empresa") & F.col("is_owner")).alias("new_empresas"))
    j = ma.join(ue, ma.mes == ue._ue_mes, "left")
    w = Window.orderBy("mes")
    gmv, rec = F.col("gmv"), F.col("receita")
    prev_gmv, prev_rec = F.lag("gmv").over(w), F.lag("receita").over(w)
    new = F.coalesce(F.col("new_empresas"), F.lit(0))
    zero = F.lit(0).cast("decimal(22,2)")
    return j.select(
        "mes", _month_label(F.col("mes")).alias("mes_label"),
        F.round(gmv, 2).alias("gmv"), F.round(rec, 2).alias("receita_plataforma"),
        F.round("pago", 2).alias("pago_oficinas"), "take_rate_real_pct", "n_pagamentos",
        money_div(gmv, F.col("n_pagamentos")).alias("ticket_medio"),
        pct(F.coalesce(F.col("gmv_pix"), zero), gmv).alias("pct_pix"),
        pct(F.coalesce(F.col("gmv_boleto"), zero), gmv).alias("pct_boleto"),
        pct(F.coalesce(F.col("gmv_transferencia"), zero), gmv).alias("pct_transferencia"),
        new.alias("new_empresas"),
        F.when(new > 0, money_div(rec, new)).alias("receita_por_nova_empresa"),
        prev_gmv.alias("gmv_mes_anterior"),
        pct(gmv - prev_gmv, prev_gmv).alias("gmv_growth_pct"),
        pct(rec - prev_rec, prev_rec).alias("receita_growth_pct"),
        F.sum(gmv).over(w).alias("gmv_acumulado"),
        F.sum(rec).over(w).alias("receita_acumulada"),
    )


# ------------------------------------------------------------------ M8
@built
def marts_geographic_analysis(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """Supply–demand balance per state. Orders are pre-aggregated per brand and
    certificates per workshop before the state-level aggregation, so the distinct
    counts of the reference become sums and no order row fans out through a join."""
    p = S.stg_pedidos(m)
    fin = F.col("foi_finalizado")
    per_brand = p.groupBy(F.col("empresa_id").alias("_pb_id")).agg(
        F.count(F.lit(1)).alias("_n"),
        count_if((F.col("status") == "publicado") | F.col("data_publicacao").isNotNull()).alias("_pub"),
        count_if(F.col("foi_matched")).alias("_mat"),
        F.sum("valor_estimado").alias("_est"),
        F.sum(F.when(fin, F.col("valor_final"))).alias("_gmv"))
    e = S.stg_empresas(m)
    d = e.join(per_brand, e.empresa_id == per_brand._pb_id, "left").groupBy(F.col("estado").alias("d_estado")).agg(
        F.count(F.lit(1)).alias("total_empresas"), count_if(F.col("ativo")).alias("empresas_ativas"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("d_pedidos"), F.coalesce(F.sum("_pub"), F.lit(0)).alias("d_pub"),
        F.coalesce(F.sum("_mat"), F.lit(0)).alias("d_mat"),
        F.round(F.sum("_est"), 2).alias("d_est"), F.round(F.sum("_gmv"), 2).alias("d_gmv"))
    o = S.stg_oficinas(m)
    s = o.groupBy(F.col("estado").alias("s_estado")).agg(
        F.count(F.lit(1)).alias("total_oficinas"), count_if(F.col("ativo")).alias("oficinas_ativas"),
        F.sum("capacidade_mensal_pecas").alias("s_cap"), dround(F.avg("score_medio"), 2).alias("s_score"),
        count_if(F.col("tier") == "ouro").alias("oficinas_ouro"),
        count_if(F.col("tier") == "diamante").alias("oficinas_diamante"))
    certs = S.stg_certificacoes(m, as_of).groupBy(F.col("oficina_id").alias("_c_of")).agg(
        F.count(F.lit(1)).alias("_nc"), F.bool_or(F.col("tipo") == "abvtex").alias("_abv"))
    c = (o.join(certs, o.oficina_id == certs._c_of, "left").groupBy(F.col("estado").alias("c_estado")).agg(
        F.coalesce(F.sum("_nc"), F.lit(0)).alias("c_total"), count_if(F.col("_abv")).alias("c_abvtex")))
    ds = d.join(s, d.d_estado == s.s_estado, "full_outer")
    estado = F.coalesce(F.col("d_estado"), F.col("s_estado"))
    j = ds.join(c, estado == c.c_estado, "left")
    te = F.coalesce(F.col("total_empresas"), F.lit(0))
    to = F.coalesce(F.col("total_oficinas"), F.lit(0))
    pub = F.coalesce(F.col("d_pub"), F.lit(0))
    bal = ratio(to, te)
    zero = F.lit(0).cast("decimal(22,2)")
    return j.select(
        estado.alias("estado"), te.alias("total_empresas"),
        F.coalesce(F.col("empresas_ativas"), F.lit(0)).alias("empresas_ativas"),
        F.coalesce(F.col("d_pedidos"), F.lit(0)).alias("total_pedidos"), pub.alias("pedidos_publicados"),
        F.coalesce(F.col("d_mat"), F.lit(0)).alias("pedidos_matched"),
        F.round(F.coalesce(F.col("d_est"), zero), 2).alias("demanda_estimada_brl"),
        F.round(F.coalesce(F.col("d_gmv"), zero), 2).alias("gmv_estado"),
        to.alias("total_oficinas"), F.coalesce(F.col("oficinas_ativas"), F.lit(0)).alias("oficinas_ativas"),
        F.coalesce(F.col("s_cap"), F.lit(0)).alias("capacidade_mensal_pecas"),
        F.coalesce(F.col("s_score"), F.lit(0.0)).alias("score_medio_oficinas"),
        F.coalesce(F.col("oficinas_ouro"), F.lit(0)).alias("oficinas_ouro"),
        F.coalesce(F.col("oficinas_diamante"), F.lit(0)).alias("oficinas_diamante"),
        F.coalesce(F.col("c_total"), F.lit(0)).alias("total_certificacoes"),
        F.coalesce(F.col("c_abvtex"), F.lit(0)).alias("oficinas_abvtex"),
        F.when(te > 0, dround(ratio(to, te), 2)).alias("ratio_oficinas_por_empresa"),
        F.when(pub > 0, pct(F.col("d_mat"), F.col("d_pub"))).alias("match_rate_pct"),
        F.when(to == 0, "sem_oferta").when(te == 0, "sem_demanda").when(bal >= 3, "excesso_oferta")
        .when(bal >= 1.5, "equilibrado").when(bal >= 0.5, "escassez_leve").otherwise("escassez_critica")
        .alias("balanco_mercado"),
    )


# ------------------------------------------------------------------ M9
@built
def v_platform_summary(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """One-row health snapshot: global aggregates over the source tables as scalar subqueries (A10)."""
    e = m.empresas.where(F.col("deleted_at").isNull() & F.col("ativo")).agg(F.count(F.lit(1))).scalar()
    o = m.oficinas.where(F.col("deleted_at").isNull() & F.col("ativo")).agg(F.count(F.lit(1))).scalar()
    p = m.pedidos.agg(F.struct(count_if(F.col("deleted_at").isNull()).alias("total_pedidos"),
                               count_if(F.col("status") == "finalizado").alias("pedidos_finalizados"))).scalar()
    pg = m.pagamentos.where(F.col("status") == "pago").agg(F.struct(
        F.coalesce(F.sum("valor_bruto"), F.lit(0).cast("decimal(22,2)")).alias("gmv_total"),
        F.coalesce(F.sum("taxa_plataforma"), F.lit(0).cast("decimal(22,2)")).alias("receita_total"))).scalar()
    return m.spark.range(1).select(
        e.alias("total_empresas_ativas"), o.alias("total_oficinas_ativas"),
        p.getField("total_pedidos").alias("total_pedidos"), p.getField("pedidos_finalizados").alias("pedidos_finalizados"),
        pg.getField("gmv_total").alias("gmv_total"), pg.getField("receita_total").alias("receita_total"),
        as_of_ts(as_of or m.as_of).alias("snapshot_at"))


# ------------------------------------------------------------------ M10
def demand_supply_by_state(m: Marketplace) -> DataFrame:
    """Per brand state: brands with published orders, published and locally matched
    orders, and active workshops of the state. The reference's correlated subquery
    is written as an aggregate of supply joined on the state."""
    p = S.stg_pedidos(m).where(F.col("data_publicacao").isNotNull())
    per_brand = p.groupBy(F.col("empresa_id").alias("_pb_id")).agg(
        F.count(F.lit(1)).alias("_n"), count_if(F.col("foi_matched")).alias("_mat"))
    e = S.stg_empresas(m)
    d = e.join(per_brand, e.empresa_id == per_brand._pb_id, "left").groupBy("estado").agg(
        count_if(F.col("_n") > 0).alias("empresas_com_pedidos"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_pedidos_publicados"),
        F.coalesce(F.sum("_mat"), F.lit(0)).alias("pedidos_matched_local"))
    sup = S.stg_oficinas(m).where(F.col("ativo")).groupBy(F.col("estado").alias("_s_estado")).agg(
        F.count(F.lit(1)).alias("_s_n"))
    j = d.join(sup, d.estado == sup._s_estado, "left")
    return j.select("estado", "empresas_com_pedidos", "total_pedidos_publicados", "pedidos_matched_local",
                    F.coalesce(F.col("_s_n"), F.lit(0)).alias("oficinas_ativas_local"))
