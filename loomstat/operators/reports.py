"""D1–D19 report computations (the dashboard pages' numbers, without charts) and G4.

Reports read the published marts; every one is a small aggregate or a top-n over a
mart, so it is cheap once the marts are materialised (``loomstat.sources.io.publish``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.scalar import clip01, dround, ratio
from loomstat.operators import intermediate as I
from loomstat.operators import staging as S
from loomstat.operators.intermediate import count_if
from loomstat.sources.binding import Marketplace

TIER_ORDER = ["elite", "premium", "standard", "basico"]


def _pct1(num, den):
    return dround(ratio(num, den) * F.lit(100.0), 1)


# ---------------------------------------------------------------- G4
def open_orders(m: Marketplace) -> DataFrame:
    """Open-order input of the matcher: published, not matched, not cancelled, with the
    brand's state (the reference's ``estado_preferencia`` does not exist: brand state)."""
    p = S.stg_pedidos(m).where((F.col("status") == "publicado") & ~F.col("foi_matched") & ~F.col("foi_cancelado"))
    e = S.stg_empresas(m).select(F.col("empresa_id").alias("_e_id"), F.col("estado").alias("empresa_estado"),
                                 F.col("segmento").alias("empresa_segmento"), F.col("porte").alias("empresa_porte"))
    return p.join(e, p.empresa_id == e._e_id).select(
        "pedido_id", "empresa_id", "categoria_id", "quantidade_total", "valor_estimado", "empresa_estado",
        "empresa_segmento", "empresa_porte")


def available_oficinas(m: Marketplace, as_of: str | None = None) -> DataFrame:
    """Supply input of the matcher: recently active workshops (I2) with their stored scores."""
    perf = I.int_oficina_performance(m, as_of).where(F.col("ativo_recente"))
    stored = S.stg_oficinas(m).select(F.col("oficina_id").alias("_s_id"), "score_medio", "score_qualidade",
                                      "score_pontualidade")
    return perf.join(stored, perf.oficina_id == stored._s_id).select(
        "oficina_id", "estado", "cidade", "capacidade_mensal_pecas", "score_medio", "score_qualidade",
        "score_pontualidade", "win_rate_pct", "pct_entrega_no_prazo", "tempo_medio_resposta_h", "tem_abvtex",
        "tem_cert_premium", "tier")


def supply_demand_gaps(orders: DataFrame, supply: DataFrame) -> DataFrame:
    """Per state: open orders, local workshops, their capacity; supply ratio and gap score.
    Three grouped series joined full-outer on the state and zero-filled (J8)."""
    d = orders.where(F.col("empresa_estado").isNotNull()).groupBy(F.col("empresa_estado").alias("estado")).agg(
        F.count(F.lit(1)).alias("n_open_pedidos"))
    s = supply.where(F.col("estado").isNotNull()).groupBy("estado").agg(
        F.count(F.lit(1)).alias("n_local_oficinas"), F.sum("capacidade_mensal_pecas").alias("capacidade_total"))
    g = d.join(s, "estado", "full_outer").na.fill(0, ["n_open_pedidos", "n_local_oficinas", "capacidade_total"])
    ratio_ = dround(F.col("n_local_oficinas").cast("double") / (F.col("n_open_pedidos") + 1).cast("double"), 3)
    return g.select("estado", "n_open_pedidos", "n_local_oficinas", "capacidade_total", ratio_.alias("supply_ratio")) \
        .withColumn("gap_score", dround((F.lit(1.0) - clip01(F.col("supply_ratio"))) * F.lit(100.0), 1))


# ---------------------------------------------------------------- overview
def headline_totals(kpis: DataFrame) -> DataFrame:
    """Total GMV and revenue, mean match rate, peak active brands and workshops."""
    return kpis.agg(F.round(F.sum("gmv"), 2).alias("gmv_total"), F.round(F.sum("receita_plataforma"), 2)
                    .alias("receita_total"), dround(F.avg("match_rate_pct"), 2).alias("match_rate_medio"),
                    F.max("empresas_ativas").alias("empresas_ativas_max"),
                    F.max("oficinas_ativas").alias("oficinas_ativas_max"))


def latest_vs_previous(kpis: DataFrame) -> DataFrame:
    """Latest month against the previous one (relative change for volumes, points for rates)."""
    w = Window.orderBy("mes")
    k = kpis.select("mes", "gmv", "empresas_ativas", "oficinas_ativas", "match_rate_pct", "completion_rate_pct",
                    F.lag("gmv").over(w).alias("_g"), F.lag("empresas_ativas").over(w).alias("_e"),
                    F.lag("oficinas_ativas").over(w).alias("_o"), F.lag("match_rate_pct").over(w).alias("_m"),
                    F.lag("completion_rate_pct").over(w).alias("_c"),
                    F.row_number().over(Window.orderBy(F.col("mes").desc())).alias("_rn"))

    def rel(cur, prev):
        return F.when(F.col(prev) > 0, dround(ratio(F.col(cur) - F.col(prev), F.col(prev)) * F.lit(100.0), 1))

    return k.where(F.col("_rn") == 1).select(
        "mes", rel("gmv", "_g").alias("gmv_delta_pct"), rel("empresas_ativas", "_e").alias("empresas_delta_pct"),
        rel("oficinas_ativas", "_o").alias("oficinas_delta_pct"),
        dround(F.col("match_rate_pct") - F.col("_m"), 2).alias("match_rate_delta_pp"),
        dround(F.col("completion_rate_pct") - F.col("_c"), 2).alias("completion_rate_delta_pp"))


def order_stages_by_month(kpis: DataFrame) -> DataFrame:
    """D3: published / matched / finalised orders per month, long form."""
    return kpis.select("mes", F.explode(F.array(
        F.struct(F.lit("publicados").alias("etapa"), F.col("pedidos_publicados").alias("pedidos")),
        F.struct(F.lit("matched").alias("etapa"), F.col("pedidos_matched").alias("pedidos")),
        F.struct(F.lit("finalizados").alias("etapa"), F.col("pedidos_finalizados").alias("pedidos")))).alias("s")
    ).select("mes", "s.*")


def last_months(kpis: DataFrame, n: int = 6) -> DataFrame:
    """The last n months (top-n by month, a TakeOrderedAndProject)."""
    return kpis.orderBy(F.col("mes").desc()).limit(n)


# ---------------------------------------------------------------- demand
def brands_per_segment(clv: DataFrame) -> DataFrame:
    """D6."""
    return clv.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("n_empresas"))


def top_brands_by_clv(clv: DataFrame, n: int = 50) -> DataFrame:
    """Top n brands by 12-month CLV estimate (NULLs last, ties by id)."""
    return clv.orderBy(F.col("clv_12m_estimado").desc_nulls_last(), F.col("empresa_id")).limit(n).select(
        "empresa_id", "nome_fantasia", "estado", "rfm_segment", "clv_12m_estimado", "clv_historico")


# ---------------------------------------------------------------- supply
def supply_kpis(scoring: DataFrame) -> DataFrame:
    """D9 (uses the mart's ``ranking_tier``; the reference's page tests a column it lacks)."""
    return scoring.agg(F.count(F.lit(1)).alias("n_oficinas"), dround(F.avg("score_composto"), 2).alias("score_medio"),
                       _pct1(count_if(F.col("ranking_tier").isin("elite", "premium")), F.count(F.lit(1)))
                       .alias("pct_elite_premium"),
                       _pct1(count_if(F.col("tem_abvtex")), F.count(F.lit(1))).alias("pct_abvtex"))


def tier_counts(scoring: DataFrame) -> DataFrame:
    """Workshops per ranking tier in the fixed tier order, zero rows included."""
    tiers = scoring.sparkSession.createDataFrame([(i, t) for i, t in enumerate(TIER_ORDER)],
                                                 "tier_idx int, ranking_tier string")
    c = scoring.groupBy("ranking_tier").agg(F.count(F.lit(1)).alias("_n"))
    return F.broadcast(tiers).join(c, "ranking_tier", "left").select(
        "tier_idx", "ranking_tier", F.coalesce(F.col("_n"), F.lit(0)).alias("n_oficinas"))


def workshops_by_state(scoring: DataFrame) -> DataFrame:
    """D11."""
    return scoring.where(F.col("estado").isNotNull()).groupBy("estado").agg(
        F.count(F.lit(1)).alias("n_oficinas"), dround(F.avg("score_composto"), 2).alias("score_medio"))


def ranked_workshops(scoring: DataFrame, tiers: list[str] | None = None, score_range: tuple[float, float] = (0.0, 10.0),
                     states: list[str] | None = None, n: int = 100) -> DataFrame:
    """Optional multi-select filters (empty = all, F10), closed score range (F4), top n."""
    s = scoring
    if tiers:
        s = s.where(F.col("ranking_tier").isin(*tiers))
    if states:
        s = s.where(F.col("estado").isin(*states))
    s = s.where(F.col("score_composto").between(score_range[0], score_range[1]))
    return s.orderBy(F.col("score_composto").desc(), F.col("oficina_id")).limit(n).select(
        "oficina_id", "nome_fantasia", "estado", "ranking_tier", "score_composto", "percentil_rank")


# ---------------------------------------------------------------- matching
def match_kpis(mq: DataFrame) -> DataFrame:
    """Means over the match-quality groups, and the share of interstate groups."""
    return mq.agg(dround(F.avg("pct_finalizado"), 2).alias("pct_finalizado_medio"),
                  dround(F.avg("avg_match_quality"), 2).alias("match_quality_medio"),
                  dround(F.avg("pct_repeat"), 2).alias("pct_repeat_medio"),
                  _pct1(count_if(F.col("tipo_match_geografico") == "interestadual"), F.count(F.lit(1)))
                  .alias("pct_grupos_interestaduais"))


def matches_by_geo(mq: DataFrame) -> DataFrame:
    """D15."""
    return mq.groupBy("tipo_match_geografico").agg(F.sum("total_matches").alias("total_matches"))


def matched_gmv_by_state(mq: DataFrame) -> DataFrame:
    """D16."""
    return mq.where(F.col("empresa_estado").isNotNull()).groupBy("empresa_estado").agg(
        F.round(F.sum("gmv_matched"), 2).alias("gmv_matched"))


def gap_by_state(geo: DataFrame, gaps: DataFrame) -> DataFrame:
    """Geographic balance with the matcher's gap score (M8 ⟕ G4 on the state)."""
    g = gaps.select(F.col("estado").alias("_g_estado"), "supply_ratio", "gap_score")
    return geo.join(g, geo.estado == g._g_estado, "left").select(
        "estado", "balanco_mercado", "ratio_oficinas_por_empresa", "supply_ratio", "gap_score")


# ---------------------------------------------------------------- financial
def financial_kpis(rev: DataFrame) -> DataFrame:
    """Totals and means over the revenue mart."""
    return rev.agg(F.round(F.sum("gmv"), 2).alias("gmv_total"), F.round(F.sum("receita_plataforma"), 2)
                   .alias("receita_total"), dround(F.avg("take_rate_real_pct"), 2).alias("take_rate_medio"),
                   dround(F.avg("ticket_medio"), 2).alias("ticket_medio"))


def gmv_mom(rev: DataFrame) -> DataFrame:
    """Month-over-month GMV change (pandas ``pct_change``: NULL for the first month)."""
    w = Window.orderBy("mes")
    prev = F.lag("gmv").over(w)
    return rev.select("mes", "gmv", dround(ratio(F.col("gmv") - prev, prev) * F.lit(100.0), 2).alias("gmv_mom_pct"))


def payment_mix(rev: DataFrame) -> DataFrame:
    """Mean share of each payment method across months."""
    m = rev.agg(*[dround(F.avg(f"pct_{k}"), 2).alias(k) for k in ("pix", "boleto", "transferencia")])
    return m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metodo"), F.col(k).alias("pct_medio"))
                                         for k in ("pix", "boleto", "transferencia")])).alias("s")).select("s.*")


# ---------------------------------------------------------------- D5, D7, D13
def demand_kpis(clv: DataFrame) -> DataFrame:
    """Brands, exact median 12-month CLV, champions share, activation share (% with
    at least one completed order). The reference's page tests a segment label the mart
    never emits; the mart's label (``champions``) is used."""
    from loomstat.functions.ranks import global_quantiles

    k = clv.agg(F.count(F.lit(1)).alias("total_empresas"),
                _pct1(count_if(F.col("rfm_segment") == "champions"), F.count(F.lit(1))).alias("champions_pct"),
                _pct1(count_if(F.col("frequencia") > 0), F.count(F.lit(1))).alias("activation_rate"))
    med = global_quantiles(clv, "clv_12m_estimado", {"median_clv": 0.5})  # refined histograms, one row
    return k.withColumn("median_clv", med.scalar())


def recency_frequency(clv: DataFrame) -> DataFrame:
    """Recency, frequency, spend and segment of every brand of the CLV mart (how many a chart draws is the chart's choice)."""
    return clv.select("empresa_id", "recencia_dias", "frequencia", "gasto_total", "rfm_segment")


def journey_kpis(funnel: DataFrame) -> DataFrame:
    """% of the top of the funnel reaching each later stage, as one row."""
    return funnel.agg(*[F.max(F.when(F.col("stage") == s, F.col("pct_of_top"))).alias(f"taxa_{lbl}")
                        for s, lbl in (("activated", "ativacao"), ("matched", "match"), ("converted", "conversao"),
                                       ("retained", "retencao"))])
