"""Analytics operations over the models: funnel (C*), cohorts (K*) and workshop scoring (R*).

Every operation takes a DataFrame (as the reference classes take an optional
pandas frame) and returns a DataFrame; small tables such as the 5-stage funnel
are produced by one global aggregate followed by an unpivot, never by driver loops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions import ranks
from loomstat.functions.scalar import dround, ratio
from loomstat.operators.intermediate import count_if, money_avg, money_div

# Funnel stages and their labels, in order.
STAGES = ["registered", "activated", "matched", "converted", "retained"]
STAGE_LABELS = {
    "registered": "Cadastrado",
    "activated": "Ativado (1º pedido publicado)",
    "matched": "Matched (proposta aceita)",
    "converted": "Convertido (pedido finalizado)",
    "retained": "Retido (2º+ pedido)",
}
TRANSITIONS = [
    ("signup → ativação", "dias_signup_para_ativacao"),
    ("ativação → match", "dias_ativacao_para_match"),
    ("match → conversão", "dias_match_para_conversao"),
    ("conversão → retenção", "dias_conversao_para_retencao"),
]
TIER_ORDER = ["elite", "premium", "standard", "basico"]


def _pct1(num, den):
    return dround(ratio(num, den) * F.lit(100.0), 1)


# ================================================================ funnel
def _stage_table(spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, s, STAGE_LABELS[s]) for i, s in enumerate(STAGES)],
                                 "stage_idx int, stage string, stage_label string")


def funnel_summary(df: DataFrame) -> DataFrame:
    """Count of brands at or beyond each stage, % of top, % of previous stage."""
    counts = df.agg(*[count_if(F.col("stage_num") >= i + 1).alias(f"c{i + 1}") for i in range(len(STAGES))])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("stage_idx"), F.col(f"c{i + 1}").alias("count"))
                                             for i in range(len(STAGES))])).alias("s")).select("s.*")
    st = _stage_table(df.sparkSession)
    w = Window.orderBy("stage_idx")
    top = F.first("count").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (long.join(F.broadcast(st), "stage_idx")
            .select("stage_idx", "stage", "stage_label", "count",
                    _pct1(F.col("count"), top).alias("pct_of_top"),
                    _pct1(F.col("count"), F.lag("count").over(w)).alias("conversion_from_prev")))


def time_to_convert(df: DataFrame) -> DataFrame:
    """Per stage transition: n, median, p25, p75 and mean days (1 decimal; NULL when empty)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(lbl).alias("transicao"),
                                                  F.col(c).cast("double").alias("dias"))
                                         for i, (lbl, c) in enumerate(TRANSITIONS)])).alias("t")).select("t.*")
    labels = df.sparkSession.createDataFrame([(i, lbl) for i, (lbl, _) in enumerate(TRANSITIONS)],
                                             "ord int, transicao string")
    base = long.groupBy("ord", "transicao").agg(F.count("dias").alias("n"), F.avg("dias").alias("_mean"))
    q = ranks.exact_quantiles(long, ["ord", "transicao"], "dias", {"_p50": 0.5, "_p25": 0.25, "_p75": 0.75})
    out = F.broadcast(labels).join(base, ["ord", "transicao"], "left").join(q, ["ord", "transicao"], "left")
    return out.select("ord", "transicao", F.coalesce(F.col("n"), F.lit(0)).alias("n"),
                      dround(F.col("_p50"), 1).alias("mediana_dias"), dround(F.col("_p25"), 1).alias("p25_dias"),
                      dround(F.col("_p75"), 1).alias("p75_dias"), dround(F.col("_mean"), 1).alias("media_dias"))


def funnel_by_segment(df: DataFrame) -> DataFrame:
    """C1 per segment in long form (segments with a NULL name are dropped, as pandas does)."""
    g = df.where(F.col("segmento").isNotNull()).groupBy("segmento").agg(
        F.count(F.lit(1)).alias("_total"),
        *[count_if(F.col("stage_num") >= i + 1).alias(f"c{i + 1}") for i in range(len(STAGES))])
    long = g.select("segmento", "_total", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("stage_idx"), F.lit(s).alias("stage"), F.col(f"c{i + 1}").alias("count"))
        for i, s in enumerate(STAGES)])).alias("s")).select("segmento", "_total", "s.*")
    return long.select("segmento", "stage_idx", "stage", "count",
                       F.coalesce(_pct1(F.col("count"), F.col("_total")), F.lit(0.0)).alias("pct_of_segment"))


def drop_off_analysis(df: DataFrame) -> DataFrame:
    """C4: brands lost between consecutive stages and the share lost."""
    s = funnel_summary(df)
    w = Window.orderBy("stage_idx")
    prev_stage, prev_count = F.lag("stage").over(w), F.lag("count").over(w)
    t = s.select("stage_idx", F.concat(prev_stage, F.lit(" → "), F.col("stage")).alias("transition"),
                 (prev_count - F.col("count")).alias("lost"), prev_count.alias("_prev"))
    return t.where(F.col("_prev").isNotNull()).select(
        "transition", "lost",
        F.when(F.col("_prev") > 0, _pct1(F.col("lost"), F.col("_prev"))).otherwise(F.lit(0.0)).alias("drop_pct"))


def cohort_funnel(df: DataFrame, cohort_col: str = "cohort_mes") -> DataFrame:
    """Per cohort, number of brands and % reaching each stage."""
    g = df.where(F.col(cohort_col).isNotNull()).groupBy(F.col(cohort_col).alias("cohort_mes")).agg(
        F.count(F.lit(1)).alias("n_empresas"),
        *[count_if(F.col("stage_num") >= i + 1).alias(f"_c{i + 1}") for i in range(len(STAGES))])
    return g.select("cohort_mes", "n_empresas",
                    *[_pct1(F.col(f"_c{i + 1}"), F.col("n_empresas")).alias(f"pct_{s}") for i, s in enumerate(STAGES)])


def gmv_by_stage(df: DataFrame) -> DataFrame:
    """N, mean and total GMV per current stage among converted and retained brands."""
    c = df.where(F.col("stage_num") >= 4).where(F.col("current_stage").isNotNull())
    g = F.col("gmv_total")
    return c.groupBy("current_stage").agg(
        F.count(g).alias("n"), money_avg(g).alias("avg_gmv"), F.round(F.sum(g), 2).alias("total_gmv"))


# ================================================================ cohorts (K1-K6)
def _all_months(df: DataFrame, months: list[int] | None) -> tuple[DataFrame, list[int]]:
    """``df``, failing where a month offset has no column (a matrix never drops a month silently), and the columns: the
    offsets that occur unless given (months of the calendar, so few)."""
    if months is None:
        return df, [r[0] for r in df.select("mes_n").distinct().orderBy("mes_n").collect()]
    known = F.col("mes_n").isin(*months)
    return df.withColumn("mes_n", F.when(known | F.col("mes_n").isNull(), F.col("mes_n")).otherwise(
        F.raise_error(F.concat(F.lit("no matrix column for month "), F.col("mes_n").cast("string"))))), months


def retention_matrix(df: DataFrame, months: list[int] | None = None) -> DataFrame:
    """K1: cohort × month-offset matrix of retention %, 1 decimal; missing cells stay NULL. One column per entry of ``months``."""
    df, months = _all_months(df, months)
    p = df.groupBy("cohort_label").pivot("mes_n", months).agg(F.max("retention_rate_pct"))
    return p.select("cohort_label", *[dround(F.col(str(mn)), 1).alias(str(mn)) for mn in months])


def revenue_matrix(df: DataFrame, months: list[int] | None = None) -> DataFrame:
    """K2: cohort × month-offset revenue matrix, missing cells 0, 2 decimals. One column per entry of ``months``."""
    df, months = _all_months(df, months)
    p = df.groupBy("cohort_label").pivot("mes_n", months).agg(F.max("receita_cohort"))
    return p.select("cohort_label", *[F.round(F.coalesce(F.col(str(mn)), F.lit(0).cast("decimal(22,2)")), 2)
                                      .alias(str(mn)) for mn in months])


def average_retention_curve(df: DataFrame) -> DataFrame:
    """K3: mean, median and number of observed cohorts per month offset."""
    g = df.groupBy("mes_n").agg(dround(F.avg("retention_rate_pct"), 2).alias("avg_retention"),
                                F.count("cohort_label").alias("n_cohorts"))
    med = ranks.exact_quantiles(df, ["mes_n"], "retention_rate_pct", {"_med": 0.5})
    return g.join(med, "mes_n", "left").select("mes_n", "avg_retention", dround(F.col("_med"), 2)
                                               .alias("median_retention"), "n_cohorts")


def cohort_summary(df: DataFrame) -> DataFrame:
    """K4: per cohort: size, retention at months 0/1/3/6 (NULL when not observed), revenue."""
    r = F.col("retention_rate_pct")
    return df.groupBy(F.col("cohort_label").alias("cohort")).agg(
        F.first("cohort_size").alias("cohort_size"),
        *[dround(F.max(F.when(F.col("mes_n") == k, r)), 1).alias(f"retention_m{k}") for k in (0, 1, 3, 6)],
        F.round(F.sum("receita_cohort"), 2).alias("receita_total"),
        money_avg(F.col("receita_cohort")).alias("receita_media_mensal"),
        F.max("mes_n").alias("meses_observados"))


def ltv_by_cohort(df: DataFrame, horizon_months: int = 12) -> DataFrame:
    """K5: revenue up to the horizon (inclusive), total and per member."""
    g = df.where(F.col("mes_n") <= horizon_months).groupBy("cohort_label", "cohort_size").agg(
        F.sum("receita_cohort").alias("ltv_total"))
    return g.select("cohort_label", "cohort_size", "ltv_total",
                    money_div(F.col("ltv_total"), F.col("cohort_size")).alias("ltv_per_empresa"))


def best_and_worst_cohorts(df: DataFrame, metric: str = "retention_m3") -> DataFrame:
    """K6: cohort labels at the max and min of a K4 column (first label on ties); NULLs if none."""
    s = cohort_summary(df).where(F.col(metric).isNotNull())
    m = F.col(metric).cast("double")
    return s.agg(F.min_by("cohort", F.struct(-m, F.col("cohort"))).alias("best"),
                 F.min_by("cohort", F.struct(m, F.col("cohort"))).alias("worst"))


# ================================================================ scoring
@dataclass(frozen=True)
class ScoringWeights:
    qualidade: float = 0.30
    pontualidade: float = 0.25
    comunicacao: float = 0.15
    experiencia: float = 0.15
    certificacoes: float = 0.10
    velocidade: float = 0.05

    def __post_init__(self) -> None:
        total = sum(self.as_dict().values())
        if abs(total - 1.0) > 0.001:
            raise ValueError(f"Weights must sum to 1.0, got {total:.4f}")

    def as_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("qualidade", "pontualidade", "comunicacao", "experiencia",
                                              "certificacoes", "velocidade")}


DIMENSIONS = list(ScoringWeights().as_dict())
SCORE_OUTPUT = ["oficina_id", "nome_fantasia", "estado", "cidade", "tier", "capacidade_mensal_pecas", "total_pedidos",
                "total_avaliacoes", "score_qualidade", "score_pontualidade", "score_comunicacao", "score_experiencia",
                "score_certificacoes", "score_velocidade", "score_composto", "ranking_tier", "percentil_rank",
                "win_rate_pct", "pct_entrega_no_prazo", "tempo_medio_resposta_h", "tem_abvtex", "tem_cert_premium",
                "ativo_recente"]


def _rating_dim(df: DataFrame, live: str, stored: str) -> F.Column:
    n = F.coalesce(F.col("total_avaliacoes"), F.lit(0)) if "total_avaliacoes" in df.columns else F.lit(0)
    live_c = F.col(live) if live in df.columns else F.lit(None).cast("double")
    stored_c = F.col(stored) if stored in df.columns else F.lit(None).cast("double")
    return (F.when((n >= 3) & live_c.isNotNull(), live_c.cast("double") * 2.0)
            .when(stored_c.isNotNull(), stored_c.cast("double") * 2.0).otherwise(F.lit(6.0)))


def _composite(weights: ScoringWeights) -> F.Column:
    total = None
    for dim, w in weights.as_dict().items():
        term = F.col(f"score_{dim}") * F.lit(w)
        total = term if total is None else total + term
    return dround(total, 2)


def _with_dimensions(df: DataFrame) -> DataFrame:
    t = F.col("tempo_medio_resposta_h").cast("double")
    return df.withColumns({
        "score_qualidade": _rating_dim(df, "nota_qualidade_media", "score_qualidade_media"),
        "score_pontualidade": _rating_dim(df, "nota_pontualidade_media", "score_pontualidade_media"),
        "score_comunicacao": _rating_dim(df, "nota_comunicacao_media", "score_comunicacao_media"),
        "score_experiencia": F.least(F.lit(10.0), F.coalesce(F.col("total_pedidos").cast("double"), F.lit(0.0)) / 5.0),
        "score_certificacoes": F.least(F.lit(10.0), F.coalesce(F.col("score_certificacoes").cast("double"),
                                                              F.lit(0.0)) * 2.0),
        "score_velocidade": F.when(t.isNull(), 5.0).when(t <= 1, 10.0).when(t <= 4, 8.0).when(t <= 12, 6.0)
        .when(t <= 24, 4.0).otherwise(2.0),
    })


def _tier(c: F.Column) -> F.Column:
    return F.when(c >= 8.5, "elite").when(c >= 7.0, "premium").when(c >= 5.0, "standard").otherwise("basico")


def pandas_pct_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Pandas ``rank(pct=True)`` (average ties) ×100, 1 decimal, for a bounded value domain."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    r = counts.select(value, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_below"), "_c",
                      F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_n"))
    r = r.select(value, dround(((F.col("_below") + (F.col("_c") + 1) / 2.0) / F.col("_n")) * 100.0, 1).alias(out))
    return df.join(r, value, "left")


def compute_scores(df: DataFrame, weights: ScoringWeights | None = None) -> DataFrame:
    """Six 0–10 dimensions, weighted composite (2 decimals), tier, percentile rank.
    Not the same formula as the scoring mart (M4), as in the reference."""
    w = weights or ScoringWeights()
    scored = _with_dimensions(df)
    scored = scored.withColumn("score_composto", _composite(w))
    scored = scored.withColumn("ranking_tier", _tier(F.col("score_composto")))
    scored = pandas_pct_rank(scored, "score_composto", "percentil_rank")
    return scored.select(*[c for c in SCORE_OUTPUT if c in scored.columns])


def ranked_oficinas(df: DataFrame, estado: str | None = None, min_score: float = 0.0, limit: int = 50,
                    weights: ScoringWeights | None = None) -> DataFrame:
    """R2: filter by state and minimum score, top ``limit`` by score (ties by id).
    The percentile is computed before filtering."""
    s = compute_scores(df, weights)
    if estado:
        s = s.where(F.col("estado") == estado)
    s = s.where(F.col("score_composto") >= min_score)
    return s.orderBy(F.col("score_composto").desc(), F.col("oficina_id").asc()).limit(limit)


def explain_scores(df: DataFrame, weights: ScoringWeights | None = None) -> DataFrame:
    """R3 for every workshop: one row per dimension with score, weight and contribution."""
    w = weights or ScoringWeights()
    s = compute_scores(df, w)
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), dround(F.col(f"score_{d}"), 2).alias("score"),
                              F.lit(float(wt)).alias("weight"),
                              dround(F.col(f"score_{d}") * F.lit(float(wt)), 3).alias("contribution"))
                     for d, wt in w.as_dict().items()])
    return s.select("oficina_id", "nome_fantasia", "score_composto", "ranking_tier", "percentil_rank",
                    F.explode(dims).alias("d")).select("oficina_id", "nome_fantasia", "score_composto", "ranking_tier",
                                                       "percentil_rank", "d.*")


def explain_score(df: DataFrame, oficina_id, weights: ScoringWeights | None = None) -> DataFrame:
    """R3 for one workshop; raises ValueError when the id is absent."""
    out = explain_scores(df, weights).where(F.col("oficina_id") == F.lit(oficina_id))
    if out.limit(1).count() == 0:
        raise ValueError(f"Oficina '{oficina_id}' not found in scored data")
    return out


def _desc_rank_int(df: DataFrame, value: str, out: str) -> DataFrame:
    """Pandas rank(ascending=False) with average ties, truncated to int."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    r = counts.select(value, F.floor(F.coalesce(F.sum("_c").over(w), F.lit(0)) + (F.col("_c") + 1) / 2.0)
                      .cast("int").alias(out))
    return df.join(r, value, "left")


def compare_weights(df: DataFrame, alt: ScoringWeights, current: ScoringWeights | None = None) -> DataFrame:
    """Both composite scores in one pass, their delta, ranks under each and the rank change."""
    cur = current or ScoringWeights()
    d = _with_dimensions(df).select("oficina_id", _composite(cur).alias("score_current"),
                                    _composite(alt).alias("score_alt"))
    d = d.withColumn("score_delta", dround(F.col("score_alt") - F.col("score_current"), 3))
    d = _desc_rank_int(d, "score_current", "rank_current")
    d = _desc_rank_int(d, "score_alt", "rank_alt")
    return d.withColumn("rank_delta", F.col("rank_current") - F.col("rank_alt"))


def tier_distribution(df: DataFrame, weights: ScoringWeights | None = None) -> DataFrame:
    """Count and % per ranking tier, all four tiers present."""
    s = compute_scores(df, weights)
    tiers = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(TIER_ORDER)], "tier_idx int, ranking_tier string")
    c = s.groupBy("ranking_tier").agg(F.count(F.lit(1)).alias("_n"))
    total = s.agg(F.count(F.lit(1))).scalar()
    j = F.broadcast(tiers).join(c, "ranking_tier", "left").withColumn("_total", total)
    n = F.coalesce(F.col("_n"), F.lit(0))
    return j.select("tier_idx", "ranking_tier", n.alias("n_oficinas"), _pct1(n, F.col("_total")).alias("pct"))


def scoring_input(m) -> DataFrame:
    """Pipeline input of the scorer: workshop performance (I2) plus the stored
    scores of the workshop table on the scorer's 0–5 scale (stored 0–10 halved);
    the reference's loader selects columns I2 does not have."""
    from loomstat.operators import intermediate as I
    from loomstat.operators import staging as S

    perf = I.int_oficina_performance(m)
    stored = S.stg_oficinas(m).select(
        F.col("oficina_id").alias("_s_id"),
        (F.col("score_qualidade") * F.lit(0.5).cast("decimal(2,1)")).alias("score_qualidade_media"),
        (F.col("score_pontualidade") * F.lit(0.5).cast("decimal(2,1)")).alias("score_pontualidade_media"),
        (F.col("score_comunicacao") * F.lit(0.5).cast("decimal(2,1)")).alias("score_comunicacao_media"))
    return perf.join(stored, perf.oficina_id == stored._s_id).drop("_s_id")
