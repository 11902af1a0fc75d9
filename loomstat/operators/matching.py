"""G1: order × workshop compatibility scoring over an explicit set of candidate pairs.

score = .30·quality + .25·punctuality + .20·geo + .15·capacity + .10·speed, where the
workshop terms are min–max normalised over the *available* workshops (a constant
column normalises to 1), quality/punctuality default to 3.0 and response time to 24 h.

The full order × workshop matrix is quadratic by definition, so it is not built here:
callers pass the candidate pairs they want scored (the recommendation path must prune
candidates before scoring). Normalisation constants come from one global aggregate
(one row, broadcast); the state→region lookup is a small dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default state → region map of the reference (Brazilian states).
STATE_REGION = {
    "SC": "sul", "PR": "sul", "RS": "sul",
    "SP": "sudeste", "RJ": "sudeste", "MG": "sudeste", "ES": "sudeste",
    "CE": "nordeste", "BA": "nordeste", "PE": "nordeste",
    "PA": "norte", "AM": "norte",
    "DF": "centro-oeste", "GO": "centro-oeste", "MT": "centro-oeste",
}
WEIGHTS = {"quality": 0.30, "punctuality": 0.25, "geo": 0.20, "capacity": 0.15, "speed": 0.10}


def region_table(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    m = mapping or STATE_REGION
    return spark.createDataFrame(sorted(m.items()), "estado string, region string")


def region_table_from_nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    """State → region for the driver's binding (nation name → region name)."""
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("estado"), F.col("r_name").alias("region"))


def workshop_terms(supply: DataFrame) -> DataFrame:
    """Per workshop: normalised quality, punctuality and (inverted) speed in [0, 1]."""
    q = F.coalesce(F.col("score_qualidade").cast("double"), F.lit(3.0))
    p = F.coalesce(F.col("score_pontualidade").cast("double"), F.lit(3.0))
    t = F.coalesce(F.col("tempo_medio_resposta_h").cast("double"), F.lit(24.0))
    s = supply.select("*", q.alias("_q0"), p.alias("_p0"), t.alias("_t0"))
    bounds = s.agg(F.struct(*[f(c).alias(f"{c}_{n}") for c in ("_q0", "_p0", "_t0")
                              for n, f in (("mn", F.min), ("mx", F.max))])).scalar()  # one struct, evaluated once

    def norm(c, invert=False):
        mn, mx = bounds.getField(f"{c}_mn"), bounds.getField(f"{c}_mx")
        v = (F.col(c) - mn) / (mx - mn)
        v = F.lit(1.0) - v if invert else v
        return F.when(mx == mn, F.lit(1.0)).otherwise(v)

    return s.select(
        "oficina_id", "estado", "capacidade_mensal_pecas", "tier",
        norm("_q0").alias("quality_score"), norm("_p0").alias("punctuality_score"),
        norm("_t0", invert=True).alias("speed_score"))


def geo_score(order_state: F.Column, order_region: F.Column, ws_state: F.Column, ws_region: F.Column) -> F.Column:
    """1.0 same state, 0.8 same (known) region, else 0.5; 0.5 when a state is missing."""
    missing = order_state.isNull() | (order_state == "") | ws_state.isNull() | (ws_state == "")
    return (F.when(missing, 0.5).when(order_state == ws_state, 1.0)
            .when(order_region.isNotNull() & (order_region == ws_region), 0.8).otherwise(0.5))


def capacity_score(qty: F.Column, cap: F.Column) -> F.Column:
    """Fit of the order size to monthly capacity: 30–70 % is best, over capacity worst."""
    r = qty.cast("double") / cap.cast("double")
    return (F.when(cap.isNull() | (cap <= 0), 0.0).when(r <= 0.10, 0.4).when(r <= 0.30, 0.7)
            .when(r <= 0.70, 1.0).when(r <= 1.00, 0.7).otherwise(0.2))


def score_pairs(pairs: DataFrame, orders: DataFrame, supply: DataFrame, regions: DataFrame) -> DataFrame:
    """Score candidate (pedido_id, oficina_id) pairs. Orders need ``quantidade_total`` and
    ``empresa_estado``; a missing or zero quantity counts as 100 pieces."""
    terms = workshop_terms(supply)
    reg_o = regions.select(F.col("estado").alias("_os"), F.col("region").alias("_oreg"))
    reg_w = regions.select(F.col("estado").alias("_ws"), F.col("region").alias("_wreg"))
    o = orders.select("pedido_id", F.col("empresa_estado").alias("_ostate"),
                      F.when(F.coalesce(F.col("quantidade_total"), F.lit(0)) == 0, F.lit(100))
                      .otherwise(F.col("quantidade_total")).alias("_qty"))
    j = (pairs.select("pedido_id", "oficina_id").join(o, "pedido_id").join(terms, "oficina_id")
         .join(reg_o, F.col("_ostate") == F.col("_os"), "left")
         .join(reg_w, F.col("estado") == F.col("_ws"), "left"))
    geo = geo_score(F.col("_ostate"), F.col("_oreg"), F.col("estado"), F.col("_wreg"))
    cap = capacity_score(F.col("_qty"), F.col("capacidade_mensal_pecas"))
    total = (F.col("quality_score") * WEIGHTS["quality"] + F.col("punctuality_score") * WEIGHTS["punctuality"]
             + geo * WEIGHTS["geo"] + cap * WEIGHTS["capacity"] + F.col("speed_score") * WEIGHTS["speed"])
    m4, m3 = 1e4, 1e3
    return j.select("pedido_id", "oficina_id", (F.round(total * m4) / m4).alias("score"),
                    (F.round(geo * m3) / m3).alias("geo_score"), (F.round(cap * m3) / m3).alias("capacity_score"),
                    (F.round(F.col("quality_score") * m3) / m3).alias("quality_score"),
                    (F.round(F.col("punctuality_score") * m3) / m3).alias("punctuality_score"),
                    (F.round(F.col("speed_score") * m3) / m3).alias("speed_score"),
                    F.col("estado").alias("oficina_estado"), F.col("tier").alias("oficina_tier"))
