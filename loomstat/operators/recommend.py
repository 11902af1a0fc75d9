"""Exact top-n workshop recommendations per open order, without scoring all pairs.

score(o, w) = B(w) + 0.20·geo(o, w) + 0.15·cap(q_o, c_w), with the workshop-only part
B(w) = 0.30·quality + 0.25·punctuality + 0.10·speed (normalised as in G1). An order
enters only through its profile (state s, quantity q).

Candidate lemma. Inside one *class* — workshops with the same geo bonus and the same
capacity band for the profile — the bonus is constant, so a workshop outside the class
top-n by (B desc, id) is beaten by n workshops of its own class. Geo bonus is monotone
in nesting (same state ⊂ same region ⊂ all), so it is enough to take, for every capacity
band k, the top-n by B among workshops in (state s), (region of s) and (all), each
restricted to band k. Their union contains the exact top-n of the profile.

Band k for quantity q is an interval of capacity c (integer arithmetic, identical to
the ratio bands of G1). "Top-n by B among workshops of group X with c in [lo, hi)" is a
range top-n: workshops of X are positioned by (c, id), a tree of fan-out 8 keeps the top-n
of every block of positions (each level from the one below, ≤ 8n rows per block, all
levels in one job, checkpointed once), and an interval is the union of at most 14 blocks
per level. The wide fan-out keeps the plan short: a third of the levels of a binary tree.

Work is bounded by (workshops × levels × 3 groups) for the tree and by
(profiles × 3 groups × 6 bands × 14 blocks per level × n) for candidates; no
order × workshop product is formed. Ranking is by the unrounded score, ties by id
(the reference sorts rounded scores with an unstable sort, so its tie order is undefined).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.ranks import global_row_number
from loomstat.operators.matching import WEIGHTS, capacity_score, geo_score, workshop_terms

NEG_INF = -(2 ** 62)
POS_INF = 2 ** 62
FAN_BITS = 3  # children of a tree block: 2 ** FAN_BITS


def _band_intervals(q: F.Column) -> list[tuple[int, F.Column, F.Column]]:
    """(band, lo, hi) with band membership  lo <= c < hi  for quantity q >= 1 (integers)."""
    ten_q = q * 10
    c3 = F.ceil(ten_q / F.lit(3)).cast("long")   # 3c >= 10q  <=>  c >= ceil(10q/3)
    c7 = F.ceil(ten_q / F.lit(7)).cast("long")   # 7c >= 10q  <=>  c >= ceil(10q/7)
    return [
        (0, F.lit(NEG_INF).cast("long"), F.lit(1).cast("long")),      # no capacity
        (5, F.lit(1).cast("long"), q.cast("long")),                    # over capacity (r > 1)
        (4, q.cast("long"), c7),                                       # 0.7 < r <= 1
        (3, c7, c3),                                                   # 0.3 < r <= 0.7
        (2, c3, ten_q.cast("long")),                                   # 0.1 < r <= 0.3
        (1, ten_q.cast("long"), F.lit(POS_INF).cast("long")),          # r <= 0.1
    ]


def _grouped_positions(long: DataFrame) -> DataFrame:
    """0-based position of each workshop inside its group by (c, id), as an exact global
    row number minus the rows of earlier groups (the group table is bounded by the
    number of states and regions)."""
    numbered = global_row_number(long, [F.col("grp"), F.col("c"), F.col("oficina_id")], "_g")
    sizes = long.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("grp", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), "_n")
    return numbered.join(offs, "grp").withColumn("pos", F.col("_g") - F.col("_off") - 1).drop("_g", "_off")


def _segment_tree(pos: DataFrame, n: int, levels: int) -> DataFrame:
    """Rows (grp, lvl, blk, oficina_id, b_score): the top-n by (b_score desc, id) of every tree block."""
    level = pos.select("grp", F.lit(0).alias("lvl"), F.col("pos").alias("blk"), "oficina_id", "b_score")
    out = [level]
    for lvl in range(1, levels + 1):
        parent = level.select("grp", F.lit(lvl).alias("lvl"), F.shiftright("blk", FAN_BITS).alias("blk"), "oficina_id",
                              "b_score")
        w = Window.partitionBy("grp", "blk").orderBy(F.col("b_score").desc(), F.col("oficina_id"))
        level = parent.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
        out.append(level)
    tree = out[0]
    for t in out[1:]:
        tree = tree.unionByName(t)
    # one job builds every level: each level's plan is a prefix of the next one, so the
    # shuffles are shared (exchange reuse); the finished tree is checkpointed once
    return tree.checkpoint(eager=True)


def _lower_bounds(pos: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """For bound rows (grp, keys..., bound): number of workshops of grp with c < bound.

    Workshop rows and bound rows share one total order (grp, value, kind, tie) with bound
    rows first at equal values. With rn_all = global row number among all rows and
    rn_bound = global row number among bound rows only, the workshops before a bound row
    number rn_all - rn_bound; subtracting the workshops of earlier groups (a table with one
    row per group) leaves the count inside its group. Both row numbers are distributed
    (range partitioning), so no group - not even "all workshops" - lands in one task."""
    tie = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    w_rows = pos.select("grp", F.col("c").alias("v"), F.lit(1).alias("_kind"),
                        F.col("oficina_id").cast("string").alias("_tie"),
                        *[F.lit(None).cast(bounds.schema[k].dataType).alias(k) for k in keys])
    b_rows = bounds.select("grp", F.col("bound").alias("v"), F.lit(0).alias("_kind"), tie.alias("_tie"), *keys)
    order = [F.col("grp"), F.col("v"), F.col("_kind"), F.col("_tie")]
    all_n = global_row_number(w_rows.unionByName(b_rows), order, "_rn_all").where(F.col("_kind") == 0)
    b_n = global_row_number(b_rows, order, "_rn_bound").select("grp", "_tie", "_rn_bound")
    sizes = pos.groupBy("grp").agg(F.count(F.lit(1)).alias("_gn"))
    w = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("grp", F.coalesce(F.sum("_gn").over(w), F.lit(0)).alias("_wb"))  # one row per group
    return (all_n.join(b_n, ["grp", "_tie"]).join(before, "grp", "left")
            .select("grp", *keys, (F.col("_rn_all") - F.col("_rn_bound") - F.coalesce(F.col("_wb"), F.lit(0)))
                    .alias("lb")))


def recommendations(orders: DataFrame, supply: DataFrame, regions: DataFrame, top_n: int = 5) -> DataFrame:
    """Top ``top_n`` workshops per open order: (pedido_id, oficina_id, rank, score and sub-scores)."""
    terms = workshop_terms(supply)
    reg = regions.select(F.col("estado").alias("_rs"), F.col("region").alias("_rr"))
    ws = (terms.join(reg, terms.estado == reg._rs, "left")
          .select("oficina_id", "estado", F.col("_rr").alias("region"),
                  F.coalesce(F.col("capacidade_mensal_pecas"), F.lit(0)).cast("long").alias("c"),
                  "quality_score", "punctuality_score", "speed_score", "tier",
                  (F.col("quality_score") * WEIGHTS["quality"] + F.col("punctuality_score") * WEIGHTS["punctuality"]
                   + F.col("speed_score") * WEIGHTS["speed"]).alias("b_score")))
    long = (ws.where(F.col("estado").isNotNull())
            .select(F.concat(F.lit("S:"), F.col("estado")).alias("grp"), "c", "oficina_id", "b_score")
            .unionByName(ws.where(F.col("region").isNotNull())
                         .select(F.concat(F.lit("R:"), F.col("region")).alias("grp"), "c", "oficina_id", "b_score"))
            .unionByName(ws.select(F.lit("A").alias("grp"), "c", "oficina_id", "b_score")))
    pos = _grouped_positions(long).checkpoint(eager=True)
    max_group = pos.agg(F.max("_n")).first()[0] or 1
    levels = max(0, math.ceil(math.log2(max_group) / FAN_BITS))
    tree = _segment_tree(pos.select("grp", "pos", "oficina_id", "b_score"), top_n, levels)

    # order profiles: (state, quantity); a missing or zero quantity counts as 100 pieces
    qty = F.when(F.coalesce(F.col("quantidade_total"), F.lit(0)) == 0, F.lit(100)).otherwise(F.col("quantidade_total"))
    o = orders.select("pedido_id", F.col("empresa_estado").alias("p_estado"), qty.cast("long").alias("p_qty")) \
        .withColumn("pk_s", F.coalesce(F.col("p_estado"), F.lit("")))
    key = ["pk_s", "p_qty"]
    profiles = (o.select("pk_s", "p_estado", "p_qty").distinct()
                .join(reg, F.col("p_estado") == reg._rs, "left")
                .select("pk_s", "p_estado", "p_qty", F.col("_rr").alias("p_region")))
    queries = profiles.select(*key, F.explode(F.array(
        F.concat(F.lit("S:"), F.col("p_estado")), F.concat(F.lit("R:"), F.col("p_region")), F.lit("A"))).alias("grp")) \
        .where(F.col("grp").isNotNull())
    bands = F.array(*[F.struct(F.lit(k).alias("band"), lo.alias("lo"), hi.alias("hi"))
                      for k, lo, hi in _band_intervals(F.col("p_qty"))])
    qb = queries.select(*key, "grp", F.explode(bands).alias("b")).select(*key, "grp", "b.*") \
        .where(F.col("lo") < F.col("hi"))
    qkeys = key + ["band", "side"]
    bounds = (qb.select("grp", *key, "band", F.lit("lo").alias("side"), F.col("lo").alias("bound"))
              .unionByName(qb.select("grp", *key, "band", F.lit("hi").alias("side"), F.col("hi").alias("bound"))))
    lb = _lower_bounds(pos, bounds, qkeys)
    ivals = (lb.groupBy("grp", *key, "band").pivot("side", ["lo", "hi"]).agg(F.first("lb"))
             .withColumnRenamed("lo", "plo").withColumnRenamed("hi", "phi").where(F.col("plo") < F.col("phi")))
    # canonical decomposition: at each level, the blocks inside [plo, phi) whose parent block is not inside
    fan = 1 << FAN_BITS
    size = F.expr(f"shiftleft(CAST(1 AS BIGINT), lvl * {FAN_BITS})")
    per_lvl = ivals.select(*key, "grp", "plo", "phi", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("lvl"))
    per_lvl = per_lvl.select("*", F.ceil(F.col("plo") / size).cast("long").alias("l"), F.floor(F.col("phi") / size).cast("long").alias("r"),
                             F.ceil(F.col("plo") / (size * fan)).cast("long").alias("pl"), F.floor(F.col("phi") / (size * fan)).cast("long").alias("pr"))

    def run(lo, hi):  # blocks lo .. hi - 1
        return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))

    whole = (F.col("lvl") == levels) | (F.col("pl") >= F.col("pr"))  # no parent inside
    kept = F.when(whole, run(F.col("l"), F.col("r"))).otherwise(F.concat(run(F.col("l"), F.col("pl") * fan), run(F.col("pr") * fan, F.col("r"))))
    blocks = per_lvl.select(*key, "grp", "lvl", F.explode(kept).alias("blk"))
    cands = blocks.join(tree, ["grp", "lvl", "blk"]).select(*key, "oficina_id").distinct()
    # exact score of every candidate for its profile, then top-n per profile
    scored = cands.join(profiles, key).join(ws.drop("b_score"), "oficina_id")
    geo = geo_score(F.col("p_estado"), F.col("p_region"), F.col("estado"), F.col("region"))
    cap = capacity_score(F.col("p_qty"), F.col("c"))
    total = (F.col("quality_score") * WEIGHTS["quality"] + F.col("punctuality_score") * WEIGHTS["punctuality"]
             + geo * WEIGHTS["geo"] + cap * WEIGHTS["capacity"] + F.col("speed_score") * WEIGHTS["speed"])
    scored = scored.select(*key, "oficina_id", "estado", "tier", "quality_score", "punctuality_score", "speed_score",
                           geo.alias("geo"), cap.alias("cap"), total.alias("_s"))
    w = Window.partitionBy(*key).orderBy(F.col("_s").desc(), F.col("oficina_id"))
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    m4, m3 = 1e4, 1e3
    return o.join(top, key).select(
        "pedido_id", "oficina_id", "rank", (F.round(F.col("_s") * m4) / m4).alias("score"),
        (F.round(F.col("geo") * m3) / m3).alias("geo_score"), (F.round(F.col("cap") * m3) / m3).alias("capacity_score"),
        (F.round(F.col("quality_score") * m3) / m3).alias("quality_score"),
        (F.round(F.col("punctuality_score") * m3) / m3).alias("punctuality_score"),
        (F.round(F.col("speed_score") * m3) / m3).alias("speed_score"),
        F.col("estado").alias("oficina_estado"), F.col("tier").alias("oficina_tier"))
