"""G1 on the reference's matching fixture (FIXTURES.md A4), checked against a brute-force
pandas-free computation of the same formula."""

import pytest

from loomstat.operators import matching as G


@pytest.fixture(scope="module")
def fixture(spark):
    orders = spark.createDataFrame(
        [(f"p{i}", f"e{i}", 100 + 50 * i, 5000.0 + 1000 * i, "SC") for i in range(1, 5)],
        "pedido_id string, empresa_id string, quantidade_total int, valor_estimado double, empresa_estado string")
    supply = spark.createDataFrame(
        [(f"o{i}", "SC" if i <= 3 else "SP", 300 + 100 * i, 3 + .2 * i, 3 + .15 * i, float(max(1, 10 - i)),
          "premium" if i % 2 == 0 else "standard") for i in range(1, 6)],
        "oficina_id string, estado string, capacidade_mensal_pecas int, score_qualidade double, "
        "score_pontualidade double, tempo_medio_resposta_h double, tier string")
    pairs = orders.select("pedido_id").crossJoin(supply.select("oficina_id"))  # 4 × 5 test fixture only
    return orders, supply, pairs


def test_score_pairs(spark, fixture):
    orders, supply, pairs = fixture
    out = G.score_pairs(pairs, orders, supply, G.region_table(spark)).collect()
    assert len(out) == 20
    assert all(0.0 <= r["score"] <= 1.0 for r in out)
    by = {(r["pedido_id"], r["oficina_id"]): r for r in out}
    # brute force for one pair: p1 (qty 150, SC) × o1 (SC, cap 400): ratio .375 -> 1.0; o1 has the lowest
    # quality and punctuality (-> 0) and the slowest response, 9 h (inverted speed -> 0)
    r = by[("p1", "o1")]
    assert r["geo_score"] == 1.0 and r["capacity_score"] == 1.0 and r["speed_score"] == 0.0
    assert r["score"] == round(0 * .30 + 0 * .25 + 1.0 * .20 + 1.0 * .15 + 0.0 * .10, 4)
    assert by[("p1", "o4")]["geo_score"] == 0.5  # SC vs SP: different regions


def test_geo_and_capacity_bands(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("SC", "SC", 300, 500), ("SC", "PR", 600, 500), ("SC", "CE", 100, 0)],
                               "a string, b string, q int, c int")
    reg = {"SC": "sul", "PR": "sul", "CE": "nordeste"}
    rows = df.select(
        G.geo_score(F.col("a"), F.create_map(*[x for k, v in reg.items() for x in (F.lit(k), F.lit(v))])[F.col("a")],
                    F.col("b"), F.create_map(*[x for k, v in reg.items() for x in (F.lit(k), F.lit(v))])[F.col("b")])
        .alias("g"), G.capacity_score(F.col("q"), F.col("c")).alias("k")).collect()
    assert [r["g"] for r in rows] == [1.0, 0.8, 0.5]
    assert rows[0]["k"] == 1.0 and rows[1]["k"] < 0.5 and rows[2]["k"] == 0.0


def test_recommendations_match_brute_force(spark):
    """G2 against a pure-Python brute force on a random fixture with ties, zero capacity,
    missing states and zero quantities."""
    import random

    from loomstat.operators import recommend as GR

    rnd = random.Random(7)
    states = ["SC", "PR", "RS", "SP", "RJ", "CE", None]
    supply_rows = []
    for i in range(40):
        supply_rows.append((f"o{i:02d}", rnd.choice(states), rnd.choice([0, 100, 250, 400, 400, 800, 1500]),
                            rnd.choice([None, 3.0, 3.5, 4.0, 4.0]), rnd.choice([None, 2.5, 3.0, 4.5]),
                            rnd.choice([None, 1.0, 6.0, 12.0, 30.0]), "standard"))
    supply = spark.createDataFrame(supply_rows, "oficina_id string, estado string, capacidade_mensal_pecas int, "
                                                "score_qualidade double, score_pontualidade double, "
                                                "tempo_medio_resposta_h double, tier string")
    order_rows = [(f"p{j:02d}", rnd.choice(states), rnd.choice([0, None, 20, 40, 100, 300, 700])) for j in range(30)]
    orders = spark.createDataFrame(order_rows, "pedido_id string, empresa_estado string, quantidade_total int")
    regions = G.region_table(spark)
    got = {(r["pedido_id"], r["rank"]): r["oficina_id"]
           for r in GR.recommendations(orders, supply, regions, top_n=3).collect()}

    # brute force with the same floating-point operations in the same order
    def norm(vals, invert=False):
        mn, mx = min(vals), max(vals)
        return [1.0 if mx == mn else ((1.0 - (v - mn) / (mx - mn)) if invert else (v - mn) / (mx - mn)) for v in vals]

    qs = norm([r[3] if r[3] is not None else 3.0 for r in supply_rows])
    ps = norm([r[4] if r[4] is not None else 3.0 for r in supply_rows])
    ss = norm([r[5] if r[5] is not None else 24.0 for r in supply_rows], invert=True)
    reg = G.STATE_REGION
    expected = {}
    for pid, st, q in order_rows:
        q = 100 if not q else q
        scored = []
        for k, (oid, wst, cap, *_rest) in enumerate(supply_rows):
            if not st or not wst:
                geo = 0.5
            elif st == wst:
                geo = 1.0
            elif reg.get(st) is not None and reg.get(st) == reg.get(wst):
                geo = 0.8
            else:
                geo = 0.5
            if not cap or cap <= 0:
                cs = 0.0
            else:
                r = q / cap
                cs = 0.4 if r <= 0.10 else 0.7 if r <= 0.30 else 1.0 if r <= 0.70 else 0.7 if r <= 1.00 else 0.2
            total = qs[k] * 0.3 + ps[k] * 0.25 + geo * 0.2 + cs * 0.15 + ss[k] * 0.1
            scored.append((-total, oid))
        for rank, (_, oid) in enumerate(sorted(scored)[:3], start=1):
            expected[(pid, rank)] = oid
    assert got == expected
