"""The reduced transportation problem and the expanded assignment against brute force."""

import itertools
import random

import numpy as np
import pytest

from loomstat.operators import assignment as G3
from loomstat.operators import matching as G

STATES = ["SC", "PR", "SP", "CE", None]


def best_total(values):
    """Largest total of a rectangular matrix by trying everything (small) or the classical cubic method."""
    v = np.array(values)
    if v.shape[0] > v.shape[1]:
        v = v.T
    n, m = v.shape
    if m <= 6:
        return max(sum(v[i, j] for i, j in enumerate(cols)) for cols in itertools.permutations(range(m), n))
    u, p, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = -v[i0 - 1, j - 1] - u[i0] - p[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    p[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0] = match[j1]
            j0 = j1
    return sum(v[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j])


@pytest.mark.parametrize("seed", range(40))
def test_transport_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows, cols = rng.integers(1, 6), rng.integers(1, 7)
    value = rng.integers(0, rng.choice([3, 10, 1000]), (rows, cols))
    capacity = rng.integers(1, 4, cols)
    supply = np.minimum(rng.integers(0, 4, rows), capacity.sum())
    while supply.sum() > capacity.sum():
        supply[supply.argmax()] -= 1
    got = G3.transport(supply, capacity, lambda i: value[i])
    units = np.repeat(np.arange(rows), supply)
    whole = [[value[i][j] for j in np.repeat(np.arange(cols), capacity)] for i in units]
    assert got.total == got.bound == (best_total(whole) if len(units) else 0)
    shipped, held = np.zeros(rows, int), np.zeros(cols, int)
    for (i, j), n in got.flows.items():
        assert n > 0
        shipped[i] += n
        held[j] += n
    assert (shipped == supply).all() and (held <= capacity).all()


def test_too_much_supply_is_an_error():
    with pytest.raises(ValueError, match="more supply"):
        G3.transport(np.array([3]), np.array([1, 1]), lambda i: np.zeros(2, int))


def test_capacity_ranges_hold_the_bands():
    qty = np.array([1, 7, 30, 100, 333])
    edges = G3.capacity_edges(qty)
    for c in range(0, 4000):
        edge = 0 if c < edges[0] else int(edges[np.searchsorted(edges, c, side="right") - 1])
        assert (G3.capacity_units(qty, c) == G3.capacity_units(qty, edge)).all()
        for q, units in zip(qty, G3.capacity_units(qty, c), strict=True):
            r = q / c if c else None
            score = 0.0 if r is None else 0.4 if r <= 0.10 else 0.7 if r <= 0.30 else 1.0 if r <= 0.70 else 0.7 if r <= 1.0 else 0.2
            assert units == round(score * 1500)


def _case(seed, n_orders, n_shops):
    rnd = random.Random(seed)
    orders = [(f"p{i:03d}", rnd.choice(STATES), rnd.choice([None, 0, 30, 100, 100, 400])) for i in range(n_orders)]
    shops = [(f"o{i:03d}", rnd.choice(STATES), rnd.choice([None, 0, 100, 250, 250, 900]), rnd.choice([None, 3.0, 4.0]), rnd.choice([None, 2.5, 4.5]),
              rnd.choice([None, 6.0, 24.0]), "standard") for i in range(n_shops)]
    return orders, shops


def _frames(spark, orders, shops):
    return (spark.createDataFrame(orders, "pedido_id string, empresa_estado string, quantidade_total int"),
            spark.createDataFrame(shops, "oficina_id string, estado string, capacidade_mensal_pecas int, score_qualidade double, "
                                         "score_pontualidade double, tempo_medio_resposta_h double, tier string"))


def _matrix(spark, orders, supply):
    """Scores of all pairs by G1 (small fixtures only), in units."""
    pairs = orders.select("pedido_id").crossJoin(supply.select("oficina_id"))
    return {(r["pedido_id"], r["oficina_id"]): round(r["score"] * 10_000) for r in G.score_pairs(pairs, orders, supply, G.region_table(spark)).collect()}


@pytest.mark.parametrize(("n_orders", "n_shops"), [(1, 1), (6, 6), (6, 3), (3, 6), (2, 40), (40, 30), (30, 40), (60, 12)])
def test_assignment_against_brute_force(spark, n_orders, n_shops):
    orders, shops = _case(n_orders * 100 + n_shops, n_orders, n_shops)
    o, s = _frames(spark, orders, shops)
    score = _matrix(spark, o, s)
    got = G3.optimal_assignment(o, s, G.region_table(spark)).collect()
    assert len(got) == min(n_orders, n_shops) == len({r["pedido_id"] for r in got}) == len({r["oficina_id_optimal"] for r in got})
    total = 0
    for r in got:
        units = score[r["pedido_id"], r["oficina_id_optimal"]]
        assert round(r["compatibility_score"] * 10_000) == units
        assert r["rank_in_available"] == 1 + sum(score[r["pedido_id"], x[0]] > units for x in shops)
        total += units
    assert total == best_total([[score[p[0], x[0]] for x in shops] for p in orders])


def test_contested_orders(spark):
    """Every workshop wants the same few orders: prices have to rise through several groups."""
    rnd = random.Random(1)
    orders = [(f"p{i:03d}", rnd.choice(["SC", "SC", "SP"]), rnd.choice([100, 100, 4000])) for i in range(50)]
    shops = [(f"o{i:03d}", rnd.choice(["SC", "PR"]), rnd.choice([200, 210, 5000]), 3.0 + i % 4, 3.0, 5.0, "x") for i in range(50)]
    o, s = _frames(spark, orders, shops)
    score = _matrix(spark, o, s)
    total = G3.totals(G3.optimal_assignment(o, s, G.region_table(spark))).first()
    assert total["n_assigned"] == 50 and total["one_to_one"]
    assert round(total["total_score"] * 10_000) == best_total([[score[p[0], x[0]] for x in shops] for p in orders])


def test_nothing_to_assign(spark):
    o, s = _frames(spark, *_case(1, 3, 3))
    for a, b in ((o.limit(0), s), (o, s.limit(0))):
        got = G3.optimal_assignment(a, b, G.region_table(spark))
        assert got.collect() == [] and tuple(G3.totals(got).first()) == (0.0, 0, True)
