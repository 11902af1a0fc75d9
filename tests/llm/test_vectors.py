"""op4 and op6 against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import adaptive_scan, nn_descent
from loomstat.llm.adaptive_scan import scan, search
from loomstat.llm.nn_descent import near_duplicates

ODD = [(100_000, None), (100_020, []), (100_040, [0.0] * 16), (100_060, [1.0] * 15 + [None]), (100_080, [float("nan")] * 16), (100_100, [float("inf")] * 16),
       (100_120, [1.0, 2.0]), (None, [1.0] * 16)]


def cloud(n, dim=16, seed=0, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.3, 2], (n, 1))).astype(np.float32)


def frame(spark, x, odd=True):
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)] + ([(i, v, 0) for i, v in ODD] if odd else [])
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")


@pytest.mark.parametrize("n", [12, 700, 3000])
def test_search_recall_scores_and_order(spark, n):
    x = cloud(n)
    x[5] = x[3]  # ties go to the smaller id
    got = search(frame(spark, x), F.col("vec_id") % 20 == 0).toPandas()
    d = x.astype(float)
    hit = total = 0
    for q in range(0, n, 20):
        own = got[got.query_id == q].sort_values("rank")
        s = d @ d[q]
        order = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:20]
        assert own["rank"].tolist() == list(range(1, len(order) + 1)) and q not in set(own.vec_id)
        assert np.allclose(own.score, s[own.vec_id], atol=1e-9)
        pairs = list(zip(-own.score, own.vec_id, strict=True))
        assert pairs == sorted(pairs)
        hit, total = hit + len(set(order) & set(own.vec_id)), total + len(order)
    assert hit / total >= 0.9
    assert set(got.query_id) == set(range(0, n, 20))


def test_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "BLOCK_ROWS", 50)
    monkeypatch.setattr(adaptive_scan, "BLOCK_QUERIES", 7)
    x = cloud(1500, groups=2)
    got = search(frame(spark, x), F.col("vec_id") % 20 == 0).toPandas()
    d = x.astype(float)
    hit = sum(len(set(sorted(range(len(x)), key=lambda i: (-(d[i] @ d[q]), i))[:21]) & set(got[got.query_id == q].vec_id)) for q in range(0, 1500, 20))
    assert hit / (75 * 20) >= 0.9 and len(got) == 75 * 20


def test_scan_loses_hardly_any_pair_within_the_limit():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(40, 65)), rng.normal(size=(2000, 65))
    dist = ((q[:, None] - c) ** 2).sum(axis=2)
    limit = np.sort(dist, axis=1)[:, 20]
    i, j = scan(q, c, limit)
    assert (dist[i, j] <= limit[i] * (1 + 1e-6)).all() and len(i) >= 0.98 * (dist <= limit[:, None]).sum()


def test_search_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(empty, F.lit(True)).collect() == [] and search(frame(spark, cloud(0)), F.lit(True)).collect() == []
    assert search(frame(spark, cloud(1), False), F.lit(True)).collect() == []
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search(rows, F.col("vec_id") == 3).collect()}
    assert got == {(3, 1): (2, 3.0), (3, 2): (1, 1.0)}


def brute(x, w=None):
    d = x.astype(float)
    d /= np.sqrt((d * d).sum(axis=1))[:, None]
    linked = d @ d.T >= 0.95
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    while True:
        new = np.minimum(comp, np.where(linked, comp, len(x)).min(axis=1))
        if (new == comp).all():
            return linked.sum(axis=1), comp
        comp = new


@pytest.mark.parametrize(("n", "groups"), [(30, 3), (900, 40), (1500, 3)])
def test_links_and_components(spark, monkeypatch, n, groups):
    monkeypatch.setattr(nn_descent, "TILE", 64)
    x = cloud(n, seed=4, groups=groups)
    x[7], x[8] = x[3], x[3]
    got = near_duplicates(frame(spark, x)).toPandas()
    odd = got[got.vec_id.isna() | (got.vec_id >= 100_000)]
    assert len(odd) == len(ODD) and (odd[odd.vec_id.notna()].n_links == 0).all() and odd.kept.all()
    own = got[got.vec_id < 100_000].sort_values("vec_id")
    links, comp = brute(x)
    assert len(own) == n
    assert own.n_links.sum() >= 0.97 * links.sum() and (own.n_links.to_numpy() <= links).all()
    assert (own.component_id.to_numpy() == comp).mean() >= 0.97
    assert (own.kept == (own.vec_id == own.component_id)).all()


def test_equal_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(5, [1.0, 0.0])] * 3 + [(2, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in near_duplicates(rows).collect())
    assert got == [(2, 3, 2, True), (5, 3, 2, False), (5, 3, 2, False), (5, 3, 2, False), (9, 0, 9, True)]
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("starts", [3, 1])
def test_a_large_group_does_not_hide_lost_pairs(spark, monkeypatch, starts):
    monkeypatch.setattr(nn_descent, "BUCKET", 8)  # buckets that part most pairs
    monkeypatch.setattr(nn_descent, "TREES", 1)
    monkeypatch.setattr(nn_descent, "STARTS", starts, raising=False)
    monkeypatch.setattr(nn_descent, "QUERIES", 300, raising=False)
    rng = np.random.default_rng(6)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    group = unit(rng.normal(size=(1, 64))) + 0.01 * rng.normal(size=(500, 64))
    a, r = unit(rng.normal(size=(150, 64))), rng.normal(size=(150, 64))
    b = 0.957 * a + np.sqrt(1 - 0.957**2) * unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    x = np.r_[group, a, b, unit(rng.normal(size=(700, 64)))].astype(np.float32)
    links, comp = brute(x)
    assert links[500:800].tolist() == [1] * 300 and (links[:500] == 499).all()
    got = near_duplicates(frame(spark, x, odd=False)).toPandas().sort_values("vec_id")
    assert got.n_links[:500].tolist() == [499] * 500
    assert got.n_links[500:800].sum() >= 0.97 * 300
    if starts == 1:  # all nodes are compared with all
        assert got.n_links.tolist() == links.tolist() and got.component_id.tolist() == comp.tolist()
