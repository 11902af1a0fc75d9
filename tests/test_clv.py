"""CLV model on a small literal RFM fixture (FIXTURES.md A5) and likelihood against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import clv as V

RFM = [(f"e{i}", float(f), float(rec), float(rec + t_extra), float(mv))
       for i, (f, rec, t_extra, mv) in enumerate([
           (1, 30, 60, 900), (2, 120, 40, 1500), (3, 200, 90, 2200), (0, 0, 150, 0), (5, 280, 20, 4100),
           (1, 10, 100, 700), (4, 150, 60, 3000), (0, 0, 30, 0), (2, 60, 110, 1200), (7, 290, 15, 5000),
           (3, 100, 80, 1800), (1, 45, 70, 650), (6, 250, 30, 4500), (0, 0, 119, 0), (2, 90, 50, 1100)])]


@pytest.fixture(scope="module")
def rfm(spark):
    return spark.createDataFrame(RFM, "empresa_id string, frequency double, recency double, T double, "
                                      "monetary_value double")


def _ll_numpy(r, al, a, b):
    tot = 0.0
    for _, x, tx, t, _m in RFM:
        a1 = math.lgamma(r + x) - math.lgamma(r) + r * math.log(al)
        a2 = math.lgamma(a + b) + math.lgamma(b + x) - math.lgamma(b) - math.lgamma(a + b + x)
        a3 = -(r + x) * math.log(al + t)
        a4 = math.log(a) - math.log(b + max(x, 1) - 1) - (r + x) * math.log(tx + al)
        mx = max(a3, a4)
        tot += a1 + a2 + math.log(math.exp(a3 - mx) + (math.exp(a4 - mx) if x > 0 else 0.0)) + mx
    return tot


def test_loglik_matches_numpy(rfm):
    for params in [(0.5, 50.0, 0.8, 2.5), (2.0, 10.0, 0.3, 5.0)]:
        got = rfm.select(F.sum(V.bgnbd_loglik(F.col("frequency").cast("int"), F.col("recency"), F.col("T"),
                                              *[F.lit(p) for p in params]))).first()[0]
        assert got == pytest.approx(_ll_numpy(*params), rel=1e-12)


def test_lgamma_column(spark):
    zs = [0.1, 0.5, 1.0, 2.5, 7.3, 40.0, 1234.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(V.lgamma_col(F.col("z"))).collect()]
    assert np.allclose(got, [math.lgamma(z) for z in zs], atol=1e-10)


def test_fit_predict_segment(rfm):
    assert not V.fit_bgnbd(rfm, max_iter=3)[3]
    bg, obj, _, converged = V.fit_bgnbd(rfm, max_iter=60)
    assert converged
    start = -_ll_numpy(1.0, 1.0, 1.0, 1.0) / len(RFM) + 0.001 * 4
    assert obj < start
    gg, *_ = V.fit_gamma_gamma(rfm, max_iter=60)
    out = V.predict_clv(rfm, bg, gg).collect()
    assert len(out) == len(RFM)
    assert all(0.0 <= r["prob_alive"] <= 1.0 for r in out)
    assert all(r["expected_purchases_12m"] >= 0 for r in out)
    seg = V.segment_by_clv(V.predict_clv(rfm, bg, gg)).collect()
    assert {r["clv_segment"] for r in seg} <= set(V.SEGMENT_LABELS) and all(r["clv_segment"] for r in seg)
    pa = {r["empresa_id"]: r["prob_alive"] for r in V.probability_alive(rfm, bg).collect()}
    assert pa["e3"] == 1.0  # no repeat purchase: alive by definition


def test_digamma_column(spark):
    zs = [0.01, 0.1, 0.5, 1.0, 2.5, 7.3, 40.0, 1234.5]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").selectExpr(V.digamma_sql("z")).collect()]
    assert got[3] == pytest.approx(-0.5772156649015329, abs=1e-12) and got[2] == pytest.approx(-0.5772156649015329 - 2 * math.log(2), abs=1e-12)
    for z, d in zip(zs, got, strict=True):  # recurrence down to the asymptotic series, and differences of ln Γ
        up = z + 200.0
        exact = math.log(up) - 0.5 / up - 1 / (12 * up**2) + 1 / (120 * up**4) - sum(1 / (z + i) for i in range(200))
        assert d == pytest.approx(exact, abs=1e-11) and V.digamma(z) == pytest.approx(exact, abs=1e-11)
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").selectExpr(V.lgamma_sql("z")).collect()]
    assert np.allclose(got, [math.lgamma(z) for z in zs], atol=1e-10)


@pytest.mark.parametrize("which", ["bgnbd", "gg"])
def test_gradients_against_differences(rfm, which):
    rng = np.random.default_rng(2)
    if which == "bgnbd":
        stats, model, n, scale = V.bgnbd_stats(rfm), V.BGNBD, 4, [0.5, 30.0, 0.8, 2.5]
    else:
        stats = rfm.where("frequency > 0").select(F.col("frequency").alias("x"), F.col("monetary_value").alias("m"), F.lit(2.0).alias("w"))
        model, n, scale = V.GAMMA_GAMMA, 3, [3.0, 2.0, 800.0]
    for _ in range(3):
        at, h = np.log(scale) + rng.normal(0, 0.5, n), 1e-5
        around = [at] + [at + s * h * np.eye(n)[j] for j in range(n) for s in (1, -1)]
        got = V._evaluate(stats, around, model, 0.001)
        for j in range(n):
            assert got[0][1][j] == pytest.approx((got[1 + 2 * j][0] - got[2 + 2 * j][0]) / (2 * h), rel=1e-5, abs=1e-7)
    if which == "bgnbd":
        p = np.exp(at)
        assert got[0][0] == pytest.approx(-_ll_numpy(*p) / len(RFM) + 0.001 * float(p @ p), rel=1e-12)


def _simplex(evaluate, x0: np.ndarray, step: float = 0.5, max_iter: int = 400, xtol: float = 1e-4,
                ftol: float = 1e-6) -> tuple[np.ndarray, float, int, bool]:
    """Nelder-Mead, an optimiser without gradients."""
    n = len(x0)
    simplex = [x0] + [x0 + step * np.eye(n)[i] for i in range(n)]
    fs = evaluate(simplex)
    it, converged = 0, False
    for it in range(1, max_iter + 1):
        order = np.argsort(fs)
        simplex = [simplex[i] for i in order]
        fs = [fs[i] for i in order]
        if max(abs(f - fs[0]) for f in fs) <= ftol and max(np.max(np.abs(s - simplex[0])) for s in simplex) <= xtol:
            converged = True
            break
        centroid = np.mean(simplex[:-1], axis=0)
        worst = simplex[-1]
        xr = centroid + (centroid - worst)
        xe = centroid + 2.0 * (centroid - worst)
        xoc = centroid + 0.5 * (centroid - worst)
        xic = centroid - 0.5 * (centroid - worst)
        fr, fe, foc, fic = evaluate([xr, xe, xoc, xic])
        if fr < fs[0]:
            simplex[-1], fs[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < fs[-2]:
            simplex[-1], fs[-1] = xr, fr
        elif fr < fs[-1] and foc <= fr:
            simplex[-1], fs[-1] = xoc, foc
        elif fr >= fs[-1] and fic < fs[-1]:
            simplex[-1], fs[-1] = xic, fic
        else:
            new = [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]
            simplex = [simplex[0]] + new
            fs = [fs[0]] + evaluate(new)
    best = int(np.argmin(fs))
    return simplex[best], fs[best], it, converged


def _gg_numpy(p, q, v):
    return sum(math.lgamma(p * x + q) - math.lgamma(p * x) - math.lgamma(q) + q * math.log(v) + (p * x - 1) * math.log(m) + p * x * math.log(x)
               - (p * x + q) * math.log(x * m + v) for _, x, _, _, m in RFM if x > 0)


def test_fits_reach_the_optimum_of_a_simplex_search(rfm):
    buyers = sum(1 for r in RFM if r[1] > 0)
    for fit, loglik, n, k in ((V.fit_bgnbd, _ll_numpy, len(RFM), 4), (V.fit_gamma_gamma, _gg_numpy, buyers, 3)):
        p, f, jobs, converged = fit(rfm)
        point, g, _, done = _simplex(lambda cands, ll=loglik, n=n: [-ll(*np.exp(c)) / n + 0.001 * float(np.exp(c) @ np.exp(c)) for c in cands],
                                     np.zeros(k), max_iter=4000, xtol=1e-7, ftol=1e-12)
        assert converged and done and jobs <= 40
        assert f == pytest.approx(g, abs=1e-8)
        assert [getattr(p, c) for c in p.__dataclass_fields__] == pytest.approx(list(np.exp(point)), rel=2e-3)


def test_customers_without_repeats(spark):
    """No repeat buyer: nothing to fit the spend model on, and the purchase rate falls towards 0 without an optimum; both are told."""
    rfm = spark.createDataFrame([(str(i), 0.0, 0.0, 30.0 + i, 0.0) for i in range(9)], "empresa_id string, frequency double, recency double, T double, monetary_value double")
    assert not V.fit_bgnbd(rfm, max_iter=5)[3]
    assert not V.fit_gamma_gamma(rfm, max_iter=5)[3]


def test_hypergeometric_against_closed_forms():
    z = np.array([0.0, 0.1, 0.5, 0.89, 0.95, 0.999, 0.99999])
    for got, want in [
        (V._hyp2f1(1.0, 1.0, 2.0, z[1:]), -np.log1p(-z[1:]) / z[1:]),  # c - a - b = 0
        (V._hyp2f1(0.5, 1.0, 1.5, z[1:]), np.arctanh(np.sqrt(z[1:])) / np.sqrt(z[1:])),
        (V._hyp2f1(0.5, 0.5, 1.5, z[1:]), np.arcsin(np.sqrt(z[1:])) / np.sqrt(z[1:])),
        (V._hyp2f1(0.7, 1.3, 1.3, z), (1 - z) ** -0.7),
    ]:
        assert np.allclose(got, want, rtol=1e-9)
    k = np.arange(6_000_000)  # the plain series, summed to the end
    plain = 1 + np.exp(np.cumsum(np.log((1.5 + k) * (2 + k) / ((3 + k) * (k + 1)) * 0.99999))).sum()
    assert V._hyp2f1(1.5, 2.0, 3.0, 0.99999) == pytest.approx(plain, rel=1e-9)
    assert np.isnan(V._hyp2f1(1.0, 1.0, 2.0, 0.999999, max_terms=100))  # never a partial sum


def test_unfinished_fit_is_reported(rfm):
    with pytest.raises(RuntimeError, match="no optimum"):
        V.fit_gamma_gamma(rfm, max_iter=3, require_convergence=True)


def test_more_than_four_segments(spark):
    clv = spark.createDataFrame([(str(i), float(i)) for i in range(60)], "empresa_id string, clv_12m_predicted double")
    got = V.segment_by_clv(clv, 12, 6).groupBy("clv_segment").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(f"segment_{i}", 10) for i in range(1, 7)]


def test_recovers_parameters_of_simulated_customers(spark):
    rng = np.random.default_rng(8)
    r, alpha, a, b = 0.9, 20.0, 0.8, 2.5
    rows = []
    for i in range(4000):
        rate, drop, span = rng.gamma(r, 1 / alpha), rng.beta(a, b), rng.uniform(100, 400)
        t = x = tx = 0
        while (t := t + rng.exponential(1 / rate)) <= span:
            x, tx = x + 1, t
            if rng.random() < drop:
                break
        rows.append((str(i), float(x), float(tx), span, 0.0))
    rfm = spark.createDataFrame(rows, "empresa_id string, frequency double, recency double, T double, monetary_value double")
    p, _, _, converged = V.fit_bgnbd(rfm, penalizer=0.0)
    assert converged
    assert p.r / p.alpha == pytest.approx(r / alpha, rel=0.1) and p.a / (p.a + p.b) == pytest.approx(a / (a + b), rel=0.15)


def test_recovers_spend_parameters(spark):
    rng = np.random.default_rng(4)
    p, q, v = 4.0, 3.5, 900.0
    rows = []
    for i in range(6000):
        x = int(rng.integers(1, 9))
        rows.append((str(i), float(x), 1.0, 2.0, float(rng.gamma(p * x, 1 / rng.gamma(q, 1 / v)) / x)))
    rfm = spark.createDataFrame(rows, "empresa_id string, frequency double, recency double, T double, monetary_value double")
    got, _, jobs, converged = V.fit_gamma_gamma(rfm, penalizer=0.0)
    assert converged and jobs <= 40
    assert (got.p, got.q, got.v) == pytest.approx((p, q, v), rel=0.15)


def test_a_slow_value_does_not_hold_up_its_batch(monkeypatch):
    steps = []
    real = V.np.isfinite
    monkeypatch.setattr(V.np, "isfinite", lambda v: steps.append(np.size(v)) or real(v))
    z = np.r_[np.full(999, 0.1), 0.89]
    got = V._series_2f1(np.full(1000, 2.5), np.full(1000, 3.5), np.full(1000, 4.2), z, 100_000)
    assert sum(steps) < 1000 * 40 and len(steps) > 100  # one value needs more than 100 terms, the others fewer than 40
    assert np.allclose(got[:1], V._series_2f1(np.array([2.5]), np.array([3.5]), np.array([4.2]), z[:1], 1000), rtol=0)


def test_likelihoods_take_no_powers():
    assert not any("pow(" in expression for model in (V.BGNBD, V.GAMMA_GAMMA) for stage in model.stages for expression in stage)
