"""Lifetime value: RFM summary (V1) and BG/NBD quantities as column expressions (V5, V6).

The reference fits BG/NBD + Gamma-Gamma with an in-process library. Here the
per-customer summary is a distributed two-level aggregate and model quantities
are plain column expressions; only fitted parameters (a handful of floats) ever
cross to the driver. Not claimed to be numerically identical to that library.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators import staging as S
from loomstat.sources.binding import Marketplace


def transactions(m: Marketplace) -> DataFrame:
    """Completed orders with a positive value: (empresa_id, order_date, valor_final)."""
    p = S.stg_pedidos(m).where(F.col("foi_finalizado") & (F.col("valor_final") > 0))
    return p.select("empresa_id", F.to_date("dt_criacao").alias("order_date"), "valor_final")


def rfm_summary(tx: DataFrame, include_first_in_monetary: bool = False) -> DataFrame:
    """V1: per customer, with a daily period: frequency = repeat purchase days,
    recency = days from first to last purchase day, T = days from first purchase day to
    the observation end (the last purchase day in the data), monetary_value = mean daily
    spend over repeat days (0 without repeats), or over all days when
    ``include_first_in_monetary``."""
    days = tx.groupBy("empresa_id", "order_date").agg(F.sum("valor_final").alias("_v"))
    end = tx.agg(F.max("order_date")).scalar()  # observation end: scalar subquery
    g = days.groupBy("empresa_id").agg(
        F.min("order_date").alias("_first"), F.max("order_date").alias("_last"), (F.count(F.lit(1)) - 1).alias("frequency"),
        F.sum("_v").alias("_all"), F.min_by("_v", "order_date").alias("_first_v"))
    if include_first_in_monetary:
        g = g.withColumns({"_mv_sum": F.col("_all"), "_mv_n": F.col("frequency") + 1})
    else:  # repeat days only
        g = g.withColumns({"_mv_sum": F.col("_all") - F.col("_first_v"), "_mv_n": F.col("frequency")})
    g = g.withColumn("_end", end)
    mv = F.when(F.col("_mv_n") > 0, F.round(F.col("_mv_sum").cast("decimal(28,2)") / F.col("_mv_n").cast("decimal(20,0)"), 2))
    return g.select(
        "empresa_id",
        F.col("frequency").cast("double").alias("frequency"),
        F.datediff("_last", "_first").cast("double").alias("recency"),
        F.datediff("_end", "_first").cast("double").alias("T"),
        F.coalesce(mv.cast("double"), F.lit(0.0)).alias("monetary_value"))


@dataclass(frozen=True)
class BGNBDParams:
    r: float
    alpha: float
    a: float
    b: float


def probability_alive(rfm: DataFrame, p: BGNBDParams, digits: int = 6) -> DataFrame:
    """V6: P(alive | x, t_x, T) = 1 / (1 + [x>0] · a/(b+x-1) · ((α+T)/(α+t_x))^(r+x))."""
    x, tx, T = F.col("frequency"), F.col("recency"), F.col("T")
    term = (F.lit(p.a) / (F.lit(p.b) + x - 1.0)) * F.pow((F.lit(p.alpha) + T) / (F.lit(p.alpha) + tx), F.lit(p.r) + x)
    pa = F.when(x > 0, F.lit(1.0) / (F.lit(1.0) + term)).otherwise(F.lit(1.0))
    m = float(10 ** digits)
    return rfm.select("empresa_id", "frequency", "recency", "T", (F.round(pa * m) / m).alias("prob_alive"))


# ====================================================================== model fitting (V2, V3)
import math  # noqa: E402
from collections.abc import Callable  # noqa: E402

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

LN_2PI_HALF = 0.5 * math.log(2 * math.pi)


def lgamma_col(z: F.Column) -> F.Column:
    """ln Γ(z) for z > 0 as a column expression: shift by 8, then Stirling's series
    (absolute error below 1e-13), so the likelihood stays in whole-stage codegen."""
    y = z + 8.0
    series = ((y - 0.5) * F.log(y) - y + F.lit(LN_2PI_HALF) + 1.0 / (12.0 * y) - 1.0 / (360.0 * F.pow(y, 3))
              + 1.0 / (1260.0 * F.pow(y, 5)) - 1.0 / (1680.0 * F.pow(y, 7)))
    shift = F.log(z)
    for i in range(1, 8):
        shift = shift + F.log(z + float(i))
    return series - shift


def lgamma_sql(z: str) -> str:
    """``lgamma_col`` as SQL text over a column, with one logarithm for the whole shift and the series in products (a power
    costs as much as a logarithm)."""
    y, shift = f"({z} + 8)", " * ".join(f"({z} + {i})" for i in range(8))
    y2 = f"({y} * {y})"
    series = f"(1D / 12 - (1D / 360 - (1D / 1260 - 1 / (1680 * {y2})) / {y2}) / {y2}) / {y}"
    return f"(({y} - 0.5D) * ln({y}) - {y} + {LN_2PI_HALF!r}D + {series} - ln({shift}))"


def digamma_sql(z: str) -> str:
    """ψ(z), the derivative of ln Γ, for z > 0: the same shift by 8 and the derivative of its series."""
    y, shift = f"({z} + 8)", " + ".join(f"1 / ({z} + {i})" for i in range(8))
    y2 = f"({y} * {y})"
    series = f"(1D / 12 - (1D / 120 - (1D / 252 - (1D / 240 - 1 / (132 * {y2})) / {y2}) / {y2}) / {y2}) / {y2}"
    return f"(ln({y}) - 0.5D / {y} - {series} - ({shift}))"


def digamma(z: float) -> float:
    """ψ(z) of a parameter."""
    y = z + 8.0
    return (math.log(y) - 0.5 / y - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - 1 / (132 * y**10)
            - sum(1.0 / (z + i) for i in range(8)))


def _log_rising(base: F.Column, n: F.Column) -> F.Column:
    """Σ_{i<n} ln(base + i) for a non-negative integer n (= lnΓ(base+n) - lnΓ(base))."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0),
                                     lambda acc, i: acc + F.log(base + i.cast("double")))).otherwise(F.lit(0.0))


def bgnbd_stats(rfm: DataFrame) -> DataFrame:
    """BG/NBD sufficient statistics: customers grouped by (x, t_x, T) with a weight,
    materialised once (every likelihood evaluation reuses it)."""
    return (rfm.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("w"))
            .select(F.col("frequency").cast("int").alias("x"), F.col("recency").alias("tx"), F.col("T").alias("tt"),
                    F.col("w").cast("double").alias("w")))


def bgnbd_loglik(x: F.Column, tx: F.Column, tt: F.Column, r, alpha, a, b) -> F.Column:
    """Per-customer BG/NBD log-likelihood (Fader, Hardie & Lee 2005); parameters may be columns."""
    xd = x.cast("double")
    a1 = _log_rising(r, x) + r * F.log(alpha)
    a2 = _log_rising(b, x) - _log_rising(a + b, x)
    a3 = -(r + xd) * F.log(alpha + tt)
    a4 = F.log(a) - F.log(b + F.greatest(xd, F.lit(1.0)) - 1.0) - (r + xd) * F.log(tx + alpha)
    mx = F.greatest(a3, a4)
    return a1 + a2 + F.log(F.exp(a3 - mx) + F.when(x > 0, F.exp(a4 - mx)).otherwise(F.lit(0.0))) + mx


Evaluation = tuple[float, np.ndarray]


@dataclass(frozen=True)
class Likelihood:
    """A model's log-likelihood with closed-form derivatives over a statistics table.

    ``known(*parameters)`` names the values that hold for all customers (the parameters and functions of them), ``stages`` are
    select lists, each over the columns of the one before, so that no intermediate is written out twice; the last one names
    the log-likelihood ``value`` and its derivatives ``slope0``, ``slope1``, ... by the parameters."""

    parameters: int
    known: Callable[..., dict[str, float]]
    stages: tuple[tuple[str, ...], ...]


def _evaluate(stats: DataFrame, cands: list[np.ndarray], model: Likelihood, penalizer: float) -> list[Evaluation]:
    """Objective and gradient of several log-parameter vectors in one job.

    The few candidates are a literal array exploded against every statistics row; one aggregate sums value and gradient of
    each. Returned are the mean negative log-likelihood + penalizer·Σθ² and its derivative by the logarithms of the parameters."""
    theta = [np.exp(c) for c in cands]
    known = [model.known(*map(float, t)) for t in theta]
    lits = F.array(*[F.struct(F.lit(i).alias("cid"), *[F.lit(float(v)).alias(k) for k, v in at.items()]) for i, at in enumerate(known)])
    rows = stats.select("*", F.explode(lits).alias("_c")).select("*", "_c.*").drop("_c")
    for stage in model.stages:
        rows = rows.selectExpr("*", *stage)
    names = ["value", *[f"slope{j}" for j in range(model.parameters)]]
    got = {r["cid"]: r for r in rows.groupBy("cid").agg(*[F.expr(f"sum(w * {c}) / sum(w) AS {c}") for c in names]).collect()}  # a row a candidate
    out = []
    for i, t in enumerate(theta):
        parts = np.array([got[i][c] for c in names] if i in got else [math.nan] * len(names), float)
        f = -parts[0] + penalizer * float(t @ t)
        g = t * (-parts[1:] + 2 * penalizer * t)
        out.append((float(f), g) if np.isfinite(f) and np.isfinite(g).all() else (math.inf, np.full(len(t), math.nan)))
    return out


STEPS = (1.0, 0.4, 0.1, 0.02)


def quasi_newton(evaluate, x0: np.ndarray, max_iter: int = 100, gtol: float = 1e-7, longest: float = 2.0) -> tuple[np.ndarray, float, int, bool]:
    """BFGS on the driver over a handful of parameters; every iteration is one evaluation (one Spark job) of the step lengths
    ``STEPS`` along the search direction. A step is at most ``longest`` in any log-parameter. Returns the point, its value,
    the number of evaluations and whether the gradient vanished (or value and point stand still next to it)."""
    x, inverse = np.array(x0, float), np.eye(len(x0))
    (f, g), jobs, scaled = evaluate([x])[0], 1, False
    while True:
        if np.abs(g).max() <= gtol:
            return x, f, jobs, True
        if jobs >= max_iter:
            return x, f, jobs, False
        d = -inverse @ g
        if d @ g >= 0:  # no descent: start the curvature anew
            inverse, scaled = np.eye(len(x)), False
            d = -g
        d *= min(1.0, longest / np.abs(d).max())
        tried = evaluate([x + t * d for t in STEPS])
        jobs += 1
        best = min((i for i in range(len(STEPS)) if tried[i][0] <= f + 1e-4 * STEPS[i] * (d @ g)), key=lambda i: tried[i][0], default=None)
        if best is None:
            if np.array_equal(inverse, np.eye(len(x))) or np.abs(g).max() <= 100 * gtol:
                if np.abs(g).max() <= 1000 * gtol:  # rounding of the sums hides what is left
                    return x, f, jobs, True
                longest /= 50
                if longest < 1e-9:
                    return x, f, jobs, False
            inverse, scaled = np.eye(len(x)), False
            continue
        s, y = STEPS[best] * d, tried[best][1] - g
        x, (f, g) = x + s, tried[best]
        sy = float(s @ y)
        if sy > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            if not scaled:
                inverse, scaled = np.eye(len(x)) * (sy / float(y @ y)), True
            left = np.eye(len(x)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy


@dataclass(frozen=True)
class GGParams:
    p: float
    q: float
    v: float


def _bgnbd_known(r: float, alpha: float, a: float, b: float) -> dict[str, float]:
    return {"r": r, "alpha": alpha, "a": a, "b": b, "lg_const": r * math.log(alpha) - math.lgamma(r) - math.lgamma(b) + math.lgamma(a + b),
            "ln_alpha": math.log(alpha), "ln_a": math.log(a), "dg_r": digamma(r), "dg_b": digamma(b), "dg_ab": digamma(a + b)}


#: BG/NBD over rows (x, tx, tt, w); ``share``: how likely the customer dropped out right after the last purchase.
BGNBD = Likelihood(4, _bgnbd_known, (
    ("double(x) + r AS rx", "double(x) + b AS bx", "double(x) + a + b AS abx", "alpha + tx AS dead", "alpha + tt AS alive"),
    ("ln(dead) AS ln_dead", "ln(alive) AS ln_alive", f"{lgamma_sql('rx')} + {lgamma_sql('bx')} - {lgamma_sql('abx')} + lg_const AS common",
     f"{digamma_sql('rx')} - dg_r AS up_r", f"{digamma_sql('bx')} - dg_b AS up_b", f"{digamma_sql('abx')} - dg_ab AS up_ab"),
    ("-rx * ln_alive AS here", "CASE WHEN x > 0 THEN ln_a - ln(bx - 1) - rx * ln_dead END AS gone"),
    ("greatest(here, gone) AS top",),  # passes over null
    ("exp(here - top) AS e_here", "coalesce(exp(gone - top), 0D) AS e_gone"),
    ("e_gone / (e_here + e_gone) AS share", "common + top + ln(e_here + e_gone) AS value"),
    ("up_r + ln_alpha - (1 - share) * ln_alive - share * ln_dead AS slope0", "r / alpha - rx * ((1 - share) / alive + share / dead) AS slope1",
     "share / a - up_ab AS slope2", "up_b - up_ab - CASE WHEN x > 0 THEN share / (bx - 1) ELSE 0D END AS slope3")))


def _fitted(stats: DataFrame, model: Likelihood, penalizer: float, max_iter: int, require: bool):
    x, f, it, converged = quasi_newton(lambda c: _evaluate(stats, c, model, penalizer), np.zeros(model.parameters), max_iter=max_iter)
    if require and not converged:
        raise RuntimeError(f"no optimum within {max_iter} iterations (objective {f})")
    return np.exp(x), float(f), it, converged


def fit_bgnbd(rfm: DataFrame, penalizer: float = 0.001, max_iter: int = 400, require_convergence: bool = False) -> tuple[BGNBDParams, float, int, bool]:
    """V2: maximum likelihood BG/NBD (mean negative log-likelihood + penalizer·Σθ², on log-parameters) over the customers
    grouped by (x, t_x, T). Returns the parameters, the objective, the evaluations (one job each) and whether it converged."""
    stats = bgnbd_stats(rfm).checkpoint(eager=True)
    (r, alpha, a, b), f, it, converged = _fitted(stats, BGNBD, penalizer, max_iter, require_convergence)
    return BGNBDParams(float(r), float(alpha), float(a), float(b)), f, it, converged


def gg_loglik(x: F.Column, m: F.Column, p, q, v) -> F.Column:
    """Per-customer Gamma-Gamma log-likelihood of the mean spend m over x repeat purchases."""
    px = p * x
    return (lgamma_col(px + q) - lgamma_col(px) - lgamma_col(q) + q * F.log(v) + (px - 1.0) * F.log(m)
            + px * F.log(x) - (px + q) * F.log(x * m + v))


def _gg_known(p: float, q: float, v: float) -> dict[str, float]:
    return {"p": p, "q": q, "v": v, "ln_v": math.log(v), "lg_q": math.lgamma(q), "dg_q": digamma(q)}


#: Gamma-Gamma over rows (x, m, w).
GAMMA_GAMMA = Likelihood(3, _gg_known, (
    ("p * x AS px", "x * m + v AS spent", "ln(m) AS ln_m", "ln(x) AS ln_x"),
    ("px + q AS pxq", "ln(spent) AS ln_spent"),
    (f"{digamma_sql('pxq')} AS joint", f"{digamma_sql('px')} AS own", f"{lgamma_sql('pxq')} - {lgamma_sql('px')} AS ratio"),
    ("ratio - lg_q + q * ln_v + (px - 1) * ln_m + px * ln_x - pxq * ln_spent AS value",
     "x * (joint - own + ln_m + ln_x - ln_spent) AS slope0", "joint - dg_q + ln_v - ln_spent AS slope1", "q / v - pxq / spent AS slope2")))


def fit_gamma_gamma(rfm: DataFrame, penalizer: float = 0.001, max_iter: int = 400, require_convergence: bool = False) -> tuple[GGParams, float, int, bool]:
    """V3: Gamma-Gamma spend model on repeat buyers (frequency > 0, positive spend), grouped by (x, m)."""
    buyers = rfm.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    stats = (buyers.groupBy(F.col("frequency").alias("x"), F.col("monetary_value").alias("m")).agg(F.count(F.lit(1)).cast("double").alias("w"))
             .checkpoint(eager=True))
    (p, q, v), f, it, converged = _fitted(stats, GAMMA_GAMMA, penalizer, max_iter, require_convergence)
    return GGParams(float(p), float(q), float(v)), f, it, converged


# ====================================================================== prediction (V4, V5, V7)
def _lgamma(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln |Γ(z)| and the sign of Γ(z); infinite at the poles 0, -1, -2, ..."""
    z = np.asarray(z, dtype=float)
    pole = (z <= 0) & (z == np.round(z))
    value = np.vectorize(math.lgamma, otypes=[float])(np.where(pole, 1.0, z)) if z.size else z
    return np.where(pole, np.inf, value), np.where((z > 0) | (np.floor(z) % 2 == 0), 1.0, -1.0)


def _series_2f1(a, b, c, z, max_terms: int) -> np.ndarray:
    """Gauss series; NaN where ``max_terms`` terms do not reach double precision. A value whose series has converged takes
    no further part, so a batch costs the terms of each value and not the most of any."""
    out = np.full(z.shape, np.nan)
    at, term, total = np.arange(z.size), np.ones_like(z), np.ones_like(z)
    for k in range(max_terms):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        active = np.abs(term) > 1e-16 * np.abs(total)
        finite = np.isfinite(total)
        out[at[~active & finite]] = total[~active & finite]
        active &= finite
        if not active.all():
            at, a, b, c, z, term, total = (v[active] for v in (at, a, b, c, z, term, total))
            if not at.size:
                break
    return out


def _hyp2f1(a: np.ndarray, b: np.ndarray, c: np.ndarray, z: np.ndarray, max_terms: int = 2_000_000) -> np.ndarray:
    """₂F₁(a, b; c; z) for 0 <= z < 1, vectorised over a batch. Near 1 the series in z hardly converges; there the
    two series in 1 - z are used (unless c - a - b is next to an integer, where they cancel). Never a partial sum:
    values that do not converge are NaN."""
    a, b, c, z = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, c, z))
    d = c - a - b
    far = (z > 0.9) & (np.abs(d - np.round(d)) > 1e-5)
    out = np.empty_like(z)
    if (~far).any():
        n = ~far
        out[n] = _series_2f1(a[n], b[n], c[n], z[n], max_terms)
    if far.any():
        a, b, c, z, d = a[far], b[far], c[far], z[far], d[far]
        (gc, _), (gd, sd), (ge, se) = _lgamma(c), _lgamma(d), _lgamma(-d)
        (ca, sca), (cb, scb), (ga, sa), (gb, sb) = _lgamma(c - a), _lgamma(c - b), _lgamma(a), _lgamma(b)
        with np.errstate(over="ignore", invalid="ignore"):
            near = sd * sca * scb * np.exp(gc + gd - ca - cb) * _series_2f1(a, b, 1.0 - d, 1.0 - z, max_terms)
            rest = se * sa * sb * np.exp(gc + ge - ga - gb + d * np.log1p(-z)) * _series_2f1(c - a, c - b, 1.0 + d, 1.0 - z, max_terms)
            out[far] = near + rest
    return out


def _expected_purchases_np(t: float, x, tx, tt, p: BGNBDParams) -> np.ndarray:
    r, alpha, a, b = p.r, p.alpha, p.a, p.b
    x, tx, tt = (np.asarray(v, dtype=float) for v in (x, tx, tt))
    if t <= 0:
        return np.zeros_like(x)
    _a, _b, _c = r + x, b + x, a + b + x - 1.0
    z = t / (alpha + tt + t)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ln_hyp = np.log(_hyp2f1(_a, _b, _c, z))
        bad = ~np.isfinite(ln_hyp)
        if bad.any():  # overflow: Euler's transformation has the smaller terms
            a_, b_, c_, z_ = _a[bad], _b[bad], _c[bad], z[bad]
            ln_hyp[bad] = np.log(_hyp2f1(c_ - a_, c_ - b_, c_, z_)) + (c_ - a_ - b_) * np.log1p(-z_)
        first = (a + b + x - 1.0) / (a - 1.0)
        second = 1.0 - np.exp(ln_hyp + (r + x) * np.log((alpha + tt) / (alpha + t + tt)))
        den = 1.0 + (x > 0) * (a / (b + x - 1.0)) * ((alpha + tt) / (alpha + tx)) ** (r + x)
        return first * second / den


def expected_purchases_col(t_days: float, p: BGNBDParams):
    """V5 as an Arrow pandas UDF (₂F₁ has no built-in column form)."""
    @F.pandas_udf(T.DoubleType())
    def ep(x: pd.Series, tx: pd.Series, tt: pd.Series) -> pd.Series:
        return pd.Series(_expected_purchases_np(t_days, x.values, tx.values, tt.values, p))

    return ep(F.col("frequency"), F.col("recency"), F.col("T"))


def expected_purchases(rfm: DataFrame, p: BGNBDParams, t_days: float = 30) -> DataFrame:
    """V5: expected purchases in the next ``t_days`` per customer."""
    return rfm.select("empresa_id", expected_purchases_col(t_days, p).alias("expected_purchases"))


def predict_clv(rfm: DataFrame, bg: BGNBDParams, gg: GGParams, months: int = 12, discount_rate: float = 0.01,
                days_per_month: int = 30) -> DataFrame:
    """V4: expected purchases over months·30 days, discounted CLV (Σ over months of
    expected spend × (E[X(30k)] − E[X(30(k−1))]) / (1+d)^k) and P(alive)."""
    @F.pandas_udf(T.DoubleType())
    def clv_udf(x: pd.Series, tx: pd.Series, tt: pd.Series, m: pd.Series) -> pd.Series:
        xv, txv, ttv = x.values, tx.values, tt.values
        spend = (gg.p * (gg.v + xv * m.fillna(0).values)) / (gg.p * xv + gg.q - 1.0)
        total = np.zeros_like(xv, dtype=float)
        prev = np.zeros_like(xv, dtype=float)
        for k in range(1, months + 1):
            cur = _expected_purchases_np(days_per_month * k, xv, txv, ttv, bg)
            total = total + spend * (cur - prev) / (1.0 + discount_rate) ** k
            prev = cur
        return pd.Series(total)

    ep = expected_purchases_col(months * days_per_month, bg)
    pa = probability_alive(rfm, bg, digits=12).select("empresa_id", "prob_alive")
    out = rfm.select("empresa_id", "frequency", F.col("recency").alias("recency_days"), F.col("T").alias("age_days"),
                     F.round(F.coalesce(F.col("monetary_value"), F.lit(0.0)), 2).alias("avg_order_value"),
                     (F.round(ep * 1e3) / 1e3).alias(f"expected_purchases_{months}m"),
                     (F.round(clv_udf(F.col("frequency"), F.col("recency"), F.col("T"), F.col("monetary_value")) * 1e2)
                      / 1e2).alias(f"clv_{months}m_predicted"))
    return out.join(pa, "empresa_id").withColumn("prob_alive", F.round(F.col("prob_alive") * 1e4) / 1e4)


SEGMENT_LABELS = ["low_value", "mid_low", "mid_high", "high_value"]


def segment_by_clv(clv: DataFrame, months: int = 12, n_segments: int = 4) -> DataFrame:
    """V7: quantile-cut labels (right-closed bins, lowest value included). Edges are exact
    quantiles by refined histograms; only the values around the edges reach the driver.
    When repeated edges collapse bins, the remaining bins keep the lowest labels in order
    (pandas refuses that case: labels no longer match bins)."""
    from loomstat.functions.ranks import quantile_values

    col = f"clv_{months}m_predicted"
    edges = quantile_values(clv, col, [i / n_segments for i in range(n_segments + 1)])
    if edges is None:
        return clv.withColumn("clv_segment", F.lit(None).cast("string"))
    uniq = sorted(set(edges))
    labels = SEGMENT_LABELS[:n_segments] if n_segments <= len(SEGMENT_LABELS) else [f"segment_{i + 1}" for i in range(n_segments)]
    v = F.col(col)
    seg = F.lit(None).cast("string")
    if len(uniq) == 1:  # every value equal: a single closed bin holding all of them
        return clv.withColumn("clv_segment", F.when(v == uniq[0], F.lit(labels[0])).otherwise(seg))
    for i in range(len(uniq) - 1, 0, -1):
        lower_ok = (v >= uniq[i - 1]) if i == 1 else (v > uniq[i - 1])
        seg = F.when(lower_ok & (v <= uniq[i]), F.lit(labels[i - 1])).otherwise(seg)
    return clv.withColumn("clv_segment", seg)
