"""Quantiles by refined histograms against a sort."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import ranks as R


@pytest.mark.parametrize("kind", ["money", "double", "huge range", "ties", "one", "large decimals"])
def test_against_a_sort(spark, kind, monkeypatch):
    rng = random.Random(kind)
    n = {"one": 1}.get(kind, 700)
    make = {"money": lambda: Decimal(rng.randrange(10**7)) / 100, "double": lambda: rng.gauss(0, 1e3), "huge range": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 307),
            "ties": lambda: float(rng.choice([1, 1, 1, 2, 5])), "one": lambda: 3.5, "large decimals": lambda: Decimal(10**25 + rng.randrange(4)) / 100}[kind]
    values = [make() for _ in range(n)]
    schema = "v decimal(38,2)" if isinstance(values[0], Decimal) else "v double"
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, schema).repartition(3)
    monkeypatch.setattr(R, "REFINE_BUCKETS", 16 if kind != "huge range" else 512)
    got_n, got = R.order_statistics(df, "v", lambda k: [0, 1, 2, k // 3 + 1, k - 1, k, k + 1])
    want = sorted(values)
    assert got_n == n and got == {p: want[p - 1] for p in {1, 2, n // 3 + 1, n - 1, n} if 1 <= p <= n}
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    if kind != "huge range":
        assert R.quantile_values(df, "v", qs) == pytest.approx(list(np.quantile([float(v) for v in values], qs)), rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert R.quantile_values(df, "v", [0.5]) is None and R.global_quantiles(df, "v", {"m": 0.5}).first()["m"] is None


def test_passes_are_aggregates(spark, monkeypatch):
    """No sort, range shuffle or checkpoint; few passes for money."""
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(10**9)) / 100).cast("decimal(18,2)").alias("v"))
    plans = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    got = R.quantile_values(df, "v", [0.25, 0.5, 0.75])
    monkeypatch.undo()
    assert got == pytest.approx(df.selectExpr("percentile(v, array(0.25D, 0.5D, 0.75D))").first()[0])
    assert 1 <= len(plans) <= 5 and not any(w in p for p in plans for w in ("rangepartitioning", "Sort ", "Checkpoint"))
