"""Distinct sketches: merged estimates against exact counts, storage by day."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from loomstat.operators import sketches as K

START = dt.date(2024, 1, 1)


def _events(spark, days=20, per_day=400, users=3000, seed=1):
    rng = random.Random(seed)
    rows = [(dt.datetime.combine(START + dt.timedelta(days=d), dt.time(rng.randrange(24))), rng.randrange(users) if rng.random() < 0.95 else None, rng.choice("abc"))
            for d in range(days) if d != 5 for _ in range(per_day)]
    return spark.createDataFrame(rows, "ts timestamp, u long, kind string"), rows


def _exact(rows, first, last, i):
    return len({r[i] for r in rows if first <= r[0].date() <= last and r[i] is not None})


def _near(got, want):
    return abs(got - want) <= max(1, K.BOUND * want)


def test_windows_and_months_by_merging(spark):
    events, rows = _events(spark)
    daily = K.daily_sketches(events, "ts", ["u", "kind"]).cache()
    assert daily.count() == 19 * 2
    got = {(r["dia"], r["column_name"]): r for r in K.rolling(daily, 7).collect()}
    assert len(got) == 19 * 2  # a day without events has no row
    for (day, column), r in got.items():
        first = day - dt.timedelta(days=6)
        assert _near(r["n_distinct"], _exact(rows, first, day, 1 if column == "u" else 2)), (day, column)
        assert r["n_rows"] == sum(first <= x[0].date() <= day for x in rows)
    month = {r["column_name"]: r["n_distinct"] for r in K.by_month(daily).collect()}
    assert _near(month["u"], _exact(rows, START, dt.date(2024, 1, 31), 1)) and month["kind"] == 3


def test_sketches_are_small_and_merge_in_partial_aggregates(spark):
    events, _ = _events(spark, days=2, per_day=3000, users=10**6)
    daily = K.daily_sketches(events, "ts", ["u"])
    assert daily.agg(F.max(F.length("sketch"))).first()[0] < 5000
    plan = K.rolling(daily)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_storage_replaces_days(spark, tmp_path):
    path = str(tmp_path / "sketches")
    events, rows = _events(spark, days=4)
    K.store(K.daily_sketches(events, "ts", ["u"]), path)
    before = {d: os.listdir(f"{path}/{d}") for d in os.listdir(path) if d.startswith("dia=")}
    later = events.where("to_date(ts) = '2024-01-03'").limit(10)
    K.store(K.daily_sketches(later, "ts", ["u"]), path)
    after = {d: os.listdir(f"{path}/{d}") for d in os.listdir(path) if d.startswith("dia=")}
    assert [d for d in before if before[d] != after[d]] == ["dia=2024-01-03"]
    got = {r["dia"]: r["n_rows"] for r in K.stored(spark, path).collect()}
    assert got == {START: 400, START + dt.timedelta(days=1): 400, START + dt.timedelta(days=2): 10, START + dt.timedelta(days=3): 400}


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1, None, 1.5, ["a"]), (2, None, 1.5, ["a"]), (2, None, None, ["b"])], "a long, `b.c` string, d double, e array<string>")
    got = {r["column_name"]: (r["null_count"], r["n_distinct"]) for r in K.profile(df).collect()}
    assert got == {"a": (0, 2), "b.c": (3, 0), "d": (1, 1), "e": (0, 2)}
    assert {r["n_distinct"] for r in K.profile(df.limit(0)).collect()} == {0}


def test_audits_keep_the_bound(market):
    got = K.rolling_audit(market).collect()
    assert got and all(r["dentro_do_limite"] for r in got)
    assert all(r["n_columns"] == r["n_within"] for r in K.profile_audit(market, ["pedidos"]).collect())
