"""T4–T6 on a two-batch event fixture: duplicates, a late row, same-instant events."""

import datetime as dt
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstat.sources.io import SCHEMAS
from loomstat.streaming import live as T


def _write(path, rows):
    cols = list(zip(*rows))
    table = pa.table({"event_id": pa.array(cols[0], pa.int64()), "ts": pa.array(cols[1], pa.timestamp("us")),
                      "user_id": pa.array(cols[2], pa.int64()), "event_type": pa.array(cols[3]),
                      "value": pa.array(cols[4], pa.float64()), "props": pa.array(cols[5])})
    pq.write_table(table, path)


@pytest.fixture(scope="module")
def event_dir(tmp_path_factory):
    """Three files read as three micro-batches. Spark judges lateness against the watermark
    reached before the previous batch, so the late row comes two batches after the data
    that moved the watermark."""
    d = tmp_path_factory.mktemp("events")
    day = dt.datetime(2024, 1, 1)
    first = [(1, day.replace(hour=10), 7, "view", 1.0, "{}"), (2, day.replace(hour=10), 7, "click", 2.0, "{}"),
             (3, day.replace(hour=10, minute=20), 7, "view", 1.0, "{}"),  # same session as 1-2 (same instant too)
             (4, day.replace(hour=12), 8, "view", 1.0, "{}"),
             (5, day + dt.timedelta(days=1, hours=5), 8, "view", 1.0, "{}")]
    second = [(5, day + dt.timedelta(days=1, hours=5), 8, "view", 1.0, "{}"),  # duplicate id, within the watermark
              (7, day + dt.timedelta(days=1, hours=6), 8, "view", 1.0, "{}"),
              (8, day + dt.timedelta(days=3), 8, "view", 1.0, "{}")]         # pushes the watermark past day 2
    third = [(6, day.replace(hour=1), 9, "view", 1.0, "{}")]                 # late: older than the watermark
    for name, rows in (("a", first), ("b", second), ("c", third)):
        _write(os.path.join(d, f"{name}.parquet"), rows)
        time.sleep(1.1)  # the file source orders new files by modification time
    return str(d)


def _stream(spark, path):
    return (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(path)
            .withColumn("ts", F.col("ts").cast("timestamp")))


def test_dedup_drops_duplicates_and_late_rows(spark, event_dir):
    out = T.run_available_now(T.deduplicated_events(_stream(spark, event_dir)), spark, "t6-test")
    ids = sorted(r["event_id"] for r in out.collect())
    assert ids == [1, 2, 3, 4, 5, 7, 8]  # 2 once, 6 dropped as late


def test_sessions_and_daily_activity(spark, event_dir):
    sess = T.run_available_now(T.user_sessions(_stream(spark, event_dir)), spark, "t5-test")
    rows = sorted((r["user_id"], r["inicio"], r["n_eventos"]) for r in sess.collect())
    # user 7: events at 10:00, 10:00 (same instant) and 10:20 form one session
    assert (7, dt.datetime(2024, 1, 1, 10, 0), 3) in rows
    daily = T.run_available_now(T.daily_activity(_stream(spark, event_dir)), spark, "t4-test")
    by_day = {r["dia"].date(): r for r in daily.collect()}
    d1 = by_day[dt.date(2024, 1, 1)]
    assert d1["total_eventos"] == 4 and d1["usuarios_ativos"] == 2  # late event of user 9 is not counted
    assert dt.date(2024, 1, 4) not in by_day  # window still open at the end of the input


def test_open_windows_are_added(spark, event_dir):
    events = spark.read.schema(SCHEMAS["events"]).parquet(event_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    seen = T.deduplicated_events(_stream(spark, event_dir))
    on_time = T.run_available_now(seen, spark, "open").cache()
    daily = T.with_open_days(T.run_available_now(T.daily_activity(_stream(spark, event_dir)), spark, "t4-open"), events)
    by_day = {r["dia"].date(): r["total_eventos"] for r in daily.collect()}
    assert by_day == {dt.date(2024, 1, 1): 4, dt.date(2024, 1, 2): 3, dt.date(2024, 1, 4): 1}  # all but the late row
    sess = T.with_open_sessions(T.run_available_now(T.user_sessions(_stream(spark, event_dir)), spark, "t5-open"), events)
    assert sess.agg(F.sum("n_eventos")).first()[0] == 8 and on_time.count() == 7
    assert sess.where("inicio >= '2024-01-04'").count() == 1


@pytest.mark.parametrize("folder", [False, True])
def test_event_stream_reads_a_file_and_a_folder(spark, tmp_path, folder):
    rows = [(i, dt.datetime(2024, 1, 1, i), 1, "view", 1.0, "{}") for i in range(4)]
    if folder:
        os.makedirs(tmp_path / "events.parquet")
        _write(str(tmp_path / "events.parquet" / "part-0.parquet"), rows[:2])
        _write(str(tmp_path / "events.parquet" / "part-1.parquet"), rows[2:] + rows[:1])  # one id twice
    else:
        _write(str(tmp_path / "events.parquet"), rows + rows[:1])
        _write(str(tmp_path / "other.parquet"), [(99, dt.datetime(2024, 1, 1), 1, "view", 1.0, "{}")])
    out = T.run_available_now(T.deduplicated_events(T.event_stream(spark, str(tmp_path))), spark, "layout")
    assert sorted(r["event_id"] for r in out.collect()) == [0, 1, 2, 3]
    assert T.event_batch(spark, str(tmp_path)).count() == 5


def test_order_codes_stay_distinct(spark):
    orders = spark.range(120_000).select(F.col("id"), F.lit(dt.datetime(1997, 5, 1)).alias("created_at"))
    codes = T.order_codes(orders)
    r = codes.agg(F.countDistinct("codigo").alias("n"), F.min("codigo").alias("lo"), F.max(F.length("codigo")).alias("w")).first()
    assert (r["n"], r["lo"], r["w"]) == (120_000, "PED-1997-00001", len("PED-1997-120000"))


def test_source_order_codes_above_seven_digits(spark, market, tmp_path):
    from loomstat.sources.binding import bind

    big = bind(spark, market.sf_dir, market.as_of)
    big._raw["orders"] = market.raw("orders").limit(10).withColumn("o_orderkey", F.lit(9_999_995) + F.row_number().over(Window.orderBy("o_orderkey")))
    codes = sorted(r[0].split("-")[2] for r in big.pedidos.select("codigo").collect())
    assert len(set(codes)) == 10 and "10000000" in codes and "9999996" in codes


def _batch(spark, rows):
    return spark.createDataFrame(rows, "k long, v double, at long")


def test_upsert_updates_retries_and_refuses_a_lost_snapshot(spark, tmp_path):
    base = str(tmp_path / "s")
    write = T.upsert_snapshot(base, ["k"], "at")
    write(_batch(spark, [(1, 1.0, 1), (2, 2.0, 1), (1, 1.5, 2)]), 0)
    write(_batch(spark, [(1, 9.0, 3), (3, 3.0, 3)]), 1)
    want = {(1, 9.0), (2, 2.0), (3, 3.0)}
    assert {(r["k"], r["v"]) for r in T.latest_snapshot(spark, base).collect()} == want
    write(_batch(spark, [(1, 9.0, 3), (3, 3.0, 3)]), 1)  # the epoch again, as after a failure
    assert {(r["k"], r["v"]) for r in T.latest_snapshot(spark, base).collect()} == want
    write(_batch(spark, [(2, 7.0, 4)]), 2)
    assert sorted(n for n in os.listdir(f"{base}/manifest") if n.endswith(".json")) == ["0000000001.json", "0000000002.json"]
    with pytest.raises(FileNotFoundError):
        write(_batch(spark, [(5, 1.0, 9)]), 9)
