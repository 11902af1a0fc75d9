"""Live versions of the metrics as Structured Streaming jobs, plus T3 (order codes).

Streams read the event log (or lineitem for reviews) as a file source; tests and the
registry run them with ``trigger(availableNow=True)`` into a Parquet sink under the
shared checkpoint folder (``spark.checkpoint.dir``) and read the sink back, so the
output never passes through the driver. Windows still open when the input ends (their end is
beyond the watermark) stay in the stream's state; ``with_open_days`` and ``with_open_sessions``
add them from the same events, so every event that the stream accepts is counted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.session import ensure_checkpoint_dir
from loomstat.sources.io import SCHEMAS
from loomstat.streaming.upsert import latest_snapshot, upsert_snapshot

WATERMARK = "1 hour"
SESSION_GAP = "30 minutes"


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Structured Streaming source over the event table (timestamps cast at the source:
    watermarks reject zone-less timestamps)."""
    r = spark.readStream.schema(SCHEMAS["events"])
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    path = f"{sf_dir}/events.parquet"
    if _is_folder(spark, path):  # part files of a table
        return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return r.option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a batch."""
    return spark.read.schema(SCHEMAS["events"]).parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _final_watermark(events: DataFrame, watermark: str) -> F.Column:
    return events.agg(F.max("ts") - F.expr(f"INTERVAL {watermark}")).scalar()


def with_open_days(closed: DataFrame, events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """T4's closed days and the days that end beyond the final watermark (the last day or two of the input)."""
    day = F.date_trunc("day", F.col("ts"))
    late = events.withColumn("_w", _final_watermark(events, watermark)).where(day + F.expr("INTERVAL 1 DAY") > F.col("_w"))
    return closed.unionByName(_daily(late))


def with_open_sessions(closed: DataFrame, events: DataFrame, gap: str = SESSION_GAP, watermark: str = WATERMARK) -> DataFrame:
    """T5's closed sessions and, per user, those of the events after the last closed one that end beyond the final watermark."""
    last = closed.groupBy("user_id").agg(F.max("fim").alias("_last"))
    rest = events.join(last, "user_id", "left").where(F.col("_last").isNull() | (F.col("ts") >= F.col("_last")))
    open_ = _sessions(rest, gap).withColumn("_w", _final_watermark(events, watermark)).where(F.col("fim") > F.col("_w")).drop("_w")
    return closed.unionByName(open_)


def daily_activity(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """T4: per day: events, exact distinct users, exact distinct sessions (user + hour).
    Exact distinct counts are not allowed on a stream; grouping first by (day, user, session),
    then (day, user), then day gives them exactly, with state bounded by the watermark."""
    return _daily(events.withWatermark("ts", watermark))


def _daily(events: DataFrame) -> DataFrame:
    e = events.withColumn(
        "session_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMddHH")))
    l1 = e.groupBy(F.window("ts", "1 day").alias("w"), "user_id", "session_id").agg(F.count(F.lit(1)).alias("n"))
    l2 = l1.groupBy("w", "user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"))
    l3 = l2.groupBy("w").agg(F.sum("n").alias("total_eventos"), F.count(F.lit(1)).alias("usuarios_ativos"),
                             F.sum("s").alias("sessoes"))
    return l3.select(F.col("w.start").alias("dia"), "total_eventos", "usuarios_ativos", "sessoes")


def user_sessions(events: DataFrame, gap: str = SESSION_GAP, watermark: str = WATERMARK) -> DataFrame:
    """T5: sessions per user (start, end = last event + gap, number of events)."""
    return _sessions(events.withWatermark("ts", watermark), gap)


def _sessions(events: DataFrame, gap: str) -> DataFrame:
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n_eventos"))
    return s.select("user_id", F.col("s.start").alias("inicio"), F.col("s.end").alias("fim"), "n_eventos")


def deduplicated_events(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """De-duplicated ingest by event id; rows later than the watermark are dropped.
    Lateness is judged against the watermark reached before the previous micro-batch
    (Spark's watermark for late events), duplicates against ids still in state."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def run_available_now(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a streaming DataFrame to completion into Parquet under the shared checkpoint
    folder and return the written table as a batch DataFrame."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex}"
    q = (df.writeStream.format("parquet").outputMode("append").option("path", base + "/out")
         .option("checkpointLocation", base + "/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(base + "/out")


def order_codes(pedidos: DataFrame) -> DataFrame:
    """``PED-YYYY-NNNNN`` (more digits from the 100,000th order of a year on) numbered per creation year by (created_at, id). Assigned in
    the batch layer: a count+1 trigger races under concurrency. The per-year sequence is a
    global row number over (year, created_at, id) minus the rows of earlier years, so a
    large year is spread over many tasks rather than one window partition."""
    from pyspark.sql import Window

    from loomstat.functions.ranks import global_row_number

    p = pedidos.select(F.col("id").alias("pedido_id"), "created_at", F.year("created_at").alias("ano"))
    numbered = global_row_number(p, [F.col("ano"), F.col("created_at"), F.col("pedido_id")], "_g")
    per_year = p.groupBy("ano").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("ano").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_year.select("ano", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    j = numbered.join(F.broadcast(offsets), "ano")  # one row per year
    seq = F.col("_g") - F.col("_before")
    return j.select("pedido_id", "ano", seq.alias("seq"),
                    F.concat(F.lit("PED-"), F.col("ano").cast("string"), F.lit("-"),
                             F.format_string("%05d", seq)).alias("codigo"))  # five digits at least


# ---------------------------------------------------------------- T1 / T2
def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def live_workshop_scores(reviews: DataFrame) -> DataFrame:
    """Per workshop, the rounded mean of each rating dimension (NULLs skipped) and the
    number of reviews, maintained as reviews arrive (streaming aggregation, update mode).
    State is one row per workshop."""
    from loomstat.functions.scalar import dround

    r = reviews.where(F.col("avaliado_oficina_id").isNotNull())
    return r.groupBy(F.col("avaliado_oficina_id").alias("oficina_id")).agg(
        dround(F.avg("nota_qualidade"), 2).alias("score_qualidade"),
        dround(F.avg("nota_pontualidade"), 2).alias("score_pontualidade"),
        dround(F.avg("nota_comunicacao"), 2).alias("score_comunicacao"),
        F.count(F.lit(1)).alias("total_avaliacoes"),
        F.max("created_at").alias("updated_at"))


#: Micro-batches of a backlog. Each one updates up to all workshops, so their number must not follow the number of files.
BACKLOG_BATCHES = 8


def run_live_scores(spark: SparkSession, reviews_path: str, name: str = "t1", files_per_trigger: int | None = None) -> DataFrame:
    """Run T1 over a Parquet directory of reviews as a file stream (``BACKLOG_BATCHES`` micro-batches at most, or so many
    files each), upserting each batch's updated workshops into the buckets they fall into (T2)."""
    reviews = spark.read.parquet(reviews_path)
    schema = reviews.schema
    files_per_trigger = files_per_trigger or max(1, -(-len(reviews.inputFiles()) // BACKLOG_BATCHES))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(reviews_path)
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/streams/{name}-{uuid.uuid4().hex}"
    q = (live_workshop_scores(stream).writeStream.outputMode("update")
         .foreachBatch(upsert_snapshot(base + "/snapshots", ["oficina_id"], "updated_at"))
         .option("checkpointLocation", base + "/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_snapshot(spark, base + "/snapshots")
