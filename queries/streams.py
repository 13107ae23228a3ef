"""Streaming queries: events replayed from files, each equal to its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airlog.streaming import horizon, manifests, onair, plays, sinks, status, timers
from queries.registry import query
from queries.scratch import scratch


def _replayed(t, df: DataFrame, folder: str, kind: str = "parquet", files: int = 48) -> DataFrame:
    """Write rows as files, so many that each stays small, and read them back as a stream of two micro-batches."""
    df.repartition(files).write.format(kind).save(folder)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // 2)).format(kind).load(folder)


def _status_events(t) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("feature", "commercial", "bump")])
    return t.read("events").select(
        F.lit("playing").alias("status"), F.col("event_type").alias("network_name"), F.col("user_id").alias("channel_number"),
        F.col("ts").alias("timestamp"), F.concat(F.lit("title "), F.col("event_id")).alias("title"), F.col("value").alias("duration"),
        F.concat(F.lit("f"), "event_id").alias("file_path"), F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("content_type"),
        F.lit(False).alias("awaiting_pin"))


@query("latest_status", """
    SELECT user_id AS channel_number, arg_max(event_type, (ts, 'title ' || event_id)) AS network_name, max(ts) AS "timestamp",
           arg_max('title ' || event_id, (ts, 'title ' || event_id)) AS title,
           arg_max(coalesce(['feature', 'commercial', 'bump'][event_id % 4 + 1], 'unknown'), (ts, 'title ' || event_id)) AS content_type
    FROM events GROUP BY 1""")
def _(t):
    folder = scratch(t)
    _status_events(t).repartition(4).write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder + "/in")
    stream = status.latest_status(status.read_status(t.spark, folder + "/in", 2))
    out = folder + "/out"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    run.awaitTermination()
    from airlog.streaming.sinks import latest_of_each

    found = latest_of_each(t.spark, out, ["channel_number"])
    return found.select("channel_number", "network_name", "timestamp", "title", "content_type")


@query("latest_status_batch", """
    SELECT user_id AS channel_number, arg_max('title ' || event_id, (ts, 'title ' || event_id)) AS title FROM events GROUP BY 1""")
def _(t):
    return status.latest_status(_status_events(t)).select("channel_number", "title")


@query("stream_play_counts", """
    SELECT i.id, 5 + coalesce(p.n, 0) AS count FROM items i
    LEFT JOIN (SELECT station, path, count(*) AS n FROM plays GROUP BY 1, 2) p ON p.station = i.station AND p.path = i.path""")
def _(t):
    folder = scratch(t)
    stream = _replayed(t, t.plays.select("station", "path", "ts"), folder + "/in")
    plays.count_plays(stream, folder + "/counts", folder + "/state").awaitTermination()
    totals = plays.play_totals(t.spark, folder + "/counts")
    return plays.counted_catalog(t.parts_as_items.withColumn("count", F.lit(5)), totals).select("id", "count")


@query("stream_distinct_plays", """
    SELECT event_type AS station, CAST(user_id AS VARCHAR) AS path, count(*) AS plays FROM events GROUP BY 1, 2""")
def _(t):
    """Every third event is sent twice and counted once; the delay spans the whole data, so no event is late."""
    folder = scratch(t)
    sent = t.read("events").select("event_id", F.col("event_type").alias("station"), F.col("user_id").cast("string").alias("path"),
                                   F.col("ts").cast("timestamp").alias("ts"))
    stream = _replayed(t, sent.unionByName(sent.filter("event_id % 3 = 0")), folder + "/in")
    once = plays.deduplicated(stream, ["event_id"], delay="10000 days")
    plays.count_plays(once, folder + "/counts", folder + "/state").awaitTermination()
    return plays.play_totals(t.spark, folder + "/counts").select("station", "path", "plays")


@query("stream_horizon_alerts", """
    WITH ends AS (SELECT station, arg_max(end_time, (start_time, end_time, id)) AS schedule_end FROM blocks_by_user GROUP BY 1)
    SELECT s.station, e.schedule_end FROM (SELECT CAST(c_custkey AS VARCHAR) AS station FROM customer) s LEFT JOIN ends e ON e.station = s.station
    WHERE e.schedule_end IS NULL OR e.schedule_end < TIMESTAMP '2024-01-30 00:00:00'""")
def _(t):
    folder = scratch(t)
    stream = _replayed(t, t.blocks_by_user.select("station", "id", "start_time", "end_time"), folder + "/in")
    stations = t.read("customer").select(F.col("c_custkey").cast("string").alias("station"))
    horizon.horizon_alerts(stream, stations, folder + "/alerts", folder + "/state", "2024-01-29 00:00:00", 24).awaitTermination()
    return horizon.current_alerts(t.spark, folder + "/alerts")


@query("stream_due_stations", """
    WITH moved AS (SELECT station, id, start_time + y AS start_time, end_time + y AS end_time FROM (
      SELECT *, CASE WHEN station::INT % 2 = 1 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END AS y FROM blocks_by_user)),
    ends AS (SELECT station, arg_max(end_time, (start_time, end_time, id::VARCHAR)) AS schedule_end FROM moved GROUP BY 1)
    SELECT coalesce(s.station, e.station) AS station, e.schedule_end FROM (SELECT CAST(c_custkey AS VARCHAR) AS station FROM customer) s
    FULL JOIN ends e ON e.station = s.station WHERE e.schedule_end IS NULL OR e.station::INT % 2 = 0""")
def _(t):
    """Stations that are due by the clock: half of the schedules ended long ago, the others end in a hundred years."""
    years = F.when(F.col("station").cast("int") % 2 == 1, F.expr("INTERVAL 100 YEARS")).otherwise(F.expr("INTERVAL 0 YEARS"))
    moved = t.blocks_by_user.select("station", "id", (F.col("start_time") + years).alias("start_time"), (F.col("end_time") + years).alias("end_time"))
    stations = t.read("customer").select(F.col("c_custkey").cast("string").alias("station"))
    folder = scratch(t)
    run = timers.watch_schedules(_replayed(t, moved, folder + "/in"), stations, folder + "/changes", folder + "/state", 24)
    timers.catch_up(run, 600)
    return timers.current_due(t.spark, folder + "/changes")


@query("stream_on_schedule", """
    SELECT e.id AS number, e.station, b.id AS block_id, b.title IS NOT DISTINCT FROM e.title AND b.id IS NOT NULL AS agrees
    FROM (SELECT id, station, title, start_time + INTERVAL 30 MINUTE AS at FROM blocks_by_user WHERE id % 3 = 0) e
    LEFT JOIN blocks_by_user b ON b.station = e.station AND b.start_time <= e.at AND e.at < b.end_time AND b.id % 5 <> 0""")
def _(t):
    """Every third event half an hour after its start, against the blocks that are on then; both are streams of several batches."""
    folder, made = scratch(t), t.blocks_by_user
    moved = {c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")}
    end = t.spark.sql("SELECT 0L AS id, 'end' AS station, '' AS title, timestamp'2100-01-01' + make_dt_interval(400 * id) AS start_time, "
                      "timestamp'2100-01-02' + make_dt_interval(400 * id) AS end_time FROM range(2)")
    blocks = made.filter("id % 5 <> 0").withColumns(moved).select("id", "station", "title", "start_time", "end_time").unionByName(end)
    events = made.filter("id % 3 = 0").withColumns(moved).select(
        F.col("id").alias("number"), "station", (F.col("start_time") + F.expr("INTERVAL 30 MINUTES")).alias("at"), "title").unionByName(
        end.select(F.col("id").alias("number"), "station", F.col("start_time").alias("at"), "title"))
    # in files by time, as they would come; the delay is longer than what one batch reads
    streams = []
    for name, df, at in (("events", events, "at"), ("blocks", blocks, "start_time")):
        df.repartitionByRange(4, at).write.parquet(f"{folder}/{name}")
        streams.append(t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/{name}"))
    onair.watch_status(*streams, folder + "/found", folder + "/state", delay="60 days").awaitTermination()
    return sinks.read_batches(t.spark, folder + "/found").filter("station <> 'end'").select("number", "station", "block_id", "agrees")


@query("stream_manifest_ingest", """
    SELECT coalesce(a.path, b.path) AS path, coalesce(a.size, b.size) AS size, coalesce(a.mtime_ns, b.mtime_ns) AS mtime_ns
    FROM manifest_before b FULL JOIN manifest_after a ON a.path = b.path""")
def _(t):
    folder = scratch(t)
    stream = _replayed(t, t.manifest_after, folder + "/in")
    meta = t.manifest_before.withColumns({"meta": F.lit("{}"), "media_type": F.lit("video")})
    manifests.ingest_manifest(stream, meta, folder + "/changes", folder + "/state").awaitTermination()
    return manifests.cached(t.spark, meta, folder + "/changes").select("path", "size", "mtime_ns")


@query("schedule_ends", """
    SELECT station, arg_max(end_time, (start_time, end_time, id)) AS schedule_end FROM blocks GROUP BY 1""")
def _(t):
    return horizon.schedule_ends(t.blocks)
