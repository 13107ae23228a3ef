"""Streams: a replayed batch changes nothing, and results equal the batch form."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from airlog.streaming import manifests, onair, plays, sinks, status, timers
from conftest import rows


def test_a_batch_stored_again_counts_once(spark, tmp_path):
    folder = str(tmp_path / "counts")
    df = spark.createDataFrame([("s", "p", 2)], "station string, path string, plays bigint")
    for _ in range(3):
        sinks.write_batch(df, folder, 0)
    sinks.write_batch(df, folder, 1)
    assert rows(plays.play_totals(spark, folder)) == [("s", "p", 4)]


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    kind = "station string, path string, ts timestamp_ntz"
    source, folder, state = (str(tmp_path / n) for n in ("in", "counts", "state"))
    for day in (1, 2):
        made = spark.createDataFrame([("s", "p", datetime(2024, 1, day)), ("s", "q", datetime(2024, 1, day))], kind)
        made.coalesce(1).write.mode("append").parquet(source)
        plays.count_plays(spark.readStream.schema(kind).parquet(source), folder, state).awaitTermination()
    assert rows(plays.play_totals(spark, folder)) == [("s", "p", 2), ("s", "q", 2)]


def test_repeats_within_the_delay_are_dropped(spark, tmp_path):
    kind = "id bigint, station string, path string, ts timestamp"
    made = spark.createDataFrame([(1, "s", "p", datetime(2024, 1, 1)), (1, "s", "p", datetime(2024, 1, 1)), (2, "s", "p", datetime(2024, 1, 1))], kind)
    made.write.parquet(str(tmp_path / "in"))
    stream = plays.deduplicated(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), ["id"])
    plays.count_plays(stream, str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination()
    assert rows(plays.play_totals(spark, str(tmp_path / "counts"))) == [("s", "p", 2)]


def test_status_without_content_type_is_unknown(spark):
    made = spark.createDataFrame([("playing", "n", 1, datetime(2024, 1, 1), "old", None, None, "feature", False),
                                  ("playing", "n", 1, datetime(2024, 1, 2), "new", None, None, None, False)],
                                 "status string, network_name string, channel_number bigint, timestamp timestamp_ntz, title string, duration double, "
                                 "file_path string, content_type string, awaiting_pin boolean")
    row = status.latest_status(made).first()
    assert (row["title"], row["content_type"]) == ("new", "unknown")


def test_later_batches_read_one_version_and_few_batches(spark, tmp_path):
    kind = "station string, path string, ts timestamp_ntz"
    source, folder, state = (str(tmp_path / n) for n in ("in", "counts", "state"))
    for day in range(1, 8):
        spark.createDataFrame([("s", "p", datetime(2024, 1, day))], kind).coalesce(1).write.mode("append").parquet(source)
        plays.count_plays(spark.readStream.schema(kind).parquet(source), folder, state, every=3).awaitTermination()
    assert rows(plays.play_totals(spark, folder, every=3)) == [("s", "p", 7)]
    read = sinks.stored(spark, folder, every=3).inputFiles()
    assert any("version=6" in f for f in read) and not any("batch_id=5" in f for f in read)


def test_merged_batches_are_removed(spark, tmp_path):
    """What two versions have taken up goes; a batch run again still gives the same totals."""
    folder = str(tmp_path / "counts")

    def merged(counts):
        return counts.groupBy("station").agg(F.sum("plays").alias("plays"), F.max("batch_id").alias("batch_id"))

    sinks.start(spark.createDataFrame([], "station string, plays bigint"), folder)
    for batch in [*range(12), 11]:
        sinks.write_batch(spark.createDataFrame([("s", 1)], "station string, plays bigint"), folder, batch)
        sinks.compact(spark, folder, batch, merged, 3)
    assert sorted(int(b) for b in sinks.subfolders(spark, folder, "batch_id=")) == list(range(6, 12))
    assert sorted(int(v) for v in sinks.subfolders(spark, folder + "_versions", "version=")) == [6, 9, 12]
    assert sinks.stored(spark, folder, every=3).agg(F.sum("plays")).first()[0] == 12


def test_a_file_without_metadata_is_refreshed_once(spark, tmp_path):
    kind = "path string, size bigint, mtime_ns bigint"
    source, folder, state = (str(tmp_path / n) for n in ("in", "changes", "state"))
    meta = spark.createDataFrame([("a.mp3", 1, 1, "", "audio"), ("b.mp3", 1, 1, "{\"title\":\"b\"}", "audio")],
                                 kind + ", meta string, media_type string")
    for size in (1, 1, 1, 2):
        spark.createDataFrame([("a.mp3", 1, 1), ("b.mp3", size, 1)], kind).coalesce(1).write.mode("append").parquet(source)
        manifests.ingest_manifest(spark.readStream.schema(kind).parquet(source), meta, folder, state, every=2).awaitTermination()
    assert rows(sinks.read_batches(spark, folder).select("batch_id", "path", "action")) == [
        (0, "a.mp3", "refresh"), (3, "b.mp3", "update")]
    assert rows(manifests.cached(spark, meta, folder, every=2).select("path", "size", "meta")) == [
        ("a.mp3", 1, "{}"), ("b.mp3", 2, "{\"title\":\"b\"}")]


def test_alerts_fire_when_time_passes(spark, tmp_path):
    """No row comes after the first batch; a schedule reaches the threshold before and another after a restart."""
    kind = "station string, id bigint, start_time timestamp_ntz, end_time timestamp_ntz"
    source, folder, state = (str(tmp_path / n) for n in ("in", "changes", "state"))
    now = datetime.now(timezone.utc).replace(tzinfo=None)

    def block(station, number, seconds, start=0):
        return (station, number, now + timedelta(seconds=start), now + timedelta(hours=1, seconds=seconds))

    made = [block("past", 1, -99999, -99999), block("soon", 1, 15), block("later", 1, 40), block("far", 1, 10**6),
            block("renewed", 1, -50, -100), block("renewed", 2, 10**6, -10)]
    blocks = spark.createDataFrame(made, kind)
    blocks.coalesce(1).write.parquet(source)
    stations = spark.createDataFrame([("past",), ("never",)], "station string")

    def run(seconds, wanted):
        query = timers.watch_schedules(spark.readStream.schema(kind).parquet(source), stations, folder, state, 1)
        try:
            until = time.monotonic() + seconds
            while time.monotonic() < until and due() != wanted:
                time.sleep(1)
                assert query.exception() is None
        finally:
            query.stop()

    def due():
        return {r["station"] for r in timers.current_due(spark, folder).collect()}

    run(60, {"past", "never", "soon"})
    assert due() == {"past", "never", "soon"}
    run(90, {"past", "never", "soon", "later"})
    plain = timers.due_at(blocks, stations, datetime.now(timezone.utc).replace(tzinfo=None), 1)
    assert rows(timers.current_due(spark, folder)) == rows(plain) and len(due()) == 4
    changes = sinks.read_batches(spark, folder)
    assert changes.filter("station = 'far'").count() == 0 and changes.groupBy("station").count().filter("count > 1").count() == 0
    fired = {r["station"]: r["at_us"] - (r["schedule_end_us"] - 3_600_000_000) for r in changes.filter("station IN ('soon', 'later')").collect()}
    assert all(late > 0 for late in fired.values())


def test_a_new_block_ends_an_alert(spark, tmp_path):
    kind = "station string, id bigint, start_time timestamp_ntz, end_time timestamp_ntz"
    source, folder, state = (str(tmp_path / n) for n in ("in", "changes", "state"))
    for number, end in ((1, datetime(2024, 1, 1)), (2, datetime(2099, 1, 1))):
        spark.createDataFrame([("s", number, datetime(2023, 1, number), end)], kind).write.mode("append").parquet(source)
        timers.catch_up(timers.watch_schedules(spark.readStream.schema(kind).parquet(source), None, folder, state, 1), 60)
        assert timers.current_due(spark, folder).count() == 2 - number
    assert [r["due"] for r in sinks.read_batches(spark, folder).orderBy("at_us").collect()] == [True, False]


def test_many_stations_share_a_row_of_state_and_a_timer(spark, tmp_path):
    """The calls to the state grow with the groups, not with the stations; each station is still judged by itself."""
    kind = "station string, id bigint, start_time timestamp_ntz, end_time timestamp_ntz"
    source, folder, state = (str(tmp_path / n) for n in ("in", "changes", "state"))
    made = [(str(n), 1, datetime(2023, 1, 1), datetime(2023 if n % 2 else 2099, 1, 2)) for n in range(0, 2600, 13)]
    spark.createDataFrame(made, kind).write.parquet(source)
    stations = spark.range(5000).select(F.col("id").cast("string").alias("station")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    query = timers.watch_schedules(spark.readStream.schema(kind).parquet(source), stations, folder, state, 1)
    timers.catch_up(query, 90)
    kept = max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators)
    assert 0 < kept <= 3 * timers.GROUPS
    got = rows(timers.current_due(spark, folder))
    ends = {station: end for station, _, _, end in made}
    assert got == sorted(((s, ends.get(s)) for s in [*map(str, range(5000)), None] if s not in ends or ends[s].year == 2023), key=repr)
    assert got == rows(timers.due_at(spark.createDataFrame(made, kind), stations, datetime.now(timezone.utc).replace(tzinfo=None), 1))


def test_status_against_blocks_of_two_streams(spark, tmp_path):
    """The stream gives the rows of the batch form over all events, and its state keeps no more than the delay and the longest block."""
    start = datetime(2024, 1, 1)
    blocks = [(k, f"s{k % 2}", f"t{k % 5}", start + timedelta(hours=k), start + timedelta(hours=k + 1 + k % 3)) for k in range(240)]
    blocks.append((900, "s0", "long", start + timedelta(hours=20), start + timedelta(hours=75)))
    events = [(k, f"s{k % 3}", start + timedelta(minutes=37 * k), f"t{k % 5}") for k in range(380)]
    kinds = ("id bigint, station string, title string, start_time timestamp, end_time timestamp",
             "number bigint, station string, at timestamp, title string")
    days = range(12)
    far = datetime(2024, 3, 1)
    batches = [([b for b in blocks if (b[3] - start).days == d], [e for e in events if (e[2] - start).days == d]) for d in days]
    batches.append(([(999, "end", "", far, far + timedelta(hours=1))], [(999, "end", far, "")]))
    batches.append(([(998, "end", "", far + timedelta(days=2), far + timedelta(days=3))], [(998, "end", far + timedelta(days=2), "")]))
    sizes, folder = [], str(tmp_path / "found")
    for b, e in batches:
        for rows_, kind, name in zip((b, e), kinds, ("blocks", "events")):
            spark.createDataFrame(rows_, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(kind).parquet(str(tmp_path / name)) for kind, name in zip(kinds[::-1], ("events", "blocks"))]
        query = onair.watch_status(*streams, folder, str(tmp_path / "state"), delay="2 hours", longest_hours=6)
        query.awaitTermination()
        sizes.append(query.lastProgress.stateOperators[0].numRowsTotal)
    found = sinks.read_batches(spark, folder).drop("batch_id").filter("station <> 'end'")
    plain = onair.on_schedule(spark.createDataFrame(events, kinds[1]), spark.createDataFrame(blocks, kinds[0]), longest_hours=6)
    assert rows(found) == rows(plain)
    assert found.filter("block_id IS NULL").select("number").distinct().count() >= 126
    # a day's rows and what the delay and the longest stretch keep of the day before
    assert max(sizes) <= 40 and sizes[-1] <= 8


def test_replayed_rows_are_written_by_many_tasks_and_read_in_two_batches(spark, tmp_path):
    from queries.streams import _replayed
    from queries.views import Tables

    stream = _replayed(Tables(spark, "unused"), spark.range(1000), str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 48
    run = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(1 for p in run.recentProgress if p.numInputRows) == 2 and spark.table("replayed").count() == 1000
