"""Interval operators against brute force on random schedules, in wide and narrow buckets."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from airlog.functions.values import micros
from airlog.operators import diff, intervals as iv, scan
from airlog.operators.quality import check_guide
from airlog.operators.scan import DAY_US, OrderedScan, Running, cut_by_digits, numbered, numbered_by_digits
from airlog.plans.playout import plan_timeline
from conftest import rows
from queries.views import Tables

T0 = datetime(2024, 1, 1)
BLOCKS = "id bigint, station string, start_time timestamp_ntz, end_time timestamp_ntz, title string"


def schedule(n, stations, seed, longest=300):
    """Random blocks; one station holds a third of them, many of those are copies of one interval."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        if i % 3 == 0:
            station, start, length = "hot", 1000 if i % 2 else rng.randrange(3000), 60 if i % 2 else rng.randrange(1, longest)
        else:
            station, start, length = f"s{rng.randrange(stations)}", rng.randrange(3000), rng.randrange(1, longest)
        made.append((i, station, T0 + timedelta(seconds=start), T0 + timedelta(seconds=start + length), f"t{i % 5}"))
    return made


@pytest.mark.parametrize("width", [DAY_US, 50_000_000])
def test_coverage_adds_up(spark, width):
    made = schedule(400, 6, 1)
    blocks = spark.createDataFrame(made, BLOCKS)
    lo, hi = T0 + timedelta(seconds=200), T0 + timedelta(seconds=2500)
    stations = sorted({b[1] for b in made}) + ["empty"]
    windows = spark.createDataFrame([(s, lo, hi) for s in stations], "station string, seam timestamp_ntz, horizon timestamp_ntz")
    got = {r["station"]: r for r in iv.coverage(blocks, windows, width=width).collect()}
    for s in stations:
        mine = sorted((max(b[2], lo), min(b[3], hi), b[0], b[2], b[3]) for b in made if b[1] == s and b[2] < hi and b[3] > lo)
        mine.sort(key=lambda b: (b[3], b[4], b[2]))
        covered = {sec for b in mine for sec in range(int((b[0] - T0).total_seconds()), int((b[1] - T0).total_seconds()))}
        assert got[s]["covered_us"] == len(covered) * 10**6
        assert got[s]["covered_us"] + got[s]["gap_us"] == got[s]["interval_us"]
        reach, overlaps = None, 0
        for start, end, *_ in mine:
            if reach is not None and start < reach:
                overlaps += (min(reach, end) - start).total_seconds()
            reach = end if reach is None else max(reach, end)
        assert got[s]["overlap_us"] == overlaps * 10**6
    assert got["empty"]["gap_count"] == 1 and got["empty"]["covered_us"] == 0


@pytest.mark.parametrize("window, busy, free", [
    ((10, 20), (10, 20), False), ((12, 15), (10, 20), False), ((5, 25), (10, 20), False), ((20, 30), (10, 20), True),
    ((0, 10), (10, 20), True), ((40, 50), (10, 20), True), ((19, 30), (10, 20), False)])
def test_exclusion_truth_table(spark, window, busy, free):
    def row(i, key, span):
        return (i, key, T0 + timedelta(seconds=span[0]), T0 + timedelta(seconds=span[1]))

    kind = "id bigint, realpath string, start_time timestamp_ntz, end_time timestamp_ntz"
    cands = spark.createDataFrame([row(1, "a", window), row(2, None, window), row(3, "b", window)], kind)
    taken = spark.createDataFrame([row(9, "a", busy), row(8, "a", (100, 110)), row(7, None, busy)], kind)
    assert {r["id"] for r in iv.exclude_overlapping(cands, taken).collect()} == ({1, 2, 3} if free else {2, 3})


@pytest.mark.parametrize("bucket", [1, 7, 100000])
def test_overlap_join_equals_the_plain_predicate(spark, bucket):
    a, b = schedule(120, 3, 2), schedule(120, 3, 3)
    want = sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and x[3] > y[2])
    left, right = spark.createDataFrame(a, BLOCKS), spark.createDataFrame(b, BLOCKS)
    got = iv.overlap_join(left, right, bucket_seconds=bucket).select("id", "r_id")
    assert rows(got) == sorted(want, key=repr)
    semi = iv.overlap_join(left, right, keys=["station"], bucket_seconds=bucket, how="left_semi")
    assert {r["id"] for r in semi.collect()} == {x[0] for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    assert semi.count() == semi.distinct().count()


def test_overlap_join_of_very_different_lengths(spark):
    """Years and seconds in one join: few rows an interval, each pair once, few pairs looked at beyond those that overlap."""
    rnd = random.Random(9)
    lengths = [1, 60, 7200, 86400 * 30, 86400 * 400, 0]

    def made(n, seed):
        rnd.seed(seed)
        starts = [T0 + timedelta(seconds=rnd.randrange(86400 * 500)) for _ in range(n)]
        return [(i, "s", at, at + timedelta(seconds=lengths[i % 6]), "t") for i, at in enumerate(starts)]

    a, b = made(240, 1), made(240, 2) + [(1000, "s", T0 - timedelta(days=36500), T0 + timedelta(days=36500), "long")]
    left, right = spark.createDataFrame(a, BLOCKS), spark.createDataFrame(b, BLOCKS)
    want = [(x[0], y[0]) for x in a for y in b if x[2] < y[3] and x[3] > y[2]]
    got = rows(iv.overlap_join(left, right, ["station"]).select("id", "r_id"))
    assert got == sorted(want, key=repr) and len(set(got)) == len(got)
    cells = iv.in_cells(iv.with_micros(right), 60_000_000)
    assert cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 2
    levels = cells.agg(F.collect_set("_level")).first()[0]
    assert len(levels) <= 2 * math.log2(200 * 365 * 86400 / 60)
    assert iv.start_cells(iv.with_micros(left), F.array(*map(F.lit, levels)), 60_000_000).count() == 240 * len(levels)


def test_overlap_join_of_nulls_and_repeats(spark):
    """Null stations and times, empty and backward blocks, and rows that come twice, against the plain predicate."""
    made = [(k if k % 6 else None, [None, "a", "b"][k % 3], None if k % 7 == 6 else T0 + timedelta(seconds=k * 20 % 130), None if k % 11 == 10 else T0 + timedelta(seconds=k * 37 % 300), "t")
            for k in range(60)] * 2
    df = spark.createDataFrame(made, BLOCKS)
    for keys in ([], ["station"]):
        want = [(x[0], x[1], y[0], y[1]) for x in made for y in made if None not in (*x[2:4], *y[2:4]) and (not keys or x[1] and x[1] == y[1]) and x[2] < y[3] and x[3] > y[2]
                and (x[3] > x[2] if x[2] <= y[2] else y[3] > y[2])]
        assert rows(iv.overlap_join(df, df, keys, 60).select("id", "station", "r_id", "r_station")) == sorted(want, key=repr) != []


def test_pairs_of_a_crowded_time_are_stored_small(spark, tmp_path):
    """Many blocks on air at once: what their pairs take in a file is far less than a byte a pair."""
    blocks = spark.range(2500).selectExpr("id * 7919 AS id", "concat('s', id % 5) AS station", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(id * 7 % 1200 AS decimal(18, 6))) AS start_time")
    blocks = blocks.withColumn("end_time", F.col("start_time") + F.expr("INTERVAL 30 MINUTE"))
    pairs = iv.overlap_join(blocks, blocks).filter("station <> r_station").select("id", "r_id")
    pairs.coalesce(2).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 5_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * 5_000_000


@pytest.mark.parametrize("closed, width", [(False, DAY_US), (True, DAY_US), (False, 50_000_000), (True, 50_000_000)])
def test_now_playing_takes_the_earliest_block(spark, closed, width):
    made = schedule(200, 3, 4)
    points = [(b[1], T0 + timedelta(seconds=s)) for b in made[:40] for s in (0, 500, 1000, 1060, (b[3] - T0).seconds)]
    probes = spark.createDataFrame(sorted(set(points)), "station string, at timestamp_ntz")
    got = {(r["station"], r["at"]): r["block_id"] for r in iv.now_playing(spark.createDataFrame(made, BLOCKS), probes, closed, width).collect()}
    for station, at in set(points):
        fit = [b for b in made if b[1] == station and b[2] <= at and (at <= b[3] if closed else at < b[3])]
        want = min(fit, key=lambda b: (b[2], b[3], b[0]))[0] if fit else None
        assert got[(station, at)] == want


def test_scan_forms_agree(spark):
    made = [(f"k{i % 3}" if i % 2 else "hot", (i * 7919) % 1009, i, None if i % 4 else i) for i in range(600)]
    df = spark.createDataFrame(made, "key string, o int, id int, v int")
    wanted = (Running("m", "max", F.col("v")), Running("s", "sum", F.col("id"), False), Running("c", "count", F.col("v")),
              Running("l", "last", F.col("v"), False))
    results = []
    for width in (None, 10):
        scan = OrderedScan(df, ["key"], ["o", "id"], width).running(*wanted)
        scan.running(Running("again", "max", F.col("s") % 17))
        results.append(rows(scan.result().select("id", "m", "s", "c", "l", "again")))
    assert results[0] == results[1]


def test_one_hot_key_is_cut_into_buckets(spark):
    df = spark.range(2000).selectExpr("'hot' AS key", "id AS o", "id")
    scan = OrderedScan(df, ["key"], ["o", "id"], 100).running(Running("n", "count", F.lit(1)), Running("s", "sum", F.col("id")))
    assert scan.df.select("key", F.col("_bucket_of_order")).distinct().count() == 20
    assert scan.result().filter("n <> id + 1 OR s <> id * (id + 1) / 2").count() == 0


def test_building_runs_no_job(spark, folder):
    """Ordered scans; ranks by digits do count crowded keys first, see test_ranks_count_nodes_only."""
    t = Tables(spark, folder)
    builds = [
        lambda: iv.coverage(t.blocks, t.windows), lambda: iv.components(t.blocks), lambda: iv.lookahead(t.blocks, tag="title"),
        lambda: iv.exclude_overlapping(t.baseline, t.proposed, "content_id"),
        lambda: iv.now_playing(t.blocks, t.blocks.selectExpr("station", "start_time AS at")),
        lambda: diff.diff_schedules(t.baseline, t.proposed, t.windows),
        lambda: check_guide(t.blocks, t.blocks), lambda: plan_timeline(t.plan_entries, order=["l_linenumber", "l_partkey", "l_suppkey"])]
    t.blocks, t.baseline, t.proposed, t.windows, t.parts_as_items, t.plan_entries  # reading a footer may run a job
    spark.sparkContext.setJobGroup("building", "no job may run")
    try:
        for build in builds:
            build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []


def test_numbering_by_digits(spark):
    made = [(a, b, c) for a in ("x", None, "y", "x\0", "x\0\1", "xy", "日本", "日本x") for b in (2, -1, None) for c in ("q", "p")]
    df = spark.createDataFrame(made, "a string, b int, c string")
    expected = [tuple(r) for r in df.orderBy("a", "b", "c").collect()]
    for crowd in (100, 7, 1):
        got = [tuple(r)[:3] for r in numbered_by_digits(df, [], ["a", "b", "c"], "n", crowd).orderBy("n").collect()]
        assert got == expected
    assert numbered_by_digits(df.where("false"), [], ["a"], "n", 1).collect() == []


def test_a_hot_key_is_numbered_in_many_tasks(spark):
    """A third of all rows have one key and a long common beginning; no window holds more of them than are allowed."""
    made = [("hot" if i % 3 == 0 else f"k{i % 50}", f"shows/with/one/beginning/{i % 7}/{'same' if i % 2 else i}.mp4", i) for i in range(3000)]
    df = spark.createDataFrame(made, "key string, path string, id bigint").withColumn("_n", F.lit(0))
    got = numbered_by_digits(df, ["key"], ["path", "id"], "n", crowd=40)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("path", "id")).cast("bigint"))
    assert rows(got) == rows(plain) and got.columns == plain.columns
    cut, node, _ = cut_by_digits(df, ["key"], ["path", "id"], 40)
    sizes = [r["count"] for r in cut.filter("key = 'hot'").groupBy(*node).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 40 and len(sizes) > 10


def test_crowded_rows_are_shuffled_once_into_many_partitions(spark, monkeypatch):
    """All rows have one of three keys; none of them is sorted by key alone, and no task gets a third of them."""
    monkeypatch.setattr(scan, "CROWD", 100)
    df = spark.range(3000).selectExpr("concat('k', id % 3) AS key", "concat('title ', id % 40) AS title", "id")
    got = numbered_by_digits(df, ["key"], ["title", "id"], "n", crowd=50)
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("title", "id")).cast("bigint"))
    assert rows(got) == rows(plain)
    text = numbered_by_digits(df, ["key"], ["title", "id"], "n", crowd=50)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and text.count("Exchange hashpartitioning") == 1
    assert max(n for n, in got.rdd.mapPartitions(lambda x: [(sum(1 for _ in x),)]).collect()) < 500


def test_ranks_count_nodes_only(spark, folder):
    """Without a crowded key, building runs the count of the keys and asks whether there is one."""
    t = Tables(spark, folder)
    t.parts_as_items  # reading a footer may run a job
    spark.sparkContext.setJobGroup("ranking", "few jobs")
    try:
        cut, node, found = cut_by_digits(t.parts_as_items, ["station"], ["path", "id"], 10**6)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert node == ["station"] and found == [] and len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranking")) <= 4


def test_lookahead_keeps_the_block_and_crosses_buckets(spark):
    made = [(i, "s" if i % 4 else "other", T0 + timedelta(hours=7 * i), T0 + timedelta(hours=7 * i + 1), None if i % 5 == 0 else f"t{i}") for i in range(40)]
    for width in (3_600_000_000, DAY_US, 10**15):
        got = {r["id"]: r for r in iv.lookahead(spark.createDataFrame(made, BLOCKS), 3, "title", width).collect()}
        for i, station, start, *_ in made:
            after = [b[4] for b in made if b[1] == station and b[2] > start][:3] + [None] * 3
            assert [got[i][f"next_{k}"] for k in (1, 2, 3)] == after[:3] and got[i]["start_time"] == start


def test_numbering_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "key string, id int")
    for width in (None, 1):
        assert rows(numbered(df, ["key"], ["id"], "n", width).select("id", "n")) == [(1, 1), (2, 2), (3, 1)]


def test_preview_keeps_blocks_under_a_second(spark):
    made = [(1, "s", T0, T0 + timedelta(milliseconds=500), "blink"), (2, "s", T0 + timedelta(milliseconds=500), T0 + timedelta(hours=3), "film")]
    got = iv.preview(spark.createDataFrame(made, BLOCKS), T0).orderBy("id").collect()
    assert [(r["title"], r["width_us"], r["ends_later"]) for r in got] == [("blink", 500000, False), ("film", 3 * 3600 * 10**6 - 500000, True)]


def test_slot_grid_gives_what_is_on_at_every_slot(spark):
    """Nested, empty, backward and endless blocks, blocks across the edges, null titles, stations repeated, null or without blocks."""
    day = datetime(2024, 1, 10)
    spans = [("a", -60, 45), ("a", 30, 200), ("a", 60, 90), ("a", 230, 230), ("a", 240, 235), ("a", 300, 330), ("b", 100, 100), ("b", 400, 390),
             ("b", 420, 9000), ("d", -500, -400), ("e", 0, 30), ("e", 15, 75), (None, 0, 600), ("f", 30, None), ("f", 200, 200)]
    at = lambda m: None if m is None else day + timedelta(minutes=m)
    blocks = spark.createDataFrame([(s, n, at(x), at(y), None if n == 5 else f"t{n}") for n, (s, x, y) in enumerate(spans)],
                                   "station string, id int, start_time timestamp_ntz, end_time timestamp_ntz, title string")
    stations = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("d",), ("e",), ("f",), (None,)], "station string")
    grid = iv.slot_grid(blocks, stations, day, at(600), 25)
    slots = stations.crossJoin(spark.range(24).selectExpr("timestamp_ntz'2024-01-10' + id * INTERVAL 25 MINUTES AS at"))
    seen = iv.now_playing(iv.blocks_in_window(blocks, day, at(600)), slots)
    expected = seen.select("at", "station", F.coalesce("title", F.lit("Offair")).alias("title"),
                           F.coalesce(F.col("start_us") < micros("at"), F.lit(False)).alias("continued"))
    assert rows(grid) == rows(expected)
    assert grid.count() == 8 * 24


def test_slots_are_laid_out_last(spark):
    """No slot is shuffled or sorted: the slots appear above every exchange of the plan."""
    blocks = spark.createDataFrame([("a", 1, datetime(2024, 1, 10), datetime(2024, 1, 11), "t")],
                                   "station string, id int, start_time timestamp_ntz, end_time timestamp_ntz, title string")
    grid = iv.slot_grid(blocks, blocks.select("station"), "2024-01-10", "2024-01-12")
    lines = grid._jdf.queryExecution().executedPlan().toString().splitlines()
    assert max(n for n, x in enumerate(lines) if "Generate" in x) < min(n for n, x in enumerate(lines) if "Exchange" in x)


@pytest.mark.parametrize("build", [
    lambda blocks, windows: iv.coverage_spans(blocks, windows), lambda blocks, windows: iv.components(blocks),
    lambda blocks, windows: diff.ScheduleDiff(blocks, blocks.filter("id % 7 > 0"), windows, ["title"]).meanings])
def test_ordered_scans_are_spread_over_many_tasks(spark, build):
    """Small compressed shuffles are not merged into a few tasks that have to sort them: a month of one station is in many partitions."""
    blocks = spark.range(4000).selectExpr(
        "id", "'s' AS station", "timestamp_ntz'2024-01-01' + id * INTERVAL 10 MINUTES AS start_time",
        "timestamp_ntz'2024-01-01' + id * INTERVAL 10 MINUTES + INTERVAL 5 MINUTES AS end_time", "'t' AS title")
    windows = spark.sql("SELECT 's' AS station, timestamp_ntz'2024-01-01' AS seam, timestamp_ntz'2024-02-01' AS horizon")
    found = build(blocks, windows)
    assert found.select("station", F.spark_partition_id().alias("p")).distinct().count() > 10
