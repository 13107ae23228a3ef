"""Hint pools and replays that are judged before requests meet their items, and lists before they are read."""

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from airlog.functions.hints import hint_matches
from airlog.operators import catalog as ct, intervals as iv, quality as q

RULE = "under string, rule_order int, month string, quarter string, date_range string, week_number string, day_of_week string, day_part string, custom_holiday string, exclusive boolean"


@pytest.mark.parametrize("compat", [False, True])
def test_judged_requests_give_the_rows_of_judged_pairs(spark, compat):
    """Repeated and null requests, items without a path or rules, and stations without any, in both readings."""
    rules = spark.createDataFrame([
        ("a/x", 1, "January", None, None, None, None, None, None, True), ("a", 2, None, "Q1", None, None, None, None, None, None),
        ("a/y", 1, "May", None, None, None, None, None, None, None), ("a/x/late", 3, None, None, None, None, "friday", None, None, False)], RULE)
    paths = ["a/x/1", "a/x/1", "a/y/2", "a/z", "b/1", None, "a/x/late/3"]
    items = spark.createDataFrame([(n, f"s{s}", p) for s in range(2) for n, p in enumerate(paths)] + [(9, None, "b/1")], "id int, station string, path string")
    whens = [datetime(2024, 1, 5, 3), datetime(2024, 5, 4, 3), datetime(2024, 2, 2, 3), None]
    requests = spark.createDataFrame(
        [(n if n < 7 else None, s, w) for n, (s, w) in enumerate([(s, w) for s in ("s0", "s1", "none", None) for w in whens] + [("s0", whens[0])] * 2)]
        + [(1, "s1", whens[0])], "request_id int, station string, when timestamp_ntz")
    pairs = ct.apply_meta_hints(requests.join(items, "station"), rules, compat=compat, items=items)
    pool = ct.apply_meta_hints(requests, rules, compat=compat, items=items, on=["station"])
    columns = ["request_id", "station", "when", "id", "path"]
    assert rows(pool.select(*columns)) == rows(pairs.select(*columns)) != []


def test_plays_of_a_list_are_counted_once(spark):
    """A list that a thousand plays name is read once, and gives what the lists written out give."""
    lists = spark.createDataFrame([("a", [1, 2, 2]), ("b", []), ("c", [7]), (None, [1])], "k string, ids array<int>")
    plays = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 3 == 0, "b").when(F.col("id") % 5 == 0, "x").alias("k"))
    counts = spark.createDataFrame([(1, 0), (2, 1000), (3, 0)], "id int, count bigint")
    found = q.replay_counts(plays, counts, counts, lists, ["k"])
    assert rows(found) == rows(q.replay_counts(plays.join(lists, "k"), counts, counts))
    assert {r["id"]: r["increments"] for r in found.collect()} == {1: 500, 2: 1000, 3: 0}


def _wanted(spark):
    hints = "array<struct<type:string,month:string,quarter:string,range_string:string,range_start:string,range_end:string,part:string,day:string,where:string,week_number:string,custom_holiday:string>>"
    items = spark.range(60).selectExpr(
        "id", "concat('s', id % 2) AS station", "if(id % 7 = 0, null, 't') AS tag", "CAST(id % 5 * 30 AS DOUBLE) AS duration",
        "if(id % 4 = 0, null, concat('r', id % 6)) AS realpath", "concat(if(id % 3 = 0, 'a/x/', if(id % 3 = 1, 'a/', 'b/')), id) AS path")
    friday = F.from_json(F.lit('[{"type": "day_of_week", "day": "friday"}]'), hints)
    items = items.withColumn("hints", F.when(F.col("id") % 11 == 5, None).when(F.col("id") % 4 == 1, friday).otherwise(F.from_json(F.lit("[]"), hints)))
    whens = [datetime(2024, 1, 5, 3), datetime(2024, 5, 4, 3), datetime(2024, 2, 2, 23), None]
    requests = spark.createDataFrame(
        [(n if n % 9 else None, f"s{n % 3}", "t", whens[n % 4], [20.0, 61.0, 200.0][n % 3 if n < 6 else 2]) for n in range(24)]
        + [(1, "s1", "t", whens[0], 500.0)], "request_id int, station string, tag string, when timestamp_ntz, seconds double")
    rules = spark.createDataFrame([("a/x", 1, "January", None, None, None, None, None, None, True), ("a", 2, None, "Q1", None, None, None, None, None, None)], RULE)
    busy = spark.createDataFrame([
        ("r1", datetime(2024, 1, 5, 3, 1), datetime(2024, 1, 5, 3, 1)), ("r2", datetime(2024, 1, 5, 3, 1), datetime(2024, 1, 5, 4)),
        ("r3", datetime(2024, 1, 4), datetime(2024, 1, 5, 3)), ("r5", datetime(2024, 1, 1), datetime(2024, 2, 2, 23, 0, 1)),
        (None, datetime(2024, 1, 1), datetime(2025, 1, 1)), ("r1", datetime(2024, 5, 4, 3, 2), None), ("r2", None, datetime(2024, 5, 5))],
        "realpath string, start_time timestamp_ntz, end_time timestamp_ntz")
    return requests, items, rules, busy


@pytest.mark.parametrize("ruled", [False, True])
@pytest.mark.parametrize("held", [False, True])
def test_candidates_give_the_rows_of_judged_pairs(spark, ruled, held):
    """Hints, then rules, then busy items, pair by pair; with repeated and null requests, and items without a path, tag or hints."""
    requests, items, rules, busy = _wanted(spark)
    pairs = requests.join(items, ["station", "tag"]).filter("duration >= 1 AND duration < seconds").filter(hint_matches("hints", "when"))
    if ruled:
        pairs = ct.apply_meta_hints(pairs, rules, items=items)
    if held:
        end = F.col("when") + F.make_dt_interval(secs=F.col("duration"))
        pairs = iv.exclude_overlapping(pairs.withColumns({"start_time": F.col("when"), "end_time": end}), busy, "realpath", ("request_id", "id"))
    pool = ct.candidates(requests, items, rules if ruled else None, busy if held else None)
    columns = ["request_id", "station", "when", "seconds", "id", "path", "duration", "realpath"]
    assert rows(pool.select(*columns)) == rows(pairs.select(*columns)) != []


def test_pairs_of_candidates_are_not_shuffled(spark, tmp_path):
    """More items of each station and tag add to the pool, not to the rows that are sorted: the items are met last."""
    requests, items, rules, busy = _wanted(spark)
    text = ct.candidates(requests, items, rules, busy)._jdf.queryExecution().optimizedPlan().toString()
    # windows stand below the joins with the items, never above them
    top = text.splitlines()[:text.splitlines().index(next(x for x in text.splitlines() if "Join" in x))]
    assert not any("Window" in line for line in top)


def _asked(spark, n):
    return spark.range(n).selectExpr("if(id % 10 = 9, null, id % 50) AS request_id", "if(id % 8 = 7, null, 's') AS station", "if(id % 6 = 5, null, 'A') AS block_tag",
                                     "if(id % 7 = 6, null, 'B') AS next_1", "'C' AS next_2", "CAST(null AS string) AS next_3", "CAST(id % 4 * 50 AS double) AS seconds")


def test_next_pool_gives_the_rows_of_a_plain_join(spark):
    """Repeated and null requests, stations, tags and lengths; more items of one tag than a tile holds."""
    items = spark.range(300).selectExpr("if(id % 9 = 8, null, id % 100) AS id", "if(id % 5 = 4, null, 's') AS station", "element_at(array('next/--B', 'next/A--B--C', 'next/--C', null), CAST(id % 4 + 1 AS int)) AS tag",
                                        "if(id % 11 = 10, null, CAST(id % 30 * 5 AS double)) AS duration")
    want = []
    for r in _asked(spark, 120).collect():
        tails = ["B", "B--C"] if r["next_1"] else []
        tags = {f"next/{h}--{t}" for h in ("", r["block_tag"]) if h is not None for t in tails}
        want += [(i["station"], i["tag"], r["request_id"], r["seconds"], i["id"], i["duration"]) for i in items.collect()
                 if i["station"] and i["station"] == r["station"] and i["tag"] in tags and i["duration"] is not None and 1 <= i["duration"] < r["seconds"]]
    got = ct.next_pool(_asked(spark, 120), items)
    assert got.columns == ["station", "tag", "request_id", "seconds", "id", "duration"] and rows(got) == sorted(want, key=repr) != []


def test_pairs_of_a_crowded_tag_are_spread_and_stored_small(spark, tmp_path):
    """One tag holds all pairs of tables too large to send to every task: several tasks make them, and a file takes far less than a byte a pair."""
    requests = spark.range(400).selectExpr("id AS request_id", "'s' AS station", "'A' AS block_tag", "'B' AS next_1", "CAST(null AS string) AS next_2", "CAST(null AS string) AS next_3", "100.0D AS seconds")
    items = spark.range(6000).selectExpr("id * 7919 AS id", "'s' AS station", "'next/--B' AS tag", "60.0D AS duration")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pool = ct.next_pool(requests, items).select("request_id", "id", F.spark_partition_id().alias("task"))
        assert pool.select("task").distinct().count() >= 4
        pool.drop("task").coalesce(2).write.parquet(str(tmp_path / "pool"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.read.parquet(str(tmp_path / "pool")).distinct().count() == 2_400_000
    assert sum(f.stat().st_size for f in (tmp_path / "pool").glob("*.parquet")) < 0.4 * 2_400_000


def test_least_played_counts_its_choices(spark):
    pool = spark.createDataFrame([(1, 7, 3, "a", "p"), (1, 8, 2, "b", "q"), (2, 9, 1, "c", "r")], "request_id int, id int, count int, title string, path string")
    assert rows(ct.pick_least_played(pool, ["request_id"], counted="n").select("request_id", "id", "n")) == [(1, 8, 2), (2, 9, 1)]


def test_lists_that_many_events_name_are_judged_once(spark):
    """The verdicts of lists named by key are those of lists in every event; unknown keys of a list and null groups give none."""
    items = spark.createDataFrame([(1, "s", "p"), (2, "s", "p"), (3, "s", "q"), (None, "s", "r")], "id bigint, station string, path string")
    lists = spark.createDataFrame([("a", [1, 2]), ("b", [2, 1]), ("c", [3]), ("d", []), ("e", None)], "name string, ids array<bigint>")
    made = [(f"{k}{j}", n, s, p) for j in range(2) for k, (n, s, p) in enumerate(
        (n, s, p) for n in ("a", "b", "c", "d", "e", "none") for s in ("s", None) for p in ("p", "q", "r", "?", None))]
    events = spark.createDataFrame(made, "event_id string, name string, station string, path string")
    whole = q.check_event_groups(events.join(lists, "name"), items)
    named = q.check_event_groups(events, items, lists=lists, on=["name"])
    assert named.columns == whole.columns and rows(named) == rows(whole) and len(rows(named)) > 40
