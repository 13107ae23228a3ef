"""Segments, break plans and sequences against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from airlog.operators.sequences import episode_index
from airlog.plans import breaks, playout, segments as sg
from conftest import rows

POINTS = "path string, seq bigint, chapter_start double, chapter_end double"


def cut(starts, duration):
    """Segments of sorted starts as (start, length)."""
    starts = sorted(starts)
    if starts[0] > 0:
        starts = [0.0] + starts
    return [(s, e - s) for s, e in zip(starts, starts[1:] + [duration])]


def fold(segs, least):
    segs = [list(s) for s in segs]
    while len(segs) > 1:
        i = min(range(1, len(segs)), key=lambda k: segs[k][1])
        if segs[i][1] >= least:
            break
        segs[i - 1][1] += segs[i][1]
        del segs[i]
    return [tuple(s) for s in segs]


def files_and_points(seed, n_files=25):
    rng = random.Random(seed)
    made, files = {}, []
    for f in range(n_files):
        starts = sorted(rng.sample(range(0, 3000), rng.choice([1, 3, 8, 40])))
        made[f"f{f}"] = [float(s) for s in starts]
        files.append((f"f{f}", 3050.0))
    points = [(p, i, s, None) for p, starts in made.items() for i, s in enumerate(starts)]
    return made, files, points


@pytest.mark.parametrize("width", [600, 7])
def test_merge_short_equals_folding_one_by_one(spark, width):
    made, files, points = files_and_points(5)
    segs = sg.segments(spark.createDataFrame(points, POINTS), spark.createDataFrame(files, "path string, duration double"), width)
    got = sg.merge_short(segs, width=width)
    want = [(p, s, s + d, d) for p, starts in made.items() for s, d in fold(cut(starts, 3050.0), 60)]
    assert rows(got.select("path", "chapter_start", "chapter_end", "segment_duration")) == sorted(want, key=repr)


@pytest.mark.parametrize("name, lengths", [
    ("equal", [5.0] * 300), ("rising", [1 + k / 10 for k in range(300)]), ("falling", [50 - k / 10 for k in range(300)]),
    ("steep", [58.0, 29.0, 14.0, 7.0, 3.0, 1.0] * 40), ("zigzag", [30.0, 1.0, 2.0, 31.0, 59.0] * 60)])
def test_long_runs_of_short_segments(spark, monkeypatch, name, lengths):
    """Chains of all shapes fold in few jobs, in many buckets and without a Python worker."""
    starts = [0.0]
    for length in lengths:
        starts.append(starts[-1] + length)
    segs = spark.createDataFrame([("f", k, a, b, b - a) for k, (a, b) in enumerate(zip(starts, starts[1:]))],
                                 "path string, seq bigint, chapter_start double, chapter_end double, segment_duration double")
    jobs, plain = [], sg.durable
    monkeypatch.setattr(sg, "durable", lambda df: jobs.append(df._jdf.queryExecution().toString()) or plain(df))
    got = rows(sg.merge_short(segs, width=100).select("chapter_start", "segment_duration"))
    want = fold([(a, b - a) for a, b in zip(starts, starts[1:])], 60)
    assert got == sorted([(a, d) for a, d in want], key=repr)
    assert len(jobs) <= 8 and not any("Python" in j or "InPandas" in j for j in jobs)


def test_merge_short_can_leave_the_hole(spark):
    points = [("f", 0, 0.0, 100.0), ("f", 1, 100.0, 120.0), ("f", 2, 120.0, 300.0)]
    segs = sg.segments(spark.createDataFrame(points, POINTS), spark.createDataFrame([("f", 300.0)], "path string, duration double"))
    assert rows(sg.merge_short(segs, compat_hole=True).select("chapter_start", "chapter_end")) == [(0.0, 100.0), (120.0, 300.0)]
    assert rows(sg.merge_short(segs).select("chapter_start", "chapter_end")) == [(0.0, 120.0), (120.0, 300.0)]


@pytest.mark.parametrize("wanted, spans", [
    (0, []), (1, [(0, 500)]), (2, [(0, 400), (400, 500)]), (3, [(0, 200), (200, 400), (400, 500)]),
    (5, [(0, 100), (100, 200), (200, 300), (300, 400), (400, 500)]), (9, [(0, 100), (100, 200), (200, 300), (300, 400), (400, 500)])])
def test_thinning(spark, wanted, spans):
    points = spark.createDataFrame([("f", i, i * 100.0, None) for i in range(5)], POINTS)
    segs = sg.segments(points, spark.createDataFrame([("f", 500.0)], "path string, duration double"))
    for positions in (1, 1000):
        got = sg.thin_segments(segs, wanted, width=150, positions=positions).select("chapter_start", "chapter_end")
        assert rows(got) == sorted([(float(a), float(b)) for a, b in spans], key=repr)


def test_thinned_segments_cover_each_file(spark):
    made, files, points = files_and_points(7, 8)
    segs = sg.segments(spark.createDataFrame(points, POINTS), spark.createDataFrame(files, "path string, duration double"))
    found = {}
    for r in sg.thin_segments(segs, 7).collect():
        found.setdefault(r["path"], []).append((r["chapter_start"], r["chapter_end"]))
    for path, starts in made.items():
        spans = sorted(found[path])
        assert len(spans) == min(7, len(cut(starts, 3050.0))) and spans[0][0] == 0 and spans[-1][1] == 3050.0
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and {s for s, _ in spans} <= {0.0, *starts}


def test_bad_log_lines_are_skipped(spark):
    lines = [("f", 1, "[blackdetect @ 0x1] black_start:100 black_end:110 black_duration:10"), ("f", 2, "[blackdetect @ 0x1] black_start:x black_end:1 black_duration:1"),
             ("f", 3, "frame=1 fps=2"), ("f", 4, "[blackdetect @ 0x1] black_start:5 black_end:6 black_duration:1"),
             ("f", 5, "[blackdetect @ 0x1] black_start:290 black_end:295")]
    log = spark.createDataFrame(lines, "path string, line_no bigint, line string")
    files = spark.createDataFrame([("f", 300.0)], "path string, duration double")
    got = sg.black_segments(log, files).select("chapter_start", "chapter_end", "segment_duration")
    assert rows(got) == [(0.0, 105.0, 105.0), (105.0, 300.0, 195.0)]


ORDERS = [
    ("standard", 5, 2, "c0 c1 c2 r0 c3 c4 r1"), ("standard", 6, 2, "c0 c1 c2 c3 r0 c4 c5 r1"), ("standard", 2, 3, "c0 r0 c1 r1 r2"),
    ("standard", 2, 5, "c0 r0 r1 c1 r2 r3 r4"), ("standard", 4, 1, "c0 c1 c2 c3 r0"), ("standard", 3, 0, "c0 c1 c2"),
    ("center", 3, 2, "c0 r0 r1 c1 c2"), ("center", 4, 2, "c0 c1 r0 r1 c2 c3"), ("end", 3, 2, "c0 c1 c2 r0 r1")]


def clip_plans(spark, asked):
    """Paths in playing order of plans of so many clips and reels."""
    numbered = list(enumerate(asked))
    plan = breaks.assemble_clip_plan(
        spark.createDataFrame([(n, s, None, 0.0, None, 0.0) for n, (s, *_) in numbered],
                              "block_id int, strategy string, start_bump string, start_bump_seconds double, end_bump string, end_bump_seconds double"),
        spark.createDataFrame([(n, i, f"c{i}", 1.0, "feature") for n, (_, k, _) in numbered for i in range(k)],
                              "block_id int, clip_no int, path string, duration double, content_type string"),
        spark.createDataFrame([(n, i, 0, f"r{i}", 1.0, "commercial") for n, (_, _, r) in numbered for i in range(r)],
                              "block_id int, reel_no int, entry_no int, path string, duration double, content_type string"))
    got = {n: [] for n, _ in numbered}
    for row in sorted(plan.collect(), key=lambda r: (r["block_id"], r["major"], r["minor"])):
        got[row["block_id"]].append(row["path"])
    return [got[n] for n, _ in numbered]


def test_clip_orders(spark):
    assert [" ".join(p) for p in clip_plans(spark, [o[:3] for o in ORDERS])] == [o[3] for o in ORDERS]


def test_clip_plans_play_everything_once_and_spread_reels(spark):
    asked = [(s, k, r) for s in ("standard", "end", "center") for k in range(1, 8) for r in range(10)]
    for (strategy, k, r), plan in zip(asked, clip_plans(spark, asked)):
        assert [p for p in plan if p[0] == "c"] == [f"c{i}" for i in range(k)]
        assert [p for p in plan if p[0] == "r"] == [f"r{i}" for i in range(r)]
        if strategy == "standard" and r >= k and r > 1:
            gaps = [len(g.split()) for g in " ".join(x if x[0] == "r" else "|" for x in plan).split("|")[1:-1]]
            assert not gaps or max(gaps) - min(gaps) <= 1


@pytest.mark.parametrize("start, end, want", [
    (0, 3, [0, 1, 2, 0, 1, 2]), (1, 3, [1, 2, 0, 1, 2, 0]), (2, 5, [2, 3, 4, 0, 1, 2]), (0, 1, [0] * 6), (3, 2, [0, 1, 0, 1, 0, 1]), (0, 0, [0] * 6)])
def test_episodes_go_round_from_the_start(spark, start, end, want):
    df = spark.createDataFrame([(k, start, end) for k in range(6)], "k bigint, s bigint, e bigint")
    assert [r[1] for r in sorted(df.select("k", episode_index(F.col("k"), F.col("s"), F.col("e"))).collect())] == want


def test_play_points_of_repeated_probes_and_of_none_on_air(spark):
    """Two equal probes keep two rows, one off air keeps a null, an entry without a block answers nobody; many tasks share the scan."""
    blocks = spark.createDataFrame([("s", 7, "x", "2024-01-01 00:00:00", "2024-01-01 01:00:00")], "station string, id bigint, title string, a string, b string").selectExpr(
        "station", "id", "title", "CAST(a AS timestamp_ntz) AS start_time", "CAST(b AS timestamp_ntz) AS end_time")
    entries = spark.createDataFrame([(7, 0, 600.0), (7, 1, 600.0), (None, 0, 1e12)], "block_id bigint, position int, duration double")
    probes = spark.createDataFrame([("s", "2024-01-01 00:10:05")] * 2 + [("s", "2024-01-01 00:30:00"), ("s", "2024-01-02 00:00:00"), (None, "2024-01-01 00:00:00")],
                                   "station string, a string").selectExpr("station", "CAST(a AS timestamp_ntz) AS at")
    timeline = playout.plan_timeline(entries)
    assert timeline.rdd.getNumPartitions() >= 96
    found = playout.play_point(blocks, timeline, probes).selectExpr("station", "date_format(at, 'dd HH:mm:ss') AS at", "block_id", "index", "offset_us")
    assert rows(found) == sorted([("s", "01 00:10:05", 7, 1, 5_000_000)] * 2 + [
        ("s", "01 00:30:00", 7, None, None), ("s", "02 00:00:00", None, None, None), (None, "01 00:00:00", None, None, None)], key=repr)


def _odd_marks(spark):
    """Marks without a start, end, file or number, marks and files that come twice, and one file with most of the marks."""
    made = [("big" if k % 3 else f"f{k % 5}", None if k % 17 == 5 else k % 13, None if k % 19 == 7 else float(k * 37 % 900), None if k % 2 else float(k * 37 % 900 + 5)) for k in range(120)]
    made += made[:20] + [(None, 1, 5.0, None), ("lost", 1, 5.0, None), ("bare", 1, None, None), ("zero", 1, 0.0, 7.0), ("zero", 2, 9.0, None), ("two", 1, 100.0, None), ("two", 2, 300.0, None)]
    files = spark.createDataFrame([(p, 1000.0) for p in ("big", "f0", "f1", "f2", "f3", "f4", "bare", "zero", "two", "two", "none", None)], "path string, duration double")
    return spark.createDataFrame(made, "path string, seq bigint, chapter_start double, chapter_end double").distinct().unionAll(
        spark.createDataFrame(made[:6], "path string, seq bigint, chapter_start double, chapter_end double")), files


@pytest.mark.parametrize("width", [60, 600])
def test_odd_marks_give_what_whole_files_give(spark, width):
    """Segments and thinned ones in narrow buckets are those of windows over whole files."""
    points, files = _odd_marks(spark)
    lead_in = points.groupBy("path").agg(F.min("chapter_start").alias("chapter_end")).filter("chapter_end > 0").selectExpr("path", "-1L AS seq", "0.0D AS chapter_start", "chapter_end")
    whole = points.unionByName(lead_in).withColumn("until", F.expr(
        "first(chapter_start, true) OVER (PARTITION BY path ORDER BY chapter_start ASC NULLS LAST, seq ASC NULLS LAST, chapter_end ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"))
    want = whole.join(files, "path").selectExpr("path", "seq", "chapter_start", "coalesce(chapter_end, until, duration) AS chapter_end", "coalesce(until, duration) - chapter_start AS segment_duration")
    assert rows(sg.segments(points, files, width=width)) == rows(want) != []
    placed = want.selectExpr("*", "row_number() OVER (PARTITION BY path ORDER BY chapter_start, seq, chapter_end) - 1 AS idx", "count(*) OVER (PARTITION BY path) AS n",
                             "last(chapter_end) OVER (PARTITION BY path ORDER BY chapter_start, seq, chapter_end DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e")
    kept = placed.filter("n <= 4 OR idx = 0 OR idx IN (bround((n - 1) / 3D), bround((n - 1) / 3D * 2), bround((n - 1) / 3D * 3))")
    thin = kept.selectExpr("path", "chapter_start", "if(n <= 4, chapter_end, coalesce(first(chapter_start, true) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), e)) AS chapter_end")
    assert rows(sg.thin_segments(want, 4, width=width)) == rows(thin) != []


@pytest.mark.parametrize("width", [60, 600])
def test_thinning_shuffles_rows_once_for_each_step(spark, width):
    """Marks are shuffled once and segments once; what else is shuffled is one row for each bucket or file, and the distinct marks of the test."""
    points, files = _odd_marks(spark)
    found = sg.thin_segments(sg.segments(points, files, width=width), 3, width=width)
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    final = text[:text.index("+- == Initial Plan ==")]
    assert len(re.findall(r"\+- Exchange hashpartitioning\(path", final)) <= 12
