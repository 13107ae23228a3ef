"""Plans: what reaches the scan, what is shuffled, and what must not appear."""

from __future__ import annotations

import re

import pytest

from airlog.operators import catalog, diff, intervals as iv
from queries.views import Tables


@pytest.fixture(scope="module")
def t(spark, folder):
    return Tables(spark, folder)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("build", [
    lambda t: iv.overlap_join(t.blocks, t.blocks), lambda t: iv.exclude_overlapping(t.baseline, t.proposed, "content_id"),
    lambda t: iv.now_playing(t.blocks, t.blocks.selectExpr("station", "start_time AS at")),
    lambda t: iv.coverage(t.blocks, t.windows), lambda t: diff.diff_schedules(t.baseline, t.proposed, t.windows),
    lambda t: diff.diff_snapshots(t.manifest_before, t.manifest_after), lambda t: iv.lookahead(t.blocks, tag="title")])
def test_no_nested_loops(t, build):
    text = plan(build(t))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_window_filter_and_columns_reach_the_scan(t):
    text = plan(iv.blocks_in_window(t.blocks, "2024-01-10", "2024-01-11", "view").select("id"))
    assert "EqualTo(event_type,view)" in text and "LessThan(ts," in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in text


def test_eligibility_reaches_the_scan(t, spark, folder):
    items = spark.read.parquet(f"{folder}/part.parquet").withColumnRenamed("p_retailprice", "duration")
    assert "GreaterThanOrEqual(p_retailprice,1.0), LessThan(p_retailprice,1000.0)" in plan(catalog.eligible(items, 1000.0, strict=True))


def test_components_shuffle_rows_twice_and_buckets_once(t):
    """Rows meet in buckets, never a whole station in one task: once for the totals, once for the labels."""
    text = plan(iv.components(t.blocks))
    assert text.count(") Exchange") == 3 and text.count("hashpartitioning(station") == 3


def test_first_per_combines_before_the_shuffle(t):
    text = plan(catalog.first_per(t.blocks, ["station"], ["start_time", "id"]))
    assert "partial_min_by" in text and "Window" not in text


def test_window_bounds_of_an_audit_meet_the_raw_column(t):
    """The bounds are known only when the query runs; they are compared with the scanned column below the join."""
    text = plan(iv.coverage(t.blocks, t.windows))
    assert re.search(r"\(ts#\d+ < (Reused)?Subquery", text, re.IGNORECASE) or re.search(r"ts#\d+ < .{0,12}subquery", text, re.IGNORECASE)
