"""Searches in a stored catalog: the rows of a full scan from a small part of its bytes."""

from __future__ import annotations

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from airlog.operators import trigrams
from airlog.operators.catalog import search
from conftest import rows


def bytes_read(spark, work):
    """What the work returns, and the bytes that its tasks read from files."""
    group = f"search-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, total = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            if tracker.getStageInfo(stage):
                total += store.lastStageAttempt(stage).inputBytes()
    return found, total


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rnd = random.Random(4)
    words = ["moon", "Night", "ÄRGER", "100%", "a_b", "the", "rîng", "ab", "x"]
    made = [(i, f"st{i % 3}", " ".join(rnd.choice(words) for _ in range(4)) + ("" if i % 997 else " Quixotic"),
             None if i % 7 == 0 else rnd.choice(words), f"dir{i % 40}/{i:06d}.mp4") for i in range(20000)]
    items = spark.createDataFrame(made, "id bigint, station string, title string, tag string, path string")
    folder = str(tmp_path_factory.mktemp("catalog"))
    trigrams.store_catalog(items, folder, span=250, folders=256)
    return items, folder


@pytest.mark.parametrize("text", ["quixotic", "MOON", "ärger", "ight m_o", "0%", "a\\", "moon%rîng", "ab", "", "zzz", "dir7/", "the the the"])
def test_same_rows_as_a_full_scan(spark, stored, text):
    items, folder = stored
    got = trigrams.search_stored(spark, folder, text, folders=256)
    assert got.columns == items.columns
    assert rows(got) == rows(search(items, text))
    assert rows(trigrams.search_stored(spark, folder, text, ["tag"], "st1", folders=256)) == rows(search(items, text, ["tag"], "st1"))


def test_a_rare_word_reads_a_small_part(spark, stored):
    items, folder = stored
    whole = sum(f.stat().st_size for f in Path(folder, "items").rglob("*.parquet"))
    plain, full = bytes_read(spark, lambda: rows(search(spark.read.parquet(f"{folder}/items"), "003988.MP4").select("id")))
    found, some = bytes_read(spark, lambda: rows(trigrams.search_stored(spark, folder, "003988.MP4", folders=256).select("id")))
    assert found == plain == [(3988,)]
    assert 0 < some < min(whole / 10, full)


def test_no_posting_row_holds_more_than_a_range(spark, stored):
    _, folder = stored
    longest = spark.read.parquet(f"{folder}/postings").agg(F.max("n"), F.max(F.size("ids"))).first()
    assert longest[0] == longest[1] == 250


def test_folders_do_not_grow_with_the_ranges(spark, tmp_path):
    """20,000 ranges of one id in 8 folders, which every search lists."""
    items = spark.range(20000).selectExpr("id", "concat('t', id) AS title", "'x' AS tag", "concat('p/', id) AS path")
    trigrams.store_catalog(items, str(tmp_path), span=1, folders=8)
    assert len([d for d in (tmp_path / "items").iterdir() if d.is_dir()]) <= 8
    assert rows(trigrams.search_stored(spark, str(tmp_path), "t1999", folders=8).select("id")) == [(1999,)] + [(19990 + i,) for i in range(10)]
