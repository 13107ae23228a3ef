"""Files, sidecars, configuration documents and table versions."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from airlog import schemas
from airlog.operators import diff, fingerprints
from airlog.sources import configs, listing, manifests, sidecars, tables
from conftest import rows


def test_scan_and_snapshot_diff(spark, tmp_path):
    for name in ("A/1.mp4", "A/2.mkv", "A/notes.txt", "top.MP4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * 10)
    files, skipped, _ = manifests.scan_manifest(spark, str(tmp_path))
    assert rows(files.select("path", "size")) == [("A/1.mp4", 10), ("A/2.mkv", 10), ("top.MP4", 10)]
    assert rows(skipped) == [("A/notes.txt", "unsupported_extension")]


def test_golden_snapshot_diff(spark):
    kind = "path string, size bigint, mtime_ns bigint"
    before = spark.createDataFrame([("A/1.mp4", 1, 1)], kind)
    after = spark.createDataFrame([("A/1.mp4", 2, 1), ("B/1.mp4", 1, 1)], kind)
    assert rows(diff.diff_snapshots(before, after).select("kind", "change", "item")) == [
        ("file", "added", "B/1.mp4"), ("file", "modified", "A/1.mp4"), ("show", "new", "B")]


def test_hidden_directories_are_named_once(spark):
    listing = spark.createDataFrame([(".git/a.mp4",), (".git/b/c.mp4",), ("A/.x.mp4",), ("A/y.mp4",)], "path string")
    files, skipped = manifests.classify_manifest(listing)
    assert rows(files) == [("A/y.mp4",)]
    assert rows(skipped) == [(".git", "hidden_directory"), ("A/.x.mp4", "hidden")]


def test_sidecars_from_files(spark, tmp_path):
    (tmp_path / "film no.1.nfo").write_text("<movie><title>One</title></movie>")
    cars = sidecars.read_sidecars(spark, str(tmp_path))
    files = spark.createDataFrame([("film no.1.mkv",), ("other.mkv",)], "path string")
    got = {r["path"]: r["meta"] for r in sidecars.pair_sidecars(files, cars).collect()}
    assert got["film no.1.mkv"]["title"] == "One" and got["other.mkv"] is None


def test_configs_from_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"station_conf": {"network_name": "One", "monday": {"6": {"tags": ["a", "b"]}}}}))
    (tmp_path / "bad.json").write_text("{")
    parsed = configs.parse_configs(configs.load_configs(spark, str(tmp_path)))
    assert sorted((r["file"].rsplit("/", 1)[1], r["error"]) for r in parsed.collect()) == [("bad.json", "malformed"), ("good.json", None)]
    assert rows(configs.config_slots(parsed).select("station", "day", "hour", "tags")) == [("One", "monday", 6, ["a", "b"])]


def test_widen_old_catalog_rows(spark):
    old = spark.createDataFrame([(1, "p")], "id bigint, path string")
    wide = tables.widen(old, schemas.CATALOG_DEFAULTS, schemas.CATALOG)
    assert rows(wide) == [(1, "p", None, "feature", "video")]


def test_unsafe_replacement(spark):
    t = datetime
    kind = "id bigint, station string, start_time timestamp_ntz, end_time timestamp_ntz"
    base = spark.createDataFrame([(1, "s", t(2024, 1, 1), t(2024, 1, 3)), (2, "s", t(2024, 1, 3), t(2024, 1, 9)), (3, "x", t(2024, 1, 1), t(2024, 1, 2))], kind)
    new = spark.createDataFrame([(3, "s", t(2024, 1, 3), t(2024, 1, 4))], kind)
    problems = tables.replacement_problems(base, new, "s", t(2024, 1, 2), t(2024, 1, 5))
    assert rows(problems) == [("crosses_range_end", 2), ("id_collision", 3), ("overlaps_seam", 1)]


def test_decode_bad_json_gives_null(spark):
    raw = spark.createDataFrame(
        [(1, "s", "LiquidBlock", None, None, None, "t", "{", "{", "[1", "nope")], schemas.BLOCK)
    row = tables.decode_blocks(raw).first()
    assert row["content_ids"] is None and row["plan"] == [] and row["break_info"] is None


@pytest.mark.parametrize("changed, same", [(0, True), (1, False)])
def test_fingerprint_ignores_order_but_not_values(spark, changed, same):
    a = spark.createDataFrame([(1, "x", 0.5), (2, None, 1.5), (2, None, 1.5)], "id int, name string, v double")
    b = spark.createDataFrame([(2, None, 1.5), (1, "x", 0.5 + changed), (2, None, 1.5)], "id int, name string, v double")
    assert fingerprints.runs_match(a, b).first()["passed"] is same


def test_fingerprint_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert fingerprints.runs_match(a, b).first()["passed"] is False


def test_listing_of_a_real_library(spark, tmp_path):
    root = tmp_path / "library"
    for name in ("_intro.mp4", ".x", ".git/a.mp4", "A/1.mp4", "A/deep/er/_2.mkv", "A/deep/er/.3.mkv", "B/note.txt", "B/.h/4.mp4"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * len(name))
    (root / "B/lost.mp4").symlink_to("nowhere")
    (root / "B/loop.mp4").symlink_to("loop.mp4")
    (root / "B/lost.txt").symlink_to("nowhere")
    (root / "B/again").symlink_to("../A/deep")
    (root / "A/deep/up").symlink_to("../..")
    for parts in (1, 7):
        files, skipped, errors = manifests.scan_manifest(spark, str(root), parts=parts)
        assert rows(files.select("path", "size")) == [("A/1.mp4", 7), ("A/deep/er/_2.mkv", 16), ("_intro.mp4", 10)]
        assert rows(skipped) == [(".git", "hidden_directory"), (".x", "hidden"), ("A/deep/er/.3.mkv", "hidden"),
                                 ("B/.h", "hidden_directory"), ("B/lost.txt", "unsupported_extension"), ("B/note.txt", "unsupported_extension")]
        assert [r["path"] for r in errors.orderBy("path").collect()] == ["B/loop.mp4", "B/lost.mp4"]


def test_an_unreadable_folder_is_a_row(tmp_path, monkeypatch):
    for name in ("A/1.mp4", "B/2.mp4"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text("x")
    scan = listing.os.scandir

    def refused(path):
        if path.endswith("/A"):
            raise PermissionError(13, "Permission denied")
        return scan(path)

    monkeypatch.setattr(listing.os, "scandir", refused)
    found = [row for part in range(5) for row in listing.walk(str(tmp_path), part, 5)]
    assert sorted((r[0], r[3], r[-1]) for r in found) == [("A", True, "Permission denied"), ("B/2.mp4", False, None)]
    assert [r[0::7] for r in listing.walk(str(tmp_path / "none"))] == [(".", "No such file or directory")]


def test_listing_plan_lists_nothing_on_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing.os, "scandir", None)
    manifests.scan_manifest(spark, str(tmp_path / "none"))


def test_listing_stream_gives_what_comes_later(spark, tmp_path):
    root, kept = tmp_path / "library", str(tmp_path / "kept")
    (root / "A").mkdir(parents=True)
    (root / "A/1.mp4").write_text("x")
    (tmp_path / "late").mkdir()
    (tmp_path / "late/2.mp4").write_text("xx")

    def run():
        listing.stream_library(spark, str(root), lag_seconds=0).writeStream.format("parquet").option("path", kept).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        files, _, _ = manifests.split_listing(listing.newest_of_each(spark.read.parquet(kept)))
        return rows(files.select("path", "size"))

    assert run() == [("A/1.mp4", 1)]
    (tmp_path / "late").rename(root / "B")
    (root / "A/1.mp4").write_text("xxx")
    assert run() == [("A/1.mp4", 3), ("B/2.mp4", 2)] == rows(manifests.scan_manifest(spark, str(root))[0].select("path", "size"))


def test_a_document_is_read_once_and_by_many_tasks(spark):
    text = ('{"station_conf": {"network_name": "N", "fallback_tag": "f", "bump_dir": "b", "day_templates": {"w": {"6": {"tags": ["x", "y"]}}}, '
            '"monday": "w", "tuesday": {"7": {"tags": "z", "start_bump": "s", "continued": true}}, "sunday": null, '
            '"clip_shows": {"c": {"end_clip": "e"}}, "tag_overrides": {"t": {"commercial_dir": "ads"}}}}')
    parsed = configs.parse_configs(spark.createDataFrame([("a.json", text), ("b.json", text + "}")], "file string, text string"))
    slots = configs.config_slots(parsed)
    assert rows(slots.select("day", "hour", "tags", "continued")) == [
        ("monday", 6, ["x", "y"], False), ("tuesday", 7, ["z"], True)]
    found = configs.referenced_tags(parsed)
    assert rows(found) == sorted([("N", k, n) for k, n in (
        ("tag", "f"), ("tag", "x"), ("tag", "y"), ("tag", "z"), ("tag", "c"), ("tag", "e"), ("bump_dir", "b"), ("start_bump", "s"),
        ("commercial_dir", "ads"))], key=repr)
    assert slots.rdd.getNumPartitions() >= 96
    assert found._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json") == parsed.select("error")._jdf.queryExecution().optimizedPlan().toString().count("try_parse_json")
