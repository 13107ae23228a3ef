"""Golden sidecars and legacy rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airlog.functions import metadata as md

CASES = [
    ("<movie><title>Jaws</title><year>1975</year><plot>Shark</plot></movie>", {"type": "movie", "title": "Jaws", "year": "1975", "plot": "Shark"}),
    ("<movie><title>Jaws</title><premiered>1975-06-20</premiered><outline>Shark</outline></movie>", {"year": "1975", "plot": "Shark"}),
    ('<?xml version="1.0"?>\n<musicvideo><title> Song </title><artist>Band</artist></musicvideo>', {"type": "music", "title": "Song", "artist": "Band"}),
    ("<episodedetails><title>Pilot</title><season>1</season><episode>x2</episode></episodedetails>",
     {"type": "episode", "season": 1, "episode": None, "episode_raw": "x2"}),
    ("<tvshow><title>Show</title></tvshow>", {"type": "tvshow", "title": "Show"}),
    ("<artist><title>Solo</title><genre>Folk</genre></artist>", {"type": "artist", "genre": "Folk"}),
    ("First line\n\n  second\nthird\n4\n5\n6", {"type": "plaintext", "title": "First line", "lines": ["First line", "second", "third", "4", "5"]}),
    ("<artist><genre>Folk</genre></artist>", None),
    ("<movie></movie>", None),
    ("   \n ", None),
    ("", None),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_sidecars(spark, text, expected):
    got = spark.createDataFrame([(text,)], "text string").select(md.parse_sidecar("text").alias("m")).first()["m"]
    if expected is None:
        assert got is None
    else:
        assert {k: got[k] for k in expected} == expected


def test_unclosed_xml_is_plain_text(spark):
    got = spark.createDataFrame([("<movie><title>Jaws",)], "text string").select(md.parse_sidecar("text").alias("m")).first()["m"]
    assert got["type"] == "plaintext"


def test_display_of_plain_text(spark):
    df = spark.createDataFrame([("a\nb\nc\nd",)], "text string").select(md.parse_sidecar("text").alias("m"))
    row = df.select(md.display_fields("m").alias("d"), md.overlay_lines("m").alias("o")).first()
    assert tuple(row["d"]) == ("a", "b", "c") and row["o"] == ["a", "b", "c", "d"]


def test_empty_overlay(spark):
    df = spark.createDataFrame([("<movie><title>x</title></movie>",)], "text string").select(md.parse_sidecar("text").alias("m"))
    assert df.select(F.isnull(md.overlay_lines("m"))).first()[0]
