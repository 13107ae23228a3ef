"""Golden dates for calendar tests and hints."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airlog.functions import calendar as cal
from airlog.functions import hints


def at(spark, text, test):
    df = spark.createDataFrame([(text,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    return df.select(test).first()[0]


# Dates at the edges of weeks, holidays and ranges.
@pytest.mark.parametrize("when, week, hit", [
    ("2025-12-29", "week number 1", True), ("2027-01-02", "week number 1", False),
    ("2026-12-29", "week number 53", True), ("2026-12-27", "week number 53", False), ("2026-03-18", "2", False)])
def test_weeks(spark, when, week, hit):
    assert at(spark, when, cal.on_week("t", week)) is hit


@pytest.mark.parametrize("when, rule, hit", [
    ("2025-12-25", "December 25", True), ("2025-12-24", "December 25", False), ("2027-12-25", "December 25", True),
    ("2027-12-24", "December 25", False), ("2021-12-26", "December 25", False), ("2028-01-01", "January 1", True),
    ("2027-12-31", "January 1", False), ("2026-11-26", "4th thursday november", True),
    ("2026-11-25", "4th Thursday November", False), ("2026-05-25", "last monday may", True),
    ("2026-05-26", "last monday may", False)])
def test_holidays(spark, when, rule, hit):
    assert at(spark, when, cal.on_holiday("t", "day", {"day": rule})) is hit


@pytest.mark.parametrize("when, text, hit", [
    ("2024-12-15", "December 1 - December 25", True), ("2024-01-15", "December 1 - December 25", False),
    ("2024-12-15", "December 1 - January 31", True), ("2025-01-10", "December 1 - January 31", True),
    ("1985-01-10", "December 1 - January 31", True), ("2040-04-15", "December 1 - January 31", False),
    ("2024-12-25 00:00:00", "December 1 - December 25", True), ("2024-12-25 00:00:01", "December 1 - December 25", False),
    ("2024-12-25", "December 31 - Smarch 5", False), ("2024-02-20", "February 1 - February 30", False)])
def test_ranges(spark, when, text, hit):
    assert at(spark, when, cal.in_month_day_range("t", text)) is hit


def test_inclusive_range_keeps_the_last_day(spark):
    assert at(spark, "2024-12-25 22:00:00", cal.in_month_day_range("t", "December 1 - December 25", inclusive=True))


@pytest.mark.parametrize("key, when, hit", [
    ("April 23", "2024-04-23 10:00", True), ("April 23", "2024-04-24", False),
    ("December 24 - January 2", "2024-12-31", True), ("December 24 - January 2", "2024-01-02 23:00", True),
    ("December 24 - January 2", "2024-01-03", False), ("April 31", "2024-04-30", False), ("nonsense", "2024-04-30", False)])
def test_date_keys(spark, key, when, hit):
    assert at(spark, when, cal.matches_date_key("t", F.lit(key))) is hit


def test_day_parts_wrap_and_keep_their_last_hour():
    parts = cal.day_part_hours({"late": (22, 2), "noon": (12, 14)})
    assert parts == {"late": [22, 23, 0, 1, 2], "noon": [12, 13]}


@pytest.mark.parametrize("name, kinds", [
    ("October", ["month"]), ("october", []), ("Q4", ["quarter"]), ("December 1 - December 25", ["range"]),
    ("morning", ["day_part"]), ("friday", ["day_of_week"]), ("Friday", []), ("cartoons", []), ("pre", []),
    ("week number 44", ["week_number"]), ("44", []), ("week number 54", []), ("aug_day", ["custom_holiday"]),
    ("Aug_Day", []), ("q2sd", [])])
def test_folder_names(spark, name, kinds):
    found = hints.parse_hints(F.lit(name), holidays=["aug_day"])
    assert spark.range(1).select(F.transform(found, lambda h: h["type"])).first()[0] == kinds


def test_matching_names_stack(spark):
    found = hints.parse_hints(F.lit("October"), holidays=["October"])
    assert spark.range(1).select(F.transform(found, lambda h: h["type"])).first()[0] == ["month", "custom_holiday"]


def test_bump_names_only_in_bump_folders(spark):
    found = hints.parse_hints(F.lit("pre"), bumps=True)
    assert spark.range(1).select(hints.bump_position(found)).first()[0] == "pre"


def test_hints_survive_storage(spark):
    path = F.lit("base/October/Q4/friday/morning/week number 44/December 1 - December 25/aug_day/pre/x.mp4")
    found = hints.folder_hints(path, "base", holidays=["aug_day"], bumps=True)
    back = hints.decode_hints(hints.encode_hints(found))
    row = spark.range(1).select(F.size(found).alias("n"), (found == back).alias("same")).first()
    assert (row["n"], row["same"]) == (8, True)


def test_broadcast_week(spark):
    row = at(spark, "2024-01-17", cal.broadcast_week("t"))
    assert (str(row["week_start"]), str(row["week_end"])) == ("2024-01-15 06:00:00", "2024-01-22 06:00:00")
