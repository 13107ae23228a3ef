"""Station configuration documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from airlog.functions.calendar import DAYS
from airlog.functions.values import strict_json, tags_array
from airlog.operators.scan import spread
from airlog.sources.manifests import source_file

_MAP = T.MapType(T.StringType(), T.StringType())


def load_configs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per JSON file (file, text); malformed files are kept for parse_configs to report."""
    read = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return read.select(source_file().alias("file"), F.col("value").alias("text"))


def _get(path: str, text: str = "text") -> Column:
    return F.get_json_object(text, "$.station_conf." + path)


def parse_configs(configs: DataFrame) -> DataFrame:
    """Station settings of each document, and an error instead of them where it cannot be used.

    Reading a document takes far longer than its bytes tell, so documents are spread over more tasks than their files are.
    """
    # exploded, so that no filter on it goes back below the shuffle
    valid = spread(configs, "file").withColumn("_valid", F.explode(F.array(strict_json("text").isNotNull())))
    name = _get("network_name")
    error = F.when(~F.col("_valid"), "malformed").when(name.isNull(), "no_network_name")
    return valid.select(
        "file", "text", error.alias("error"), name.alias("station"),
        _get("network_type").alias("network_type"), _get("content_dir").alias("content_root"),
        _get("channel_number").try_cast("bigint").alias("channel_number"),
        F.coalesce(_get("hidden").try_cast("boolean"), F.lit(False)).alias("hidden"),
        _get("break_strategy").alias("break_strategy"),
        _get("schedule_increment").try_cast("int").alias("schedule_increment"),
        _get("fallback_tag").alias("fallback_tag"),
    )


def _as_map(text: Column) -> Column:
    return F.from_json(F.when(F.startswith(text, F.lit("{")), text), _MAP)


def _rules(stations: DataFrame, *more: str) -> DataFrame:
    """The slot rules of every usable document, a row for each entry of a rule: station, rule_kind, rule_key, rule_order, day, hour, slot.

    A document is parsed once, and so are its day templates. `more` names settings whose entries follow as rules of that kind, and
    station itself, an entry without fields that has `names`: what the document refers to directly.
    """
    fields = ["day_templates", *DAYS, "date_overrides", "week_overrides", "fallback_tag", "bump_dir", "commercial_dir", *more]
    usable = stations.filter("error IS NULL").select("station", F.json_tuple(F.get_json_object("text", "$.station_conf"), *fields).alias(*fields))
    # an exploded column is computed once, however often it is named
    parsed = usable.withColumn("_templates", F.explode(F.array(_as_map(F.col("day_templates")))))
    null = F.lit(None).cast("string")

    def inlined(day: Column) -> Column:
        return F.when(F.startswith(day, F.lit("{")), day).otherwise(F.try_element_at("_templates", day))

    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (
        ("tag", "fallback_tag"), ("bump_dir", "bump_dir"), ("commercial_dir", "commercial_dir"))])
    unnamed = F.slice(named, F.lit(1), F.lit(0))

    def rule(kind: str, key: Column, order: Column, day: Column, slots: Column, names: Column = unnamed) -> Column:
        return F.struct(F.lit(kind).alias("rule_kind"), key.alias("rule_key"), order.cast("int").alias("rule_order"),
                        day.alias("day"), slots.alias("slots"), names.alias("names"))

    plain = [rule("weekday", F.lit(d), F.lit(0), F.lit(d), inlined(F.col(d))) for d in DAYS]
    plain += [rule(m, null, F.lit(0), null, F.col(m)) for m in more]
    if more:
        plain.append(rule("station", null, F.lit(0), null, F.lit('{"station": {}}'), named))
    weekdays = F.array(*plain)
    dates = F.transform(
        F.map_entries(_as_map(F.col("date_overrides"))),
        lambda e, i: rule("date", e["key"], i, null, inlined(e["value"])))
    weeks = F.flatten(F.transform(
        F.map_entries(_as_map(F.col("week_overrides"))),
        lambda e, i: F.transform(
            F.map_entries(_as_map(e["value"])),
            lambda d: rule("week", e["key"], i, d["key"], inlined(d["value"])))))
    empty = F.slice(weekdays, F.lit(1), F.lit(0))
    every = F.concat(weekdays, F.coalesce(dates, empty), F.coalesce(weeks, empty))
    rules = parsed.select("station", F.explode(every).alias("r")).select("station", "r.*")
    return rules.select("station", "rule_kind", "rule_key", "rule_order", "day", "names", F.explode(_as_map(F.col("slots"))).alias("hour", "slot"))


def config_slots(stations: DataFrame) -> DataFrame:
    """Slots of all documents in long form.

    station, rule_kind (weekday, date or week), rule_key, rule_order, day, hour, tags, continued, slot
    (JSON text). A weekday given by name of a day template takes the template's slots.
    """
    columns = ["station", "rule_kind", "rule_key", "rule_order", "day"]
    slots = _rules(stations).select(*columns, "hour", "slot", F.json_tuple("slot", "tags", "continued").alias("tags", "continued"))
    return slots.select(
        *columns, F.col("hour").try_cast("int").alias("hour"), tags_array("tags").alias("tags"),
        F.coalesce(F.col("continued").try_cast("boolean"), F.lit(False)).alias("continued"), "slot")


def referenced_tags(stations: DataFrame) -> DataFrame:
    """Everything a document refers to, as distinct (station, kind, name).

    Kinds: tag, bump_dir, commercial_dir, start_bump and end_bump, from slots of every rule level,
    tag overrides, clip shows, the fallback tag and the station itself. One pass over the documents gives them all.
    """
    fields = ("bump_dir", "commercial_dir", "start_bump", "end_bump")
    inside = ("tags", *fields, "start_clip", "end_clip")
    entries = _rules(stations, "tag_overrides", "clip_shows").select(
        "station", "rule_kind", "hour", "names", F.json_tuple("slot", *inside).alias(*inside))

    def named(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("name"))

    dirs = F.array(*[named(f, F.col(f)) for f in fields])
    clips = F.array(named("tag", F.col("hour")), named("tag", F.col("start_clip")), named("tag", F.col("end_clip")))
    tags = F.coalesce(F.transform(tags_array("tags"), lambda v: named("tag", v)), F.slice(dirs, F.lit(1), F.lit(0)))
    refers = (F.when(F.col("rule_kind") == "station", F.col("names")).when(F.col("rule_kind") == "clip_shows", clips)
              .when(F.col("rule_kind") == "tag_overrides", dirs).otherwise(F.concat(tags, dirs)))
    every = entries.select("station", F.explode(refers).alias("r")).select("station", "r.*")
    return every.filter("name IS NOT NULL AND name <> ''").distinct()
