"""Calendar rules, proposals and recommendations.

Slots in long form: station, rule_kind (weekday, week or date), rule_key, rule_order, day, hour and
any slot columns. A weekday rule's key is the weekday; the others have calendar keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from airlog.functions import calendar as cal
from airlog.functions.values import micros, seconds_interval
from airlog.operators.catalog import first_per

_LEVELS = {"date": 0, "week": 1, "weekday": 2}


def _level(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in _LEVELS.items() for x in pair])
    return F.try_element_at(table, kind)


def inline_templates(slots: DataFrame, templates: DataFrame) -> DataFrame:
    """Replace rows naming a day template by the template's slots (template, hour, slot columns)."""
    own = slots.filter("template IS NULL").drop("template")
    extra = [c for c in templates.columns if c != "template"]
    keys = [c for c in own.columns if c not in extra]
    drawn = slots.filter("template IS NOT NULL").select(*keys, "template").join(templates, "template").drop("template")
    return own.unionByName(drawn.select(*own.columns))


def slot_calendar(slots: DataFrame, first_day, last_day) -> DataFrame:
    """The slot of every (station, date, hour): date rules over week rules over weekdays.

    Within a level only the first matching rule counts. Where that rule has no slot for the hour, the
    next level is used, not the next rule. Every rule is expanded to its own days, so stations, days
    and rules are never crossed.
    """
    first, last = (F.lit(str(day)).cast("date") for day in (first_day, last_day))
    rules = slots.select("station", "rule_kind", "rule_key", "rule_order").distinct()
    bounded = rules.withColumns({
        "_bounds": F.when(F.col("rule_kind") != "weekday", cal.key_bounds(F.col("rule_key"))),
        "_weekday": F.when(F.col("rule_kind") == "weekday", cal.weekday_number(F.col("rule_key"))),
    })
    # a weekday rule steps by whole weeks, a calendar key by the days of its bounds
    opening = F.date_add(first, F.pmod(F.col("_weekday") - F.weekday(first), F.lit(7)))
    weekly = F.when(opening <= last, F.sequence(opening, last, F.expr("INTERVAL 7 DAYS")))
    days = F.when(F.col("_weekday").isNotNull(), weekly).otherwise(cal.days_in_bounds(F.col("_bounds"), first, last))
    dated = bounded.withColumn("date", F.explode(days)).drop("_bounds", "_weekday")
    chosen = first_per(dated, ["station", "date", "rule_kind"], ["rule_order", "rule_key"]).drop("rule_order")
    laid = chosen.join(slots.drop("rule_order"), ["station", "rule_kind", "rule_key"])
    fits = (F.col("rule_kind") != "week") | (F.col("day") == cal.weekday_name("date"))
    ranked = laid.filter(fits).withColumn("_level", _level(F.col("rule_kind")))
    return first_per(ranked, ["station", "date", "hour"], ["_level"]).drop("_level")


OVERRIDABLE = ("start_bump", "end_bump", "bump_dir", "commercial_dir", "break_strategy", "schedule_increment")


def effective_slot(slots: DataFrame, overrides: DataFrame, stations: DataFrame, fields: Sequence[str] = OVERRIDABLE) -> DataFrame:
    """Settings of each slot: tag override over slot over station. Tags without an override keep the slot's.

    slots: station, tag, fields; overrides: station, tag, fields; stations: station, fields.
    """
    over = overrides.select("station", "tag", *[F.col(f).alias(f"_o_{f}") for f in fields])
    base = stations.select("station", *[F.col(f).alias(f"_s_{f}") for f in fields])
    joined = slots.join(over, ["station", "tag"], "left").join(base, "station", "left")
    keep = [c for c in slots.columns if c not in fields]
    return joined.select(*keep, *[F.coalesce(f"_o_{f}", f, f"_s_{f}").alias(f) for f in fields])


# ---- directives and proposals --------------------------------------------------------------


def expand_directives(directives: DataFrame, week_start, parts: Mapping[str, Sequence[int]] = cal.DAY_PARTS) -> DataFrame:
    """One row per (channel, date, hour, series) a directive asks for.

    directives: id, channel, type (date_slot, marathon, daypart, or a season or theme over a date
    range), series, date, hour, daypart, start_date, end_date, hours (array), all_day.
    """
    start = F.lit(str(week_start)).cast("date")
    one_day = F.col("type").isin("date_slot", "marathon")
    part = F.col("type") == "daypart"
    dates = (
        F.when(one_day, F.array("date"))
        .when(part, F.sequence(start, F.date_add(start, 6)))
        .when(F.col("start_date") <= F.col("end_date"), F.sequence("start_date", "end_date"))
    )
    hours = (
        F.when(one_day, F.array(F.col("hour").cast("int"))).when(part, cal.hours_of(F.col("daypart"), parts))
        .when(F.col("all_day"), F.sequence(F.lit(0), F.lit(23))).otherwise(F.col("hours").cast("array<int>"))
    )
    dated = directives.select("id", "channel", "series", F.explode(dates).alias("date"), hours.alias("_hours"))
    return dated.select("id", "channel", "series", "date", F.explode("_hours").alias("hour"))


def directive_conflicts(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(channel, date, hour) asked for by more than one series, counting slots that exist already."""
    every = rows.select("channel", "date", "hour", "series")
    if existing is not None:
        every = every.unionByName(existing.select("channel", "date", "hour", "series"))
    return every.groupBy("channel", "date", "hour").agg(F.count_distinct("series").alias("series_count")).filter("series_count > 1")


def check_proposal(
    changes: DataFrame,
    directives: DataFrame,
    exclusions: DataFrame,
    owners: DataFrame,
    protected: DataFrame,
    closed_channels: Sequence[int] = (1, 8),
    locked_channels: Sequence[int] = (8,),
) -> DataFrame:
    """Rule violations of a proposal, as distinct (code, series).

    changes: series, action, from_channel, to_channel. directives: series, channel. exclusions and
    protected: series. owners: series, channel as configured now. Series are compared in lower case.
    Nothing is given to a closed channel and nothing taken from a locked one; what closed channels own
    stays with them.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("series", F.lower("series"))

    raw_exclusions = exclusions.select("series")
    changes, directives, owners = keyed(changes), keyed(directives), keyed(owners).distinct()
    excluded, held = keyed(raw_exclusions), keyed(protected).select("series").distinct()
    counts = owners.groupBy("series").agg(
        F.count_distinct("channel").alias("n_owners"), F.min("channel").alias("owner"))
    asked = directives.select("series", "channel").distinct()
    in_change = changes.select("series").distinct()
    closed = list(closed_channels)

    def found(df: DataFrame, code: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), "series")

    target = changes.filter("to_channel IS NOT NULL").select("series", F.col("to_channel").alias("channel"))
    source = changes.filter("from_channel IS NOT NULL").select("series", F.col("from_channel").alias("channel"))
    intended = changes.groupBy("series").agg(F.max("to_channel").alias("intended"), F.lit(True).alias("changed"))
    placed = directives.join(intended, "series", "left").join(counts, "series", "left")
    permitted = F.when(F.col("changed"), F.col("intended")).when(F.col("n_owners") == 1, F.col("owner"))
    used = in_change.union(directives.select("series")).distinct()
    leaving = source.filter(~F.col("channel").isin(*closed)).unionByName(
        excluded.join(owners, "series").filter(~F.col("channel").isin(*closed)).select("series", "channel")).distinct()
    projected = owners.join(leaving, ["series", "channel"], "left_anti").unionByName(
        asked.filter(~F.col("channel").isin(*closed)).select("series", "channel")).distinct()
    checks = [
        found(counts.filter("n_owners > 1"), "exclusive_ownership"),
        found(changes.groupBy("series").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several_changes"),
        found(changes.join(held, "series", "left_semi"), "protected_change"),
        found(changes.filter(F.col("from_channel").isin(*locked_channels) | F.col("to_channel").isin(*closed)), "closed_channel_change"),
        found(source.join(owners, ["series", "channel"], "left_anti"), "not_assigned_to_source"),
        found(changes.filter("action = 'assign'").join(counts, "series", "left_semi"), "already_assigned"),
        found(target.join(asked, ["series", "channel"], "left_anti"), "missing_directive"),
        found(changes.filter("action = 'remove'").join(asked, "series", "left_semi"), "removed_but_scheduled"),
        found(directives.filter(F.col("channel").isin(*closed)), "closed_channel_directive"),
        found(directives.join(held, "series", "left_semi"), "protected_directive"),
        found(placed.filter("changed IS NULL AND n_owners IS NULL"), "unassigned_series"),
        found(placed.filter(permitted.isNotNull() & (permitted != F.col("channel"))), "ownership_conflict"),
        found(excluded.groupBy("series").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate_exclusion"),
        found(excluded.join(held, "series", "left_semi"), "protected_exclusion"),
        found(excluded.join(used, "series", "left_semi"), "excluded_but_used"),
        found(projected.groupBy("series").agg(F.count_distinct("channel").alias("n")).filter("n > 1"), "projected_ownership"),
        found(projected.filter(~F.col("channel").isin(*closed)).join(excluded, "series", "left_semi"), "exclusion_remains"),
    ]
    every = checks[0]
    for more in checks[1:]:
        every = every.unionByName(more)
    return every.distinct()


def _timed_well() -> Column:
    """Whether an entry's duration and skip are finite and within their bounds."""
    duration, skip = F.col("duration").cast("double"), F.coalesce(F.col("skip").cast("double"), F.lit(0.0))
    # NaN is larger than any number
    return F.coalesce((duration > 0) & (duration <= 86400) & (skip >= 0) & (skip < float("inf")), F.lit(False))


def effect_features(proved: DataFrame, directives: DataFrame, blocks: DataFrame, timeline: DataFrame) -> DataFrame:
    """What proves each request: the features (id, block_id, start_us, end_us) of all blocks that start in its hour.

    proved: rows of effect_evidence; only those with that status give rows. timeline: block_id, content_type, from_us, until_us.
    """
    asked = directives.join(proved.filter("status = 'proved'").select("id"), "id").select(
        "id", "station", (F.col("date").cast("timestamp_ntz") + seconds_interval(F.col("hour") * 3600)).alias("_from"))
    begun = blocks.select(F.col("id").alias("block_id"), "station", micros("start_time").alias("_at"),
                          F.date_trunc("hour", F.col("start_time")).cast("timestamp_ntz").alias("_from"))
    shown = timeline.filter("content_type = 'feature'").select("block_id", "from_us", "until_us")
    return asked.join(begun, ["station", "_from"]).join(shown, "block_id").select(
        "id", "block_id", (F.col("_at") + F.col("from_us")).alias("start_us"), (F.col("_at") + F.col("until_us")).alias("end_us"))


def effect_evidence(directives: DataFrame, blocks: DataFrame, timeline: DataFrame, catalog: DataFrame) -> DataFrame:
    """Whether each (station, date, hour, series) request is proved by the schedule.

    All blocks starting in the hour must be plain blocks of the series on their own station, the
    features of the plan must be that item and nothing else, every entry must be longer than 0 and at most a day and skip no
    negative time, and the plan must end inside the block. Returns id, blocks and status: proved, no_blocks, wrong_type,
    wrong_series, bad_timing, no_feature or plan_too_long.
    blocks: id, station, liquid_type, start_time, end_time, content_id. timeline: block_id, path, content_type, until_us,
    duration and skip in seconds.
    """
    timed = directives.withColumn("_from", F.col("date").cast("timestamp_ntz") + seconds_interval(F.col("hour") * 3600))
    asked = timed.select(F.col("id").alias("_d"), "station", "_from", "series")
    hour = F.date_trunc("hour", F.col("start_time")).cast("timestamp_ntz")
    items = catalog.select(F.col("id").alias("content_id"), F.col("station").alias("_owner"), "tag",
                           F.coalesce("realpath", "path").alias("_path"))
    rows = blocks.withColumn("_from", hour).join(asked, ["station", "_from"]).join(items, "content_id", "left")
    ends = timeline.groupBy(F.col("block_id").alias("_b")).agg(
        F.max("until_us").alias("_plan_us"), F.bool_and(_timed_well()).alias("_timed"),
        F.min(F.when(F.col("content_type") == "feature", F.col("path"))).alias("_lo"),
        F.max(F.when(F.col("content_type") == "feature", F.col("path"))).alias("_hi"))
    judged = rows.join(ends, F.col("id") == F.col("_b"), "left")
    fault = (
        F.when(F.col("liquid_type") != "LiquidBlock", 1)
        .when(~F.coalesce((F.col("tag") == F.col("series")) & (F.col("_owner") == F.col("station")), F.lit(False)), 2)
        .when(~F.coalesce("_timed", F.lit(True)), 3)
        .when(~F.coalesce((F.col("_lo") == F.col("_path")) & (F.col("_hi") == F.col("_path")), F.lit(False)), 4)
        .when(F.col("_plan_us") > micros("end_time") - micros("start_time"), 5).otherwise(0)
    )
    worst = judged.withColumn("_fault", fault).groupBy("_d").agg(
        F.count_distinct("id").alias("blocks"), F.min(F.when(F.col("_fault") > 0, F.col("_fault"))).alias("_fault"))
    names = F.array(*[F.lit(x) for x in ("wrong_type", "wrong_series", "bad_timing", "no_feature", "plan_too_long")])
    status = F.when(F.col("blocks").isNull(), "no_blocks").when(F.col("_fault").isNull(), "proved").otherwise(
        F.get(names, F.col("_fault") - 1))
    return directives.select("id").join(worst, F.col("id") == F.col("_d"), "left").select(
        "id", F.coalesce("blocks", F.lit(0)).alias("blocks"), status.alias("status"))


# ---- recommendations -----------------------------------------------------------------------

def keyword_hits(shows: DataFrame, policy: DataFrame) -> DataFrame:
    """(show, number, name, keyword) for every keyword that a show's name contains, ignoring case.

    An equi-join on the different substrings of each name that have the length of some keyword; the
    lengths are a joined table too.
    """
    words = policy.select("number", "name", F.explode("keywords").alias("keyword")).filter("keyword <> ''").distinct()
    lengths = words.select(F.length(F.lower("keyword")).alias("_n")).distinct()
    sized = shows.select("show", F.lower("show").alias("_text")).select(
        "show", "_text", F.explode(F.sequence(F.lit(1), F.length("_text"))).alias("_n")).join(lengths, "_n")
    starts = F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1)
    cut = sized.select("show", F.explode(F.array_distinct(
        F.transform(starts, lambda i: F.substr("_text", i, F.col("_n"))))).alias("_piece"))
    return cut.join(words.withColumn("_piece", F.lower("keyword")), "_piece").select("show", "number", "name", "keyword")


def recommend(shows: DataFrame, policy: DataFrame, owners: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Best channel of every show by keyword hits, with its evidence.

    Columns: show, status, channel, identity, score, confidence, matched_keywords, owners, channels. policy: number, name,
    accepts_recommendations, keywords (array). Shows that are assigned already are passed through with their owners, whose
    names are in channels.
    """
    skip = [x.lower() for x in excluded] + ["(media root)"]
    named = shows.select("show").distinct().filter(~F.lower("show").isin(*skip))
    held = owners.groupBy(F.lower("tag").alias("_key")).agg(
        F.count_distinct("station").alias("owners"), F.array_sort(F.collect_set("station")).alias("channels"))
    marked = named.withColumn("_key", F.lower("show")).join(held, "_key", "left").drop("_key")
    open_policy = policy.filter("accepts_recommendations")
    free = marked.filter("owners IS NULL").select("show")
    hits = keyword_hits(free, open_policy).groupBy("show", "number", "name").agg(
        F.array_sort(F.collect_set("keyword")).alias("matched")).withColumn("score", F.size("matched").cast("bigint"))
    best = hits.groupBy("show").agg(F.max_by(F.struct("number", "name", "score", "matched"), F.struct("score", -F.col("number"))).alias("b"))
    score, none = F.coalesce("b.score", F.lit(0)), F.array().cast("array<string>")
    advised = free.join(best, "show", "left").select(
        "show", F.lit("advisory").alias("status"), F.col("b.number").alias("channel"), F.col("b.name").alias("identity"),
        score.alias("score"), F.when(score == 0, "unclassified").when(score == 1, "low").otherwise("medium").alias("confidence"),
        F.coalesce("b.matched", none).alias("matched_keywords"), F.lit(0).cast("bigint").alias("owners"), none.alias("channels"))
    kept = marked.filter("owners IS NOT NULL").select(
        "show", F.lit("already_assigned").alias("status"), F.lit(None).cast("int").alias("channel"),
        F.lit(None).cast("string").alias("identity"), F.lit(0).cast("bigint").alias("score"),
        F.lit(None).cast("string").alias("confidence"), none.alias("matched_keywords"), "owners", "channels")
    return advised.unionByName(kept)
