"""Item catalogs: lookups, eligibility, metadata-hint pools, ranking, play counts and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from airlog.functions import calendar as cal
from airlog.functions import paths
from airlog.functions.hints import hint_matches
from airlog.functions.values import let, micros, seeded_number
from airlog.operators.intervals import _ntz, now_playing, room_until_busy
from airlog.operators.scan import spread
from airlog.operators.tiles import SLICES, in_tiles, sliced

# The total orders used for stable output.
ORDERS = {
    "catalog": ("tag", "title", "path", "id"),
    "schedule": ("station", "start_time", "end_time", "id"),
    "least_played": ("count", "title", "path", "id"),
}


# ---- filters -------------------------------------------------------------------------------


def where(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values, all of them pushed to the scan."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def search(df: DataFrame, text: str, columns: Sequence[str] = ("title", "tag", "path"),
           station: str | None = None) -> DataFrame:
    """Rows with the text in any of the columns, ignoring case; % and _ stay wildcards."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.col(name).ilike(pattern)
    found = df.filter(hit)
    return found if station is None else found.filter(F.col("station") == station)


def eligible(df: DataFrame, max_seconds: float | Column, strict: bool = False) -> DataFrame:
    """Items of at least one second that fit: up to the limit, or strictly below it."""
    limit = max_seconds if isinstance(max_seconds, Column) else F.lit(max_seconds)
    fits = F.col("duration") < limit if strict else F.col("duration") <= limit
    return df.filter((F.col("duration") >= 1) & fits)


def scope(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the active set."""
    return df.join(ids.select(key), key, "left_semi")


def channels(stations: DataFrame, with_hidden: bool = True, scheduled_only: bool = False) -> DataFrame:
    """Channel list for a guide, with defaults for missing settings."""
    listed = stations.select(
        "network_name",
        F.coalesce("network_long_name", F.lit("")).alias("network_long_name"),
        "channel_number",
        F.coalesce("hidden", F.lit(False)).alias("hidden"),
        F.coalesce("has_schedule", F.lit(False)).alias("has_schedule"),
    )
    if not with_hidden:
        listed = listed.filter(~F.col("hidden"))
    return listed.filter("has_schedule") if scheduled_only else listed


def bad_durations(df: DataFrame, ignore_tags: Sequence[str] = ("sign_off", "off_air")) -> DataFrame:
    """Items under a second, marked when the duration is not even positive."""
    return df.filter((F.col("duration") < 1) & ~F.col("tag").isin(*ignore_tags)).withColumn(
        "non_positive", F.col("duration") <= 0)


def stale_rows(meta: DataFrame, manifest: DataFrame, cutoff) -> DataFrame:
    """Cached rows not updated since the cutoff whose file is gone."""
    return meta.filter(F.col("last_updated") < _ntz(cutoff)).join(manifest.select("path"), "path", "left_anti")


# ---- metadata-hint pools -------------------------------------------------------------------

_RULE_TESTS = ("month", "quarter", "date_range", "week_number", "day_of_week", "day_part", "custom_holiday")


def _parsed_rules(rules: DataFrame, parts: Mapping[str, Sequence[int]]) -> DataFrame:
    """Rules with their texts parsed once, before they meet any candidate."""
    return rules.select(
        F.array_join(paths.parts("under"), "/").alias("_dir"), "rule_order", *_RULE_TESTS,
        F.coalesce("exclusive", F.lit(False)).alias("_exclusive"),
        cal.month_number("month").alias("_month"), cal.quarter_of(F.col("quarter")).alias("_quarter"),
        cal.range_bounds(F.col("date_range")).alias("_range"), cal.week_of(F.col("week_number")).alias("_week"),
        cal.weekday_number("day_of_week").alias("_weekday"), cal.hours_of(F.col("day_part"), parts).alias("_hours"))


def _rule_passes(rule: Column, when: Column, holidays: Mapping[str, str] | None) -> Column:
    """Whether every field set in a parsed rule holds at a time."""
    tests = {
        "month": F.month(when) == rule["_month"],
        "quarter": F.quarter(when) == rule["_quarter"],
        "date_range": cal.in_range_bounds(when, rule["_range"]),
        "week_number": F.weekofyear(when) == rule["_week"],
        "day_of_week": F.weekday(when) == rule["_weekday"],
        "day_part": F.array_contains(rule["_hours"], F.hour(when)),
        "custom_holiday": cal.on_holiday(when, rule["custom_holiday"], holidays or {}),
    }
    passed = F.lit(True)
    for name in _RULE_TESTS:
        passed = passed & (rule[name].isNull() | F.coalesce(tests[name], F.lit(False)))
    return passed


def rules_of_paths(items: DataFrame, rules: DataFrame, parts: Mapping[str, Sequence[int]] = cal.DAY_PARTS) -> DataFrame:
    """(path, _rules): the parsed rules of each path that has any, in their order.

    A rule applies to every path below its directory (`under`). A path has as many rules as its directories have.
    """
    item = paths.parts("path")
    above = F.transform(F.sequence(F.lit(1), F.size(item)), lambda n: F.array_join(F.slice(item, F.lit(1), n), "/"))
    parsed = _parsed_rules(rules, parts)
    rule = F.struct("rule_order", *[c for c in parsed.columns if c not in ("_dir", "rule_order")])
    return items.select("path").distinct().select("path", F.explode(above).alias("_dir")).join(parsed, "_dir").groupBy("path").agg(
        F.collect_list(rule).alias("_rules"))


def apply_meta_hints(
    candidates: DataFrame,
    rules: DataFrame,
    per: Sequence[str] = ("request_id",),
    when: str = "when",
    compat: bool = False,
    holidays: Mapping[str, str] | None = None,
    parts: Mapping[str, Sequence[int]] = cal.DAY_PARTS,
    items: DataFrame | None = None,
    on: Sequence[str] | None = None,
) -> DataFrame:
    """The candidate pool of each request under metadata-hint rules.

    Without a passing exclusive item, the pool is the items without rules plus those whose rules all pass; with one, it is only
    the passing exclusive items. compat=True also counts an item as exclusive when an exclusive rule passed before a later
    rule of the same item failed. items is a table with every candidate's path, such as the catalog, if it is smaller than the
    candidates. Rules are found once per path; each candidate is judged in its own row, and one window per request
    tells whether an exclusive item passed.

    With `on`, candidates are requests, and each may air the items that equal it in these columns. A request is then judged once
    for every distinct list of rules among its items, and meets the items themselves last: no pair is shuffled.
    """
    ruled = rules_of_paths(candidates if items is None else items, rules, parts)
    if on is not None:
        return _judged_requests(candidates, items.join(ruled, "path", "left"), list(on), per, when, compat, holidays)
    met = candidates.join(ruled, "path", "left")
    judged = met.withColumn("_verdict", _verdict(F.col("_rules"), F.col(when), compat, holidays))
    pooled = judged.withColumn("_only_exclusive", F.bool_or("_verdict.captured").over(Window.partitionBy(*per)))
    return pooled.filter(F.when(F.col("_only_exclusive"), F.col("_verdict.captured")).otherwise(F.col("_verdict.all_pass"))).select(
        *candidates.columns)


def _verdict(rules: Column, when: Column, compat: bool, holidays: Mapping[str, str] | None) -> Column:
    """(all_pass, captured): whether no rule of a list fails at a time, and whether the list makes its items exclusive."""
    judged = F.transform(rules, lambda r: F.struct(
        r["rule_order"].alias("at"), _rule_passes(r, when, holidays).alias("passes"), r["_exclusive"].alias("exclusive")))

    def ruling(j: Column) -> Column:
        failed_at = F.array_min(F.transform(F.filter(j, lambda r: ~r["passes"]), lambda r: r["at"]))
        exclusive_at = F.array_min(F.transform(F.filter(j, lambda r: r["passes"] & r["exclusive"]), lambda r: r["at"]))
        all_pass = failed_at.isNull()
        captured = exclusive_at.isNotNull() & ((all_pass | (exclusive_at < failed_at)) if compat else all_pass)
        return F.struct(all_pass.alias("all_pass"), captured.alias("captured"))

    return let(judged, ruling)


def _judged_requests(requests: DataFrame, ruled: DataFrame, on: list[str], per: Sequence[str], when: str, compat: bool,
                     holidays: Mapping[str, str] | None) -> DataFrame:
    """Requests with the items they may air, judged by the distinct lists of rules that the items they could meet have."""
    listed = ruled.withColumn("_rules", F.array_sort(F.coalesce("_rules", F.array())))
    lists = listed.groupBy(*on).agg(F.array_sort(F.collect_set("_rules")).alias("_lists"))
    numbered = listed.join(lists, on).withColumn("_list", F.array_position("_lists", F.col("_rules"))).drop("_lists", "_rules")
    asked = requests.join(lists, on).withColumn("_verdicts", F.transform("_lists", lambda r: _verdict(r, F.col(when), compat, holidays)))
    pooled = asked.drop("_lists").withColumn("_only_exclusive", F.bool_or(
        F.exists("_verdicts", lambda v: v["captured"])).over(Window.partitionBy(*per)))
    aired = pooled.withColumn("_airs", F.when(F.col("_only_exclusive"), F.transform("_verdicts", lambda v: v["captured"])).otherwise(
        F.transform("_verdicts", lambda v: v["all_pass"]))).drop("_verdicts", "_only_exclusive")
    met = aired.filter(F.exists("_airs", lambda a: a)).join(numbered, on)
    return met.filter(F.element_at("_airs", F.col("_list").cast("int"))).drop("_airs", "_list")


# ---- ranking and samples -------------------------------------------------------------------


def ordered(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(*ORDERS[order])


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], counted: str | None = None) -> DataFrame:
    """The first row of each key, and how many it has if a column is named for that.

    Combined before the shuffle, so a large key costs nothing extra.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    sizes = [F.count(F.lit(1)).alias(counted)] if counted else []
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"), *sizes)
    return best.select(*keys, "_row.*", *([counted] if counted else []))


def pick_least_played(candidates: DataFrame, per: Sequence[str], seed: int | None = None, counted: str | None = None) -> DataFrame:
    """One item per request: fewest plays, ties by title, path and id, or by a seeded hash.

    counted names a column that tells how many items the request could choose from.
    """
    if seed is None:
        return first_per(candidates, per, ORDERS["least_played"], counted)
    shuffled = candidates.withColumn("_tie", seeded_number(seed, *per, "id"))
    return first_per(shuffled, per, ["count", "_tie", "id"], counted).drop("_tie")


def order_ci(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(F.lower(name), name)


def best_match(scored: DataFrame, per: Sequence[str], score: str = "score", number: str = "number") -> DataFrame:
    """Highest score per key; the lowest number wins a tie."""
    return first_per(scored.withColumn("_rank", -F.col(score)), per, ["_rank", number]).drop("_rank")


def sample_bounded(df: DataFrame, per: Sequence[str], order: Sequence[str], text: str, n: int = 50,
                   max_bytes: int = 512) -> DataFrame:
    """The first n rows of each key with a text preview of bounded bytes, and what was cut."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    kept = df.withColumn("rank", rank).filter(F.col("rank") <= n)
    raw = F.encode(text, "utf-8")
    preview = F.make_valid_utf8(F.substring(raw, 1, max_bytes).cast("string"))
    sizes = df.groupBy(*per).agg((F.count(F.lit(1)) > n).alias("samples_truncated"))
    return kept.join(sizes, list(per)).select(
        *per, "rank", preview.alias("preview"), (F.octet_length(text) > max_bytes).alias("value_truncated"),
        "samples_truncated")


# ---- aggregates ----------------------------------------------------------------------------


def catalog_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("station").agg(
        F.count(F.lit(1)).alias("entry_count"), F.sum("duration").alias("total_duration"))


def extents(blocks: DataFrame) -> DataFrame:
    """First start and the end of the last-starting block, per station."""
    return blocks.groupBy("station").agg(
        F.min("start_time").alias("first_start"),
        F.max_by("end_time", F.struct("start_time", "end_time", "id")).alias("last_end"),
    )


def horizon(blocks: DataFrame) -> DataFrame:
    """Latest end of any block and the block count, per station."""
    return blocks.groupBy("station").agg(
        F.max("end_time").alias("final_scheduled"), F.count(F.lit(1)).alias("block_count"))


def library_totals(catalog: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row with the catalog and schedule sizes."""
    tallied = catalog.select(F.lit(1).alias("item"), F.lit(0).alias("block")).unionAll(
        blocks.select(F.lit(0), F.lit(1)))
    return tallied.agg(
        F.coalesce(F.sum("item"), F.lit(0)).alias("catalog_entry_count"),
        F.coalesce(F.sum("block"), F.lit(0)).alias("schedule_block_count"))


def station_status(blocks: DataFrame, stations: DataFrame, now) -> DataFrame:
    """Current item and final scheduled time of each station."""
    probes = stations.select("station", _ntz(now).alias("at"))
    on_air = (F.col("start_time") <= _ntz(now)) & (F.col("end_time") > _ntz(now))
    current = now_playing(blocks.filter(on_air), probes)
    return current.join(horizon(blocks).select("station", "final_scheduled"), "station", "left").select(
        "station", "title", "start_us", "end_us", "final_scheduled")


def tag_counts(catalog: DataFrame, under: str | None = None) -> DataFrame:
    """Entries per tag, optionally only tags at or below one."""
    if under is not None:
        catalog = catalog.filter((F.col("tag") == under) | F.startswith(F.col("tag"), F.lit(under + "/")))
    return catalog.groupBy("tag").agg(F.count(F.lit(1)).alias("entries"))


def show_rollup(manifest: DataFrame) -> DataFrame:
    """Files and bytes per show, the first path component."""
    return manifest.groupBy(paths.show_of("path").alias("show")).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))


def series_counts(blocks: DataFrame, catalog: DataFrame, content: str = "content_id") -> DataFrame:
    """Blocks per series: the item's tag, else the title up to ' - '."""
    tags = catalog.select(F.col("id").alias("_item"), "tag")
    series = F.coalesce(F.nullif("tag", F.lit("")), F.split_part("title", F.lit(" - "), F.lit(1)))
    return (
        blocks.drop("tag").join(tags, F.col(content) == F.col("_item"), "left")
        .groupBy("station", series.alias("series")).agg(F.count(F.lit(1)).alias("blocks"))
    )


def apply_plays(catalog: DataFrame, plays: DataFrame) -> DataFrame:
    """Add the number of plays of each (station, path) to every catalog row with that path."""
    counted = plays.groupBy("station", "path").agg(F.count(F.lit(1)).alias("_plays"))
    return catalog.join(counted, ["station", "path"], "left").withColumn(
        "count", F.col("count") + F.coalesce("_plays", F.lit(0))).drop("_plays")


def tag_owners(slots: DataFrame) -> DataFrame:
    """Distinct (tag, station) pairs named by a long-form slot table, tags in lower case."""
    named = slots.select("station", F.explode("tags").alias("tag"))
    return named.select(F.lower("tag").alias("tag"), "station").distinct()


def ownership_violations(owners: DataFrame) -> DataFrame:
    """Tags owned by more than one station."""
    return owners.groupBy("tag").agg(F.count_distinct("station").alias("owners")).filter("owners > 1")


def distinct_paths(catalog: DataFrame, stations: DataFrame) -> DataFrame:
    """Real media paths used by the active stations."""
    return catalog.join(stations.select("station"), "station", "left_semi").select(
        F.coalesce("realpath", "path").alias("path")).distinct()


# ---- candidate tables ----------------------------------------------------------------------


def candidates(
    requests: DataFrame,
    catalog: DataFrame,
    rules: DataFrame | None = None,
    busy: DataFrame | None = None,
    holidays: Mapping[str, str] | None = None,
    parts: Mapping[str, Sequence[int]] = cal.DAY_PARTS,
) -> DataFrame:
    """Every item each request could air: right tag, shorter than the slot, hints passing, not busy elsewhere.

    Requests have request_id, station, tag, when and seconds. All requests see the same counts. A request is judged once for every
    distinct list of hints and rules among the items of its station and tag, and looks once for each of their real paths how long
    it is free; it meets the items themselves last, so no pair is shuffled.
    """
    on = ["station", "tag"]
    wanted = requests.select(*on, "request_id", "when", "seconds")
    items = catalog.filter("duration >= 1")
    columns = [*wanted.columns, *[c for c in catalog.columns if c not in on]]
    hinted = "hints" in catalog.columns
    if hinted or rules is not None:
        wanted, items = _judged_by_traits(wanted, items, catalog, rules, on, hinted, holidays, parts)
    fits = F.col("duration") < F.col("seconds")
    if "_airs" in wanted.columns:
        fits = fits & F.element_at("_airs", F.col("_trait"))
    if busy is None:
        return wanted.join(items, on).filter(fits).select(*columns)
    shortest = items.filter("realpath IS NOT NULL").groupBy(*on, "realpath").agg(F.min("duration").alias("_shortest"))
    paired = wanted.join(shortest, on).filter(F.col("_shortest") < F.col("seconds")).drop("_shortest")
    room = room_until_busy(paired, busy, ["realpath"], "when")
    end = F.col("when") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("duration").cast("decimal(18,6)"))
    free = F.coalesce(micros(end) <= F.col("_busy_from"), F.lit(True))
    held = room.join(items, [*on, "realpath"]).filter(fits & free)
    loose = wanted.join(items.filter("realpath IS NULL"), on).filter(fits)
    return held.select(*columns).unionAll(loose.select(*columns))


def _judged_by_traits(wanted: DataFrame, items: DataFrame, catalog: DataFrame, rules: DataFrame | None, on: list[str], hinted: bool,
                      holidays: Mapping[str, str] | None, parts: Mapping[str, Sequence[int]]) -> tuple[DataFrame, DataFrame]:
    """Requests with _airs, whether the items of each trait air, and items with the number of their _trait.

    A trait is a list of hints and a list of rules; those of one station and tag are numbered. A passing exclusive item is asked for
    only among those whose hints pass and that are shorter than the slot: one is if the shortest of its trait is.
    """
    when = F.col("when")
    hints = F.col("hints") if hinted else F.lit(None).cast("string")
    ruled, found = items, F.lit(None).cast("string")
    if rules is not None:
        ruled, found = items.join(rules_of_paths(catalog, rules, parts), "path", "left"), F.array_sort(F.coalesce("_rules", F.array()))
    marked = ruled.withColumn("_trait", F.struct(hints.alias("hints"), found.alias("rules")))
    shortest = marked.groupBy(*on, "_trait").agg(F.min("duration").alias("_shortest"))
    traits = shortest.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("_trait", "_shortest"))).alias("_traits"))

    def judged(trait: Column) -> Column:
        passes = hint_matches(trait["hints"], when, holidays, parts) if hinted else F.lit(True)
        rows = F.struct(F.lit(True).alias("all_pass"), F.lit(False).alias("captured")) if rules is None else _verdict(
            trait["rules"], when, False, holidays)
        return let(rows, lambda v: F.struct(
            (F.coalesce(passes, F.lit(False)) & v["all_pass"]).alias("all_pass"), (F.coalesce(passes, F.lit(False)) & v["captured"]).alias("captured")))

    asked = wanted.join(traits, on).withColumn("_verdicts", F.transform("_traits", lambda t: F.struct(
        judged(t["_trait"]).alias("v"), (t["_shortest"] < F.col("seconds")).alias("fits"))))
    asked = asked.drop("_traits").withColumn("_exclusive", F.exists("_verdicts", lambda t: t["v"]["captured"] & t["fits"]))
    if rules is not None:
        asked = asked.withColumn("_exclusive", F.bool_or("_exclusive").over(Window.partitionBy("request_id")))
    airs = F.when(F.col("_exclusive"), F.transform("_verdicts", lambda t: t["v"]["captured"])).otherwise(
        F.transform("_verdicts", lambda t: t["v"]["all_pass"]))
    aired = asked.withColumn("_airs", airs).drop("_verdicts", "_exclusive").filter(F.exists("_airs", lambda a: a))
    listed = traits.select(*on, F.transform("_traits", lambda t: t["_trait"]).alias("_traits"))
    numbered = marked.join(listed, on).withColumn("_trait", F.array_position("_traits", F.col("_trait")).cast("int")).drop("_traits", "_rules")
    return aired, numbered


def next_pool(requests: DataFrame, catalog: DataFrame, prefix: str = "next/") -> DataFrame:
    """Coming-up-next items: those in folders named after what follows a block.

    A folder is '--B', '--B--C' or '--B--C--D' for the next tags, optionally after the current tag.
    Requests carry request_id, block_tag, next_1, next_2, next_3, seconds.

    The result is pairs, of which a few tags hold most. So items are packed into tiles, by duration, and the requests of a tag are dealt
    to several tasks, which get its tiles each; pairs are made last, tile by tile.
    """
    heads = F.array(F.lit(""), F.col("block_tag"))
    tails = F.array(*[
        F.when(F.col(f"next_{n}").isNotNull(), F.concat_ws("--", *[F.col(f"next_{i}") for i in range(1, n + 1)]))
        for n in (1, 2, 3)
    ])
    # a longer look-ahead counts only when every step before it is known
    known = F.when(F.col("next_1").isNull(), 0).when(F.col("next_2").isNull(), 1).when(F.col("next_3").isNull(), 2).otherwise(3)
    tails = F.slice(tails, F.lit(1), known)
    keys = F.flatten(F.transform(
        F.filter(heads, lambda h: h.isNotNull()),
        lambda h: F.transform(tails, lambda t: F.concat(F.lit(prefix), h, F.lit("--"), t))))
    wanted = requests.select("request_id", "station", "seconds", F.explode(F.array_distinct(keys)).alias("tag"))
    on, listed = ["station", "tag"], [c for c in catalog.columns if c not in ("station", "tag")]
    tiles = in_tiles(catalog.filter("duration >= 1"), on, sliced(*catalog.columns), "duration").filter("station IS NOT NULL AND tag IS NOT NULL")
    key = F.struct(*on, "_slice").alias("_key")
    dealt = wanted.withColumn("_slice", sliced("request_id", "seconds")).select(key, "request_id", "seconds")
    copies = tiles.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).select(key, *on, "_rows", "_least")
    met = spread(copies, "_key").hint("merge").join(spread(dealt, "_key"), "_key").filter(F.col("_least") < F.col("seconds"))
    pairs = met.select(*on, "request_id", "seconds", F.explode("_rows").alias("_item"))
    return pairs.filter(F.col("_item.duration") < F.col("seconds")).select(
        *on, "request_id", "seconds", *[F.col(f"_item.{c}").alias(c) for c in listed])
