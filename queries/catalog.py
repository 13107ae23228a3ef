"""Catalog, ranking and aggregate queries over parts shaped as items and events as schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from airlog.functions import paths
from airlog.functions.hints import decode_hints
from airlog.operators import catalog as ct, trigrams
from airlog.operators.intervals import lookahead
from queries.registry import query
from queries.scratch import scratch

NOON = "2024-01-15 12:00:00"


@query("point_filter", "SELECT * FROM catalog WHERE station = 'Brand#7' AND tag = 'PROMO'")
def _(t):
    return ct.where(t.catalog, station="Brand#7", tag="PROMO")


@query("search_all_columns", """
    SELECT id, title FROM items WHERE title ILIKE '%RING%' OR tag ILIKE '%RING%' OR path ILIKE '%RING%'""")
def _(t):
    return ct.search(t.parts_as_items, "RING").select("id", "title")


@query("search_titles_on_station", """
    SELECT id, title FROM items WHERE station = 'Brand#3' AND title ILIKE '%b_lt%'""")
def _(t):
    return ct.search(t.parts_as_items, "b_lt", ["title"], "Brand#3").select("id", "title")


_SEARCHES = ("RING", "b_lt", "st%ee", "no such thing", "_", "#3/", "blue s1")


@query("search_stored", " UNION ALL ".join(
    f"SELECT {k} AS search, id, title FROM items WHERE title ILIKE '%{text}%' OR tag ILIKE '%{text}%' OR path ILIKE '%{text}%'"
    for k, text in enumerate(_SEARCHES)))
def _(t):
    """Several searches in a catalog that is stored with its trigrams; one has wildcards, one no trigram, one nothing to find."""
    folder = scratch(t) + "/catalog"
    trigrams.store_catalog(t.parts_as_items, folder, span=500, folders=16)
    found = [trigrams.search_stored(t.spark, folder, text, folders=16).select(F.lit(k).alias("search"), "id", "title")
             for k, text in enumerate(_SEARCHES)]
    return reduce(DataFrame.unionByName, found)


@query("eligible_inclusive", "SELECT id, duration FROM items WHERE duration BETWEEN 1 AND 1320")
def _(t):
    return ct.eligible(t.parts_as_items, 1320.0).select("id", "duration")


@query("eligible_strict", "SELECT id, duration FROM items WHERE duration >= 1 AND duration < 1320")
def _(t):
    return ct.eligible(t.parts_as_items, 1320.0, strict=True).select("id", "duration")


@query("scope_to_active", """
    SELECT * FROM items WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    active = t.read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return ct.scope(t.parts_as_items, active)


@query("guide_channels", """
    SELECT s_name AS network_name, '' AS network_long_name, s_suppkey AS channel_number,
           s_acctbal < 0 AS hidden, s_nationkey % 2 = 0 AS has_schedule
    FROM supplier WHERE NOT s_acctbal < 0""")
def _(t):
    stations = t.read("supplier").select(
        F.col("s_name").alias("network_name"), F.lit(None).cast("string").alias("network_long_name"),
        F.col("s_suppkey").alias("channel_number"), (F.col("s_acctbal") < 0).alias("hidden"),
        (F.col("s_nationkey") % 2 == 0).alias("has_schedule"))
    return ct.channels(stations, with_hidden=False)


@query("bad_durations", """
    SELECT id, CAST(p_size - 5 AS DOUBLE) AS duration, p_size - 5 <= 0 AS non_positive
    FROM items JOIN part ON p_partkey = id WHERE p_size - 5 < 1""")
def _(t):
    odd = t.parts_as_items.withColumn("duration", F.col("duration") / 60 - 5)
    return ct.bad_durations(odd).select("id", "duration", "non_positive")


@query("stale_rows", """
    SELECT m.path FROM (SELECT path, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(mtime_ns * 1000000) AS last_updated
                        FROM manifest_before) m
    WHERE last_updated < TIMESTAMP '2024-01-08 00:00:00' AND path NOT IN (SELECT path FROM manifest_after)""")
def _(t):
    meta = t.manifest_before.withColumn("last_updated", F.expr(
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(mtime_ns as decimal(18,6)))"))
    return ct.stale_rows(meta, t.manifest_after, "2024-01-08 00:00:00").select("path")


@query("catalog_summary", """
    SELECT station, CAST(count(*) AS BIGINT) AS entry_count, sum(duration) AS total_duration FROM items GROUP BY 1""")
def _(t):
    return ct.catalog_summary(t.parts_as_items)


@query("schedule_extents", """
    SELECT station, min(start_time) AS first_start, arg_max(end_time, (start_time, end_time, id)) AS last_end
    FROM blocks_by_user GROUP BY 1""")
def _(t):
    return ct.extents(t.blocks_by_user)


@query("schedule_horizon", """
    SELECT station, max(end_time) AS final_scheduled, CAST(count(*) AS BIGINT) AS block_count FROM blocks_by_user GROUP BY 1""")
def _(t):
    return ct.horizon(t.blocks_by_user)


@query("library_totals", """
    SELECT CAST((SELECT count(*) FROM items) AS BIGINT) AS catalog_entry_count,
           CAST((SELECT count(*) FROM blocks) AS BIGINT) AS schedule_block_count""")
def _(t):
    return ct.library_totals(t.parts_as_items, t.blocks)


@query("station_status", f"""
    WITH cur AS (
      SELECT station, arg_min(title, (start_time, end_time, id)) AS title,
             epoch_us(min(start_time)) AS start_us, epoch_us(arg_min(end_time, (start_time, end_time, id))) AS end_us
      FROM blocks_by_user WHERE start_time <= TIMESTAMP '{NOON}' AND end_time > TIMESTAMP '{NOON}' GROUP BY 1)
    SELECT s.station, c.title, c.start_us, c.end_us, f.final_scheduled
    FROM (SELECT CAST(c_custkey AS VARCHAR) AS station FROM customer) s
    LEFT JOIN cur c ON c.station = s.station
    LEFT JOIN (SELECT station, max(end_time) AS final_scheduled FROM blocks_by_user GROUP BY 1) f ON f.station = s.station""")
def _(t):
    stations = t.read("customer").select(F.col("c_custkey").cast("string").alias("station"))
    return ct.station_status(t.blocks_by_user, stations, NOON)


@query("tag_counts", "SELECT tag, CAST(count(*) AS BIGINT) AS entries FROM items GROUP BY 1")
def _(t):
    return ct.tag_counts(t.parts_as_items)


@query("show_rollup", """
    SELECT source AS show, CAST(count(*) AS BIGINT) AS file_count, CAST(sum(n_chars) AS BIGINT) AS total_bytes
    FROM documents GROUP BY 1""")
def _(t):
    return ct.show_rollup(t.manifest)


@query("series_counts", """
    SELECT b.station, coalesce(nullif(i.tag, ''), split_part(b.title, ' - ', 1)) AS series, CAST(count(*) AS BIGINT) AS blocks
    FROM (SELECT station, station || ' - part ' || (id % 3) AS title, id AS content_id FROM blocks) b
    LEFT JOIN items i ON i.id = b.content_id GROUP BY 1, 2""")
def _(t):
    titled = t.blocks.withColumns({
        "title": F.concat("station", F.lit(" - part "), (F.col("id") % 3).cast("string")), "content_id": F.col("id")})
    return ct.series_counts(titled, t.parts_as_items)


@query("apply_plays", """
    SELECT i.id, 5 + coalesce(p.n, 0) AS count
    FROM items i LEFT JOIN (SELECT station, path, count(*) AS n FROM plays GROUP BY 1, 2) p
      ON p.station = i.station AND p.path = i.path""")
def _(t):
    return ct.apply_plays(t.parts_as_items.withColumn("count", F.lit(5)), t.plays).select("id", "count")


def _slots(t):
    return t.read("orders").select(
        F.concat(F.lit("st"), F.col("o_custkey") % 40).alias("station"),
        F.array(F.concat(F.lit("Tag"), F.col("o_orderkey") % 977), F.concat(F.lit("TAG"), F.col("o_orderkey") % 1499)).alias("tags"))


_OWNERS = """
    owners AS (
      SELECT DISTINCT 'tag' || (o_orderkey % 977) AS tag, 'st' || (o_custkey % 40) AS station FROM orders
      UNION SELECT DISTINCT 'tag' || (o_orderkey % 1499), 'st' || (o_custkey % 40) FROM orders)"""


@query("tag_owners", f"WITH {_OWNERS} SELECT tag, station FROM owners")
def _(t):
    return ct.tag_owners(_slots(t))


@query("ownership_violations", f"""WITH {_OWNERS}
    SELECT tag, CAST(count(DISTINCT station) AS BIGINT) AS owners FROM owners GROUP BY 1 HAVING count(DISTINCT station) > 1""")
def _(t):
    return ct.ownership_violations(ct.tag_owners(_slots(t)))


@query("distinct_paths", """
    SELECT DISTINCT CASE WHEN id % 3 = 0 THEN path ELSE '/real/' || title END AS path
    FROM items WHERE station IN (SELECT 'Brand#' || n_nationkey FROM nation WHERE n_regionkey = 1)""")
def _(t):
    items = t.parts_as_items.withColumn("realpath", F.when(F.col("id") % 3 != 0, F.concat(F.lit("/real/"), "title")))
    active = t.read("nation").filter("n_regionkey = 1").select(F.concat(F.lit("Brand#"), "n_nationkey").alias("station"))
    return ct.distinct_paths(items, active)


@query("least_played", """
    SELECT station, tag, arg_min(id, (count, title, path, id)) AS id FROM catalog GROUP BY 1, 2""")
def _(t):
    return ct.pick_least_played(t.catalog, ["station", "tag"]).select("station", "tag", "id")


@query("least_played_seeded", """
    SELECT station, tag, arg_min(id, (count, md5('42:' || station || ':' || tag || ':' || id)[:15], id)) AS id, min(count) AS count
    FROM catalog GROUP BY 1, 2""")
def _(t):
    return ct.pick_least_played(t.catalog, ["station", "tag"], seed=42).select("station", "tag", "id", "count")


@query("ordered_catalog", "SELECT tag, title, path, id FROM items")
def _(t):
    return ct.ordered(t.parts_as_items.select("tag", "title", "path", "id"), "catalog")


@query("ordered_schedule", "SELECT station, start_time, end_time, id FROM blocks")
def _(t):
    return ct.ordered(t.blocks.select("station", "start_time", "end_time", "id"), "schedule")


@query("first_per_station", "SELECT station, min(start_time) AS start_time, arg_min(id, (start_time, end_time, id)) AS id FROM blocks_by_user GROUP BY 1")
def _(t):
    return ct.first_per(t.blocks_by_user, ["station"], ["start_time", "end_time", "id"]).select("station", "start_time", "id")


@query("order_case_insensitive", "SELECT DISTINCT source AS show FROM documents")
def _(t):
    return ct.order_ci(t.read("documents").select(F.col("source").alias("show")).distinct(), "show")


@query("sample_bounded", """
    WITH ranked AS (
      SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank,
             count(*) OVER (PARTITION BY source) > 5 AS samples_truncated,
             list_filter(generate_series(least(length(text), 512), 0, -1), lambda k: strlen(text[:k]) <= 512)[1] AS chars,
      FROM documents)
    SELECT source, CAST(rank AS INTEGER) AS rank, strlen(text) > 512 AS value_truncated, samples_truncated,
           text[:chars] AS whole_chars, strlen(text) > 512 AND strlen(text[:chars]) < 512 AS cut_char
    FROM ranked WHERE rank <= 5""")
def _(t):
    """A preview whose last character was cut ends in the replacement character; the rest are whole characters."""
    found = ct.sample_bounded(t.read("documents"), ["source"], ["doc_id"], "text", n=5, max_bytes=512)
    return found.select("source", "rank", "value_truncated", "samples_truncated",
                        F.regexp_replace("preview", "\ufffd+$", "").alias("whole_chars"), F.endswith("preview", F.lit("\ufffd")).alias("cut_char"))


@query("best_match", """
    SELECT lang, arg_max(doc_id, (n_chars, -doc_id)) AS number, max(n_chars) AS score FROM documents GROUP BY 1""")
def _(t):
    scored = t.read("documents").select("lang", F.col("n_chars").alias("score"), F.col("doc_id").alias("number"))
    return ct.best_match(scored, ["lang"])


def _rules(t):
    """One metadata-hint rule per (brand, type) folder, and wider ones per brand."""
    folders = t.read("part").select("p_brand", "p_type").distinct()
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    null = F.lit(None).cast("string")
    narrow = folders.select(
        F.concat_ws("/", "p_brand", "p_type").alias("under"), F.lit(2).alias("rule_order"),
        F.when(n % 4 == 0, F.lit("January")).alias("month"), null.alias("quarter"),
        F.when(n % 4 == 1, F.lit("January 5 - January 20")).alias("date_range"), null.alias("week_number"),
        F.when(n % 4 == 2, F.lit("friday")).alias("day_of_week"), F.when(n % 4 == 3, F.lit("late")).alias("day_part"),
        null.alias("custom_holiday"), (F.col("p_type") == "PROMO").alias("exclusive")).filter("under NOT LIKE '%/SMALL'")
    wide = folders.select("p_brand").distinct().filter("p_brand LIKE '%5'").select(
        F.col("p_brand").alias("under"), F.lit(1).alias("rule_order"), null.alias("month"), F.lit("Q1").alias("quarter"),
        null.alias("date_range"), null.alias("week_number"), null.alias("day_of_week"), null.alias("day_part"),
        null.alias("custom_holiday"), F.lit(False).alias("exclusive"))
    return narrow.unionByName(wide)


def _requests(t):
    """One request per event, for the items of a brand with a given running time."""
    return t.read("events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("Brand#"), F.col("event_id") % 25 + 1).alias("station"),
        ((F.col("event_id") % 50 + 1) * 60).cast("double").alias("duration"), F.col("ts").alias("when"))


_JUDGED = """
    pool AS (
      SELECT e.event_id AS request_id, e.ts AS "when", i.id, i.tag,
             CAST(regexp_extract(i.station, '(\\d+)', 1) AS INTEGER) AS n
      FROM events e JOIN items i ON i.station = 'Brand#' || (e.event_id % 25 + 1)
           AND i.duration = (e.event_id % 50 + 1) * 60),
    judged AS (
      SELECT *, tag <> 'SMALL' OR n % 10 = 5 AS has_meta,
        (tag = 'SMALL' OR CASE n % 4
          WHEN 0 THEN month("when") = 1
          WHEN 1 THEN CAST("when" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-19'
                      OR "when" = TIMESTAMP '2024-01-20 00:00:00'
          WHEN 2 THEN isodow("when") = 5
          ELSE hour("when") IN (23, 0, 1, 2) END)
        AND (n % 10 <> 5 OR quarter("when") = 1) AS passes
      FROM pool),
    kept AS (
      SELECT *, max(CASE WHEN passes AND tag = 'PROMO' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS only_exclusive
      FROM judged)"""


@query("meta_hint_pool", f"""WITH {_JUDGED}
    SELECT request_id, id FROM kept
    WHERE CASE WHEN only_exclusive = 1 THEN passes AND tag = 'PROMO' ELSE passes OR NOT has_meta END""")
def _(t):
    items = t.parts_as_items.select("id", "station", "path", "duration")
    return ct.apply_meta_hints(_requests(t), _rules(t), items=items, on=["station", "duration"]).select("request_id", "id")


@query("meta_hint_pool_compat", f"""WITH {_JUDGED},
    firsts AS (
      SELECT *, CASE n % 4 WHEN 0 THEN month("when") = 1
        WHEN 1 THEN CAST("when" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' OR "when" = TIMESTAMP '2024-01-20 00:00:00'
        WHEN 2 THEN isodow("when") = 5 ELSE hour("when") IN (23, 0, 1, 2) END AS narrow FROM pool),
    caught AS (
      SELECT request_id, id, tag = 'PROMO' AND narrow AS captured, (tag = 'SMALL' OR narrow) AND (n % 10 <> 5 OR quarter("when") = 2) AS every_rule
      FROM firsts),
    pooled AS (SELECT *, bool_or(captured) OVER (PARTITION BY request_id) AS only_captured FROM caught)
    SELECT request_id, id FROM pooled WHERE CASE WHEN only_captured THEN captured ELSE every_rule END""")
def _(t):
    """An exclusive rule comes first and the rule of a whole brand last, for a quarter in which nothing is asked."""
    items = t.parts_as_items.select("id", "station", "path", "duration")
    late = _rules(t).withColumn("rule_order", 3 - F.col("rule_order")).withColumn("quarter", F.when(F.col("quarter") == "Q1", F.lit("Q2")))
    return ct.apply_meta_hints(_requests(t), late, compat=True, items=items, on=["station", "duration"]).select("request_id", "id")


@query("candidates", """
    WITH req AS (SELECT event_id AS request_id, 'Brand#' || (event_id % 25 + 1) AS station, ts AS "when",
                        value * 20 AS seconds, ['ECONOMY','PROMO','SMALL','LARGE','MEDIUM','STANDARD'][event_id % 6 + 1] AS tag
                 FROM events),
    fit AS (
      SELECT r.*, i.id, i.title, i.path, i.count, i.duration, i.tag = 'PROMO' AS exclusive, i.tag IN ('PROMO', 'LARGE') AS ruled
      FROM req r JOIN catalog i ON i.station = r.station AND i.tag = r.tag AND i.duration >= 1 AND i.duration < r.seconds
      WHERE i.id % 3 <> 0 OR isodow(r."when") = 5),
    passed AS (
      SELECT *, NOT ruled OR CASE WHEN exclusive THEN hour("when") IN (23, 0, 1, 2) ELSE month("when") = 1 END AS passes FROM fit),
    pooled AS (SELECT *, bool_or(exclusive AND passes) OVER (PARTITION BY request_id) AS only_exclusive FROM passed),
    ok AS (
      SELECT r.request_id, r.id, r.title, r.path, r.count FROM (SELECT * FROM pooled WHERE CASE WHEN only_exclusive THEN exclusive AND passes ELSE passes END) r
      WHERE NOT EXISTS (
        SELECT 1 FROM blocks b WHERE b.station <> 'view' AND 'item' || (b.content_id % 40) = 'item' || (r.id % 40)
          AND b.start_time < r."when" + to_microseconds(CAST(r.duration * 1000000 AS BIGINT)) AND b.end_time > r."when"))
    SELECT request_id, arg_min(id, (count, title, path, id)) AS id, CAST(count(*) AS BIGINT) AS n FROM ok GROUP BY 1""")
def _(t):
    """Eligible items per request whose hints and rules pass, not busy on another station, and the least-played one of them."""
    tags = F.array(*[F.lit(x) for x in ("ECONOMY", "PROMO", "SMALL", "LARGE", "MEDIUM", "STANDARD")])
    requests = t.read("events").select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("Brand#"), F.col("event_id") % 25 + 1).alias("station"),
        F.get(tags, (F.col("event_id") % 6).cast("int")).alias("tag"), F.col("ts").alias("when"),
        (F.col("value") * 20).alias("seconds"))
    items = t.catalog.withColumns({
        "realpath": F.concat(F.lit("item"), F.col("id") % 40), "hints": decode_hints(F.when(
            F.col("id") % 3 == 0, F.lit(r'["{\"type\": \"day_of_week\", \"day\": \"friday\"}"]')))})
    null, part = F.lit(None).cast("string"), F.col("p_type")
    rules = t.read("part").select("p_brand", "p_type").distinct().filter("p_type IN ('PROMO', 'LARGE')").select(
        F.concat_ws("/", "p_brand", "p_type").alias("under"), F.lit(1).alias("rule_order"), F.when(part == "LARGE", F.lit("January")).alias("month"),
        *[null.alias(c) for c in ("quarter", "date_range", "week_number", "day_of_week")], F.when(part == "PROMO", F.lit("late")).alias("day_part"),
        null.alias("custom_holiday"), (part == "PROMO").alias("exclusive"))
    busy = t.blocks.filter("station <> 'view'").withColumn("realpath", F.concat(F.lit("item"), F.col("content_id") % 40))
    pool = ct.candidates(requests, items, rules, busy).select("request_id", "id", "count", "title", "path")
    return ct.pick_least_played(pool, ["request_id"], counted="n").select("request_id", "id", "n")


@query("next_pool", """
    WITH tagged AS (SELECT station, id, start_time, end_time, 'U' || (content_id % 4) AS block_tag FROM blocks),
    ahead AS (SELECT station, id, block_tag, lead(block_tag) OVER w AS n1, lead(block_tag, 2) OVER w AS n2,
                     lead(block_tag, 3) OVER w AS n3
              FROM tagged WINDOW w AS (PARTITION BY station ORDER BY start_time, end_time, id)),
    folders AS (
      SELECT i.id AS item, i.duration,
             'next/' || CASE i.id % 3 WHEN 0 THEN '--U' || (i.id % 4) WHEN 1 THEN 'U' || (i.id % 4) || '--U' || (i.id % 2)
                        ELSE '--U' || (i.id % 4) || '--U' || (i.id % 2) END AS tag
      FROM items i)
    SELECT a.id AS request_id, f.item AS id FROM ahead a JOIN folders f ON f.tag IN (
        'next/--' || n1, 'next/--' || n1 || '--' || n2, 'next/--' || n1 || '--' || n2 || '--' || n3,
        'next/' || block_tag || '--' || n1, 'next/' || block_tag || '--' || n1 || '--' || n2,
        'next/' || block_tag || '--' || n1 || '--' || n2 || '--' || n3)
    WHERE f.duration >= 1 AND f.duration < 120""")
def _(t):
    tagged = t.blocks.withColumn("block_tag", F.concat(F.lit("U"), F.col("content_id") % 4))
    requests = lookahead(tagged).withColumns({
        "request_id": F.col("id"), "seconds": F.lit(120.0), "station": F.lit("any")})
    n, m = F.concat(F.lit("U"), F.col("id") % 4), F.concat(F.lit("U"), F.col("id") % 2)
    folder = (F.when(F.col("id") % 3 == 0, F.concat(F.lit("next/--"), n))
              .when(F.col("id") % 3 == 1, F.concat(F.lit("next/"), n, F.lit("--"), m))
              .otherwise(F.concat(F.lit("next/--"), n, F.lit("--"), m)))
    items = t.parts_as_items.select("id", F.lit("any").alias("station"), folder.alias("tag"), "duration")
    return ct.next_pool(requests, items).select("request_id", "id")


@query("media_type", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 1 OR doc_id % 3 = 2 AND source = 'src1' THEN 'audio' ELSE 'video' END AS media_type
    FROM documents""")
def _(t):
    ext = (F.when(F.col("doc_id") % 3 == 0, F.lit("mkv")).when(F.col("doc_id") % 3 == 1, F.lit("MP3"))
           .when(F.col("source") == "src1", F.lit("opus")).otherwise(F.lit("d/no_extension")))
    return t.read("documents").select("doc_id", paths.media_type(F.concat(F.lit("a.b/c."), ext)).alias("media_type"))
