"""Join, decoding and table-maintenance queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from airlog.operators import joins as jn
from airlog.sources import configs as cf
from airlog.sources import guide, manifests, sidecars, tables
from queries.registry import query
from queries.scratch import scratch


def _raw_blocks(t):
    """Events as schedule rows with JSON text columns."""
    n = F.col("id")
    content = (F.when(n % 4 == 0, F.concat(n % 2500)).when(n % 4 == 1, F.concat(F.lit("["), n % 2500, F.lit(", "), (n * 7) % 2500, F.lit("]")))
               .when(n % 4 == 2, F.lit("null")))
    entry = F.struct(F.concat(F.lit("f"), n).alias("path"), F.lit(0).alias("skip"), (n % 60 + 1).alias("duration"), (n % 2 == 0).alias("is_stream"))
    return t.blocks.select(
        "id", "station", F.lit("LiquidBlock").alias("liquid_type"), "start_time", "end_time", F.lit("standard").alias("break_strategy"), "title",
        F.when(n % 3 == 0, F.to_json(F.struct(F.col("station").alias("station_name"), F.lit("daily").alias("sequence_name"), F.concat(F.lit("shows/"), "content_id").alias("tag_path")))).alias("sequence_key"),
        F.when(n % 5 == 0, F.lit('{"break_strategy": "end"}')).alias("break_info"),
        content.alias("content_json"), F.to_json(F.array_repeat(entry, (n % 3).cast("int"))).alias("plan_json"))


@query("decode_blocks", """
    SELECT id, CASE WHEN id % 3 = 0 THEN 'shows/' || content_id END AS tag_path, id % 4 = 1 AS content_is_list,
           CASE id % 4 WHEN 0 THEN CASE WHEN id % 2500 <> 0 THEN CAST(id % 2500 AS VARCHAR) END WHEN 1 THEN (id % 2500) || ',' || ((id * 7) % 2500) END AS content_ids,
           CAST(id % 3 AS INTEGER) AS entries, CASE WHEN id % 3 > 0 THEN CAST(id % 60 + 1 AS DOUBLE) END AS duration,
           CASE WHEN id % 3 > 0 THEN 'feature/video' END AS kind, CASE WHEN id % 5 = 0 THEN 'end' END AS break_strategy
    FROM blocks""")
def _(t):
    b = tables.decode_blocks(_raw_blocks(t))
    first = F.get("plan", F.lit(0))
    return b.select(
        "id", "sequence_key.tag_path", "content_is_list", F.array_join("content_ids", ",").alias("content_ids"),
        F.size("plan").alias("entries"), first["duration"].alias("duration"),
        F.concat_ws("/", first["content_type"], first["media_type"]).alias("k"),
        F.try_variant_get("break_info", "$.break_strategy", "string").alias("break_strategy"),
    ).withColumn("kind", F.nullif("k", F.lit(""))).drop("k")


@query("decode_catalog", """
    SELECT id, CASE id % 3 WHEN 1 THEN 'month:October' WHEN 2 THEN 'bump:pre' ELSE '' END AS hints FROM items""")
def _(t):
    text = (F.when(F.col("id") % 3 == 1, F.lit(r'["{\"type\": \"month\", \"month\": \"October\"}"]'))
            .when(F.col("id") % 3 == 2, F.lit(r'["{\"type\": \"tide\", \"x\": 1}", "{\"type\": \"bump\", \"where\": \"pre\"}"]')))
    decoded = tables.decode_catalog(t.parts_as_items.withColumn("hints", text))
    shown = F.array_join(F.transform("hints", lambda h: F.concat(h["type"], F.lit(":"), F.coalesce(h["month"], h["where"]))), ",")
    return decoded.select("id", shown.alias("hints"))


@query("attach_content", """
    SELECT b.id, CASE b.id % 4 WHEN 0 THEN coalesce(x.title, '') WHEN 1 THEN
             CASE WHEN x.id IS NOT NULL AND y.id IS NOT NULL THEN x.title || ',' || y.title ELSE coalesce(x.title, y.title, '') END ELSE '' END AS titles
    FROM blocks b LEFT JOIN items x ON x.id = b.id % 2500 AND (b.id % 4 = 1 OR b.id % 2500 <> 0)
    LEFT JOIN items y ON y.id = (b.id * 7) % 2500""")
def _(t):
    found = jn.attach_content(tables.decode_blocks(_raw_blocks(t)), t.parts_as_items)
    return found.select("id", F.array_join(F.transform("content", lambda c: c["title"]), ",").alias("titles"))


@query("attach_content_repeated", """
    SELECT b.id % 50 AS id, b.station, b.start_time, CASE b.id % 4 WHEN 0 THEN coalesce(x.title, '') WHEN 1 THEN
             CASE WHEN x.id IS NOT NULL AND y.id IS NOT NULL THEN x.title || ',' || y.title ELSE coalesce(x.title, y.title, '') END ELSE '' END AS titles
    FROM blocks b LEFT JOIN items x ON x.id = b.id % 2500 AND (b.id % 4 = 1 OR b.id % 2500 <> 0)
    LEFT JOIN items y ON y.id = (b.id * 7) % 2500""")
def _(t):
    repeated = tables.decode_blocks(_raw_blocks(t)).withColumn("id", F.col("id") % 50)
    found = jn.attach_content(repeated, t.parts_as_items)
    return found.select("id", "station", "start_time", F.array_join(F.transform("content", lambda c: c["title"]), ",").alias("titles"))


@query("with_tag", "SELECT b.id, b.station, i.tag FROM blocks b LEFT JOIN items i ON i.id = b.id * 3")
def _(t):
    return jn.with_tag(t.blocks.withColumn("content_id", F.col("id") * 3), t.parts_as_items).select("id", "station", "tag")


def _named(t):
    return t.read("customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("st"), "c_nationkey").alias("station"), F.lit("daily").alias("sequence_name"),
        F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey") % 50, F.lit("/"), "c_custkey").alias("tag_path"))


def _entries(t):
    return t.read("orders").select(
        F.col("o_custkey").alias("named_sequence_id"), F.concat(F.lit("f"), "o_orderkey").alias("fpath"), (F.col("o_orderkey") % 100).alias("sequence_index"))


@query("sequence_position", """
    SELECT 'st' || c_nationkey AS station, 'daily' AS sequence_name, c_mktsegment || '/' || (c_custkey % 50) || '/' || c_custkey AS tag_path,
           'f' || o_orderkey AS fpath, o_orderkey % 100 AS sequence_index
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(t):
    return jn.sequence_position(_entries(t), _named(t))


@query("orphans", """
    SELECT 'f' || o_orderkey AS fpath FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(t):
    parents = _named(t).join(t.read("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id", "left_semi")
    return jn.orphans(_entries(t), parents, {"named_sequence_id": "id"}).select("fpath")


@query("sequence_children", """
    WITH n AS (SELECT 'st' || c_nationkey AS station, c_mktsegment || '/' || (c_custkey % 50) || '/' || c_custkey AS tag_path, c_mktsegment AS seg FROM customer)
    SELECT n.station, p.parent_tag, n.tag_path
    FROM n JOIN (SELECT 'st' || n_nationkey AS station, unnest(['BUILDING', 'HOUSEHOLD', 'MACHINERY/7']) AS parent_tag FROM nation) p
      ON p.station = n.station AND starts_with(n.tag_path, p.parent_tag || '/')""")
def _(t):
    parents = t.read("nation").select(
        F.concat(F.lit("st"), "n_nationkey").alias("station"), F.lit("daily").alias("sequence_name"),
        F.explode(F.array(F.lit("BUILDING"), F.lit("HOUSEHOLD"), F.lit("MACHINERY/7"))).alias("parent_tag"))
    return jn.children(_named(t), parents).select("station", "parent_tag", "tag_path")


@query("attach_metadata", """
    SELECT i.id, CASE WHEN i.id % 4 <> 0 AND m.path IS NOT NULL THEN 'meta of ' || i.title END AS meta
    FROM items i LEFT JOIN (SELECT DISTINCT title AS path FROM items WHERE title LIKE '%i%') m ON m.path = i.title""")
def _(t):
    known = t.parts_as_items.select("title").distinct().filter("title LIKE '%i%'")
    meta = known.select(F.col("title").alias("path"), F.concat(F.lit("meta of "), "title").alias("meta"))
    items = t.parts_as_items.withColumn("path", F.concat("path", F.lit("#"), F.col("id")))
    real = items.filter("id % 4 <> 0").select("path", F.col("title").alias("realpath"))
    return jn.attach_metadata(items, meta, real).select("id", "meta")


def _families(t):
    kind = F.when(F.col("c_acctbal") > 0, F.lit("standard")).otherwise("web")
    stations = t.read("customer").select(
        F.col("c_custkey").alias("station"), F.floor(F.col("c_custkey") / 10).cast("string").alias("content_root"), kind.alias("network_type"))
    slots = t.read("orders").select(F.col("o_custkey").alias("station"), F.array("o_orderpriority").alias("tags"))
    return stations, slots


@query("siblings", """
    WITH st AS (SELECT c_custkey AS station, c_custkey // 10 AS root FROM customer WHERE c_acctbal > 0),
    tg AS (SELECT DISTINCT o_custkey AS station, o_orderpriority AS tag FROM orders)
    SELECT DISTINCT a.station, b.station AS sibling
    FROM st a JOIN tg x ON x.station = a.station JOIN st b ON b.root = a.root AND b.station <> a.station
    JOIN tg y ON y.station = b.station AND y.tag = x.tag""")
def _(t):
    return jn.siblings(*_families(t))


@query("sibling_groups", """
    WITH st AS (SELECT c_custkey AS station, CAST(c_custkey // 10 AS VARCHAR) AS content_root FROM customer WHERE c_acctbal > 0),
    held AS (SELECT DISTINCT content_root, o_orderpriority AS tag, station FROM st JOIN orders ON o_custkey = station)
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY content_root, tag) - 1 AS siblings FROM held) WHERE siblings > 0""")
def _(t):
    return jn.sibling_groups(*_families(t))


@query("resolve_ids", """
    WITH names AS (SELECT DISTINCT p_brand || ' ' || p_name AS nm FROM part
                   UNION SELECT DISTINCT upper(p_brand || ' ' || p_name) FROM part WHERE p_type = 'PROMO'),
    req AS (SELECT p_partkey AS location, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN lower(p_brand || ' ' || p_name) ELSE p_name END AS series FROM part),
    known AS (SELECT lower(nm) AS k, count(*) AS n, min(nm) AS c FROM names GROUP BY 1)
    SELECT location, series, CAST(coalesce(n, 0) AS BIGINT) AS matches, c AS canonical,
           CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN series <> c THEN 'non_canonical' ELSE 'ok' END AS status
    FROM req LEFT JOIN known ON k = lower(series)""")
def _(t):
    full = F.concat_ws(" ", "p_brand", "p_name")
    names = t.read("part").select(full.alias("show")).union(t.read("part").filter("p_type = 'PROMO'").select(F.upper(full)))
    n = F.col("p_partkey") % 3
    asked = t.read("part").select(F.col("p_partkey").alias("location"), F.when(n == 0, full).when(n == 1, F.lower(full)).otherwise(F.col("p_name")).alias("series"))
    return jn.resolve_ids(asked, names)


@query("manifest_stats", """
    SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'real/' || doc_id ELSE path END AS realpath, size, mtime_ns FROM manifest""")
def _(t):
    links = t.manifest.filter("doc_id % 5 = 0").select("path", F.concat(F.lit("real/"), "doc_id").alias("realpath"))
    return manifests.manifest_stats(t.manifest, links)


@query("pair_sidecars", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'movie' END AS type, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title FROM part""")
def _(t):
    files = t.read("part").select("p_partkey", F.concat("p_brand", F.lit("/v1.0/"), "p_partkey", F.lit(".x.mkv")).alias("path"))
    text = F.concat(F.lit("<movie><title>"), "p_name", F.lit("</title></movie>"))
    cars = t.read("part").filter("p_partkey % 3 <> 0").select(F.concat("p_brand", F.lit("/v1.0/"), "p_partkey", F.lit(".x.nfo")).alias("path"), text.alias("text"))
    return sidecars.pair_sidecars(files, cars).select("p_partkey", "meta.type", "meta.title")


def _documents(t):
    """One configuration document per customer."""
    n = F.col("c_custkey")
    name = F.concat(F.lit("st"), n)

    def slot(tag):
        return F.concat(F.lit('{"tags": '), tag, F.lit("}"))

    both = F.concat(F.lit('["a'), n % 7, F.lit('", "b'), n % 5, F.lit('"]'))
    plain = F.concat(F.lit('"Show'), n % 11, F.lit('"'))
    text = F.concat(
        F.lit('{"station_conf": {"network_name": "'), name, F.lit('", "network_type": "standard", "channel_number": '), n,
        F.lit(', "break_strategy": "end", "schedule_increment": 30, "fallback_tag": "spare", "bump_dir": "bumps", "content_dir": "root'), n % 9,
        F.lit('", "day_templates": {"week": {"6": '), slot(plain), F.lit(', "7": {"continued": true, "bump_dir": "late"}}}, '),
        *[F.lit(f'"{d}": "week", ') for d in ("monday", "tuesday", "wednesday", "thursday", "friday")],
        F.lit('"saturday": {"9": '), slot(both), F.lit('}, "sunday": {}, "date_overrides": {"December 25": {"6": '), slot(F.lit('"xmas"')),
        F.lit('}}, "week_overrides": {"July 1 - July 7": {"monday": "week", "friday": {"20": '), slot(F.lit('"summer"')),
        F.lit('}}}, "clip_shows": {"clips": {"start_clip": "intro"}}, "tag_overrides": {"Show1": {"commercial_dir": "ads1"}}}}'))
    return t.read("customer").select(
        F.concat(F.lit("confs/"), n, F.lit(".json")).alias("file"),
        F.when(n % 10 == 0, F.concat(text, F.lit("]"))).when(n % 10 == 1, F.lit('{"station_conf": {}}')).otherwise(text).alias("text"))


@query("parse_configs", """
    SELECT 'confs/' || c_custkey || '.json' AS file, CASE c_custkey % 10 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no_network_name' END AS error,
           CASE WHEN c_custkey % 10 > 1 THEN c_custkey END AS channel_number, CASE WHEN c_custkey % 10 > 1 THEN 30 END AS schedule_increment
    FROM customer""")
def _(t):
    parsed = cf.parse_configs(_documents(t))
    ok = F.col("error").isNull()
    return parsed.select("file", "error", F.when(ok, F.col("channel_number")).alias("channel_number"), F.when(ok, F.col("schedule_increment")).alias("schedule_increment"))


_SLOTS = """
    c AS (SELECT c_custkey AS n, 'st' || c_custkey AS station FROM customer WHERE c_custkey % 10 > 1),
    slots AS (
      SELECT station, 'weekday' AS rule_kind, d AS rule_key, d AS day, 6 AS hour, 'Show' || (n % 11) AS tags, FALSE AS continued FROM c, (SELECT unnest(['monday','tuesday','wednesday','thursday','friday']) AS d)
      UNION ALL SELECT station, 'weekday', d, d, 7, NULL, TRUE FROM c, (SELECT unnest(['monday','tuesday','wednesday','thursday','friday']) AS d)
      UNION ALL SELECT station, 'weekday', 'saturday', 'saturday', 9, 'a' || (n % 7) || '|b' || (n % 5), FALSE FROM c
      UNION ALL SELECT station, 'date', 'December 25', NULL, 6, 'xmas', FALSE FROM c
      UNION ALL SELECT station, 'week', 'July 1 - July 7', 'monday', 6, 'Show' || (n % 11), FALSE FROM c
      UNION ALL SELECT station, 'week', 'July 1 - July 7', 'monday', 7, NULL, TRUE FROM c
      UNION ALL SELECT station, 'week', 'July 1 - July 7', 'friday', 20, 'summer', FALSE FROM c)"""


@query("config_slots", f"WITH {_SLOTS} SELECT station, rule_kind, rule_key, day, hour, tags, continued FROM slots")
def _(t):
    slots = cf.config_slots(cf.parse_configs(_documents(t)))
    return slots.select("station", "rule_kind", "rule_key", "day", "hour", F.array_join("tags", "|").alias("tags"), "continued").withColumn(
        "tags", F.nullif("tags", F.lit("")))


@query("referenced_tags", f"""WITH {_SLOTS}
    SELECT DISTINCT station, 'tag' AS kind, unnest(string_split(tags, '|')) AS name FROM slots WHERE tags IS NOT NULL
    UNION SELECT station, k, v FROM c, (VALUES ('tag', 'spare'), ('tag', 'clips'), ('tag', 'intro'), ('bump_dir', 'bumps'), ('bump_dir', 'late'), ('commercial_dir', 'ads1')) x(k, v)""")
def _(t):
    return cf.referenced_tags(cf.parse_configs(_documents(t)))


@query("widen_rows", """
    SELECT id, path, CASE WHEN id % 2 = 0 THEN 'bump' ELSE 'feature' END AS content_type,
           CASE WHEN id % 2 = 0 THEN coalesce(CASE WHEN id % 3 = 0 THEN 'audio' END, 'video') ELSE 'video' END AS media_type FROM items""")
def _(t):
    base = t.parts_as_items.select("id", "path")
    wide = base.filter("id % 2 = 0").withColumns({"content_type": F.lit("bump"), "media_type": F.when(F.col("id") % 3 == 0, F.lit("audio"))})
    return tables.union_versions(base.filter("id % 2 = 1"), wide, {"content_type": "feature", "media_type": "video"})


@query("upsert", """
    WITH latest AS (SELECT l_partkey AS id, arg_max('v' || l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS title FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT coalesce(l.id, i.id) AS id, coalesce(l.title, i.title) AS title FROM (SELECT * FROM items WHERE id % 5 <> 0) i FULL JOIN latest l ON l.id = i.id""")
def _(t):
    target = t.parts_as_items.filter("id % 5 <> 0").select("id", "title")
    changes = t.read("lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("id"), F.concat(F.lit("v"), "l_orderkey").alias("title"), "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return tables.upsert(target, changes, ["id"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"])


_LO, _HI = "2024-01-08 06:00:00", "2024-01-15 06:00:00"


@query("replace_range", f"""
    SELECT id, station, title FROM blocks WHERE NOT (station = 'view' AND start_time >= TIMESTAMP '{_LO}' AND start_time < TIMESTAMP '{_HI}')
    UNION ALL SELECT id + 1000000000, station, 'new ' || title FROM blocks WHERE station = 'view' AND start_time >= TIMESTAMP '{_LO}' AND start_time < TIMESTAMP '{_HI}'""")
def _(t):
    return tables.replace_range(t.blocks, _replacement(t), "view", _LO, _HI).select("id", "station", "title")


def _replacement(t):
    inside = t.blocks.filter("station = 'view'").filter(F.col("start_time") >= F.lit(_LO).cast("timestamp_ntz")).filter(
        F.col("start_time") < F.lit(_HI).cast("timestamp_ntz"))
    return inside.withColumns({"id": F.col("id") + 1000000000, "title": F.concat(F.lit("new "), "title")})


@query("replacement_problems", f"""
    SELECT 'crosses_range_end' AS code, id FROM blocks WHERE station = 'view' AND start_time < TIMESTAMP '{_HI}' AND end_time > TIMESTAMP '{_HI}'
    UNION ALL SELECT 'overlaps_seam', id FROM blocks WHERE station = 'view' AND start_time < TIMESTAMP '{_LO}' AND end_time > TIMESTAMP '{_LO}'
    UNION ALL SELECT 'id_collision', id FROM blocks WHERE station = 'error' AND id % 100 = 0
    UNION ALL SELECT 'outside_range', id FROM blocks WHERE station = 'error' AND id % 100 = 0""")
def _(t):
    rows = _replacement(t).unionByName(t.blocks.filter("station = 'error' AND id % 100 = 0"))
    return tables.replacement_problems(t.blocks, rows, "view", _LO, _HI)


@query("untouched_differences", """
    SELECT id, 'lost' AS side FROM blocks WHERE station = 'error' AND id % 500 = 3""")
def _(t):
    after = tables.replace_range(t.blocks.filter("NOT (station = 'error' AND id % 500 = 3)"), _replacement(t), "view", _LO, _HI)
    return tables.untouched_differences(t.blocks, after, "view", _LO, _HI).select("id", "side")


@query("guide_listings", """
    SELECT station, id, '{"title":"' || title || '","start_time":"' || strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') || '","end_time":"'
      || strftime(end_time, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS listing FROM blocks""")
def _(t):
    return guide.guide_listings(t.blocks).select("station", "id", "listing")


# ---- sinks, written to the shared checkpoint folder and read back --------------------------


@query("replace_station", """
    SELECT id, station, 'old' AS title FROM blocks WHERE station <> 'view' AND id % 2 = 0
    UNION ALL SELECT id, station, 'new' FROM blocks WHERE station = 'view' AND id % 2 = 1""")
def _(t):
    folder = scratch(t) + "/schedule"
    tables.replace_station(t.blocks.filter("id % 2 = 0").select("id", "station", F.lit("old").alias("title")), folder)
    tables.replace_station(t.blocks.filter("station = 'view' AND id % 2 = 1").select("id", "station", F.lit("new").alias("title")), folder)
    return t.spark.read.parquet(folder).select("id", "station", "title")


@query("append_blocks", "SELECT id, station, start_time FROM blocks UNION ALL SELECT id, station, start_time FROM blocks WHERE id % 3 = 0")
def _(t):
    folder, rows = scratch(t) + "/schedule", t.blocks.select("id", "station", "start_time")
    tables.append_blocks(rows, folder)
    tables.append_blocks(rows.filter("id % 3 = 0"), folder)
    return t.spark.read.parquet(folder).select("id", "station", "start_time")


@query("latest_snapshot", "SELECT path, size, mtime_ns FROM manifest_after")
def _(t):
    folder = scratch(t) + "/inventory"
    manifests.save_snapshot(t.manifest_before, folder, "20240101T000000")
    manifests.save_snapshot(t.manifest_after, folder, "20240201T000000")
    return manifests.latest_snapshot(t.spark, folder).select("path", "size", "mtime_ns")


@query("export_guide", """
    SELECT station, id, '{"title":"' || title || '","start_time":"' || strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') || '","end_time":"'
      || strftime(end_time, '%Y-%m-%dT%H:%M:%S.%f') || '","meta":{"season":' || content_id || '}}' AS listing FROM blocks
    UNION ALL SELECT DISTINCT station, NULL, '#' || length(station) FROM blocks""")
def _(t):
    """Listings with metadata, and the channels, both read back from the files."""
    folder = scratch(t)
    blocks = t.blocks.withColumn("meta", F.struct(F.col("content_id").alias("season")))
    channels = t.blocks.select("station", F.length("station").alias("number")).distinct()
    guide.export_guide(blocks, channels, folder, meta=True)
    listed = t.spark.read.schema("station string, id bigint, at timestamp_ntz, listing string").json(folder + "/schedules")
    shown = t.spark.read.schema("station string, number int").json(folder + "/channels")
    return listed.select("station", "id", "listing").unionByName(
        shown.select("station", F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("#"), "number").alias("listing")))


#: What stands in a source's folder of the library, by the documents' language; a document without one stands for a dangling link.
_LIBRARY_SQL = """
    WITH groups AS (SELECT 'show=' || coalesce(source, 'none') AS title, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY 1, 2),
    entries AS (
      SELECT title || '/' || unnest(['_' || lang || '.mp4', lang || '.TXT', '.' || lang || '.mkv', '.' || lang, 'season/' || lang || '.Mkv', lang || '.avi']) AS path,
             unnest([NULL, 'unsupported_extension', 'hidden', 'hidden_directory', NULL, NULL]) AS reason,
             unnest([NULL, NULL, NULL, NULL, NULL, 'No such file or directory']) AS error, n FROM groups)
    SELECT path, CASE WHEN reason IS NULL AND error IS NULL THEN n END AS size, reason, error FROM entries"""


def _library(t) -> str:
    """A folder with a show for every source of the documents and files of all sorts for every language of it, written by tasks.

    Beside kept files there are hidden files and folders, texts, links to nothing, and links to folders that the library has anyway.
    """
    folder = scratch(t) + "/library"
    root = folder.removeprefix("file:")
    groups = t.read("documents").groupBy(
        F.coalesce("source", F.lit("none")).alias("show"), F.coalesce("lang", F.lit("none")).alias("lang")).count()

    def written(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lang, show = row["lang"], os.path.join(root, f"show={row['show']}")
                for name in (f"_{lang}.mp4", f"{lang}.TXT", f".{lang}.mkv", f".{lang}/inside.mp4", f"season/{lang}.Mkv"):
                    os.makedirs(os.path.dirname(os.path.join(show, name)), exist_ok=True)
                    with open(os.path.join(show, name), "wb") as out:
                        out.write(b"x" * row["count"])
                for link, target in ((f"{lang}.avi", "nowhere"), (f"zz_{lang}", "season"), (f"season/back_{lang}", "..")):
                    if not os.path.lexists(os.path.join(show, link)):
                        os.symlink(target, os.path.join(show, link))
            yield batch

    groups.mapInArrow(written, groups.schema).write.format("noop").mode("overwrite").save()
    return root


def _findings(files, skipped, errors):
    nothing = F.lit(None).cast("string")
    return files.select("path", "size", nothing.alias("reason"), nothing.alias("error")).unionByName(
        skipped, allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)


@query("scan_manifest", _LIBRARY_SQL)
def _(t):
    """Files, skipped rows and errors of a library that is listed by the executors."""
    return _findings(*manifests.scan_manifest(t.spark, _library(t)))


@query("stream_listing", _LIBRARY_SQL)
def _(t):
    """The same library listed by a stream in two runs, half of the shows being renamed into place between them."""
    from airlog.sources.listing import newest_of_each, stream_library

    root, folder = _library(t), scratch(t)
    shows = sorted(os.listdir(root))
    os.mkdir(folder.removeprefix("file:"))
    for late in shows[::2]:
        os.rename(f"{root}/{late}", f"{folder.removeprefix('file:')}/{late}")
    for moved in (shows[::2], []):
        stream_library(t.spark, root, lag_seconds=0).writeStream.format("parquet").option("path", folder + "/seen").option(
            "checkpointLocation", folder + "/state").trigger(availableNow=True).start().awaitTermination()
        for late in moved:
            os.rename(f"{folder.removeprefix('file:')}/{late}", f"{root}/{late}")
    seen = newest_of_each(t.spark.read.parquet(folder + "/seen"))
    return _findings(*manifests.split_listing(seen))


@query("manifest_errors", """
    WITH l AS (SELECT doc_id, source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' ELSE '.mp4' END AS path,
                      CASE WHEN doc_id % 10 = 1 THEN 'not readable' WHEN doc_id % 10 = 2 THEN 'denied' END AS error FROM documents),
    e AS (SELECT path, error FROM l WHERE error IS NOT NULL AND doc_id % 3 <> 0)
    SELECT path, error, FALSE AS usable, (SELECT count(*) FROM e) AS errors, (SELECT count(*) FROM l WHERE error IS NULL) AS readable FROM e""")
def _(t):
    n = F.col("doc_id") % 10
    listing = t.read("documents").select(
        F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(".txt")).otherwise(".mp4")).alias("path"),
        F.when(n != 1, F.col("n_chars")).alias("size"), F.col("doc_id").alias("mtime_ns"), F.when(n == 2, F.lit("denied")).alias("error"))
    errors = manifests.listing_errors(listing)
    sound = manifests.readable(listing).agg(F.count(F.lit(1)).alias("readable"))
    judged = manifests.usable_baseline(errors)
    return errors.withColumns({"usable": judged.select("usable").scalar(), "errors": judged.select("errors").scalar(), "readable": sound.scalar()})
