"""Scalar function queries: titles, metadata, calendar, hints, paths and encodings on given rows."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from airlog import schemas
from airlog.functions import calendar as cal
from airlog.functions import hints, metadata, paths, titles, values
from airlog.plans import playout
from queries.registry import query


def _part(t):
    return t.read("part").withColumn("n", F.col("p_partkey") % 6)


@query("parse_title", """
    SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
             lambda w: upper(w[1]) || lower(w[2:])), ' ')
             || CASE WHEN p_partkey % 6 = 4 THEN ' 2' WHEN p_partkey % 6 = 5 THEN '' ELSE '' END AS title
    FROM part""")
def _(t):
    name, n = F.col("p_name"), F.col("n")
    file = (
        F.when(n == 0, F.concat(F.lit("[Releasers] - "), name, F.lit(" - 6.mkv")))
        .when(n == 1, F.concat(name, F.lit(" - s"), F.col("p_size"), F.lit("-e7 - Extra, more.mp4")))
        .when(n == 2, F.concat(F.upper(name), F.lit(" (1999).avi")))
        .when(n == 3, F.concat(F.lit("/shows/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("_title3.mp4")))
        .when(n == 4, F.concat(name, F.lit(" 2 (1976).mp4")))
        .otherwise(F.concat(name, F.lit(" - 06x"), F.col("p_size"), F.lit(".mp4")))
    )
    return _part(t).select("p_partkey", titles.parse_title(file).alias("title"))


@query("title_and_year", """
    SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 1950 + p_size END AS year FROM part""")
def _(t):
    n, name, year = F.col("p_partkey") % 3, F.col("p_name"), F.col("p_size") + 1950
    file = (F.when(n == 0, F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit(" ("), year, F.lit(")")))
            .when(n == 1, F.concat(F.replace(name, F.lit(" "), F.lit(".")), F.lit("_"), year))
            .otherwise(F.replace(name, F.lit(" "), F.lit(" - "))))
    parsed = titles.title_and_year(file)
    return t.read("part").select("p_partkey", parsed["title"].alias("title"), parsed["year"].alias("year"))


def _meta(t):
    kinds = F.array(*[F.lit(k) for k in ("music", "movie", "episode", "tvshow", "plaintext")])
    null = F.lit(None).cast("string")
    return t.read("part").select("p_partkey", F.struct(
        F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("type"), F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"), F.col("p_type").alias("album"),
        F.when(F.col("p_size") > 25, (F.col("p_size") + 1950).cast("string")).alias("year"),
        F.concat(F.lit("plot "), F.col("p_size")).alias("plot"), F.col("p_brand").alias("show_title"), null.alias("aired"),
        F.array(F.col("p_name"), F.lit(""), F.col("p_brand"), F.col("p_type"), null).alias("lines")).alias("meta"))


@query("display_fields", """
    SELECT p_partkey, p_name AS title,
           CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 2 THEN p_brand WHEN 4 THEN ''
                ELSE CASE WHEN p_size > 25 THEN CAST(p_size + 1950 AS VARCHAR) ELSE '' END END AS info,
           CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 4 THEN p_brand ELSE 'plot ' || p_size END AS description
    FROM part""")
def _(t):
    return _meta(t).select("p_partkey", metadata.display_fields("meta").alias("d")).select("p_partkey", "d.*")


@query("overlay_lines", """
    SELECT p_partkey, CASE p_partkey % 5
        WHEN 0 THEN p_brand || '|' || p_name || '|' || p_type || CASE WHEN p_size > 25 THEN '|' || (p_size + 1950) ELSE '' END
        WHEN 4 THEN p_name || '|' || p_brand || '|' || p_type END AS lines
    FROM part""")
def _(t):
    return _meta(t).select("p_partkey", F.array_join(metadata.overlay_lines("meta"), "|").alias("lines"))


@query("meta_fallbacks", """
    SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size + 1950 AS VARCHAR) ELSE '1999' END AS year,
           CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS plot FROM part""")
def _(t):
    m = F.struct(
        F.when(F.col("p_size") > 25, (F.col("p_size") + 1950).cast("string")).otherwise("").alias("year"),
        F.lit("1999-05-01").alias("premiered"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("plot"), F.col("p_brand").alias("outline"))
    filled = t.read("part").select("p_partkey", m.alias("m")).select("p_partkey", metadata.meta_fallbacks("m").alias("m"))
    return filled.select("p_partkey", "m.year", "m.plot")


@query("normalize_meta", """
    SELECT p_partkey, CASE WHEN p_size > 25 THEN '2001' ELSE '1987' END AS year,
           CASE WHEN p_partkey % 2 = 0 THEN 'movie' ELSE 'music' END AS type, p_name AS title FROM part""")
def _(t):
    m = F.struct(
        F.when(F.col("p_partkey") % 2 == 0, F.lit("movie")).alias("type"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 25, F.lit("2001")).alias("year"), F.lit("1987").alias("date"))
    clean = t.read("part").select("p_partkey", m.alias("m")).select("p_partkey", metadata.normalize_meta("m").alias("m"))
    return clean.select("p_partkey", "m.year", "m.type", "m.title")


@query("parse_sidecars", """
    SELECT p_partkey,
           CASE p_partkey % 5 WHEN 0 THEN 'movie' WHEN 1 THEN 'episode' WHEN 2 THEN 'music' WHEN 3 THEN 'plaintext'
                ELSE 'artist' END AS type,
           p_name AS title,
           CASE p_partkey % 5 WHEN 0 THEN CAST(p_size + 1950 AS VARCHAR) WHEN 2 THEN '1984' END AS year,
           CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 4 THEN p_type END AS plot,
           CASE p_partkey % 5 WHEN 1 THEN p_size END AS season,
           CASE p_partkey % 5 WHEN 3 THEN p_name || '|' || p_brand || '|' || p_type END AS lines
    FROM part""")
def _(t):
    def xml(root, *fields):
        inner = [F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>")) for k, v in fields]
        return F.concat(F.lit(f"<?xml version=\"1.0\"?>\n<{root}>"), *inner, F.lit(f"</{root}>"))

    n, name = F.col("p_partkey") % 5, ("title", F.col("p_name"))
    text = (
        F.when(n == 0, xml("movie", name, ("year", (F.col("p_size") + 1950).cast("string")), ("plot", F.col("p_type"))))
        .when(n == 1, xml("episodedetails", name, ("season", F.col("p_size").cast("string")), ("outline", F.col("p_brand"))))
        .when(n == 2, xml("musicvideo", name, ("artist", F.col("p_brand")), ("premiered", F.lit("1984-02-03"))))
        .when(n == 3, F.concat(F.lit("  "), "p_name", F.lit("\n\n"), "p_brand", F.lit("\n"), "p_type", F.lit("\n")))
        .otherwise(xml("artist", name, ("plot", F.col("p_type"))))
    )
    m = metadata.parse_sidecar("text")
    parsed = t.read("part").select("p_partkey", text.alias("text")).select("p_partkey", m.alias("m"))
    return parsed.select("p_partkey", "m.type", "m.title", "m.year", "m.plot", "m.season",
                         F.array_join("m.lines", "|").alias("lines"))


@query("calendar_tests", """
    SELECT o_orderkey, isodow(o_orderdate) = 5 AS friday, month(o_orderdate) = 11 AS november,
           quarter(o_orderdate) = 2 AS q2, weekofyear(o_orderdate) = 1 AS week1
    FROM orders""")
def _(t):
    d = "o_orderdate"
    return t.read("orders").select(
        "o_orderkey", cal.on_weekday(d, "friday").alias("friday"), cal.on_month(d, "November").alias("november"),
        cal.on_quarter(d, "Q2").alias("q2"), cal.on_week(d, "week number 1").alias("week1"))


@query("day_parts", """
    SELECT event_id, hour(ts) IN (23, 0, 1, 2) AS late, hour(ts) BETWEEN 18 AND 22 AS prime,
           hour(ts) IN (22, 23, 0, 1, 2, 3) AS graveyard FROM events""")
def _(t):
    custom = cal.day_part_hours({"graveyard": (22, 3)})
    return t.read("events").select(
        "event_id", cal.in_day_part("ts", "late").alias("late"), cal.in_day_part("ts", "prime").alias("prime"),
        cal.in_day_part("ts", "graveyard", custom).alias("graveyard"))


@query("holidays", """
    WITH y AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS yr FROM orders),
    h AS (SELECT *, (SELECT max(x) FROM (SELECT unnest(generate_series(make_date(yr, 5, 1), make_date(yr, 5, 31), INTERVAL 1 DAY)) AS x)
                     WHERE isodow(x) = 1) AS memorial,
                 (SELECT min(x) FROM (SELECT unnest(generate_series(make_date(yr, 11, 1), make_date(yr, 11, 30), INTERVAL 1 DAY)) AS x)
                     WHERE isodow(x) = 4) AS thursday1
          FROM y)
    SELECT o_orderkey, month(d) = 12 AND day(d) = 25 AS christmas, d = CAST(memorial AS DATE) AS memorial,
           d = CAST(thursday1 + INTERVAL 21 DAY AS DATE) AS thanksgiving FROM h""")
def _(t):
    days = {"christmas": "December 25", "memorial": "last monday may", "thanksgiving": "4th thursday november"}
    return t.read("orders").select("o_orderkey", *[cal.on_holiday("o_orderdate", n, days).alias(n) for n in days])


@query("month_day_ranges", """
    WITH d AS (SELECT event_id, ts AS t, month(ts) * 100 + day(ts) AS md FROM events)
    SELECT event_id,
           (md >= 110 AND t <= TIMESTAMP '2024-01-20 00:00:00') AS hint_range,
           md BETWEEN 110 AND 120 AS key_range,
           (md >= 1215 OR t <= TIMESTAMP '2024-01-08 00:00:00') AS wrapped
    FROM d""")
def _(t):
    return t.read("events").select(
        "event_id", cal.in_month_day_range("ts", "January 10 - January 20").alias("hint_range"),
        cal.in_month_day_range("ts", "January 10 - January 20", inclusive=True).alias("key_range"),
        cal.in_month_day_range("ts", "December 15 - January 8").alias("wrapped"))


@query("broadcast_weeks", """
    SELECT o_orderkey, date_trunc('week', o_orderdate) + INTERVAL 6 HOUR AS week_start,
           date_trunc('week', o_orderdate) + INTERVAL 7 DAY + INTERVAL 6 HOUR AS week_end,
           CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) + INTERVAL 7 DAY + INTERVAL 6 HOUR AS next_week,
           CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) + INTERVAL 1 MONTH + INTERVAL 6 HOUR AS next_month
    FROM orders""")
def _(t):
    week = cal.broadcast_week("o_orderdate")
    return t.read("orders").select(
        "o_orderkey", week["week_start"].alias("week_start"), week["week_end"].alias("week_end"),
        cal.next_week("o_orderdate").alias("next_week"), cal.next_month("o_orderdate").alias("next_month"))


@query("tag_of_hour", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN ['a','b'][least(minute(ts) // 30, 1) + 1]
             WHEN 2 THEN ['a','b','c'][least(minute(ts) // 20, 2) + 1]
             ELSE ['a','b','c','d','e','f','g'][least(minute(ts) // 8, 6) + 1] END AS tag FROM events""")
def _(t):
    letters = F.array(*[F.lit(x) for x in "abcdefg"])
    size = F.get(F.array(*[F.lit(n) for n in (1, 2, 3, 7)]), (F.col("event_id") % 4).cast("int"))
    return t.read("events").select("event_id", cal.tag_of_hour(F.slice(letters, F.lit(1), size), "ts").alias("tag"))



@query("hint_matches", """
    SELECT event_id, CASE event_id % 6
        WHEN 0 THEN TRUE WHEN 1 THEN month(ts) = 1 WHEN 2 THEN isodow(ts) = 5 AND hour(ts) BETWEEN 18 AND 22
        WHEN 3 THEN weekofyear(ts) = 3 WHEN 4 THEN TRUE
        ELSE quarter(ts) = 1 AND CAST(ts AS DATE) = DATE '2024-01-15' END AS passes
    FROM events""")
def _(t):
    """Stored hints decoded and tested at the time of each event."""
    stored = F.array(
        F.lit(None).cast("string"),
        F.lit(r'["{\"type\": \"month\", \"month\": \"January\"}"]'),
        F.lit(r'["{\"type\": \"day_of_week\", \"day\": \"friday\"}", "{\"type\": \"day_part\", \"part\": \"prime\"}"]'),
        F.lit(r'["{\"type\": \"week_number\", \"week_number\": \"week number 3\"}"]'),
        F.lit(r'["{\"type\": \"bump\", \"where\": \"pre\"}", "{\"type\": \"moon_phase\", \"phase\": \"full\"}"]'),
        F.lit(r'["{\"type\": \"quarter\", \"quarter\": \"q1\"}", "{\"type\": \"custom_holiday\", \"custom_holiday\": \"mlk\"}"]'))
    rows = t.read("events").withColumn("hints", hints.decode_hints(F.get(stored, (F.col("event_id") % 6).cast("int"))))
    passes = hints.hint_matches("hints", "ts", {"mlk": "3rd monday january"})
    return rows.select("event_id", passes.alias("passes"))


@query("folder_hints", """
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter,day_part'
        WHEN 3 THEN 'range' WHEN 4 THEN 'day_of_week,week_number' WHEN 5 THEN 'custom_holiday' ELSE 'bump' END AS kinds
    FROM part""")
def _(t):
    folders = F.array(*[F.lit(x) for x in (
        "cartoons", "October", "Q4/morning", "december 1 - December 25", "friday/Week Number 44", "aug_day", "pre")])
    path = F.concat(F.lit("catalog/shows/"), F.get(folders, (F.col("p_partkey") % 7).cast("int")), F.lit("/x.mp4"))
    found = hints.folder_hints(path, "catalog/shows", holidays=["aug_day"], bumps=True)
    return t.read("part").select("p_partkey", F.array_join(F.transform(found, lambda h: h["type"]), ",").alias("kinds"))


@query("bump_positions", """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' ELSE 'fill' END AS position,
           p_type || CASE p_partkey % 3 WHEN 0 THEN '-pre' WHEN 1 THEN '-post' ELSE '' END AS pool FROM part""")
def _(t):
    names = F.get(F.array(*[F.lit(x) for x in ("pre", "post", "friday")]), (F.col("p_partkey") % 3).cast("int"))
    found = hints.parse_hints(names, bumps=True)
    return t.read("part").select(
        "p_partkey", hints.bump_position(found).alias("position"), hints.bump_tag("p_type", found).alias("pool"))


@query("paths_under_directory", """
    SELECT id, station = 'Brand#1' AS under_brand, tag = 'PROMO' AS ends_promo,
           CASE WHEN tag = 'LARGE' THEN 'LARGE' WHEN tag = 'SMALL' THEN 'SMALL' END AS pattern FROM items""")
def _(t):
    base = F.col("station")
    return t.parts_as_items.select(
        "id", paths.is_under(F.lit("Brand#1/"), "path").alias("under_brand"),
        paths.ends_with_dir("path", F.lit("PROMO")).alias("ends_promo"),
        paths.first_match("path", base, ["LARGE", "LARGE/x", "SMALL"]).alias("pattern"))


@query("unsafe_text", r"""
    SELECT page_id, CASE WHEN regexp_matches(html, '(?:^|[\s"''=:(])/(?:[^/\s]+(?:/|$))') THEN 'posix_path'
        WHEN regexp_matches(html, '(?:^|[\s"''=:(])(?:[A-Za-z]:[\\/]|\\\\)') THEN 'windows_path'
        WHEN regexp_matches(html, '(?i)(authorization|bearer|cookie|password|passwd|private[ _-]?key|api[ _-]?key|access[ _-]?token|refresh[ _-]?token|secret|environment(?: variables?)?)')
        THEN 'secret' END AS reason
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '/', '|', 'g') ELSE html END AS html FROM pages)""")
def _(t):
    html = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("/"), F.lit("|"))).otherwise(F.col("html"))
    return t.read("pages").select("page_id", paths.unsafe_text(html).alias("reason"))


@query("unsafe_documents", r"""
    SELECT doc_id FROM (SELECT doc_id, text || CASE doc_id % 30 WHEN 0 THEN ' kept at /srv/' || source || '/x' WHEN 1 THEN ' his PassWord' WHEN 2 THEN ' d:\\x' ELSE '' END AS text FROM documents)
    WHERE regexp_matches(text, '(?:^|[\s"''=:(])/(?:[^/\s]+(?:/|$))')
       OR regexp_matches(text, '(?:^|[\s"''=:(])(?:[A-Za-z]:[\\/]|\\\\)')
       OR regexp_matches(text, '(?i)(authorization|bearer|cookie|password|passwd|private[ _-]?key|api[ _-]?key|access[ _-]?token|refresh[ _-]?token|secret|environment(?: variables?)?)')""")
def _(t):
    """The given texts have nothing unsafe, so of every thirty, three are given a path or a secret word."""
    n = F.col("doc_id") % 30
    added = F.when(n == 0, F.concat(F.lit(" kept at /srv/"), "source", F.lit("/x"))).when(n == 1, F.lit(" his PassWord")).when(
        n == 2, F.lit(" d:\\x")).otherwise("")
    docs = t.read("documents").withColumn("text", F.concat("text", added))
    return docs.filter(paths.unsafe_text("text").isNotNull()).select("doc_id")


@query("round_up", """
    SELECT id, CAST(ceil(duration / 1800) * 1800 AS DOUBLE) AS half_hours, duration AS exact FROM items""")
def _(t):
    return t.parts_as_items.select(
        "id", values.round_up("duration", 30).cast("double").alias("half_hours"), values.round_up("duration", 0).alias("exact"))


@query("micros", "SELECT event_id, epoch_us(ts) AS us, ts FROM events")
def _(t):
    us = values.micros("ts")
    return t.read("events").select("event_id", us.alias("us"), values.from_micros(us).alias("ts"))


@query("media_identity", """
    SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN 'media:/' || source || '/' || doc_id || '.mp4' END AS identity,
           CASE doc_id % 6 WHEN 3 THEN 'traversal' WHEN 4 THEN 'outside_roots' WHEN 5 THEN 'unsafe_character' END AS error
    FROM documents""")
def _(t):
    tail = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    heads = F.array(*[F.lit(h) for h in ("/mnt/library/", "shared/media/", "/mnt/library//", "/mnt/library/../", "/etc/", "shared/media/a\\")])
    path = F.concat(F.get(heads, (F.col("doc_id") % 6).cast("int")), tail)
    m = paths.media_identity(path, ["/mnt/library", "shared/media"])
    return t.read("documents").select("doc_id", m["identity"].alias("identity"), m["error"].alias("error"))


@query("show_dir", """
    SELECT id, CASE id % 4 WHEN 3 THEN NULL ELSE station || '/' || title END AS show_dir FROM items""")
def _(t):
    show, n = F.concat("station", F.lit("/"), "title"), F.col("id") % 4
    path = (F.when(n == 0, F.concat(show, F.lit("/Season 3/x.mp4"))).when(n == 1, F.concat(show, F.lit("/s2/SEASON4/x.mp4")))
            .when(n == 2, F.concat(show, F.lit("/x.mp4"))).otherwise(F.lit("Season 1/x.mp4")))
    return t.parts_as_items.select("id", paths.show_dir(path).alias("show_dir"))


@query("canonical_rows", """
    SELECT p_partkey, sha256('t' || strlen(p_brand) || ':' || p_brand || 't' || strlen(p_name) || ':' || p_name
        || 'i' || strlen(CAST(p_partkey AS VARCHAR)) || ':' || p_partkey
        || CASE WHEN p_size > 25 THEN 'i' || strlen(CAST(p_size AS VARCHAR)) || ':' || p_size ELSE 'n' END) AS digest
    FROM part""")
def _(t):
    rows = t.read("part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"))
    return rows.select("p_partkey", F.sha2(values.canonical(rows, rows.columns), 256).alias("digest"))


@query("content_ids", """
    SELECT DISTINCT content_id FROM (
      SELECT content_id FROM blocks WHERE id % 3 = 0
      UNION ALL SELECT content_id FROM blocks WHERE id % 3 = 1 UNION ALL SELECT id FROM blocks WHERE id % 3 = 1)""")
def _(t):
    text = (F.when(F.col("id") % 3 == 0, F.col("content_id").cast("string"))
            .when(F.col("id") % 3 == 1, F.concat(F.lit("["), F.col("content_id"), F.lit(", "), F.col("id"), F.lit("]"))))
    ids = F.explode(values.id_array(text)).alias("content_id")
    return t.blocks.select(ids).distinct()


@query("tags_array", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderpriority || '|' || o_orderstatus END AS tags
    FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(
        F.to_json(F.array("o_orderpriority", "o_orderstatus")))
    return t.read("orders").select("o_orderkey", F.array_join(values.tags_array(text), "|").alias("tags"))


@query("strict_json", """
    SELECT event_id, event_id % 4 = 0 AS ok, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
    FROM events""")
def _(t):
    n = F.col("event_id") % 4
    text = (F.when(n == 0, F.col("props")).when(n == 1, F.lit('{"k": 1, "k": 2}'))
            .when(n == 2, F.lit('{"k": NaN}')).otherwise(F.concat("props", F.lit("}"))))
    parsed = t.read("events").select("event_id", values.strict_json(text).alias("v"))
    return parsed.select("event_id", F.col("v").isNotNull().alias("ok"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("plan_positions", """
    SELECT o_orderkey AS block_id, CAST(u.pos AS INTEGER) AS pos, 'p' || o_orderkey AS path, CAST(u.pos * 30 AS DOUBLE) AS duration
    FROM orders, (SELECT unnest([0, 1, 2]) AS pos) u WHERE u.pos <= o_orderkey % 4 AND o_orderkey % 5 > 0""")
def _(t):
    entries = F.array(*[F.struct(F.concat(F.lit("p"), F.col("o_orderkey")).alias("path"), (F.lit(i) * 30.0).alias("duration")) for i in range(3)])
    plan = F.from_json(F.to_json(F.filter(entries, lambda e: e["duration"] <= F.col("o_orderkey") % 4 * 30)), T.ArrayType(schemas.PLAN_ENTRY))
    blocks = t.read("orders").select(F.col("o_orderkey").alias("block_id"), F.when(F.col("o_orderkey") % 5 > 0, plan).alias("plan"))
    return playout.plan_rows(blocks).select("block_id", F.col("position").alias("pos"), "path", "duration")
