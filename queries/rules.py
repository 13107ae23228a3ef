"""Calendar-rule, proposal and recommendation queries over orders, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlog.functions.calendar import weekday_name
from airlog.operators import rules as r
from airlog.plans.playout import plan_timeline
from queries.registry import query

_SLOT_RULES = """
    o AS (SELECT 'st' || o_custkey AS station, o_orderkey AS k, o_orderdate AS d, o_orderkey % 24 AS hour, isodow(o_orderdate) AS dow FROM orders),
    weekday AS (SELECT station, dow, hour, min('wd' || k) AS tags FROM o WHERE k % 10 > 2 GROUP BY ALL),
    dated AS (SELECT station, month(d) * 100 + day(d) AS md, hour, min('dt' || k) AS tags FROM o WHERE k % 10 = 0 GROUP BY ALL),
    span AS (SELECT station, k, month(d) * 100 + day(d) AS lo, month(d + INTERVAL 20 DAY) * 100 + day(d + INTERVAL 20 DAY) AS hi, hour, dow, 'wk' || k AS tags
             FROM o WHERE k % 10 IN (1, 2))"""


def _slots(t):
    """Weekday, date and week-range rules from orders; a week rule has one slot, on one weekday."""
    k = F.col("o_orderkey")
    o = t.read("orders").select(
        F.concat(F.lit("st"), "o_custkey").alias("station"), k.alias("k"), F.col("o_orderdate").alias("d"),
        (k % 24).cast("int").alias("hour"), weekday_name("o_orderdate").alias("dow"))
    day_key = F.date_format("d", "MMMM d")
    later = F.date_format(F.col("d") + F.expr("INTERVAL 20 DAYS"), "MMMM d")
    null = F.lit(None).cast("string")
    weekday = o.filter("k % 10 > 2").groupBy("station", "dow", "hour").agg(F.min(F.concat(F.lit("wd"), "k")).alias("tags")).select(
        "station", F.lit("weekday").alias("rule_kind"), F.col("dow").alias("rule_key"), F.lit(0).cast("bigint").alias("rule_order"), F.col("dow").alias("day"), "hour", "tags")
    dated = o.filter("k % 10 = 0").groupBy("station", day_key.alias("rule_key"), "hour").agg(F.min(F.concat(F.lit("dt"), "k")).alias("tags")).select(
        "station", F.lit("date").alias("rule_kind"), "rule_key", F.lit(0).cast("bigint").alias("rule_order"), null.alias("day"), "hour", "tags")
    week = o.filter("k % 10 IN (1, 2)").select(
        "station", F.lit("week").alias("rule_kind"), F.concat(day_key, F.lit(" - "), later).alias("rule_key"), F.col("k").alias("rule_order"),
        F.col("dow").alias("day"), "hour", F.concat(F.lit("wk"), "k").alias("tags"))
    # two orders of one customer may give the same range: the first one keeps it
    first = week.groupBy("station", "rule_kind", "rule_key").agg(F.min("rule_order").alias("rule_order"))
    return weekday.unionByName(dated).unionByName(week.join(first, ["station", "rule_kind", "rule_key", "rule_order"], "left_semi"))


@query("slot_calendar", f"""WITH {_SLOT_RULES},
    days AS (SELECT CAST(unnest(generate_series(DATE '2024-03-01', DATE '2024-03-28', INTERVAL 1 DAY)) AS DATE) AS date),
    calendar AS (SELECT date, month(date) * 100 + day(date) AS md, isodow(date) AS dow FROM days),
    weeks AS (SELECT s.station, c.date, c.dow AS today, min(s.k) AS k FROM span s JOIN calendar c
                ON lo <> 229 AND hi <> 229 AND (CASE WHEN lo <= hi THEN c.md BETWEEN lo AND hi ELSE c.md >= lo OR c.md <= hi END) GROUP BY ALL),
    every AS (
      SELECT station, date, hour, 2 AS lvl, tags FROM weekday w JOIN calendar c ON c.dow = w.dow
      UNION ALL SELECT station, date, hour, 0, tags FROM dated x JOIN calendar c ON c.md = x.md
      UNION ALL SELECT w.station, w.date, s.hour, 1, s.tags FROM weeks w JOIN span s ON s.station = w.station AND s.k = w.k AND s.dow = w.today)
    SELECT station, date, hour, arg_min(tags, lvl) AS tags FROM every GROUP BY 1, 2, 3""")
def _(t):
    return r.slot_calendar(_slots(t), "2024-03-01", "2024-03-28").select("station", "date", "hour", "tags")


@query("inline_templates", """
    SELECT c_custkey AS station, 'monday' AS day, CAST(h AS INTEGER) AS hour, 'T' || (c_custkey % 9) || '-' || h AS tags
    FROM customer, (SELECT unnest([6, 7, 8]) AS h) WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'monday', 9, 'own' FROM customer WHERE c_custkey % 3 <> 0""")
def _(t):
    n = F.col("c_custkey")
    slots = t.read("customer").select(
        n.alias("station"), F.lit("monday").alias("day"), F.when(n % 3 == 0, F.concat(F.lit("tpl"), n % 9)).alias("template"),
        F.when(n % 3 != 0, 9).alias("hour"), F.when(n % 3 != 0, F.lit("own")).alias("tags"))
    templates = t.read("customer").select((n % 9).alias("k")).distinct().select(
        F.concat(F.lit("tpl"), "k").alias("template"), "k", F.explode(F.array(F.lit(6), F.lit(7), F.lit(8))).alias("hour"))
    return r.inline_templates(slots, templates.select("template", "hour", F.concat(F.lit("T"), "k", F.lit("-"), "hour").alias("tags")))


@query("effective_slot", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 2 = 0 THEN 'over' WHEN o_orderkey % 3 = 0 THEN 'slot' ELSE 'base' || (o_custkey % 5) END AS break_strategy,
           CASE WHEN o_orderkey % 3 = 0 THEN 15 ELSE 30 END AS schedule_increment
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(t):
    k = F.col("o_orderkey")
    slots = t.read("orders").join(t.read("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        k.alias("id"), F.col("o_custkey").alias("station"), F.when(k % 7 == 0, F.lit("special")).otherwise("plain").alias("tag"),
        F.when(k % 3 == 0, F.lit("slot")).alias("break_strategy"), F.when(k % 3 == 0, 15).alias("schedule_increment"))
    over = t.read("customer").filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("station"), F.lit("special").alias("tag"), F.lit("over").alias("break_strategy"), F.lit(None).cast("int").alias("schedule_increment"))
    base = t.read("customer").select(
        F.col("c_custkey").alias("station"), F.concat(F.lit("base"), F.col("c_custkey") % 5).alias("break_strategy"), F.lit(30).alias("schedule_increment"))
    return r.effective_slot(slots, over, base, ["break_strategy", "schedule_increment"]).select("id", "break_strategy", "schedule_increment")


def _directives(t):
    k = F.col("o_orderkey")
    kind = F.get(F.array(*[F.lit(x) for x in ("date_slot", "marathon", "daypart", "season", "theme")]), (k % 5).cast("int"))
    day = F.col("o_orderdate").cast("date")
    part = F.get(F.array(F.lit("prime"), F.lit("late")), (k % 2).cast("int"))
    return t.read("orders").select(
        k.alias("id"), (F.col("o_custkey") % 200).alias("channel"), kind.alias("type"), F.concat(F.lit("Series "), k % 300).alias("series"),
        day.alias("date"), (k % 24).alias("hour"), part.alias("daypart"), day.alias("start_date"), F.date_add(day, (k % 4).cast("int")).alias("end_date"),
        F.array(F.lit(20), F.lit(21)).alias("hours"), (k % 5 == 4).alias("all_day"))


_EXPANDED = """
    expanded AS (
      SELECT o_orderkey AS id, o_custkey % 200 AS channel, 'Series ' || (o_orderkey % 300) AS series, CAST(o_orderdate AS DATE) AS date, o_orderkey % 24 AS hour FROM orders WHERE o_orderkey % 5 < 2
      UNION ALL SELECT o_orderkey, o_custkey % 200, 'Series ' || (o_orderkey % 300), CAST(DATE '1999-05-03' + CAST(d AS INTEGER) AS DATE), h
        FROM orders, (SELECT unnest([0,1,2,3,4,5,6]) AS d), LATERAL (SELECT unnest(CASE WHEN o_orderkey % 2 = 0 THEN [18,19,20,21,22] ELSE [23,0,1,2] END) AS h) WHERE o_orderkey % 5 = 2
      UNION ALL SELECT o_orderkey, o_custkey % 200, 'Series ' || (o_orderkey % 300), CAST(CAST(o_orderdate AS DATE) + CAST(d AS INTEGER) AS DATE), h
        FROM orders, LATERAL (SELECT unnest(generate_series(0, o_orderkey % 4)) AS d), LATERAL (SELECT unnest(CASE WHEN o_orderkey % 5 = 4 THEN generate_series(0, 23) ELSE [20, 21] END) AS h) WHERE o_orderkey % 5 > 2)"""


@query("expand_directives", f"WITH {_EXPANDED} SELECT id, channel, series, date, hour FROM expanded")
def _(t):
    return r.expand_directives(_directives(t), "1999-05-03")


@query("directive_conflicts", f"""WITH {_EXPANDED},
    every AS (SELECT channel, date, hour, series FROM expanded UNION ALL SELECT s_suppkey % 200, DATE '1999-05-04', 20, 'Fixed' FROM supplier)
    SELECT channel, date, hour, CAST(count(DISTINCT series) AS BIGINT) AS series_count FROM every GROUP BY 1, 2, 3 HAVING count(DISTINCT series) > 1""")
def _(t):
    existing = t.read("supplier").select(
        (F.col("s_suppkey") % 200).alias("channel"), F.lit("1999-05-04").cast("date").alias("date"), F.lit(20).alias("hour"), F.lit("Fixed").alias("series"))
    return r.directive_conflicts(r.expand_directives(_directives(t), "1999-05-03"), existing)


def _proposal(t):
    n = F.col("p_partkey")
    series = F.concat(F.lit("Show "), n)
    part = t.read("part")
    owners = part.filter("p_partkey % 4 <> 0").select(F.lower(series).alias("series"), (n % 8 + 1).alias("channel")).unionByName(
        part.filter("p_partkey % 50 = 1").select(F.lower(series).alias("series"), F.lit(3).cast("bigint").alias("channel")))
    changes = part.filter("p_partkey % 3 = 0").select(
        series.alias("series"), F.get(F.array(F.lit("assign"), F.lit("move"), F.lit("remove")), (n % 9 / 3).cast("int")).alias("action"),
        F.when(n % 9 > 0, n % 8 + 1).alias("from_channel"), F.when(n % 9 < 6, n % 8 + 1).alias("to_channel"))
    directives = part.filter("p_partkey % 2 = 0").select(F.upper(series).alias("series"), (n % 8 + 1).alias("channel"))
    exclusions = part.filter("p_partkey % 20 = 5").select(series.alias("series")).unionByName(part.filter("p_partkey % 40 = 5").select(F.upper(series).alias("series")))
    protected = part.filter("p_partkey % 33 = 0").select(series.alias("series"))
    return changes, directives, exclusions, owners, protected


_PROPOSAL = """
    p AS (SELECT p_partkey AS n, 'show ' || p_partkey AS series FROM part),
    owners AS (SELECT DISTINCT series, channel FROM (SELECT series, n % 8 + 1 AS channel FROM p WHERE n % 4 <> 0 UNION ALL SELECT series, 3 FROM p WHERE n % 50 = 1)),
    changes AS (SELECT series, ['assign','move','remove'][n % 9 // 3 + 1] AS action, CASE WHEN n % 9 > 0 THEN n % 8 + 1 END AS f, CASE WHEN n % 9 < 6 THEN n % 8 + 1 END AS g FROM p WHERE n % 3 = 0),
    dirs AS (SELECT series, n % 8 + 1 AS channel FROM p WHERE n % 2 = 0),
    excl AS (SELECT series FROM p WHERE n % 20 = 5 UNION ALL SELECT series FROM p WHERE n % 40 = 5),
    held AS (SELECT series FROM p WHERE n % 33 = 0),
    cnt AS (SELECT series, count(DISTINCT channel) AS k, min(channel) AS o FROM owners GROUP BY 1),
    proj AS (SELECT series, channel FROM owners w WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.series = w.series AND c.f = w.channel AND c.f NOT IN (1, 8))
               AND NOT (series IN (SELECT series FROM excl) AND channel NOT IN (1, 8))
             UNION SELECT series, channel FROM dirs WHERE channel NOT IN (1, 8))"""


@query("check_proposal", f"""WITH {_PROPOSAL}
    SELECT 'exclusive_ownership' AS code, series FROM cnt WHERE k > 1
    UNION SELECT 'several_changes', series FROM changes GROUP BY series HAVING count(*) > 1
    UNION SELECT 'protected_change', series FROM changes WHERE series IN (SELECT series FROM held)
    UNION SELECT 'closed_channel_change', series FROM changes WHERE f = 8 OR g IN (1, 8)
    UNION SELECT 'not_assigned_to_source', series FROM changes c WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM owners w WHERE w.series = c.series AND w.channel = c.f)
    UNION SELECT 'already_assigned', series FROM changes WHERE action = 'assign' AND series IN (SELECT series FROM owners)
    UNION SELECT 'missing_directive', series FROM changes c WHERE g IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dirs d WHERE d.series = c.series AND d.channel = c.g)
    UNION SELECT 'removed_but_scheduled', series FROM changes WHERE action = 'remove' AND series IN (SELECT series FROM dirs)
    UNION SELECT 'closed_channel_directive', series FROM dirs WHERE channel IN (1, 8)
    UNION SELECT 'protected_directive', series FROM dirs WHERE series IN (SELECT series FROM held)
    UNION SELECT 'unassigned_series', series FROM dirs WHERE series NOT IN (SELECT series FROM changes) AND series NOT IN (SELECT series FROM owners)
    UNION SELECT 'ownership_conflict', d.series FROM dirs d LEFT JOIN changes c ON c.series = d.series LEFT JOIN cnt ON cnt.series = d.series
      WHERE CASE WHEN c.series IS NOT NULL THEN c.g WHEN cnt.k = 1 THEN cnt.o END <> d.channel
    UNION SELECT 'duplicate_exclusion', series FROM excl GROUP BY series HAVING count(*) > 1
    UNION SELECT 'protected_exclusion', series FROM excl WHERE series IN (SELECT series FROM held)
    UNION SELECT 'excluded_but_used', series FROM excl WHERE series IN (SELECT series FROM changes UNION SELECT series FROM dirs)
    UNION SELECT 'projected_ownership', series FROM proj GROUP BY series HAVING count(DISTINCT channel) > 1
    UNION SELECT 'exclusion_remains', series FROM proj WHERE channel NOT IN (1, 8) AND series IN (SELECT series FROM excl)""")
def _(t):
    return r.check_proposal(*_proposal(t))


def _shows(t):
    return t.read("part").select(F.concat_ws(" ", "p_name", F.lit("of"), "p_type", "p_partkey").alias("show"))


def _policy(t):
    """Channels with the words of their items' names as keywords."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    word = F.explode(F.split("p_name", " ")).alias("word")
    return t.read("part").select(number.alias("number"), F.col("p_brand").alias("name"), word).groupBy("number", "name").agg(
        F.array_sort(F.collect_set(F.initcap("word"))).alias("keywords")).withColumn("accepts_recommendations", F.col("number") % 4 != 0)


_RECOMMEND = """
    WITH shows AS (SELECT DISTINCT p_name || ' of ' || p_type || ' ' || p_partkey AS nm FROM part),
    words AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS number, p_brand AS name, unnest(string_split(p_name, ' ')) AS w FROM part),
    owned AS (SELECT lower(p_name || ' of ' || p_type || ' ' || p_partkey) AS k, CAST(1 AS BIGINT) AS owners FROM part WHERE p_partkey % 6 = 0),
    hits AS (SELECT nm, number, name, count(DISTINCT w) AS score, string_agg(DISTINCT upper(w[1]) || w[2:], ',' ORDER BY upper(w[1]) || w[2:]) AS matched FROM shows JOIN words ON contains(lower(nm), lower(w)) AND number % 4 <> 0 GROUP BY ALL),
    best AS (SELECT nm, arg_max(number, (score, -number)) AS channel, arg_max(name, (score, -number)) AS identity, max(score) AS score, arg_max(matched, (score, -number)) AS matched FROM hits GROUP BY 1)
    SELECT s.nm AS show, CASE WHEN o.k IS NULL THEN 'advisory' ELSE 'already_assigned' END AS status,
           CASE WHEN o.k IS NULL THEN b.channel END AS channel, CASE WHEN o.k IS NULL THEN b.identity END AS identity,
           CAST(CASE WHEN o.k IS NULL THEN coalesce(b.score, 0) ELSE 0 END AS BIGINT) AS score,
           CASE WHEN o.k IS NULL THEN CASE coalesce(b.score, 0) WHEN 0 THEN 'unclassified' WHEN 1 THEN 'low' ELSE 'medium' END END AS confidence,
           coalesce(o.owners, 0) AS owners, CASE WHEN o.k IS NULL THEN coalesce(b.matched, '') ELSE '' END AS matched_keywords,
           CASE WHEN o.k IS NULL THEN '' ELSE 'st' END AS channels
    FROM shows s LEFT JOIN owned o ON o.k = lower(s.nm) LEFT JOIN best b ON b.nm = s.nm"""


@query("recommend", _RECOMMEND)
def _(t):
    owners = t.read("part").filter("p_partkey % 6 = 0").select(F.concat_ws(" ", "p_name", F.lit("of"), "p_type", "p_partkey").alias("tag"), F.lit("st").alias("station"))
    found = r.recommend(_shows(t), _policy(t), owners)
    return found.withColumns({c: F.array_join(c, ",") for c in ("matched_keywords", "channels")})


_KEYWORDS = """
    WITH shows AS (SELECT DISTINCT p_name || ' of ' || p_type || ' ' || p_partkey AS nm FROM part),
    words AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS number, p_brand AS name, unnest(string_split(p_name, ' ')) AS w FROM part)
    SELECT nm AS show, number, name, upper(w[1]) || w[2:] AS keyword FROM shows JOIN words ON contains(lower(nm), w)"""


@query("keyword_join", _KEYWORDS)
def _(t):
    return r.keyword_hits(_shows(t), _policy(t))


@query("keyword_join_large", _KEYWORDS)
def _(t):
    """A policy in which each keyword is a row of its own."""
    words = _policy(t).select("number", "name", F.explode("keywords").alias("keyword"))
    return r.keyword_hits(_shows(t), words.select("number", "name", F.array("keyword").alias("keywords")))


_EFFECT = """
    WITH b AS (SELECT id, station, start_time, end_time, id % 2000 AS content_id, CASE WHEN id % 40 = 0 THEN 'LiquidClipBlock' ELSE 'LiquidBlock' END AS liquid_type, date_trunc('hour', start_time) AS h FROM blocks),
    req AS (SELECT DISTINCT station, h FROM b WHERE id % 3 = 0 UNION SELECT DISTINCT station, h - INTERVAL 30 DAY FROM b WHERE id % 1000 = 0),
    asked AS (SELECT station || strftime(h, '%Y%m%d%H') AS id, station, h, 'series ' || (epoch(h)::BIGINT // 3600 % 2) AS series FROM req),
    judged AS (
      SELECT a.id AS d, b.id, CASE WHEN liquid_type <> 'LiquidBlock' THEN 1 WHEN 'series ' || (epoch(b.h)::BIGINT // 3600 % 2 + CASE WHEN b.id % 30 = 0 THEN 1 ELSE 0 END) <> a.series THEN 2
          WHEN b.id % 70 = 0 OR b.id % 110 = 0 THEN 3 WHEN b.id % 25 = 0 THEN 4 WHEN 30 * 1000000 > epoch_us(end_time) - epoch_us(start_time) THEN 5 ELSE 0 END AS fault
      FROM asked a JOIN b ON b.station = a.station AND b.h = a.h),
    worst AS (SELECT d, count(DISTINCT id) AS n, min(fault) FILTER (WHERE fault > 0) AS fault FROM judged GROUP BY 1)
"""


def _effects(t):
    hour = F.date_trunc("hour", "start_time").cast("timestamp_ntz")
    blocks = t.blocks.select(
        "id", "station", "start_time", "end_time", F.col("id").alias("content_id"),
        F.when(F.col("id") % 40 == 0, F.lit("LiquidClipBlock")).otherwise("LiquidBlock").alias("liquid_type"))
    h = t.blocks.filter("id % 3 = 0").select("station", hour.alias("h")).union(
        t.blocks.filter("id % 1000 = 0").select("station", hour - F.expr("INTERVAL 30 DAYS"))).distinct()
    parity = (F.unix_date(F.col("h").cast("date")).cast("bigint") * 24 + F.hour("h")) % 2
    asked = h.select(
        F.concat("station", F.date_format("h", "yyyyMMddHH")).alias("id"), "station", F.col("h").cast("date").alias("date"), F.hour("h").alias("hour"),
        F.concat(F.lit("series "), parity).alias("series"))
    # each block's item carries the series of its hour, but for every 30th
    own = (F.unix_date(F.col("start_time").cast("date")).cast("bigint") * 24 + F.hour("start_time")) % 2 + F.when(F.col("id") % 30 == 0, 1).otherwise(0)
    items = t.blocks.select("id", "station", F.concat(F.lit("series "), own).alias("tag"), F.concat(F.lit("f"), "id").alias("path"), F.lit(None).cast("string").alias("realpath"))
    plan = t.blocks.select(F.col("id").alias("block_id"), F.posexplode(F.array(F.lit("feature"), F.lit("commercial")))).select(
        "block_id", F.col("pos").alias("position"), F.col("col").alias("content_type"),
        F.when((F.col("col") == "feature") & (F.col("block_id") % 70 == 0), 0.0).otherwise(15.0).alias("duration"),
        F.when((F.col("col") == "commercial") & (F.col("block_id") % 110 == 0), -1.0).otherwise(0.0).alias("skip"),
        F.when((F.col("col") == "feature") & (F.col("block_id") % 25 != 0), F.concat(F.lit("f"), "block_id")).otherwise("other").alias("path"))
    return asked, blocks, plan_timeline(plan), items


@query("effect_evidence", _EFFECT + """    SELECT a.id, CAST(coalesce(n, 0) AS BIGINT) AS blocks, CASE WHEN n IS NULL THEN 'no_blocks' WHEN fault IS NULL THEN 'proved'
       ELSE ['wrong_type','wrong_series','bad_timing','no_feature','plan_too_long'][fault] END AS status
    FROM asked a LEFT JOIN worst w ON w.d = a.id""")
def _(t):
    return r.effect_evidence(*_effects(t))


@query("effect_features", _EFFECT + """
    SELECT a.id, b.id AS block_id, epoch_us(b.start_time) AS start_us, epoch_us(b.start_time) + 15000000 AS end_us
    FROM asked a JOIN worst w ON w.d = a.id AND w.fault IS NULL JOIN b ON b.station = a.station AND b.h = a.h""")
def _(t):
    asked, blocks, timeline, items = _effects(t)
    return r.effect_features(r.effect_evidence(asked, blocks, timeline, items), asked, blocks, timeline)
