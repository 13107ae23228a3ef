"""Plan, segment and sequence queries over orders and line items shaped as playout plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlog.operators import sequences as sq
from airlog.operators.scan import DAY_US, numbered, numbered_by_digits
from airlog.plans import breaks, playout, segments as sg
from queries.registry import query

ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]

_TIMELINE = """
    timeline AS (
      SELECT block_id, l_partkey,
             CAST(row_number() OVER w - 1 AS BIGINT) AS entry,
             CAST(sum(CAST(round(duration * 1000000) AS BIGINT)) OVER w AS BIGINT) AS until_us,
             CAST(sum(CAST(round(duration * 1000000) AS BIGINT)) OVER w AS BIGINT) - CAST(round(duration * 1000000) AS BIGINT) AS from_us
      FROM plan_entries
      WINDOW w AS (PARTITION BY block_id ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))"""


@query("plan_timeline", f"WITH {_TIMELINE} SELECT block_id, entry, l_partkey, from_us, until_us FROM timeline")
def _(t):
    return playout.plan_timeline(t.plan_entries, order=ORDER).select(
        "block_id", "entry", "l_partkey", "from_us", "until_us")


@query("play_point", f"""WITH {_TIMELINE},
    probes AS (SELECT station, start_time + to_microseconds(CAST(seconds * 500000 AS BIGINT)) AS at FROM plan_blocks
               UNION SELECT station, end_time FROM plan_blocks),
    hit AS (SELECT p.station, p.at, arg_min(b.id, (b.start_time, b.end_time, b.id)) AS block_id, min(b.start_time) AS start_time
            FROM probes p LEFT JOIN plan_blocks b ON b.station = p.station AND b.start_time <= p.at AND b.end_time > p.at
            GROUP BY 1, 2)
    SELECT h.station, h.at, h.block_id, t.entry AS index, epoch_us(h.at) - epoch_us(h.start_time) - t.from_us AS offset_us
    FROM hit h LEFT JOIN timeline t ON t.block_id = h.block_id
      AND t.from_us <= epoch_us(h.at) - epoch_us(h.start_time) AND epoch_us(h.at) - epoch_us(h.start_time) < t.until_us""")
def _(t):
    middle = F.col("start_time") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.col("seconds") * 0.5).cast("decimal(18,6)"))
    probes = t.plan_blocks.select("station", middle.alias("at")).union(
        t.plan_blocks.select("station", F.col("end_time").alias("at"))).distinct()
    return playout.play_point(t.plan_blocks, playout.plan_timeline(t.plan_entries, order=ORDER), probes)


def _points(t):
    seq = (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    return t.read("lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), seq.alias("seq"), (F.col("l_quantity") * 10).alias("chapter_start"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity") * 10 + 5).alias("chapter_end"))


def _files(t):
    return t.read("orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(600.0).alias("duration"))


_SEGMENTS = """
    points AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS path, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey AS seq,
             l_quantity * 10 AS chapter_start, CASE WHEN l_partkey % 3 = 0 THEN l_quantity * 10 + 5 END AS chapter_end
      FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
    marks AS (SELECT * FROM points UNION ALL SELECT path, -1, 0.0, min(chapter_start) FROM points GROUP BY path HAVING min(chapter_start) > 0),
    nexts AS (SELECT *, coalesce(lead(chapter_start) OVER (PARTITION BY path ORDER BY chapter_start, seq), 600.0) AS until FROM marks),
    segs AS (SELECT path, seq, chapter_start, coalesce(chapter_end, until) AS chapter_end, until - chapter_start AS segment_duration FROM nexts)"""


@query("segments", f"WITH {_SEGMENTS} SELECT path, seq, chapter_start, chapter_end, segment_duration FROM segs")
def _(t):
    return sg.segments(_points(t), _files(t))


_THIN = f"""WITH {_SEGMENTS},
    placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY chapter_start, seq) - 1 AS idx, count(*) OVER (PARTITION BY path) AS n FROM segs),
    chosen AS (SELECT path, 0 AS idx FROM placed GROUP BY path
               UNION SELECT path, CAST(round_even(i * ((n - 1) / 2.0), 0) AS BIGINT)
               FROM (SELECT DISTINCT path, n FROM placed WHERE n > 3), (SELECT unnest([1, 2]) AS i)),
    kept AS (SELECT p.* FROM placed p WHERE n <= 3 OR EXISTS (SELECT 1 FROM chosen c WHERE c.path = p.path AND c.idx = p.idx))
    SELECT k.path, k.chapter_start,
           CASE WHEN n <= 3 THEN k.chapter_end
                ELSE coalesce(lead(k.chapter_start) OVER (PARTITION BY k.path ORDER BY k.idx), l.e) END AS chapter_end
    FROM kept k JOIN (SELECT path, arg_max(chapter_end, (chapter_start, seq)) AS e FROM segs GROUP BY 1) l ON l.path = k.path"""


@query("thin_segments", _THIN)
def _(t):
    return sg.thin_segments(sg.segments(_points(t), _files(t)), 3)


@query("thin_segments_chunked", _THIN)
def _(t):
    cut = sg.segments(_points(t), _files(t), width=60)
    return sg.thin_segments(cut, 3, width=60, positions=2)


@query("merge_short_segments", f"""WITH RECURSIVE {_SEGMENTS},
    folds AS (
      SELECT path, list(seq ORDER BY chapter_start, seq) AS seqs, list(chapter_start ORDER BY chapter_start, seq) AS starts,
             list(segment_duration ORDER BY chapter_start, seq) AS lens, 0 AS folded FROM segs GROUP BY path
      UNION ALL
      SELECT path, list_slice(seqs, 1, n - 1) || list_slice(seqs, n + 1, len(seqs)),
             list_slice(starts, 1, n - 1) || list_slice(starts, n + 1, len(starts)),
             list_slice(lens, 1, n - 2) || [lens[n - 1] + lens[n]] || list_slice(lens, n + 1, len(lens)), folded + 1
      FROM (SELECT *, list_position(lens[2:], list_min(lens[2:])) + 1 AS n FROM folds WHERE list_min(lens[2:]) < 60)),
    done AS (SELECT path, arg_max((seqs, starts, lens), folded) AS f FROM folds GROUP BY path),
    kept AS (SELECT path, unnest(f[1]) AS seq, unnest(f[2]) AS chapter_start, unnest(f[3]) AS segment_duration FROM done)
    SELECT path, seq, chapter_start, chapter_start + segment_duration AS chapter_end, segment_duration FROM kept""")
def _(t):
    return sg.merge_short(sg.segments(_points(t), _files(t)))


@query("black_segments", """
    WITH marks AS (
      SELECT CAST(l_orderkey AS VARCHAR) AS path, (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 10000 + l_suppkey AS line_no,
             l_quantity * 15 + 0.25 AS midpoint
      FROM lineitem WHERE l_partkey % 10 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)
        AND l_quantity * 15 + 0.25 > 60 AND l_quantity * 15 + 0.25 < 540),
    pieces AS (SELECT path, line_no AS seq, coalesce(lag(midpoint) OVER (PARTITION BY path ORDER BY line_no), 0.0) AS chapter_start, midpoint AS chapter_end FROM marks
            UNION ALL SELECT path, max(line_no) + 1, arg_max(midpoint, line_no), 600.0 FROM marks GROUP BY path),
    marked AS (SELECT * FROM pieces UNION ALL SELECT path, -1, 0.0, min(chapter_start) FROM pieces GROUP BY path HAVING min(chapter_start) > 0)
    SELECT path, seq, chapter_start, chapter_end,
           coalesce(lead(chapter_start) OVER (PARTITION BY path ORDER BY chapter_start, seq), 600.0) - chapter_start AS segment_duration
    FROM marked""")
def _(t):
    at = F.col("l_quantity") * 15
    seq = (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    line = F.when(F.col("l_partkey") % 10 == 0, F.concat(F.lit("[blackdetect @ 0x55] black_start:"), at)).otherwise(
        F.concat(F.lit("[blackdetect @ 0x55] black_start:"), at, F.lit(" black_end:"), at + 0.5, F.lit(" black_duration:0.5")))
    log = t.read("lineitem").select(F.col("l_orderkey").cast("string").alias("path"), seq.alias("line_no"), line.alias("line"))
    return sg.black_segments(log, _files(t))


def _bases(t):
    n = F.col("o_orderkey")
    return t.read("orders").select(
        n.alias("block_id"), F.concat(F.lit("clip"), n).alias("path"), F.lit(0.0).alias("offset"),
        (n % 50 * 60 + 60).cast("double").alias("duration"), (n % 50 * 60 + 60).cast("double").alias("clip_duration"),
        F.get(F.array(F.lit("standard"), F.lit("end"), F.lit("center"), F.lit("standard")), (n % 4).cast("int")).alias("strategy"),
        F.when(n % 3 == 0, F.lit("pre")).alias("start_bump"), F.lit(5.0).alias("start_bump_seconds"),
        F.when(n % 7 == 0, F.lit("post")).alias("end_bump"), F.lit(6.0).alias("end_bump_seconds"))


def _reels(t):
    placed = numbered(t.plan_entries, ["block_id"], ORDER, "n")
    return placed.select(
        "block_id", (F.col("n") - 1).alias("reel_no"), F.lit(0).alias("entry_no"),
        F.concat(F.lit("ad"), F.col("l_partkey")).alias("path"), F.col("duration"), F.lit("commercial").alias("content_type"))


_BREAK_BASE = """
    base AS (
      SELECT o_orderkey AS block_id, 'clip' || o_orderkey AS path, CAST(o_orderkey % 50 * 60 + 60 AS DOUBLE) AS duration,
             ['standard', 'end', 'center', 'standard'][o_orderkey % 4 + 1] AS strategy FROM orders),
    reel AS (
      SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r,
             'ad' || l_partkey AS path, duration FROM plan_entries WHERE block_id IN (SELECT block_id FROM base)),
    counted AS (SELECT b.*, coalesce(c.n, 0) AS n FROM base b LEFT JOIN (SELECT block_id, count(*) AS n FROM reel GROUP BY 1) c
                ON c.block_id = b.block_id),
    bumps AS (
      SELECT block_id, -2 AS k, 0 AS m, 'pre' AS path, 0.0 AS skip, 5.0 AS duration FROM base WHERE block_id % 3 = 0
      UNION ALL SELECT block_id, 1099511627776, 0, 'post', 0.0, 6.0 FROM base WHERE block_id % 7 = 0)"""


@query("assemble_plan", f"""WITH {_BREAK_BASE},
    mode AS (SELECT *, CASE WHEN strategy = 'center' THEN 'center' WHEN n <= 1 OR strategy = 'end' THEN 'whole'
                            WHEN block_id % 5 = 0 THEN 'cuts' ELSE 'even' END AS mode FROM counted),
    content AS (
      SELECT block_id, 0 AS k, 0 AS m, path, 0.0 AS skip, duration FROM mode WHERE mode = 'whole'
      UNION ALL SELECT block_id, 0, 0, path, 0.0, duration / 2 FROM mode WHERE mode = 'center'
      UNION ALL SELECT block_id, 1000000, 0, path, duration / 2, duration / 2 FROM mode WHERE mode = 'center'
      UNION ALL SELECT block_id, i * 2, 0, path, duration / n * i, duration / n
        FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM mode WHERE mode = 'even')
      UNION ALL SELECT block_id, i * 2, 0, path, duration / 4 * i, duration / 4 * (i + 1) - duration / 4 * i
        FROM (SELECT *, unnest([0, 1, 2]) AS i FROM mode WHERE mode = 'cuts')),
    filler AS (
      SELECT r.block_id, CASE WHEN m.mode IN ('cuts', 'even') THEN r.r * 2 + 1 ELSE r.r + 1 END AS k, 0 AS m, r.path, 0.0 AS skip, r.duration
      FROM reel r JOIN mode m ON m.block_id = r.block_id),
    every AS (SELECT * FROM content UNION ALL SELECT * FROM filler UNION ALL SELECT * FROM bumps)
    SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY k, m) AS BIGINT) AS position, path,
           round(skip, 6) AS skip, round(duration, 6) AS duration FROM every""")
def _(t):
    cuts = _bases(t).filter("block_id % 5 = 0").select("block_id", "duration", F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seg_no", "i"))
    quarter = F.col("duration") / 4
    cuts = cuts.select("block_id", "seg_no", (quarter * F.col("i")).alias("chapter_start"), (quarter * (F.col("i") + 1)).alias("chapter_end"))
    plan = breaks.assemble_plan(_bases(t), _reels(t), cuts)
    placed = numbered(plan, ["block_id"], ["major", "minor"], "position")
    return placed.select("block_id", "position", "path", F.round("skip", 6).alias("skip"), F.round("duration", 6).alias("duration"))


@query("assemble_clip_plan", f"""WITH {_BREAK_BASE},
    clip AS (SELECT block_id, CAST(unnest(generate_series(0, block_id % 6)) AS BIGINT) AS i FROM base),
    sized AS (SELECT *, block_id % 6 + 1 AS k FROM counted),
    slots AS (
      SELECT s.block_id, s.strategy, s.k, s.n, c.i,
             CASE WHEN s.k > s.n THEN CASE WHEN c.i > 0 AND c.i % CAST(round_even(s.k / s.n::DOUBLE, 0) AS BIGINT) = 0 THEN 1 ELSE 0 END
                  ELSE s.n // (s.k + 1) + CASE WHEN c.i < s.n % (s.k + 1) THEN 1 ELSE 0 END END AS take
      FROM sized s JOIN clip c ON c.block_id = s.block_id WHERE s.n > 1 AND s.strategy = 'standard'),
    cum AS (SELECT *, sum(take) OVER (PARTITION BY block_id ORDER BY i) AS upto FROM slots),
    placed AS (
      SELECT r.block_id, r.path, r.duration, r.r,
             CASE WHEN s.n <= 1 OR s.strategy = 'end' THEN s.k WHEN s.strategy = 'center' THEN s.k // 2 - 1
                  ELSE coalesce((SELECT min(c.i) FROM cum c WHERE c.block_id = r.block_id AND c.upto > r.r), s.k) END AS after
      FROM reel r JOIN sized s ON s.block_id = r.block_id),
    every AS (
      SELECT block_id, i * 2 AS k, 0 AS m, 'c' || i AS path, 0.0 AS skip, 30.0 AS duration FROM clip
      UNION ALL SELECT block_id, after * 2 + 1, r, path, 0.0, duration FROM placed
      UNION ALL SELECT * FROM bumps)
    SELECT block_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY k, m) AS BIGINT) AS position, path, CAST(duration AS DOUBLE) AS duration FROM every""")
def _(t):
    clips = _bases(t).select("block_id", F.explode(F.sequence(F.lit(0), F.col("block_id") % 6)).alias("clip_no")).select(
        "block_id", "clip_no", F.concat(F.lit("c"), "clip_no").alias("path"), F.lit(30.0).alias("duration"), F.lit("feature").alias("content_type"))
    plan = breaks.assemble_clip_plan(_bases(t), clips, _reels(t))
    placed = numbered(plan, ["block_id"], ["major", "minor"], "position")
    return placed.select("block_id", "position", "path", "duration")


@query("plan_end", f"""WITH {_BREAK_BASE}
    SELECT b.block_id, CAST(c.entries + b.n + CASE WHEN b.block_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN b.block_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS entries,
           round(b.duration + coalesce(r.s, 0) + CASE WHEN b.block_id % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN b.block_id % 7 = 0 THEN 6 ELSE 0 END, 3) AS seconds
    FROM counted b LEFT JOIN (SELECT block_id, sum(duration) AS s FROM reel GROUP BY 1) r ON r.block_id = b.block_id,
         LATERAL (SELECT CASE WHEN b.strategy = 'center' THEN 2 WHEN b.n <= 1 OR b.strategy = 'end' THEN 1 ELSE b.n END AS entries) c""")
def _(t):
    ended = breaks.plan_end(breaks.assemble_plan(_bases(t), _reels(t)))
    return ended.select("block_id", "entries", F.round("seconds", 3).alias("seconds"))


# ---- sequences -----------------------------------------------------------------------------


def _episodes(t):
    return t.parts_as_items.select("station", F.col("path").alias("fpath"), "id")


def _sequences(t):
    return t.parts_as_items.select("station").distinct().select("station", F.lit(0.25).alias("start_perc"), F.lit(0.75).alias("end_perc"))


_AIRINGS = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ASSIGN_FROM = """
    WITH eps AS (SELECT station, path, row_number() OVER (PARTITION BY station ORDER BY path, id) - 1 AS episode_index,
                        count(*) OVER (PARTITION BY station) AS n FROM items),
    bounds AS (SELECT DISTINCT station, START AS s, CAST(floor(0.75 * n) AS BIGINT) AS e FROM eps),
    aired AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM plays),
    chosen AS (SELECT a.*, CASE WHEN k < greatest(e - s, 0) THEN s + k WHEN e = 0 THEN 0 ELSE (k - greatest(e - s, 0)) % e END AS episode_index
               FROM aired a JOIN bounds b ON b.station = a.station)
    SELECT c.station, c.l_orderkey, c.l_linenumber, c.l_partkey, c.l_suppkey, c.episode_index, e.path AS fpath
    FROM chosen c JOIN eps e ON e.station = c.station AND e.episode_index = c.episode_index"""
_ASSIGN = _ASSIGN_FROM.replace("START", "CAST(floor(0.25 * n) AS BIGINT)")


@query("assign_episodes", _ASSIGN)
def _(t):
    aired = sq.assign_episodes(t.plays, _sequences(t), _episodes(t), _AIRINGS, keys=["station"])
    return aired.select("station", *_AIRINGS[1:], "episode_index", "fpath")


@query("assign_episodes_chunked", _ASSIGN)
def _(t):
    aired = sq.assign_episodes(t.plays, _sequences(t), _episodes(t), _AIRINGS, keys=["station"], width=30 * DAY_US)
    return aired.select("station", *_AIRINGS[1:], "episode_index", "fpath")


@query("assign_episodes_random_start", _ASSIGN_FROM.replace(
    "START", "coalesce(('0x' || md5('42:' || station)[:15])::BIGINT % nullif(CAST(floor(0.75 * n) AS BIGINT), 0), 0)"))
def _(t):
    """A negative start fraction starts at a seeded random episode."""
    anywhere = _sequences(t).withColumn("start_perc", F.lit(-1.0))
    aired = sq.assign_episodes(t.plays, anywhere, _episodes(t), _AIRINGS, keys=["station"], seed=42)
    return aired.select("station", *_AIRINGS[1:], "episode_index", "fpath")


@query("number_hot_keys", """
    SELECT l_returnflag AS station, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus, l_shipdate, l_partkey, l_orderkey, l_linenumber, l_suppkey) AS n
    FROM lineitem""")
def _(t):
    """Positions of line items in three keys, each cut into parts of at most 500 rows by digits of the sort key."""
    items = t.read("lineitem").withColumnRenamed("l_returnflag", "station")
    order = ["l_linestatus", "l_shipdate", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"]
    return numbered_by_digits(items, ["station"], order, "n", crowd=500).select(
        "station", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n")


@query("rewind_cursors", """
    WITH eps AS (SELECT station, path, row_number() OVER (PARTITION BY station ORDER BY path, id) - 1 AS i FROM items),
    ahead AS (SELECT station, arg_min(path, (ts, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS path
              FROM plays WHERE ts >= TIMESTAMP '1999-06-01 00:00:00' GROUP BY 1)
    SELECT a.station, e.i AS current_index FROM ahead a JOIN eps e ON e.station = a.station AND e.path = a.path""")
def _(t):
    blocks = t.plays.select(
        "station", "path", F.col("ts").alias("start_time"), F.lit(0).alias("end_time"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"))
    positions = numbered_by_digits(_episodes(t), ["station"], ["fpath", "id"], "n").select(
        "station", "fpath", (F.col("n") - 1).alias("sequence_index"))
    return sq.rewind_cursors(blocks, positions, "1999-06-01 00:00:00", keys=["station"])


@query("resync_cursor", """
    WITH old AS (SELECT station, path, row_number() OVER (PARTITION BY station ORDER BY path) - 1 AS i FROM (SELECT DISTINCT station, path FROM items WHERE id % 5 <> 0)),
    new AS (SELECT station, path, row_number() OVER (PARTITION BY station ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY station) AS n
            FROM (SELECT DISTINCT station, path FROM items WHERE id % 4 <> 0)),
    cur AS (SELECT station, CAST(CAST(regexp_extract(station, '(\\d+)', 1) AS INTEGER) * 4 AS BIGINT) AS c FROM (SELECT DISTINCT station FROM items))
    SELECT cur.station, coalesce(n.i, CASE WHEN cur.c < s.n THEN cur.c END, 0) AS current_index
    FROM cur LEFT JOIN old o ON o.station = cur.station AND o.i = cur.c
    LEFT JOIN new n ON n.station = cur.station AND n.path = o.path
    LEFT JOIN (SELECT DISTINCT station, n FROM new) s ON s.station = cur.station""".replace("\\\\", "\\"))
def _(t):
    before = t.parts_as_items.filter("id % 5 <> 0").select("station", F.col("path").alias("fpath")).distinct()
    old = numbered_by_digits(before, ["station"], ["fpath"], "n").select("station", "fpath", (F.col("n") - 1).alias("sequence_index"))
    new = t.parts_as_items.filter("id % 4 <> 0").select("station", F.col("path").alias("fpath"))
    cursors = t.parts_as_items.select("station").distinct().withColumn(
        "current_index", F.regexp_extract("station", r"(\d+)", 1).cast("bigint") * 4)
    return sq.resync_cursor(cursors, old, new, keys=["station"])


@query("fill_continued", """
    WITH slots AS (
      SELECT 'st' || o_custkey AS station, isodow(o_orderdate) - 1 AS d, o_orderkey % 24 AS h, min(o_orderkey) AS k FROM orders GROUP BY 1, 2, 3),
    s AS (SELECT *, (h + 18) % 24 AS bh, CASE WHEN k % 3 <> 0 THEN 'tag' || k END AS tags, k % 3 = 0 AND k % 2 = 0 AS continued FROM slots),
    f AS (SELECT *, last_value(tags IGNORE NULLS) OVER (PARTITION BY station ORDER BY d, bh) AS held FROM s)
    SELECT station, d AS weekday, h AS hour, CASE WHEN tags IS NULL AND continued THEN held ELSE tags END AS tags,
           CASE WHEN tags IS NULL AND continued AND held IS NULL THEN 'no_preceding_tags' END AS error FROM f""")
def _(t):
    from airlog.functions.calendar import weekday_name

    slots = t.read("orders").groupBy(
        F.concat(F.lit("st"), "o_custkey").alias("station"), weekday_name("o_orderdate").alias("day"),
        F.weekday("o_orderdate").alias("weekday"), (F.col("o_orderkey") % 24).alias("hour")).agg(F.min("o_orderkey").alias("k"))
    slots = slots.withColumns({
        "tags": F.when(F.col("k") % 3 != 0, F.concat(F.lit("tag"), "k")), "continued": (F.col("k") % 3 == 0) & (F.col("k") % 2 == 0)})
    return sq.fill_continued(slots).select("station", "weekday", "hour", "tags", "error")
