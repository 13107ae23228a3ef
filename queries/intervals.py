"""Interval queries over events shaped as schedule blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlog.functions.values import micros
from airlog.operators import intervals as iv
from airlog.operators.scan import HOUR_US
from queries.registry import query

NOON = "2024-01-15 12:00:00"

_SPANS = """
    scanned AS (
      SELECT *, max(to_us) OVER (PARTITION BY station ORDER BY start_us, end_us, id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM {cut}),
    spans AS (
      SELECT station, 'gap' AS kind, coalesce(before, seam_us) AS start_us, from_us AS end_us
      FROM scanned WHERE from_us > coalesce(before, seam_us)
      UNION ALL
      SELECT station, 'overlap', from_us, {overlap_end} FROM scanned WHERE from_us < before
      UNION ALL
      SELECT w.station, 'gap', coalesce(m.last_us, epoch_us(w.seam)), epoch_us(w.horizon)
      FROM {windows} w LEFT JOIN (SELECT station, max(to_us) AS last_us FROM {cut} GROUP BY 1) m
        ON m.station = w.station
      WHERE coalesce(m.last_us, epoch_us(w.seam)) < epoch_us(w.horizon))"""

CUT_BY_USER = """
    cut_by_user AS (
      SELECT b.station, b.id, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us,
             epoch_us(w.seam) AS seam_us, epoch_us(w.horizon) AS horizon_us,
             greatest(epoch_us(start_time), epoch_us(w.seam)) AS from_us,
             least(epoch_us(end_time), epoch_us(w.horizon)) AS to_us
      FROM blocks_by_user b JOIN windows_by_user w ON w.station = b.station
      WHERE start_time < w.horizon AND end_time > w.seam AND end_time > start_time)"""


def spans_sql(cut: str = "cut", windows: str = "windows", capped: bool = True) -> str:
    end = "least(before, to_us)" if capped else "before"
    return _SPANS.format(cut=cut, windows=windows, overlap_end=end)


_SUMMARY = """
    SELECT w.station,
           CAST(count(*) FILTER (WHERE s.kind = 'gap') AS BIGINT) AS gap_count,
           CAST(coalesce(sum(s.end_us - s.start_us) FILTER (WHERE s.kind = 'gap'), 0) AS BIGINT) AS gap_us,
           CAST(count(*) FILTER (WHERE s.kind = 'overlap') AS BIGINT) AS overlap_count,
           CAST(coalesce(sum(s.end_us - s.start_us) FILTER (WHERE s.kind = 'overlap'), 0) AS BIGINT) AS overlap_us,
           CAST(epoch_us(w.horizon) - epoch_us(w.seam)
             - coalesce(sum(s.end_us - s.start_us) FILTER (WHERE s.kind = 'gap'), 0) AS BIGINT) AS covered_us,
           epoch_us(w.horizon) - epoch_us(w.seam) AS interval_us
    FROM {windows} w LEFT JOIN spans s ON s.station = w.station
    GROUP BY w.station, w.seam, w.horizon"""


@query("blocks_in_window", """
    SELECT id, station, start_time, end_time FROM blocks
    WHERE start_time < TIMESTAMP '2024-01-20 06:00:00' AND end_time > TIMESTAMP '2024-01-13 06:00:00'""")
def _(t):
    found = iv.blocks_in_window(t.blocks, "2024-01-13 06:00:00", "2024-01-20 06:00:00")
    return found.select("id", "station", "start_time", "end_time")


@query("blocks_in_window_station", """
    SELECT id, station, start_time, end_time FROM blocks
    WHERE station = 'view' AND start_time < TIMESTAMP '2024-01-20 06:00:00'
      AND end_time > TIMESTAMP '2024-01-13 06:00:00'""")
def _(t):
    found = iv.blocks_in_window(t.blocks, "2024-01-13 06:00:00", "2024-01-20 06:00:00", "view")
    return found.select("id", "station", "start_time", "end_time")


@query("coverage", f"WITH {spans_sql()} {_SUMMARY.format(windows='windows')}")
def _(t):
    return iv.coverage(t.blocks, t.windows)


@query("coverage_by_user", f"""WITH {CUT_BY_USER}, {spans_sql('cut_by_user', 'windows_by_user')}
    {_SUMMARY.format(windows='windows_by_user')}""")
def _(t):
    return iv.coverage(t.blocks_by_user, t.windows_by_user)


@query("coverage_uncapped", f"WITH {spans_sql(capped=False)} {_SUMMARY.format(windows='windows')}")
def _(t):
    return iv.coverage(t.blocks, t.windows, overlap_cap=False)


@query("coverage_spans", f"WITH {spans_sql()} SELECT station, kind, start_us, end_us FROM spans")
def _(t):
    return iv.coverage_spans(t.blocks, t.windows)


@query("coverage_chunked", f"WITH {spans_sql()} {_SUMMARY.format(windows='windows')}")
def _(t):
    """The same coverage through bounded chunks, as used when one station outgrows a task."""
    return iv.coverage(t.blocks, t.windows, width=HOUR_US)


_COMPONENTS = """
    WITH marked AS (
      SELECT *, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us,
             max(epoch_us(end_time)) OVER (PARTITION BY station ORDER BY start_time, end_time, id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM blocks_by_user),
    labelled AS (
      SELECT *, max(CASE WHEN reach IS NULL OR start_us >= reach THEN start_us END)
                OVER (PARTITION BY station ORDER BY start_us, end_us, id) AS component_us
      FROM marked)
    SELECT station, component_us, CAST(count(*) AS BIGINT) AS n, max(end_us) AS end_us
    FROM labelled GROUP BY 1, 2"""


@query("overlap_components", _COMPONENTS)
def _(t):
    labelled = iv.components(t.blocks_by_user)
    return labelled.groupBy("station", "component_us").agg(
        F.count(F.lit(1)).alias("n"), F.max("end_us").alias("end_us"))


@query("overlap_components_chunked", _COMPONENTS)
def _(t):
    labelled = iv.components(t.blocks_by_user, width=HOUR_US)
    return labelled.groupBy("station", "component_us").agg(
        F.count(F.lit(1)).alias("n"), F.max("end_us").alias("end_us"))


@query("overlap_join_keyed", """
    SELECT a.id AS left_id, b.id AS right_id
    FROM baseline a JOIN proposed b ON a.station = b.station
      AND a.start_time < b.end_time AND a.end_time > b.start_time""")
def _(t):
    columns = ["id", "station", "start_time", "end_time"]
    pairs = iv.overlap_join(t.baseline.select(*columns), t.proposed.select(*columns), keys=["station"])
    return pairs.select(F.col("id").alias("left_id"), F.col("r_id").alias("right_id"))


@query("overlap_join_bucketed", """
    SELECT a.id AS left_id, b.id AS right_id
    FROM blocks a JOIN blocks b ON a.station <> b.station AND a.start_time < b.end_time AND a.end_time > b.start_time""")
def _(t):
    """Overlap between all stations, with no equality key but the time bucket."""
    blocks = t.blocks.select("id", "station", "start_time", "end_time")
    pairs = iv.overlap_join(blocks, blocks).filter("station <> r_station")
    return pairs.select(F.col("id").alias("left_id"), F.col("r_id").alias("right_id"))


@query("overlap_semi_join", """
    SELECT a.id FROM blocks_by_user a
    WHERE EXISTS (SELECT 1 FROM blocks_by_user b WHERE b.station = a.station AND b.id % 2 = 1
                  AND a.id % 2 = 0 AND b.start_time < a.end_time AND b.end_time > a.start_time)""")
def _(t):
    even, odd = t.blocks_by_user.filter("id % 2 = 0"), t.blocks_by_user.filter("id % 2 = 1")
    return iv.overlap_join(even, odd, keys=["station"], how="left_semi").select("id")


@query("exclude_overlapping", """
    SELECT c.id FROM blocks c
    WHERE c.station = 'view' AND NOT EXISTS (
      SELECT 1 FROM blocks b WHERE b.station <> 'view' AND b.content_id = c.content_id
        AND b.start_time < c.end_time AND b.end_time > c.start_time)""")
def _(t):
    """Blocks of one station whose item is not on a sibling at the same time."""
    mine, busy = t.blocks.filter("station = 'view'"), t.blocks.filter("station <> 'view'")
    return iv.exclude_overlapping(mine, busy, key="content_id").select("id")


@query("exclude_overlapping_chunked", """
    SELECT c.id FROM blocks c
    WHERE c.station = 'view' AND NOT EXISTS (
      SELECT 1 FROM blocks b WHERE b.station <> 'view' AND b.content_id = c.content_id
        AND b.start_time < c.end_time AND b.end_time > c.start_time)""")
def _(t):
    mine, busy = t.blocks.filter("station = 'view'"), t.blocks.filter("station <> 'view'")
    return iv.exclude_overlapping(mine, busy, key="content_id", width=HOUR_US).select("id")


def _probes(t):
    return t.blocks_by_user.select("station", F.col("start_time").alias("at")).union(
        t.blocks_by_user.select("station", F.col("end_time").alias("at"))).distinct()


_PROBES = """
    WITH probes AS (SELECT station, start_time AS at FROM blocks_by_user
                    UNION SELECT station, end_time FROM blocks_by_user)"""


@query("now_playing", f"""{_PROBES}
    SELECT p.station, epoch_us(p.at) AS at_us,
           (SELECT arg_min(b.id, (b.start_time, b.end_time, b.id)) FROM blocks_by_user b
            WHERE b.station = p.station AND b.start_time <= p.at AND b.end_time > p.at) AS block_id
    FROM probes p""")
def _(t):
    return iv.now_playing(t.blocks_by_user, _probes(t)).select("station", micros("at").alias("at_us"), "block_id")


@query("now_playing_closed", f"""{_PROBES}
    SELECT p.station, epoch_us(p.at) AS at_us,
           (SELECT arg_min(b.id, (b.start_time, b.end_time, b.id)) FROM blocks_by_user b
            WHERE b.station = p.station AND b.start_time <= p.at AND b.end_time >= p.at) AS block_id
    FROM probes p""")
def _(t):
    found = iv.now_playing(t.blocks_by_user, _probes(t), closed=True)
    return found.select("station", micros("at").alias("at_us"), "block_id")


@query("slot_grid", """
    WITH slots AS (
      SELECT s.station, u.at FROM (SELECT DISTINCT station FROM blocks_by_user) s,
             (SELECT unnest(generate_series(TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-16 23:30:00',
                                            INTERVAL 30 MINUTE)) AS at) u),
    hit AS (
      SELECT p.station, p.at, arg_min(b.title, (b.start_time, b.end_time, b.id)) AS title,
             min(b.start_time) AS start_time
      FROM slots p JOIN blocks_by_user b ON b.station = p.station AND b.start_time <= p.at AND b.end_time > p.at
      GROUP BY 1, 2)
    SELECT p.at, p.station, coalesce(h.title, 'Offair') AS title, coalesce(h.start_time < p.at, FALSE) AS continued
    FROM slots p LEFT JOIN hit h ON h.station = p.station AND h.at = p.at""")
def _(t):
    stations = t.blocks_by_user.select("station").distinct()
    return iv.slot_grid(t.blocks_by_user, stations, "2024-01-10 00:00:00", "2024-01-17 00:00:00")


@query("next_up", f"""
    WITH ahead AS (
      SELECT station, id, title, row_number() OVER (PARTITION BY station ORDER BY start_time, end_time, id) AS rank
      FROM blocks_by_user WHERE start_time > TIMESTAMP '{NOON}'),
    cur AS (
      SELECT station, min(start_time) AS s, arg_min(end_time, (start_time, end_time, id)) AS e,
             arg_min(id, (start_time, end_time, id)) AS id, arg_min(title, (start_time, end_time, id)) AS title
      FROM blocks_by_user WHERE start_time <= TIMESTAMP '{NOON}' AND end_time > TIMESTAMP '{NOON}' GROUP BY 1),
    nows AS (SELECT * FROM cur WHERE e - TIMESTAMP '{NOON}' > INTERVAL 5 MINUTE)
    SELECT station, CAST(0 AS INTEGER) AS rank, 'Now' AS label, id, title FROM nows
    UNION ALL
    SELECT a.station, CAST(a.rank AS INTEGER), NULL, a.id, a.title FROM ahead a LEFT JOIN nows n ON n.station = a.station
    WHERE a.rank <= CASE WHEN n.station IS NULL THEN 3 ELSE 2 END""")
def _(t):
    return iv.next_up(t.blocks_by_user, NOON)


@query("preview", f"""
    SELECT station, id, title, epoch_us(end_time) - greatest(epoch_us(start_time), epoch_us(TIMESTAMP '{NOON}')) AS width_us,
           start_time < TIMESTAMP '{NOON}' AS started_earlier,
           end_time > TIMESTAMP '{NOON}' + INTERVAL 90 MINUTE AS ends_later
    FROM blocks WHERE start_time < TIMESTAMP '{NOON}' + INTERVAL 90 MINUTE AND end_time > TIMESTAMP '{NOON}'""")
def _(t):
    return iv.preview(t.blocks, NOON)


@query("grid_layout", f"""
    WITH lim AS (SELECT epoch_us(TIMESTAMP '2024-01-10 00:00:00') AS lo, epoch_us(TIMESTAMP '2024-01-20 00:00:00') AS hi)
    SELECT station, id,
           round((greatest(epoch_us(start_time), lo) - lo) / (hi - lo) * 100, 6) AS left_pct,
           round((least(epoch_us(end_time), hi) - greatest(epoch_us(start_time), lo)) / (hi - lo) * 100, 6) AS width_pct,
           start_time <= TIMESTAMP '{NOON}' AND end_time > TIMESTAMP '{NOON}' AS current
    FROM blocks, lim WHERE epoch_us(start_time) < hi AND epoch_us(end_time) > lo""")
def _(t):
    return iv.grid_layout(t.blocks, "2024-01-10 00:00:00", "2024-01-20 00:00:00", NOON)


_LOOKAHEAD = """
    WITH tagged AS (
      SELECT id, station, start_time, end_time,
             CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'clip ' || title WHEN 2 THEN NULL
                         ELSE 'tag' || content_id END AS block_tag
      FROM blocks)
    SELECT station, id, block_tag,
           lead(block_tag, 1) OVER w AS next_1, lead(block_tag, 2) OVER w AS next_2, lead(block_tag, 3) OVER w AS next_3
    FROM tagged WINDOW w AS (PARTITION BY station ORDER BY start_time, end_time, id)"""


def _tagged(t):
    kinds = F.array(*[F.lit(k) for k in ("LiquidOffAirBlock", "LiquidClipBlock", "LiquidBlock", "LiquidBlock", "LiquidBlock")])
    kind = F.element_at(kinds, (F.col("id") % 5 + 1).cast("int"))
    tag = iv.block_tag(kind, F.concat(F.lit("clip "), "title"), F.concat(F.lit("tag"), "content_id"), F.col("id") % 5 == 2)
    return t.blocks.withColumn("block_tag", tag)


@query("lookahead", _LOOKAHEAD)
def _(t):
    return iv.lookahead(_tagged(t)).select("station", "id", "block_tag", "next_1", "next_2", "next_3")


@query("lookahead_chunked", _LOOKAHEAD)
def _(t):
    return iv.lookahead(_tagged(t), width=HOUR_US).select("station", "id", "block_tag", "next_1", "next_2", "next_3")


@query("seam", f"""
    SELECT station,
           CAST(count(*) FILTER (WHERE start_time < TIMESTAMP '{NOON}' AND end_time > TIMESTAMP '{NOON}') AS BIGINT) AS crossing_start,
           CAST(count(*) FILTER (WHERE start_time < TIMESTAMP '2024-01-22 06:00:00'
                            AND end_time > TIMESTAMP '2024-01-22 06:00:00') AS BIGINT) AS crossing_end,
           coalesce(max(end_time) FILTER (WHERE start_time < TIMESTAMP '{NOON}' AND end_time > TIMESTAMP '{NOON}'),
                    TIMESTAMP '{NOON}') AS regeneration_start,
           greatest(max(end_time), TIMESTAMP '2024-01-22 06:00:00') AS effective_horizon
    FROM blocks_by_user GROUP BY 1""")
def _(t):
    return iv.seam(t.blocks_by_user, NOON, "2024-01-22 06:00:00")


@query("low_horizon", """
    WITH ends AS (SELECT station, arg_max(end_time, (start_time, end_time, id)) AS schedule_end
                  FROM blocks_by_user GROUP BY 1)
    SELECT s.station, e.schedule_end
    FROM (SELECT CAST(c_custkey AS VARCHAR) AS station FROM customer) s LEFT JOIN ends e ON e.station = s.station
    WHERE e.schedule_end IS NULL OR e.schedule_end < TIMESTAMP '2024-01-30 00:00:00'""")
def _(t):
    stations = t.read("customer").select(F.col("c_custkey").cast("string").alias("station"))
    return iv.low_horizon(t.blocks_by_user, stations, "2024-01-29 00:00:00", 24)
