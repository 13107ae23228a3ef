"""Schedules as interval tables: windows, coverage, overlaps, and what is on at a time.

A block table has station, id, start_time, end_time (naive timestamps). Intervals are half-open
unless an operator says otherwise; comparisons use exact microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from airlog.functions.values import from_micros, micros, seconds_interval, with_micros
from airlog.operators.scan import DAY_US, OrderedScan, Running, spread
from airlog.operators.tiles import in_tiles


# ---- filters -------------------------------------------------------------------------------


def blocks_in_window(blocks: DataFrame, lo, hi, station: str | None = None) -> DataFrame:
    """Blocks overlapping [lo, hi), for one station or all. Both bounds reach the scan."""
    found = blocks.filter((F.col("start_time") < _ntz(hi)) & (F.col("end_time") > _ntz(lo)))
    return found if station is None else found.filter(F.col("station") == station)


def _ntz(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


# ---- coverage ------------------------------------------------------------------------------


def clipped(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """Blocks of each window's station cut to [seam, horizon); empty pieces are dropped.

    The outermost bounds of all windows are applied to the raw columns first, so that a scan skips what no window needs.
    """
    latest, earliest = windows.agg(F.max("horizon")).scalar(), windows.agg(F.min("seam")).scalar()
    blocks = blocks.filter((F.col("start_time") < latest) & (F.col("end_time") > earliest))
    bounds = windows.select(
        F.col("station").alias("w_station"),
        micros("seam").alias("seam_us"),
        micros("horizon").alias("horizon_us"),
    )
    inside = with_micros(blocks).join(bounds, F.col("station") == F.col("w_station")).drop("w_station")
    cut = inside.withColumns(
        {
            "from_us": F.greatest("start_us", "seam_us"),
            "to_us": F.least("end_us", "horizon_us"),
        }
    )
    return cut.filter("to_us > from_us")


def coverage_spans(
    blocks: DataFrame,
    windows: DataFrame,
    overlap_cap: bool = True,
    width: int = DAY_US,
) -> DataFrame:
    """Every gap and overlap as (station, kind, start_us, end_us).

    A capped overlap ends where the earlier of the two blocks ends; an uncapped one always ends
    where the blocks before it end.
    """
    cut = clipped(blocks, windows).select(
        "station", "id", "start_us", "end_us", "from_us", "to_us", "seam_us", "horizon_us"
    )
    scan = OrderedScan(cut, ["station"], ["start_us", "end_us", "id"], width)
    seen = scan.running(Running("before", "max", F.col("to_us"), inclusive=False)).result()
    covered_to = F.coalesce("before", "seam_us")
    overlap_end = F.least("before", "to_us") if overlap_cap else F.col("before")
    inner = seen.select(
        "station",
        F.when(F.col("from_us") > covered_to, "gap").when(F.col("from_us") < F.col("before"), "overlap").alias("kind"),
        F.least(covered_to, F.col("from_us")).alias("start_us"),
        F.when(F.col("from_us") > covered_to, F.col("from_us")).otherwise(overlap_end).alias("end_us"),
        F.col("from_us").alias("at_us"),
    ).filter("kind IS NOT NULL")
    inner = inner.withColumn("start_us", F.when(F.col("kind") == "gap", F.col("start_us")).otherwise(F.col("at_us")))
    last = cut.groupBy("station").agg(F.max("to_us").alias("last_us"))
    tail = (
        windows.select("station", micros("seam").alias("seam_us"), micros("horizon").alias("horizon_us"))
        .join(last, "station", "left")
        .withColumn("start_us", F.coalesce("last_us", "seam_us"))
        .filter("start_us < horizon_us")
        .select("station", F.lit("gap").alias("kind"), "start_us", F.col("horizon_us").alias("end_us"))
    )
    return inner.select("station", "kind", "start_us", "end_us").unionByName(tail)


def coverage_summary(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Covered time, and the count and length of gaps and overlaps, of every window."""
    length = F.col("end_us") - F.col("start_us")

    def of(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))

    found = spans.groupBy("station").agg(
        of("gap", F.lit(1)).alias("gap_count"),
        of("gap", length).alias("gap_us"),
        of("overlap", F.lit(1)).alias("overlap_count"),
        of("overlap", length).alias("overlap_us"),
    )
    counts = ["gap_count", "gap_us", "overlap_count", "overlap_us"]
    return (
        windows.select("station", (micros("horizon") - micros("seam")).alias("interval_us"))
        .join(found, "station", "left")
        .select(
            "station",
            *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
            (F.col("interval_us") - F.coalesce("gap_us", F.lit(0))).alias("covered_us"),
            "interval_us",
        )
    )


def coverage(blocks: DataFrame, windows: DataFrame, overlap_cap: bool = True, width: int = DAY_US) -> DataFrame:
    return coverage_summary(coverage_spans(blocks, windows, overlap_cap, width), windows)


def components(
    blocks: DataFrame,
    keys: Sequence[str] = ("station",),
    tie: Sequence[str] = ("id",),
    width: int = DAY_US,
) -> DataFrame:
    """Label maximal runs of overlapping blocks with the start of the run (component_us).

    A bucket of the order tells how far it reaches and where a run last begins in it, seen alone. That begin is a true one if
    nothing before the bucket reaches past it, so a window over the buckets gives each of them what the earlier ones carry in:
    their reach and the run that is open. Both enter as the first row of the bucket, and one window over the rows does the rest.
    """
    return components_in_buckets(blocks, keys, tie, width).drop("_bucket")


def components_in_buckets(blocks: DataFrame, keys: Sequence[str], tie: Sequence[str], width: int) -> DataFrame:
    """components() with the _bucket of each row, by which and the keys the rows are partitioned."""
    order, place = ["start_us", "end_us", *tie], [*keys, "_bucket"]
    timed = with_micros(blocks).withColumn("_bucket", F.floor(F.col("start_us") / F.lit(width)))
    opens = F.col("_reach").isNull() | (F.col("start_us") >= F.col("_reach"))
    rows = Window.partitionBy(*place).orderBy(*order)
    alone = spread(timed, *place).withColumn("_reach", F.max("end_us").over(rows.rowsBetween(Window.unboundedPreceding, -1)))
    buckets = alone.groupBy(*place).agg(
        F.max("end_us").alias("_end"), F.max(F.when(opens, F.col("start_us"))).alias("_begin"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = buckets.withColumn("_before", F.max("_end").over(earlier))
    begins = F.when(F.col("_before").isNull() | (F.col("_begin") >= F.col("_before")), F.col("_begin"))
    carried = reached.withColumn("_open", F.max(begins).over(earlier)).filter(F.col("_before").isNotNull()).select(
        *place, F.col("_before").alias("end_us"), "_open", F.lit(0).alias("_real"))
    both = spread(timed.withColumn("_real", F.lit(1)).unionByName(carried, allowMissingColumns=True), *place)
    scan = Window.partitionBy(*place).orderBy("_real", *order)
    seen = both.withColumn("_reach", F.max("end_us").over(scan.rowsBetween(Window.unboundedPreceding, -1)))
    begun = F.when(F.col("_real") == 0, F.col("_open")).when(opens, F.col("start_us"))
    labelled = seen.withColumn("component_us", F.max(begun).over(scan.rowsBetween(Window.unboundedPreceding, 0)))
    return labelled.filter("_real = 1").drop("_reach", "_open", "_real")


# ---- overlap joins -------------------------------------------------------------------------


#: A cell is so many times as wide as one of the level below; the widest are under this many microseconds.
FANOUT, WIDEST = 8, 1 << 61


def _widths(finest: int) -> list[int]:
    return [finest * FANOUT ** k for k in range(64) if k == 0 or finest * FANOUT ** k < WIDEST]


def _width_of(level: str, finest: int) -> Column:
    return F.get(F.array(*map(F.lit, _widths(finest))), F.col(level))


def in_cells(df: DataFrame, finest: int) -> DataFrame:
    """Rows (_level, _cell) for every interval that is not empty: the cells it touches on the first level whose cells are as long as it.

    There are two of them at most (below the last level, whose cells are thousands of years wide).
    """
    widths, length = _widths(finest), F.col("end_us") - F.col("start_us")
    level = F.least(F.size(F.filter(F.array(*map(F.lit, widths)), lambda w: w < length)), F.lit(len(widths) - 1))
    width = _width_of("_level", finest)
    sized = df.filter("end_us > start_us").withColumn("_level", level)
    return sized.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_us") / width), F.floor((F.col("end_us") - 1) / width))))


def start_cells(df: DataFrame, levels: Column, finest: int) -> DataFrame:
    """Rows (_level, _cell) for the start of every interval: the cell it lies in on each of some levels."""
    placed = df.withColumn("_level", F.explode(levels))
    return placed.withColumn("_cell", F.floor(F.col("start_us") / _width_of("_level", finest)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = (),
    bucket_seconds: int = 300,
    how: str = "inner",
) -> DataFrame:
    """Pairs of intervals that overlap, as equi-joins on (keys, level, cell) over cells of several widths.

    Of two overlapping intervals one holds the start of the other. An interval lies in at most two cells as wide as itself
    or up to eight times wider; a start lies in one cell on every level, and of these only the levels that hold an interval of the
    other side count. So an interval of any length is a few rows, and is held only against starts within some times its own length.
    The left side holds starts that are no earlier, the right side later ones: every pair appears once. Columns of the right
    side get the prefix r_. bucket_seconds is the width of the finest cells; it changes no result. With how="left_semi" the left
    rows that have a partner are returned, and no pair is made.

    Starts are packed into tiles, in time order, which meet the intervals that reach them; pairs are made last, tile by tile.
    """
    finest = bucket_seconds * 1_000_000
    if how == "left_semi":
        return _reached(with_micros(left), right, keys, (), DAY_US).filter(F.col("_reach") > F.col("start_us")).drop("_reach")
    a, b = with_micros(left), with_micros(right)

    def held(holding: DataFrame, starting: DataFrame, swapped: bool) -> DataFrame:
        cells = in_cells(holding, finest)
        levels = cells.agg(F.collect_set("_level")).scalar()
        place = ["_level", "_cell", *keys]
        eighth = F.floor(F.col("start_us") / _width_of("_level", finest) * 8)
        tiles = in_tiles(start_cells(starting, levels, finest), place, eighth, "start_us")
        reached = (F.col("_least") < F.col("end_us")) & (F.col("_most") >= F.col("start_us"))
        met = tiles.hint("merge").join(cells, place).filter(reached)
        pairs = met.select(F.struct(*cells.columns).alias("_holder"), F.explode("_rows").alias("_start"))
        one, two = ("_start", "_holder") if swapped else ("_holder", "_start")
        at = {f"{r}{c}": F.col(f"{side}.{c}") for r, side, df in (("", one, a), ("r_", two, b)) for c in df.columns}
        on = [at["start_us"] < at["r_end_us"], at["end_us"] > at["r_start_us"]]
        on.append(at["r_start_us"] < at["start_us"] if swapped else at["start_us"] <= at["r_start_us"])
        return pairs.filter(reduce(Column.__and__, on)).select(*[v.alias(c) for c, v in at.items()])

    return held(a, b, False).unionAll(held(b, a, True))


def exclude_overlapping(
    candidates: DataFrame,
    busy: DataFrame,
    key: str = "realpath",
    tie: Sequence[str] = ("id",),
    width: int = DAY_US,
) -> DataFrame:
    """Drop candidates whose item is busy elsewhere in an overlapping window.

    No pairs are made. A candidate without a key is never dropped.
    """
    cands = with_micros(candidates)
    probed = _reached(cands, busy, [key], tie, width)
    free = probed.filter(F.col("_reach").isNull() | (F.col("_reach") <= F.col("start_us"))).drop("_reach")
    return free.unionByName(cands.filter(F.col(key).isNull()))


def room_until_busy(points: DataFrame, busy: DataFrame, keys: Sequence[str], at: str, width: int = DAY_US) -> DataFrame:
    """Points with _busy_from: the first start of a busy window of their keys that ends after them, or null.

    What begins at the point overlaps a busy window when it ends after that start; so this answers exclude_overlapping for any number of
    lengths at once. It is the same scan with time running backwards. Points without a key meet no window.
    """
    timed = with_micros(busy).filter("end_us IS NOT NULL")
    # a window without a start has always been busy
    mirrored = timed.select(*keys, (-F.col("end_us")).alias("start_us"), F.coalesce(-F.col("start_us"), F.lit((1 << 63) - 1)).alias("end_us"))
    probes = points.withColumns({"start_us": F.lit(None).cast("bigint"), "end_us": -micros(at)})
    seen = _reached(probes, mirrored, keys, (), width)
    return seen.withColumn("_busy_from", -F.col("_reach")).drop("start_us", "end_us", "_reach")


def _reached(cands: DataFrame, busy: DataFrame, keys: Sequence[str], tie: Sequence[str], width: int) -> DataFrame:
    """Candidates with keys, and how far the busy windows reach that start before a candidate ends (_reach).

    A candidate overlaps one of them when they reach past its start.
    """
    columns, keys = cands.columns, list(keys)
    keyed = [F.col(k).isNotNull() for k in keys]
    there = reduce(Column.__and__, keyed) if keyed else F.lit(True)
    marks = with_micros(busy).filter(there).groupBy(*keys, F.col("start_us").alias("_at")).agg(
        F.max("end_us").alias("_busy_to")).withColumn("_side", F.lit(1))
    # a window that starts exactly where the candidate ends does not overlap: candidates go first
    probes = cands.filter(there).withColumns({"_at": F.col("end_us"), "_side": F.lit(0)})
    both = probes.unionByName(marks, allowMissingColumns=True)
    scanned = OrderedScan(both, keys, ["_at", "_side", *tie], width).running(
        Running("_reach", "max", F.col("_busy_to"), inclusive=False))
    return scanned.result().filter("_side = 0").select(*columns, "_reach")


# ---- point lookups -------------------------------------------------------------------------


def airtime(blocks: DataFrame, closed: bool = False, width: int = DAY_US) -> DataFrame:
    """The time in which each block is the first one on air, as disjoint spans [from_us, until_us).

    Along the start order, a block that ends no later than one before it is never first. The others
    end later and later, so each is first from its start, or from the end of the one before it, until
    its own end. closed=True counts a block's end as on air.
    """
    scan = OrderedScan(with_micros(blocks), ["station"], ["start_us", "end_us", "id"], width).running(
        Running("_reach", "max", F.col("end_us"), inclusive=False))
    past = 1 if closed else 0
    first = scan.result().withColumns({
        "from_us": F.greatest(F.col("start_us"), F.col("_reach") + past), "until_us": F.col("end_us") + past})
    shown = (F.col("_reach").isNull() | (F.col("end_us") > F.col("_reach"))) & (F.col("from_us") < F.col("until_us"))
    return first.filter(shown).drop("_reach")


def now_playing(blocks: DataFrame, probes: DataFrame, closed: bool = False, width: int = DAY_US) -> DataFrame:
    """The block on air at each probe (station, at): the first one in start order.

    closed=True accepts a block ending exactly at the probe, so a boundary belongs to the earlier
    block. Probes with nothing on air are kept, with a null block. Each probe looks back to the last
    span of airtime that began before it; blocks and probes are never paired.
    """
    block = F.struct("id", "title", "start_us", "end_us", "until_us")
    spans = airtime(blocks, closed, width).select("station", F.col("from_us").alias("_us"), F.lit(0).alias("_side"), block.alias("_block"))
    points = probes.select("station", "at", micros("at").alias("_us"), F.lit(1).alias("_side")).distinct()
    both = points.unionByName(spans, allowMissingColumns=True)
    seen = OrderedScan(both, ["station"], ["_us", "_side"], width).running(
        Running("_hit", "last", F.col("_block"))).result().filter("_side = 1")
    hit = F.when(F.col("_us") < F.col("_hit.until_us"), F.col("_hit"))
    found = spread(seen.select("station", "at", hit.alias("_hit")), "station", "at")
    return probes.join(found, ["station", "at"], "left").withColumns({
        "block_id": F.col("_hit.id"), "title": F.col("_hit.title"),
        "start_us": F.col("_hit.start_us"), "end_us": F.col("_hit.end_us")}).drop("_hit")


def slot_grid(blocks: DataFrame, stations: DataFrame, lo, hi, slot_minutes: int = 30,
              off_air: str = "Offair", width: int = DAY_US) -> DataFrame:
    """One row per (slot, station) with the covering block, or the off-air text.

    Along the start order, a block answers for the time from the end of those before it until its own end: off air until it starts, then
    it is the first one on air. What is left up to the end of the grid is off air. These stretches are laid out in slots last, so no
    slot is shuffled or sorted.
    """
    low, high, step = micros(_ntz(lo)), micros(_ntz(hi)), F.lit(slot_minutes * 60_000_000).cast("bigint")
    seen = OrderedScan(with_micros(blocks_in_window(blocks, lo, hi)), ["station"], ["start_us", "end_us", "id"], width).running(
        Running("_reach", "max", F.col("end_us"), inclusive=False)).result()
    answered = seen.select("station", "title", "start_us", F.coalesce("_reach", low).alias("_from"), F.col("end_us").alias("_until"))
    last = seen.groupBy("station").agg(F.max("end_us").alias("_from"))
    none = F.lit(None)
    rest = stations.select("station").join(last, "station", "left").select(
        "station", none.cast("string").alias("title"), none.cast("bigint").alias("start_us"), F.coalesce("_from", low).alias("_from"),
        high.alias("_until"))
    runs = stations.select("station").join(answered, "station").select(*rest.columns).unionAll(rest)
    # the slots of a run, counted from the first one of the grid
    first = F.ceil((F.greatest("_from", low) - low) / step)
    after = F.ceil((F.least("_until", high) - low) / step)
    laid = runs.withColumns({"_first": first, "_last": after - 1}).filter("_first <= _last").withColumn(
        "_slot", F.explode(F.sequence("_first", "_last"))).withColumn("_us", low + F.col("_slot") * step)
    shown = F.coalesce(F.col("start_us") <= F.col("_us"), F.lit(False))
    return laid.select(
        from_micros("_us").alias("at"),
        "station",
        F.coalesce(F.when(shown, F.col("title")), F.lit(off_air)).alias("title"),
        (shown & (F.col("start_us") < F.col("_us"))).alias("continued"),
    )


# ---- station views -------------------------------------------------------------------------


def next_up(blocks: DataFrame, now, near_end_minutes: int = 5) -> DataFrame:
    """What is on now plus the next two, or the next three when the current block is nearly over."""
    moment = _ntz(now)
    live = (F.col("start_time") <= moment) & (F.col("end_time") > moment)
    ahead = blocks.filter(F.col("start_time") > moment)
    ranked = ahead.withColumn(
        "rank", F.row_number().over(Window.partitionBy("station").orderBy("start_time", "end_time", "id"))
    ).filter("rank <= 3")
    current = blocks.filter(live).groupBy("station").agg(
        F.min(F.struct("start_time", "end_time", "id", "title")).alias("c")
    )
    shows_now = F.col("c.end_time") - moment > F.expr(f"INTERVAL {near_end_minutes} MINUTES")
    now_rows = current.filter(shows_now).select(
        "station", F.lit(0).alias("rank"), F.lit("Now").alias("label"), F.col("c.id").alias("id"),
        F.col("c.title").alias("title"),
    )
    later = (
        ranked.join(now_rows.select("station", F.lit(True).alias("has_now")), "station", "left")
        .filter(F.col("has_now").isNull() | (F.col("rank") <= 2))
        .select("station", "rank", F.lit(None).cast("string").alias("label"), "id", "title")
    )
    return now_rows.unionByName(later)


def preview(blocks: DataFrame, at, span_minutes: int = 90) -> DataFrame:
    """Blocks from a time for a span: visible seconds and whether they run past either edge."""
    lo = _ntz(at)
    hi = lo + F.expr(f"INTERVAL {span_minutes} MINUTES")
    seen = blocks_in_window(blocks, lo, hi)
    return with_micros(seen).select(
        "station",
        "id",
        "title",
        (F.col("end_us") - F.greatest(F.col("start_us"), micros(lo))).alias("width_us"),
        (F.col("start_us") < micros(lo)).alias("started_earlier"),
        (F.col("end_us") > micros(hi)).alias("ends_later"),
    )


def grid_layout(blocks: DataFrame, lo, hi, now) -> DataFrame:
    """Left edge and width of each block in a guide from lo to hi, in percent."""
    low, high, moment = micros(_ntz(lo)), micros(_ntz(hi)), micros(_ntz(now))
    seen = with_micros(blocks_in_window(blocks, lo, hi))
    left = F.greatest(F.col("start_us"), low)
    right = F.least(F.col("end_us"), high)
    return seen.select(
        "station",
        "id",
        F.round((left - low) / (high - low) * 100, 6).alias("left_pct"),
        F.round((right - left) / (high - low) * 100, 6).alias("width_pct"),
        ((F.col("start_us") <= moment) & (F.col("end_us") > moment)).alias("current"),
    )


def block_tag(kind: Column, title: Column, tag: Column, is_list: Column) -> Column:
    """The tag a block announces: none when off air or looping, the title for clip shows."""
    return (
        F.when(kind.isin("LiquidOffAirBlock", "LiquidLoopBlock"), F.lit(None).cast("string"))
        .when(kind == "LiquidClipBlock", F.nullif(title, F.lit("")))
        .when(~F.coalesce(is_list, F.lit(False)), tag)
    )


def lookahead(blocks: DataFrame, n: int = 3, tag: str = "block_tag", width: int = DAY_US) -> DataFrame:
    """Each block with its tag and those of the next n blocks of its station, as next_1 .. next_n.

    The window looks ahead inside a bucket of the order. The first n tags of every bucket are lent to the buckets before it,
    where they stand after the last block, so no station lands in one task.
    """
    timed = with_micros(blocks).withColumn("_bucket", F.floor(F.col("start_us") / F.lit(width)))
    order = ["start_us", "end_us", "id"]
    keys = ["station", "_bucket"]
    heads = timed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n)
    first = heads.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(tag).alias("_tag")))).alias("_tags"))
    later = Window.partitionBy("station").orderBy("_bucket").rowsBetween(1, n)
    following = F.slice(F.flatten(F.collect_list("_tags").over(later)), 1, n)
    lent = first.withColumn("_tags", following).select(*keys, F.posexplode("_tags").alias("_lent", "_t")).select(*keys, "_lent", F.col("_t._tag").alias(tag))
    both = timed.withColumn("_lent", F.lit(-1)).unionByName(lent, allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy("_lent", *order)
    seen = both.withColumns({f"next_{i}": F.lead(tag, i).over(ahead) for i in range(1, n + 1)})
    return seen.filter("_lent = -1").select(*blocks.columns, *[f"next_{i}" for i in range(1, n + 1)])


def seam(blocks: DataFrame, boundary, end) -> DataFrame:
    """Per station: blocks crossing the boundary, where regeneration starts and the horizon."""
    edge, stop = _ntz(boundary), _ntz(end)
    crosses = (F.col("start_time") < edge) & (F.col("end_time") > edge)
    return blocks.groupBy("station").agg(
        F.count_if(crosses).alias("crossing_start"),
        F.count_if((F.col("start_time") < stop) & (F.col("end_time") > stop)).alias("crossing_end"),
        F.coalesce(F.max(F.when(crosses, F.col("end_time"))), edge).alias("regeneration_start"),
        F.greatest(F.max("end_time"), stop).alias("effective_horizon"),
    )


def low_horizon(blocks: DataFrame, stations: DataFrame, now, hours: int) -> DataFrame:
    """Stations whose schedule ends before now + hours, or that have none."""
    ends = blocks.groupBy("station").agg(
        F.max_by("end_time", F.struct("start_time", "end_time", "id")).alias("schedule_end")
    )
    limit = _ntz(now) + F.expr(f"INTERVAL {hours} HOURS")
    return (
        stations.select("station")
        .join(ends, "station", "left")
        .filter(F.col("schedule_end").isNull() | (F.col("schedule_end") < limit))
    )


def play_span(start: Column | str, seconds: Column | str) -> Column:
    """End of something that starts at a time and lasts some seconds."""
    return (F.col(start) if isinstance(start, str) else start) + seconds_interval(seconds)
