"""Alerts when time passes: stations whose schedule runs out, from timers beside their state.

A station's state is the end of its last-starting block. A timer stands at the first such end of a group of stations less the threshold,
so the alert fires when the moment comes, whether rows arrive or not. Rows are written when a station becomes due or is no longer due, or the end of one that is due moves, never for the rest.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from airlog.functions.values import micros
from airlog.operators.intervals import _ntz
from airlog.streaming import sinks

CHANGES = "station string, due boolean, schedule_end_us bigint, at_us bigint"
#: The state of a group of stations: of each its newest block and whether it was said to be due, and the one timer of the group.
_STATE = StructType([
    StructField("stations", ArrayType(StringType())), StructField("start_us", ArrayType(LongType())), StructField("end_us", ArrayType(LongType())),
    StructField("ids", ArrayType(StringType())), StructField("due", ArrayType(BooleanType())), StructField("timer_ms", LongType())])
#: Groups that stations are spread over by hash, so that a call to the state serves many of them; it changes no result. A state
#: written with another number must not be read.
GROUPS = 1024


class ScheduleTimers(StatefulProcessor):
    """Keeps one row and at most one timer for each group of stations: it stands at the first moment at which one of them becomes due."""

    def __init__(self, hours: float):
        self.ahead_us = int(hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("schedules", _STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Known stations without a schedule: due from the start, said by a timer at once."""
        timer = timerValues.getCurrentProcessingTimeInMs() + 1
        self.handle.registerTimer(timer)
        self._keep({known["station"]: (None, None, None, False) for known in initialState["stations"]}, timer)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, timer = self._held()
        said = {}
        for row in rows:
            station = row["station"]
            start, end, ident, due = held.get(station, (None, None, None, False))
            said.setdefault(station, end)
            place = (row["start_us"], row["end_us"], row["id"])
            if start is None or place > (start, end, ident):
                held[station] = (*place, due)
        moved = {station for station, end in said.items() if held[station][3] and held[station][1] != end}
        yield from self._settle(held, timer, timerValues, moved)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, timer = self._held()
        # Spark removes a timer that has fired
        yield from self._settle(held, 0 if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, timerValues)

    def _held(self) -> tuple[dict, int]:
        stored = self.state.get()
        if stored is None:
            return {}, 0
        stations, *columns, timer = stored
        return dict(zip(stations, zip(*columns))), timer

    def _keep(self, held: dict, timer: int) -> None:
        columns = zip(*held.values()) if held else ((), (), (), ())
        self.state.update((list(held), *map(list, columns), timer))

    def _settle(self, held: dict, timer: int, timerValues, moved: Collection[str] = ()) -> Iterator[Row]:
        now_ms, first = timerValues.getCurrentProcessingTimeInMs(), 0
        changes = []
        for station, (start, end, ident, due) in held.items():
            # the first whole millisecond at which the end lies less than the threshold ahead
            moment = 0 if end is None else (end - self.ahead_us) // 1000 + 1
            new = moment <= now_ms
            if not new and (not first or moment < first):
                first = moment
            if new != due or station in moved:
                changes.append((station, start, end, ident, new))
        for station, start, end, ident, new in changes:
            held[station] = (start, end, ident, new)
        if timer and timer != first:
            self.handle.deleteTimer(timer)
        if first and timer != first:
            self.handle.registerTimer(first)
        self._keep(held, first)
        for station, _, end, _, new in changes:
            yield Row(station=station, due=new, schedule_end_us=end, at_us=now_ms * 1000)

    def close(self) -> None:
        pass


def due_changes(blocks: DataFrame, stations: DataFrame | None, hours: float, groups: int = GROUPS) -> DataFrame:
    """A stream of CHANGES from a stream of blocks (station, id, start_time, end_time); a time without a zone is UTC.

    stations, if given, are known from the start, so that one without any block is due. Needs the RocksDB state store, which
    watch_schedules sets.
    """
    rows = blocks.select("station", micros("start_time").alias("start_us"), micros("end_time").alias("end_us"), F.col("id").cast("string").alias("id"))
    # after a restart Spark looks at timers from the first batch on, and a batch needs a new row: one a second comes and is left out
    beat = blocks.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().filter("value < 0").select(
        F.lit("").alias("station"), *[F.lit(0).cast("bigint").alias(c) for c in ("start_us", "end_us")], F.lit("").alias("id"))
    rows = rows.unionByName(beat)
    group = F.pmod(F.xxhash64("station"), F.lit(groups)).alias("_group")
    known = None if stations is None else stations.select("station").distinct().groupBy(group).agg(
        F.collect_list(F.struct("station")).alias("stations")).groupBy("_group")
    return rows.select(group, "*").groupBy("_group").transformWithState(
        statefulProcessor=ScheduleTimers(hours), outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime", initialState=known)


def watch_schedules(blocks: DataFrame, stations: DataFrame | None, folder: str, checkpoint: str, hours: float, **trigger) -> StreamingQuery:
    """Write the changes of every micro-batch under its id; current_due reads what they add up to.

    The query runs until it is stopped, as there is always a next moment; see catch_up.
    """
    spark = blocks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    sinks.start(spark.createDataFrame([], CHANGES), folder)

    def store(changes: DataFrame, batch_id: int) -> None:
        sinks.write_batch(changes, folder, batch_id)

    writer = due_changes(blocks, stations, hours).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def catch_up(query: StreamingQuery, seconds: float) -> None:
    """Wait, so many seconds at most, until all rows there are have been read and timers that were due then have fired, and stop the query."""
    until = time.monotonic() + seconds
    try:
        while time.monotonic() < until and query.isActive:
            done = query.recentProgress
            read = [sum(s.numInputRows for s in p.sources if not s.description.startswith("Rate")) for p in done]
            if len(read) >= 3 and not any(read[-2:]):
                return
            time.sleep(0.5)
        if query.exception() is not None:
            raise query.exception()
        raise TimeoutError(f"still reading after {seconds} seconds")
    finally:
        query.stop()


def current_due(spark: SparkSession, folder: str) -> DataFrame:
    """(station, schedule_end) of the stations that are due after the stored changes."""
    newest = sinks.read_batches(spark, folder).groupBy("station").agg(F.max_by(F.struct("due", "schedule_end_us"), "batch_id").alias("_r"))
    return newest.filter("_r.due").select("station", F.timestamp_micros("_r.schedule_end_us").cast("timestamp_ntz").alias("schedule_end"))


def due_at(blocks: DataFrame, stations: DataFrame | None, moment: str | Callable, hours: float) -> DataFrame:
    """The batch form: the stations that are due at a moment."""
    from airlog.streaming.horizon import schedule_ends

    limit = _ntz(moment() if callable(moment) else moment) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)"))
    ends = schedule_ends(blocks.withColumn("id", F.col("id").cast("string")))
    known = ends if stations is None else stations.select("station").distinct().join(ends, "station", "full_outer")
    return known.filter(F.col("schedule_end").isNull() | (F.col("schedule_end") < limit))
