"""Ordered scans: running aggregates along a sort order within a key.

There is one plan at every size. The order is cut into buckets of a fixed width, so a bucket is a function of the row alone. A
combined aggregate gives each (key, bucket) one total; a window over these totals, of which a key has as many as its
order has steps, gives what all earlier buckets carry into each; and that carried value enters the bucket as its first row. So no
task has to hold a key, and building a query runs no job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from airlog.functions.values import micros
from airlog.session import durable

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
_BUCKET, _REAL = "_bucket_of_order", "_real_row"

#: Partitions of a shuffle that is sorted by key and bucket. Spark merges small ones by their compressed size, which is far below what
#: sorting them takes; a number that is asked for stays.
SPREAD = 96


def spread(df: DataFrame, *columns: str, parts: int = 0) -> DataFrame:
    """The rows in SPREAD partitions by some columns, in more if asked for or if the session shuffles into more."""
    return df.repartition(max(parts, SPREAD, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)


@dataclass(frozen=True)
class Running:
    """A running value: kind is max, sum, count or last (the last non-null value).

    Before the first value, sums and counts are 0 and the others null.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _aggregate(kind: str, value: Column) -> Column:
    if kind == "max":
        return F.max(value)
    if kind in ("sum", "count"):
        return F.sum(value)
    if kind == "last":
        return F.last(value, ignorenulls=True)
    raise ValueError(f"unknown running aggregate {kind!r}")


class OrderedScan:
    """Rows of each key in a total order. `order` must end in a unique column.

    width: length of a bucket in the units of the first order column, a number or a time (then in microseconds). It changes
    where rows are worked on and no result. Without it a key is one bucket; that is for keys whose rows the data model
    bounds, such as the entries of one plan or the files of one show.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float | None = None):
        self.keys, self.order, self.width = list(keys), list(order), width
        if width is not None:
            first = self.order[0]
            timed = isinstance(df.schema[first].dataType, (T.TimestampNTZType, T.TimestampType))
            df = df.withColumn(_BUCKET, F.floor((micros(first) if timed else F.col(first)) / F.lit(width)))
        self.df = df

    def running(self, *wanted: Running) -> "OrderedScan":
        """Add running columns. Later calls may use the columns of earlier ones."""
        values = {f"_value_{r.name}": F.when(r.value.isNotNull(), F.lit(1)).cast("bigint") if r.kind == "count" else r.value
                  for r in wanted}
        valued = self.df.withColumns(values)
        keys, order = self.keys, self.order
        types = {}
        if self.width is not None:
            carry = self._carried(valued, wanted)
            types = {r.name: carry.schema[f"_value_{r.name}"].dataType for r in wanted}
            typed = valued.withColumns({f"_value_{r.name}": F.col(f"_value_{r.name}").cast(types[r.name]) for r in wanted})
            valued = typed.withColumn(_REAL, F.lit(1)).unionByName(carry, allowMissingColumns=True)
            keys, order = [*keys, _BUCKET], [_REAL, *order]
        if keys:
            valued = spread(valued, *keys)
        rows = Window.partitionBy(*keys).orderBy(*order)
        found = {}
        for r in wanted:
            frame = rows.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
            value = _aggregate(r.kind, F.col(f"_value_{r.name}")).over(frame)
            value = F.coalesce(value, F.lit(0)) if r.kind in ("sum", "count") else value
            found[r.name] = value.cast(types[r.name]) if r.name in types else value
        scanned = valued.withColumns(found)
        if self.width is not None:
            scanned = scanned.filter(F.col(_REAL) == 1).drop(_REAL)
        self.df = scanned.drop(*values)
        return self

    def _carried(self, valued: DataFrame, wanted: Sequence[Running]) -> DataFrame:
        """One row per (key, bucket) with what the earlier buckets of the key add up to."""
        place = F.struct(*self.order)
        totals = valued.groupBy(*self.keys, _BUCKET).agg(*[
            (F.max_by(f"_value_{r.name}", F.when(F.col(f"_value_{r.name}").isNotNull(), place)) if r.kind == "last"
             else _aggregate(r.kind, F.col(f"_value_{r.name}"))).alias(f"_total_{r.name}") for r in wanted])
        earlier = Window.partitionBy(*self.keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*self.keys, _BUCKET, F.lit(0).alias(_REAL), *[
            _aggregate(r.kind, F.col(f"_total_{r.name}")).over(earlier).cast(totals.schema[f"_total_{r.name}"].dataType)
            .alias(f"_value_{r.name}") for r in wanted])

    def result(self) -> DataFrame:
        return self.df.drop(_BUCKET)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *wanted: Running, width: float | None = None) -> DataFrame:
    return OrderedScan(df, keys, order, width).running(*wanted).result()


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, width: float | None = None) -> DataFrame:
    """1-based position of each row in its key."""
    return running(df, keys, order, Running(name, "count", F.lit(1)), width=width)


def order_text(order: Sequence[str], types: dict[str, T.DataType]) -> Column:
    """One text whose order is the order of several columns, nulls first: texts as they are, whole numbers as fixed-width digits."""
    parts = []
    for name in order:
        kind = types[name]
        if isinstance(kind, T.StringType):
            # a terminator below every character, which is doubled by a second one where it stands in the text
            text = F.concat(F.replace(name, F.lit("\x00"), F.lit("\x00\x01")), F.lit("\x00\x00"))
        elif isinstance(kind, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            number = F.col(name).cast("bigint") if isinstance(kind, T.IntegralType) else micros(F.col(name).cast("timestamp_ntz"))
            text = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
        else:
            raise TypeError(f"no text orders a column of {kind.simpleString()}")
        parts.append(F.when(F.col(name).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), text)))
    return F.concat(*parts)


#: Rows that one task may number, characters of a digit, and nodes that are few enough to be sent to every task.
CROWD, DIGIT, FEW = 200_000, 2, 10_000


def cut_by_digits(df: DataFrame, keys: Sequence[str], order: Sequence[str], crowd: int,
                  digit: int = DIGIT) -> tuple[DataFrame, list[str], list[tuple[list[str], DataFrame]]]:
    """The rows with the parts they fall into, the columns that name a part, and for each level of the trie how many rows
    of a key stand before each of its parts.

    The rows of a key are a node. A node with more than `crowd` rows is cut by the digit, a few characters of the text of the sort key,
    that follows what its first and last row have in common, so nothing is spent on what all its rows share; crowded parts are
    cut again until none is left. Parts are counted before anything is shuffled.
    """
    types = {f.name: f.dataType for f in df.schema}
    rows = df.withColumn("_sort", order_text(order, types))
    rows = rows if keys else rows.withColumn("_all", F.substr("_sort", F.lit(1), F.lit(0)))
    node, found = list(keys) or ["_all"], []
    sizes = [F.count(F.lit(1)).alias("_rows"), F.min("_sort").alias("_low"), F.max("_sort").alias("_high")]
    crowded = durable(rows.groupBy(*node).agg(*sizes).filter(F.col("_rows") > crowd).withColumn("_ahead", F.lit(0).cast("bigint")))
    while not crowded.isEmpty():
        start, part = f"_from_{len(found)}", f"_digit_{len(found)}"
        equal = F.transform(F.sequence(F.lit(1), F.least(F.length("_low"), F.length("_high"))),
                            lambda i: F.substr("_low", i, F.lit(1)) == F.substr("_high", i, F.lit(1)))
        cuts = crowded.select(*[F.col(k).alias(f"_is_{k}") for k in node], F.array_position(equal, False).cast("int").alias(start))
        same = [F.col(k).eqNullSafe(F.col(f"_is_{k}")) for k in node]
        # a few hot nodes hold all rows: these stay where they are
        rows = rows.join(F.broadcast(cuts) if crowded.count() <= FEW else cuts, same, "left").drop(*[f"_is_{k}" for k in node])
        rows = rows.withColumn(part, F.substr("_sort", F.col(start), F.lit(digit)))
        earlier = Window.partitionBy(*node).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        held = crowded.select(*[F.col(k).alias(f"_is_{k}") for k in node], "_ahead")
        counted = rows.filter(F.col(start).isNotNull()).groupBy(*node, part).agg(*sizes).join(held, same).drop(*[f"_is_{k}" for k in node])
        parts = durable(counted.withColumn("_ahead", F.col("_ahead") + F.coalesce(F.sum("_rows").over(earlier), F.lit(0))))
        rows = rows.drop(start)
        node = [*node, part]
        found.append((node, parts.select(*node, "_rows", "_ahead")))
        crowded = parts.filter(F.col("_rows") > crowd)
    return rows, node, found


def numbered_by_digits(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, crowd: int = CROWD,
                       digit: int = DIGIT) -> DataFrame:
    """1-based position of each row in its key, however many rows a key has: a radix rank over the text of the sort key.

    A window over the counts of one node's parts gives how many rows stand before each part (see cut_by_digits), and rows are
    numbered in a window inside one part, so no window holds a crowded key. `order` must end in a unique column; without keys the
    table is one key.

    Nodes are counted while the query is built, as the data decide how deep to go: once, and once more for each level that is
    crowded. Only crowded nodes and their parts are kept, in the checkpoint folder, a few for every `crowd` rows. What stands before
    a part enters its window as the first row, so rows are shuffled once, into so many partitions that the crowded ones are about CROWD in each.
    """
    rows, node, found = cut_by_digits(df, keys, order, crowd, digit)
    marked = rows.drop("_sort").withColumns({"_real": F.lit(1), "_ahead": F.lit(0).cast("bigint")})
    if found:
        hot = found[0][1].agg(F.sum("_rows")).first()[0]
        for levels, parts in found:
            marked = marked.unionByName(parts.select(*levels, F.lit(0).alias("_real"), "_ahead"), allowMissingColumns=True)
        marked = spread(marked, *node, parts=hot // CROWD)
    upto = Window.partitionBy(*node).orderBy("_real", *order).rowsBetween(Window.unboundedPreceding, 0)
    spot = F.sum("_real").over(upto) + F.max("_ahead").over(upto)
    return marked.withColumn(name, spot.cast("bigint")).filter("_real = 1").select(*df.columns, name)
