"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source is a queue of its shuffled documents, repeated `passes` times. A document's virtual finish time is the words of its
source up to and with it, divided by the source's target; the mix takes documents in the order of finish times until the total
budget is used up. Running sums come in two levels: sums of narrow buckets of the order, which are few, and running sums inside
one bucket; so no source and no stretch of the order has to fit in one task.

What is taken of a source is a run from the start of its queue. So the decisions are two or so thresholds for each source, and
the documents with their texts are joined with those, never sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlog.llm.common import word_count, written

#: The order of a queue has 60 bits; this many of them cut it into buckets.
ORDER_BITS, BUCKET_BITS = 60, 12
_FIRST_ID = -(1 << 63)


def _place_columns(seed: int, ident: Column, source: Column, text: Column) -> tuple[Column, Column, Column]:
    """id, queue and place of a row. queue orders sources by code point, null last; place is made of md5("seed:id:md5(text)")."""
    own = F.coalesce(F.md5(text.cast("string").cast("binary")), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))
    return (F.coalesce(ident.cast("long"), F.lit(_FIRST_ID)),
            F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t")),
            F.conv(F.substring(digest, 1, ORDER_BITS // 4), 16, 10).cast("long"))


def queue_entries(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source",
                  text_col: str = "text") -> DataFrame:
    """(id, queue, place, size) of every row: its source's queue, its place there and its words."""
    ident, queue, place = _place_columns(seed, F.col(id_col), F.col(source_col), F.col(text_col))
    return docs.select(ident.alias("id"), queue.alias("queue"), place.alias("place"), word_count(F.col(text_col)).alias("size"))


def targets(entries: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """(queue, source_size, target double) of each source.

    Sources take the weights in turn, in the order of their names. They share `share` times all words by weight; no target is
    above `passes` times its source's words, and what a source cannot use goes to the others by weight. The level to which all
    are filled follows from one ordered pass over the sources, a table with one row for each.
    """
    sums = entries.groupBy("queue").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy("queue")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("weight", weight).withColumn("most", passes * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "queue")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)
    ).withColumn("number", F.row_number().over(order))
    open_level = F.min(F.when(F.col("most") > F.col("weight") * F.col("level"), F.struct("number", "level"))).over(everything)
    filled = levels.withColumn("level", open_level["level"])
    target = F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("most")), F.col("most")).cast("double")
    return filled.select("queue", "source_size", target.alias("target"), "budget")


def thresholds(entries: DataFrame, goals: DataFrame, passes: int = 2) -> DataFrame:
    """(queue, last): how far the mix goes in each pass of a source, as an array of the (place, id) of the last entry taken.

    A pass of which nothing is taken has null. Entries of one id, source and text rise and fall together.
    """
    units = entries.groupBy("queue", "place", "id").agg(F.sum("size").alias("size")).where("size > 0").withColumn(
        "bucket", F.shiftright("place", ORDER_BITS - BUCKET_BITS))
    inner = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = units.groupBy("queue", "bucket").agg(F.sum("size").alias("words")).select(
        "queue", "bucket", F.coalesce(F.sum("words").over(inner), F.lit(0)).alias("carry")).join(goals, "queue")
    running = Window.partitionBy("queue", "bucket").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    queued = units.join(carried, ["queue", "bucket"]).withColumn("upto", F.col("carry") + F.sum("size").over(running))
    rounds = queued.where("target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "finish", (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target"))
    # equal steps up to the finish time 1, near which the mix ends, then steps that grow: their number is bounded
    step = F.when(F.col("finish") <= 1, F.floor(F.col("finish") * 4096)).otherwise(4097 + F.floor(F.log2("finish") * 256))
    timed = rounds.select("queue", "place", "id", "size", "pass", "finish", "budget", step.alias("step"))
    earlier = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    mass = timed.groupBy("step").agg(F.sum("size").alias("words")).select(
        "step", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carry"))
    within = Window.partitionBy("step").orderBy("finish", "place", "id", "queue", "pass").rowsBetween(
        Window.unboundedPreceding, 0)
    taken = timed.join(mass, "step").withColumn("used", F.col("carry") + F.sum("size").over(within)).where("used <= budget")
    ends = taken.groupBy("queue", "pass").agg(F.max(F.struct("place", "id")).alias("end"))
    lasts = [F.max(F.when(F.col("pass") == p, F.col("end"))) for p in range(passes)]
    return ends.groupBy("queue").agg(F.array(*lasts).alias("last"))


def _copies(place: Column, ident: Column, last: Column) -> Column:
    """How many passes reach an entry."""
    reached = F.transform(last, lambda end: F.when(
        (place < end["place"]) | ((place == end["place"]) & (ident <= end["id"])), 1).otherwise(0))
    return F.coalesce(F.aggregate(reached, F.lit(0), lambda total, one: total + F.coalesce(one, F.lit(0))), F.lit(0))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 0,
             id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, size, source_size, target, copies) of every row of a table of documents.

    Null and blank texts have size 0. Rows that repeat id, source and text are taken together; rows that only share an id, or have
    none, are not. A null source is a source. Sources without words have target 0. An empty table gives an empty plan.
    """
    entries = written(queue_entries(docs, seed, id_col, source_col, text_col), "queue")
    goals = written(targets(entries, weights, share, passes), "targets")
    # one row for each source; written, so that its size is known before the entries are joined with it
    decided = written(goals.join(thresholds(entries, goals, passes), "queue", "left"), "thresholds")
    copies = F.when(F.col("target") > 0, _copies(F.col("place"), F.col("id"), F.col("last"))).otherwise(0)
    found = entries.join(decided, "queue").select("id", "size", "source_size", "target", copies.cast("int").alias("copies"))
    return found.withColumn("id", F.when(F.col("id") != _FIRST_ID, F.col("id")))


def mixed(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 0,
          id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of the mix with all their columns, each as often as it is taken; nulls and ties as in mix_plan."""
    entries = written(queue_entries(docs, seed, id_col, source_col, text_col), "queue")
    goals = written(targets(entries, weights, share, passes), "targets")
    ends = written(thresholds(entries, goals, passes), "thresholds")
    ident, queue, place = _place_columns(seed, docs[id_col], docs[source_col], docs[text_col])
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), ident.alias("id"), queue.alias("queue"),
                       place.alias("place"))
    copies = _copies(F.col("place"), F.col("id"), F.col("last"))
    taken = rows.join(ends, "queue").select("row", copies.alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
