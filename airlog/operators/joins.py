"""Joins between schedules, catalogs, metadata and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airlog.operators.aliases import prefixed


def attach_content(blocks: DataFrame, catalog: DataFrame, fields: Sequence[str] = ("path", "title", "duration", "tag")) -> DataFrame:
    """Add `content`: the catalog items of each block's content_ids in list order, missing ones dropped.

    Each different list is looked up once and joined back, so blocks may share an id.
    """
    items = catalog.select(F.col("id").alias("_item"), F.struct(F.col("id"), *fields).alias("_content"))
    lists = blocks.select(F.col("content_ids").alias("_ids")).distinct()
    found = lists.select("_ids", F.posexplode("_ids").alias("_pos", "_id")).join(items, F.col("_id") == F.col("_item"))
    listed = found.groupBy("_ids").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "_content"))), lambda m: m["_content"]).alias("_listed"))
    none = F.array().cast(listed.schema["_listed"].dataType)
    return blocks.join(listed, blocks["content_ids"] == listed["_ids"], "left").select(
        "id", *[c for c in blocks.columns if c != "id"], F.coalesce("_listed", none).alias("content"))


def with_tag(blocks: DataFrame, catalog: DataFrame, content: str = "content_id") -> DataFrame:
    """Left join of each block with the tag of its item."""
    tags = catalog.select(F.col("id").alias(content), "tag")
    return blocks.join(tags, content, "left")


def sequence_position(entries: DataFrame, sequences: DataFrame) -> DataFrame:
    """Index of each episode path in its named sequence."""
    keys = sequences.select(F.col("id").alias("named_sequence_id"), "station", "sequence_name", "tag_path")
    return entries.join(keys, "named_sequence_id").select(
        "station", "sequence_name", "tag_path", "fpath", "sequence_index")


def attach_metadata(df: DataFrame, meta: DataFrame, real_paths: DataFrame, path: str = "path") -> DataFrame:
    """Metadata of each path through its canonical path; several paths may share one file."""
    real = real_paths.select(F.col("path").alias(path), "realpath").distinct()
    known = meta.select(F.col("path").alias("_file"), "meta")
    found = real.join(known, F.col("realpath") == F.col("_file")).select(path, "meta")
    return df.join(found, path, "left")


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows without a parent row; `on` maps child columns to parent columns."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    return child.join(keys, list(on), "left_anti")


def siblings(stations: DataFrame, slots: DataFrame) -> DataFrame:
    """Pairs of different standard stations with the same content root and a common tag.

    The pairs are the result and may be many; sibling_groups says the same with one row per station and tag.
    """
    standard = stations.filter("network_type = 'standard' AND content_root <> ''").select("station", "content_root")
    tags = slots.select("station", F.explode("tags").alias("tag")).filter("tag <> ''").distinct()
    held = standard.join(tags, "station")
    other = prefixed(held, "o_")
    same = (F.col("content_root") == F.col("o_content_root")) & (F.col("tag") == F.col("o_tag"))
    pairs = held.join(other, same & (F.col("station") != F.col("o_station")))
    return pairs.select("station", F.col("o_station").alias("sibling")).distinct()


def sibling_groups(stations: DataFrame, slots: DataFrame) -> DataFrame:
    """(content_root, tag, station, siblings) of every standard station and tag that others of its root have too.

    siblings is how many others there are. Grows with the rows, not with their pairs.
    """
    standard = stations.filter("network_type = 'standard' AND content_root <> ''").select("station", "content_root")
    tags = slots.select("station", F.explode("tags").alias("tag")).filter("tag <> ''").distinct()
    held = standard.distinct().join(tags, "station")
    sizes = held.groupBy("content_root", "tag").agg((F.count(F.lit(1)) - 1).alias("siblings")).filter("siblings > 0")
    return held.join(sizes, ["content_root", "tag"]).select("content_root", "tag", "station", "siblings")


def children(sequences: DataFrame, parents: DataFrame) -> DataFrame:
    """Sequences whose tag path lies below a parent tag of the same station and name.

    Every proper ancestor of a tag path is a join key, so no pair is tried that does not match.
    """
    levels = F.split("tag_path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(levels) - 1), lambda n: F.array_join(F.slice(levels, F.lit(1), n), "/"))
    above = F.when(F.size(levels) > 1, above)
    keyed = sequences.select("*", F.explode(above).alias("parent_tag"))
    return keyed.join(parents.select("station", "sequence_name", "parent_tag").distinct(),
                      ["station", "sequence_name", "parent_tag"])


def diff_records(before: DataFrame, after: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """added, removed, changed or same for every key of two keyed tables."""
    a = before.select(*keys, F.struct(*compare).alias("_a"))
    b = after.select(*keys, F.struct(*compare).alias("_b"))
    kind = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("change"))


def resolve_ids(requests: DataFrame, names: DataFrame, name: str = "show") -> DataFrame:
    """Check requested names against known ones: ok, unknown, ambiguous or non_canonical.

    Names are matched by lower case; case folding of letters such as the sharp s is not applied.
    """
    known = names.select(F.col(name).alias("_name")).distinct().groupBy(F.lower("_name").alias("_key")).agg(
        F.count(F.lit(1)).alias("matches"), F.min("_name").alias("canonical"))
    found = requests.withColumn("_key", F.lower("series")).join(known, "_key", "left").drop("_key")
    status = (
        F.when(F.col("matches").isNull(), "unknown").when(F.col("matches") > 1, "ambiguous")
        .when(F.col("series") != F.col("canonical"), "non_canonical").otherwise("ok")
    )
    return found.withColumns({"status": status, "matches": F.coalesce("matches", F.lit(0))})
