"""Data-quality audits: each returns the rows that are wrong, or a status for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from airlog import schemas
from airlog.functions.values import col, let, strict_json, with_micros
from airlog.operators.scan import DAY_US, OrderedScan, Running

# Names used in stored chapter envelopes.
METHODS = ("ffprobe_show_chapters_v1", "native_short_media_v1")
NEGATIVE_METHOD = "ffprobe_show_chapters_v1"
NEGATIVE_OUTCOME = "unusable_chapters"
NEGATIVE_REASON = "final_endpoint_exceeds_cached_duration"
SHORT_MEDIA_SECONDS = 300
# The keys every plan entry has.
PLAN_KEYS = ("content_type", "duration", "is_stream", "media_type", "path", "skip")
# JSON keys that would refer to other rows.
REFERENCE_KEYS = ("catalog_id", "catalog_ids", "liquid_block_id", "liquid_block_ids", "named_sequence_id", "sequence_entry_id")


# ---- JSON shapes ---------------------------------------------------------------------------


def content_problem(content: Column | str, kind: Column | str) -> Column:
    """Why a block's content reference is wrong; null when it is a positive id or a list of them.

    A JSON null is right only for web blocks.
    """
    return let(strict_json(content), lambda v: _content_problem(v, col(kind)))


def _content_problem(v: Column, kind: Column) -> Column:
    shape = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    whole = F.forall(items, lambda e: F.schema_of_variant(e) == "BIGINT")
    positive = F.forall(F.try_variant_get(v, "$", "array<bigint>"), lambda n: n > 0)
    return (
        F.when(v.isNull(), "malformed")
        .when(shape == "VOID", F.when(kind != "LiquidWebBlock", "missing"))
        .when(shape == "BIGINT", F.when(F.try_variant_get(v, "$", "bigint") <= 0, "not_positive"))
        .when(items.isNotNull(), F.when(F.size(items) == 0, "empty_list").when(~whole, "not_integer")
              .when(~positive, "not_positive"))
        .otherwise("unsupported_shape")
    )


def check_content_ids(blocks: DataFrame) -> DataFrame:
    """Blocks with a wrong content reference, and why."""
    return blocks.select("id", content_problem("content_json", "liquid_type").alias("problem")).filter("problem IS NOT NULL")


def plan_problem(plan: Column | str) -> Column:
    """Why a plan is wrong; null when every entry has exactly the six keys with usable types."""
    return let(strict_json(plan), _plan_problem)


def _plan_problem(v: Column) -> Column:
    entries = F.try_variant_get(v, "$", "array<map<string,variant>>")
    keys = F.array(*[F.lit(k) for k in PLAN_KEYS])
    shaped = F.forall(entries, lambda e: F.coalesce(F.array_sort(F.map_keys(e)) == keys, F.lit(False)))
    typed = F.forall(entries, lambda e: F.coalesce(
        (F.schema_of_variant(e["is_stream"]) == "BOOLEAN") & (F.schema_of_variant(e["path"]) == "STRING"), F.lit(False)))
    return (
        F.when(v.isNull(), "malformed").when(~F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), "not_a_list")
        .when(entries.isNull() | ~shaped, "wrong_keys").when(~typed, "wrong_types")
    )


def check_plans(blocks: DataFrame) -> DataFrame:
    return blocks.select("id", plan_problem("plan_json").alias("problem")).filter("problem IS NOT NULL")


# ---- segments and their envelopes ----------------------------------------------------------


def segments_valid(points: Column, duration: Column) -> Column:
    """Whether segments are finite, in order, apart from each other and inside the duration."""

    def ok(p: Column, i: Column) -> Column:
        before = F.get(points, i - 1)
        length = F.coalesce(p["segment_duration"], p["chapter_end"] - p["chapter_start"])
        finite = [x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) for x in (p["chapter_start"], p["chapter_end"], length)]
        return F.coalesce(
            finite[0] & finite[1] & finite[2] & (p["chapter_start"] >= 0) & (p["chapter_end"] >= p["chapter_start"])
            & (p["chapter_end"] <= duration) & (length >= 0)
            & ((i == 0) | ((p["chapter_start"] >= before["chapter_start"]) & (p["chapter_start"] >= before["chapter_end"]))),
            F.lit(False))

    return F.forall(F.transform(points, ok), lambda x: x) & F.coalesce(duration > 0, F.lit(False))


def check_segments(points: DataFrame, meta: DataFrame) -> DataFrame:
    """Files whose stored segments are not usable. `points` is an array column."""
    joined = points.join(meta.select("path", "duration"), "path")
    return joined.filter(~segments_valid(F.col("points"), F.col("duration"))).select("path", "duration")


_ENVELOPE = T.StructType([
    T.StructField("attestation_version", T.IntegerType()),
    T.StructField("method", T.StringType()),
    T.StructField("media_identity", T.StructType([
        T.StructField("size", T.LongType()), T.StructField("mtime_ns", T.LongType())])),
    T.StructField("chapters", T.ArrayType(schemas.POINT)),
    T.StructField("outcome", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("trusted_duration", T.StringType()),
])


def hex_double(value: Column | str) -> Column:
    """A double as hexadecimal text with 13 fraction digits and a signed exponent."""
    text = F.java_method(F.lit("java.lang.Double"), F.lit("toHexString"), col(value).cast("double"))
    pattern = r"^(-?0x[01]\.)([0-9a-f]+)p(-?)([0-9]+)$"
    sign = F.when(F.regexp_extract(text, pattern, 3) == "-", "-").otherwise("+")
    return F.concat(F.regexp_extract(text, pattern, 1), F.rpad(F.regexp_extract(text, pattern, 2), 13, "0"),
                    F.lit("p"), sign, F.regexp_extract(text, pattern, 4))


def with_segment_status(df: DataFrame, stored: str = "points", duration: str = "duration", size: str = "size",
                        mtime_ns: str = "mtime_ns", name: str = "status") -> DataFrame:
    """Add the status of stored segment text against the file it belongs to.

    missing, legacy_empty, legacy_nonempty, trusted_v1, trusted_negative_v2, re_attestation_required
    or invalid. The text is parsed once, in columns of its own, before it is judged.
    """
    raw = F.trim(stored)
    is_list = F.startswith(raw, F.lit("["))
    parsed = df.withColumns({
        "_valid": strict_json(raw).isNotNull(),
        "_is_list": is_list,
        "_points": F.from_json(F.when(is_list, raw), T.ArrayType(schemas.POINT)),
        "_e": F.from_json(F.when(F.startswith(raw, F.lit("{")), raw), _ENVELOPE),
        "_keys": F.array_join(F.array_sort(F.json_object_keys(raw)), ","),
    })
    e, seconds = F.col("_e"), F.col(duration)
    identity = e["media_identity"]
    checked = parsed.withColumns({
        "_segments": segments_valid(F.coalesce("_points", e["chapters"]), seconds),
        "_same": F.coalesce((identity["size"] == F.col(size)) & (identity["mtime_ns"] == F.col(mtime_ns)), F.lit(False)),
        "_hex": F.when(e["attestation_version"] == 2, hex_double(seconds)),
    })
    short = e["method"] == METHODS[1]
    ok_first = (
        (F.col("_keys") == "attestation_version,chapters,media_identity,method") & e["method"].isin(*METHODS)
        & F.col("_same") & F.col("_segments") & ~(short & ((F.size(e["chapters"]) > 0) | (seconds >= SHORT_MEDIA_SECONDS)))
    )
    ok_second = (
        (F.col("_keys") == "attestation_version,media_identity,method,outcome,reason,trusted_duration")
        & (e["method"] == NEGATIVE_METHOD) & (e["outcome"] == NEGATIVE_OUTCOME) & (e["reason"] == NEGATIVE_REASON)
        & identity["size"].isNotNull() & F.regexp_like(e["trusted_duration"], F.lit(r"^0x1\.[0-9a-f]{13}p[+-][0-9]+$"))
    )
    current = F.col("_same") & (e["trusted_duration"] == F.col("_hex"))
    usable = F.when(F.col("_segments"), "legacy_nonempty").otherwise("invalid")
    status = (
        F.when(F.col(stored).isNull(), "missing").when(~F.col("_valid"), "invalid")
        .when(F.col("_is_list"), F.when(F.size("_points") == 0, "legacy_empty").otherwise(usable))
        .when(e["attestation_version"] == 1, F.when(ok_first, "trusted_v1").otherwise("invalid"))
        .when(e["attestation_version"] == 2, F.when(ok_second, F.when(current, "trusted_negative_v2")
                                                    .otherwise("re_attestation_required")).otherwise("invalid"))
        .otherwise("invalid")
    )
    return checked.withColumn(name, status).drop("_valid", "_is_list", "_points", "_e", "_keys", "_segments", "_same", "_hex")


def overruns_only_at_end(points: Column, duration: Column) -> Column:
    """Segments that are right but for a last end past the duration."""
    last = F.element_at(points, -1)
    return segments_valid(points, last["chapter_end"]) & (last["chapter_start"] <= duration) & (last["chapter_end"] > duration)


def cache_status(files: DataFrame, points: DataFrame) -> DataFrame:
    """Census status of every file and of every stored row without a file.

    files: path, duration, size, mtime_ns, eligible. points: path, points (JSON text).
    """
    joined = files.withColumn("_file", F.lit(True)).join(points.select("path", "points"), "path", "full_outer")
    judged = with_segment_status(joined, name="_status").withColumns({
        "_stored": F.from_json("points", T.ArrayType(schemas.POINT)),
        "_is_list": F.startswith(F.trim("points"), F.lit("[")),
    })
    stored, is_list = F.col("_stored"), F.col("_is_list")
    status = (
        F.when(F.col("_file").isNull(), F.when(is_list & (F.size(stored) == 0), "unavailable_empty")
               .when(is_list, "unavailable_nonempty").otherwise("invalid"))
        .when((F.col("_status") == "invalid") & is_list & overruns_only_at_end(stored, F.col("duration")), "legacy_overrun")
        .otherwise(F.col("_status"))
    )
    return judged.select("path", "duration", "eligible", status.alias("status"))


def cache_census(files: DataFrame, points: DataFrame) -> DataFrame:
    """One row of counters over cache_status: what is trusted, stale, orphaned, and what must be probed."""
    status = cache_status(files, points)
    ours = F.col("eligible") & F.col("status").isNotNull()

    def n(*names: str) -> Column:
        return F.count_if(ours & F.col("status").isin(*names))

    redo = ("missing", "legacy_empty", "re_attestation_required", "legacy_overrun")
    short = F.count_if(ours & F.col("status").isin(*redo) & (F.col("duration") > 0) & (F.col("duration") < SHORT_MEDIA_SECONDS))
    counted = status.agg(
        F.count_if(F.col("eligible")).alias("eligible"), n("missing").alias("missing"),
        n("legacy_empty").alias("current_empty"), n("legacy_nonempty", "legacy_overrun").alias("legacy_nonempty"),
        n("legacy_nonempty").alias("trusted_legacy_nonempty"),
        n("re_attestation_required", "legacy_overrun").alias("re_attestation_required"),
        n("trusted_v1", "trusted_negative_v2").alias("versioned"), n("invalid").alias("invalid"),
        F.count_if(F.col("status") == "unavailable_empty").alias("unavailable_empty"),
        F.count_if(F.col("status") == "unavailable_nonempty").alias("unavailable_nonempty"),
        n(*redo).alias("attestations"), short.alias("short_media"))
    return counted.withColumns({
        "orphan_retirements": F.col("unavailable_empty") + F.col("unavailable_nonempty"),
        "probes": F.col("attestations") - F.col("short_media")})


# ---- references ----------------------------------------------------------------------------


def check_references(blocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Content ids that are missing from the catalog or belong to another station."""
    refs = blocks.select("id", "station", F.explode("content_ids").alias("content_id"))
    items = catalog.select(F.col("id").alias("content_id"), F.col("station").alias("_owner"))
    found = refs.join(items, "content_id", "left")
    problem = F.when(F.col("_owner").isNull(), "missing").when(F.col("_owner") != F.col("station"), "other_station")
    return found.select("id", "content_id", problem.alias("problem")).filter("problem IS NOT NULL")


def check_unique(stations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once in columns that should be unique."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return stations.select(pairs.alias("p")).select("p.*").filter("value IS NOT NULL").groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def check_guide(raw: DataFrame, projected: DataFrame, width: int = DAY_US) -> DataFrame:
    """Per station: probes one microsecond around every block edge, and how they resolve.

    checked, zero and one count probes by what the guide shows; multiple counts probes where either
    side has more than one entry, mismatched those where the guide shows other entries than the
    schedule. Every edge adds or removes its entry from a running count and a running digest of what
    is on, so no probe is paired with a block.
    """
    def edges(blocks: DataFrame, side: str) -> DataFrame:
        entry = F.xxhash64("id", "title", "start_us", "end_us").cast("decimal(20,0)")
        steps = F.explode(F.array(
            F.struct(F.col("start_us").alias("us"), F.lit(1).alias("n")), F.struct(F.col("end_us").alias("us"), F.lit(-1).alias("n"))))
        lasting = with_micros(blocks).filter("end_us > start_us")
        return lasting.select("station", steps.alias("e"), entry.alias("x")).select(
            "station", "e.us", F.col("e.n").alias(f"{side}_n"), (F.col("x") * F.col("e.n")).alias(f"{side}_x"))

    every = edges(raw, "raw").unionByName(edges(projected, "shown"), allowMissingColumns=True)
    ends = with_micros(raw).select("station", F.explode(F.array("start_us", "end_us")).alias("us"))
    probes = ends.select("station", F.explode(F.array(F.col("us") - 1, F.col("us"), F.col("us") + 1)).alias("us"), F.lit(True).alias("probe"))
    moments = every.unionByName(probes, allowMissingColumns=True).groupBy("station", "us").agg(
        *[F.sum(f"{side}_n").alias(f"{side}_n") for side in ("raw", "shown")],
        *[F.sum(f"{side}_x").cast("decimal(38,0)").alias(f"{side}_x") for side in ("raw", "shown")], F.bool_or("probe").alias("probe"))
    on = OrderedScan(moments, ["station"], ["us"], width).running(
        *[Running(f"{side}_on", "sum", F.col(f"{side}_n")) for side in ("raw", "shown")],
        *[Running(f"{side}_set", "sum", F.col(f"{side}_x")) for side in ("raw", "shown")]).result().filter("probe")
    differs = (F.col("raw_on") != F.col("shown_on")) | (F.col("raw_set") != F.col("shown_set"))
    return on.groupBy("station").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("shown_on") == 0).alias("zero"),
        F.count_if(F.col("shown_on") == 1).alias("one"),
        F.count_if((F.col("raw_on") > 1) | (F.col("shown_on") > 1)).alias("multiple"), F.count_if(differs).alias("mismatched"))


def json_keys(text: Column | str) -> Column:
    """All object keys of a JSON text at any depth, in order of appearance, their escapes decoded."""
    tokens = F.regexp_extract_all(col(text), F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    named = F.filter(tokens, lambda t: F.endswith(t, F.lit(":")))
    return F.transform(named, lambda t: F.from_json(
        F.concat(F.lit("["), F.regexp_replace(t, r'\s*:$', ""), F.lit("]")), "array<string>")[0])


def is_reference_key(key: Column) -> Column:
    """Whether a JSON key looks like a reference to another row."""
    k = F.replace(F.lower(key), F.lit("-"), F.lit("_"))
    table = F.contains(k, F.lit("catalog")) | F.contains(k, F.lit("liquid_block")) | F.contains(k, F.lit("sequence_entry"))
    return k.isin(*REFERENCE_KEYS) | (table & (F.contains(k, F.lit("id")) | F.contains(k, F.lit("ref"))))


def check_hidden_references(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Rows whose JSON columns hold keys that look like references: key, column, json_key."""
    found = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), json_keys(c).alias("keys")) for c in columns]))
    return df.select(key, found.alias("f")).select(key, "f.column", F.explode("f.keys").alias("json_key")).filter(
        is_reference_key(F.col("json_key"))).distinct()


def check_reference_columns(columns: DataFrame, known: DataFrame) -> DataFrame:
    """Id-like columns that are neither a primary key nor known.

    columns: table, column, is_primary; known: table, column.
    """
    name = F.lower("column")
    suspects = columns.filter(((name == "id") | F.endswith(name, F.lit("_id"))) & ~F.col("is_primary"))
    return suspects.select("table", "column").join(known.select("table", "column"), ["table", "column"], "left_anti")


def replay_counts(events: DataFrame, before: DataFrame, after: DataFrame, lists: DataFrame | None = None,
                  on: Sequence[str] = ()) -> DataFrame:
    """Replay selections and compare with the final counts: id, increments, problem, disposition.

    events: ids (array), one row per play. before and after: id, count. A problem is an id that is
    unknown, or a final count that the replay does not give. Where many events have the same list, `lists` may hold each once,
    in rows (*on, ids), and events only its key: plays of a list are then counted before its ids are read.
    """
    if lists is None:
        listed = events.select("ids", F.lit(1).cast("bigint").alias("_plays"))
    else:
        listed = events.groupBy(*on).agg(F.count(F.lit(1)).alias("_plays")).join(lists.select(*on, "ids"), list(on))
    played = listed.select(F.explode("ids").alias("id"), "_plays").groupBy("id").agg(F.sum("_plays").alias("_n"))
    was = before.select("id", F.col("count").alias("_was"))
    now = after.select("id", F.col("count").alias("_now"))
    joined = was.join(now, "id", "full_outer").join(played, "id", "full_outer")
    increments = F.coalesce("_n", F.lit(0))
    problem = (
        F.when(F.col("_was").isNull() | F.col("_now").isNull(), "unknown_id")
        .when(F.col("_now") != increments, "count_mismatch")
    )
    disposition = (
        F.when(increments > 0, "native_selection").when(F.col("_was") != F.col("_now"), "native_reset")
        .otherwise("preserve_baseline")
    )
    return joined.select("id", increments.alias("increments"), problem.alias("problem"), disposition.alias("disposition"))


def check_event_groups(events: DataFrame, items: DataFrame, keys: Sequence[str] = ("station", "path"), event: str = "event_id",
                       lists: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Events that do not list exactly the ids of their group in ascending order: event, keys, problem.

    events: event, keys, ids. items: id, keys. problem is unknown_group for ids of a group that has no items, else wrong_ids.
    The items of a group are entries of one file on one station; an event lists them all, so they fit in a row. Where many events
    have the same list, `lists` may hold each once, in rows (*on, ids), and events only its key: a list is then held once
    against every group that events name it for, and events meet the verdict.
    """
    groups = items.groupBy(*keys).agg(F.sort_array(F.collect_list("id")).alias("_group"))
    named = list(dict.fromkeys([*on, *keys]))
    stated = events.select(event, *keys, "ids") if lists is None else events.select(*named).distinct().join(lists.select(*on, "ids"), list(on))
    judged = stated.join(groups, list(keys), "left")
    problem = (
        F.when(F.col("_group").isNull() & (F.size(F.coalesce("ids", F.array())) > 0), "unknown_group")
        .when(F.col("_group").isNotNull() & ~F.col("ids").eqNullSafe(F.col("_group")), "wrong_ids")
    )
    if lists is None:
        return judged.select(event, *keys, problem.alias("problem")).filter("problem IS NOT NULL")
    wrong = judged.select(*[F.col(c).alias(f"_of_{c}") for c in named], problem.alias("problem")).filter("problem IS NOT NULL")
    same = [F.col(c) == F.col(f"_of_{c}") if c in on else F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in named]
    return events.join(wrong, same).select(event, *keys, "problem")
