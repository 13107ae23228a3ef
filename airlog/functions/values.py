"""Timestamps as exact microseconds, rounding, canonical encodings and JSON columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a naive timestamp, whatever the session time zone."""
    elapsed = (col(ts) - F.expr(_EPOCH)).cast("interval second")
    return (elapsed.cast("decimal(18,6)") * F.lit(1000000)).cast("bigint")


def seconds_interval(seconds: Column | str) -> Column:
    """A day-time interval from seconds, rounded once to microseconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(seconds).cast("decimal(18,6)"))


def micros_interval(us: Column | str) -> Column:
    exact = col(us).cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), exact.cast("decimal(18,6)"))


def from_micros(us: Column | str) -> Column:
    """The naive timestamp of an exact microsecond count."""
    return F.expr(_EPOCH) + micros_interval(us)


def with_micros(df: DataFrame, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Add start_us and end_us unless the table already carries them."""
    if "start_us" in df.columns and "end_us" in df.columns:
        return df
    return df.withColumns({"start_us": micros(start), "end_us": micros(end)})


def let(value: Column, use) -> Column:
    """use(value) with the value computed once per row, however often and conditionally it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def round_up(seconds: Column | str, increment_minutes: Column | int) -> Column:
    """Round a duration up to a multiple of the schedule increment; 0 leaves it alone."""
    step = (increment_minutes if isinstance(increment_minutes, Column) else F.lit(increment_minutes)) * 60
    value = col(seconds)
    return F.when(step == 0, value).otherwise(F.ceil(value / F.nullif(step, F.lit(0))) * step)


def tags_array(tags: Column | str) -> Column:
    """JSON array text, or a bare tag, as an array of strings."""
    text = F.trim(col(tags))
    is_list = F.startswith(text, F.lit("["))
    parsed = F.from_json(F.when(is_list, text), T.ArrayType(T.StringType()))
    return F.when(is_list, parsed).when(text.isNotNull(), F.array(text))


def id_array(content: Column | str) -> Column:
    """A JSON integer or array of integers as an array of ids; null when there is no reference."""
    text = F.trim(col(content))
    is_list = F.startswith(text, F.lit("["))
    many = F.from_json(F.when(is_list, text), T.ArrayType(T.LongType()))
    one = F.array(text.try_cast("bigint"))
    return F.when(is_list, many).when(text.isNotNull() & ~text.isin("", "null", "0"), one)


def strict_json(text: Column | str) -> Column:
    """Parsed JSON, null for malformed text, duplicate keys or non-finite numbers.

    The parser alone ignores what follows a complete value. A text that is exactly one value parses
    both as the only item of a list and as the only field of an object.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), col(text), F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), col(text), F.lit("}")))
    return F.when((F.size(listed) == 1) & named.isNotNull(), F.get(listed, F.lit(0)))


_TAGS = {"boolean": "b", "tinyint": "i", "smallint": "i", "int": "i", "bigint": "i",
         "float": "r", "double": "r", "string": "t", "binary": "x"}


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def canonical(df: DataFrame, columns: Sequence[str]) -> Column:
    """One unambiguous text per row: every value framed by its type tag and its length.

    Times are microseconds, whatever the session's time zone, and the entries of a map stand in the order of their keys.
    Maps inside other values and times inside nested values have no such form and are refused.
    """
    frames = []
    for name in sorted(columns):
        kind = df.schema[name].dataType.simpleString()
        value = F.col(name)
        if kind == "binary":
            text = F.base64(value)
        elif kind == "timestamp_ntz":
            text = micros(value).cast("string")
        elif kind == "timestamp":
            text = F.unix_micros(value).cast("string")
        elif kind in _TAGS or kind.startswith(("decimal", "date")):
            text = value.cast("string")
        else:
            whole = df.schema[name].dataType
            if isinstance(whole, T.MapType):
                whole, value = T.StructType([T.StructField("k", whole.keyType), T.StructField("v", whole.valueType)]), F.array_sort(F.map_entries(value))
            if _holds_map(whole) or "timestamp" in whole.simpleString():
                raise ValueError(f"column {name}: no canonical form of {kind}")
            text = F.to_json(value)
        tag = _TAGS.get(kind, kind.split("<")[0].split("(")[0])
        framed = F.concat(F.lit(tag), F.length(text).cast("string"), F.lit(":"), text)
        frames.append(F.coalesce(framed, F.lit("n")))
    return F.concat(*frames)


def title_words(text: Column) -> Column:
    """Capitalise every space-separated word and lower-case the rest of it."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))),
        " ",
    )


def seeded_number(seed: int, *columns: Column | str) -> Column:
    """A number from 0 to 2**60 - 1 drawn from a seed and a row's values: md5 of their texts joined by colons, so that any engine can
    repeat it. Nulls are left out of the text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")
