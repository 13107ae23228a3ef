"""Column renaming for joins of a table with itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
