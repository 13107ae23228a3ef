"""Registration of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Tables object under a name, with its checking SQL if it has any."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from queries.views import Tables

            return build(Tables(spark, sf_dir))

        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            from queries.sql_views import with_views

            ORACLES[name] = with_views(sql)
        return build

    return register
