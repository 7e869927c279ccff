"""Where the queries are registered: name, callable, and DuckDB SQL where SQL can express the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under its name."""

        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return register


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.round(n, places) for n, t in df.dtypes if t == "double"})
