"""Result tables as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_rows(df: DataFrame, order: list[str], places: int = 4) -> DataFrame:
    """(row): the lines of a markdown table, sorted; null is an empty cell, doubles have ``places`` digits behind the point."""
    names = df.columns
    shown = [F.format_string(f"%.{places}f", c) if kind == "double" else F.col(c).cast("string") for c, kind in df.dtypes]
    filled = [F.when(F.col(c).isNull(), "").otherwise(text) for c, text in zip(names, shown)]
    cells = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *filled), F.lit(" |")).alias("row"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(names) + " |",), ("|" + "---|" * len(names),)], "row string")
    return head.unionByName(cells)


def markdown(df: DataFrame, order: list[str]) -> str:
    """A small result as one markdown table."""
    return "\n".join(r["row"] for r in markdown_rows(df, order).collect())
