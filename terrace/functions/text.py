"""Names, labels and small formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(name: Column) -> Column:
    """'F. Last' of a name of several words, else the name."""
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) < 2, name).otherwise(F.concat(F.substring(name, 1, 1), F.lit(". "), F.element_at(parts, -1)))


def display_name(nick: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(nick, F.lit("")), short_name(name))


def body_part(value: Column) -> Column:
    return F.when(value == "Head", "Head").when(value.contains("Foot"), "Foot").otherwise("Other")


def shot_type(value: Column) -> Column:
    return F.when(value.isin("Open Play", "Free Kick"), value).otherwise("Other")


def flag(value: Column) -> Column:
    """True is 1; false and missing are 0."""
    return F.coalesce(value, F.lit(False)).cast("int")


def mean_of(text: Column) -> Column:
    """The number before '+/-'."""
    return F.trim(F.split(text, r"\+/-")[0]).cast("double")


def mean_and_deviation(values: Column) -> Column:
    return F.format_string("%.4f +/- %.4f", F.avg(values), F.stddev_samp(values))


def shirt_number(player: Column) -> Column:
    return F.regexp_extract(player, r"(\d+)$", 1).cast("int")
