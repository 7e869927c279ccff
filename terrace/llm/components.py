"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least_neighbour(links: DataFrame, rows: int) -> DataFrame:
    """(u, m): the least of each node's neighbours; written, so that the join with it shuffles both sides and can be split."""
    return materialize(links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"), "least", rows)


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Tie each node's larger neighbours to its least neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both, 2 * rows)
    tied = both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.least("m", "node").alias("v"))
    return tied.distinct()


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of them."""
    least = _least_neighbour(links, rows)
    joined = links.join(least, F.col("u") == F.col("node"))
    tied = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v")))
    return tied.distinct()


def _state(links: DataFrame) -> tuple:
    """Size and order-free sum of a table of links; equal for equal tables."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (two columns of one ordered type, undirected).

    The component is its least node. Loops, repeated links, links in both
    directions and null ends (ignored) do no harm; no links give no rows. The number of rounds
    grows with the logarithm of the longest path; each round is written.
    """
    a, b = links.columns
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links", links.count())
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        # A large star has at most as many links as before, a small star at most one more for each node.
        rows = state[0]
        now = materialize(_small_star(materialize(_large_star(now, rows), "large-star", rows), rows), "small-star", 2 * rows)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
