"""Two-dimensional histograms and their smoothing, as (ix, iy, value) tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, extent: tuple[float, float], bins: tuple[int, int], by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of x and y within [0, extent]; the far edge belongs to the last bin."""
    inside = rows.where(F.col("x").between(0, extent[0]) & F.col("y").between(0, extent[1]))
    cells = [F.least(F.lit(n - 1), F.floor(F.col(c) / F.lit(e / n))).cast("int").alias(i) for c, e, n, i in (("x", extent[0], bins[0], "ix"), ("y", extent[1], bins[1], "iy"))]
    return inside.select(*by, *cells).groupBy(*by, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))


def _spread(grid: DataFrame, axis: str, size: int, weights: dict[int, float]) -> DataFrame:
    """Hand each cell's value to the cells around it along an axis; what leaves the grid is reflected at its edge."""
    moves = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in weights.items()])
    moved = grid.withColumn("__m", F.explode(moves))
    # A value at i lands on o if o + d, reflected, is i. Each cell of the grid asks in turn through its reflections.
    at = F.col(axis) - F.col("__m.d")
    mirrored = F.array_distinct(F.array(at, -F.col(axis) - 1 - F.col("__m.d"), F.lit(2 * size - 1) - F.col(axis) - F.col("__m.d")))
    landed = moved.withColumn("__o", F.explode(mirrored)).where(F.col("__o").between(0, size - 1))
    others = [c for c in grid.columns if c not in (axis, "n")]
    return landed.groupBy(*others, F.col("__o").alias(axis)).agg(F.sum(F.col("n") * F.col("__m.w")).alias("n"))


def blurred(grid: DataFrame, bins: tuple[int, int], sigma: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian blur along both axes, radius int(4 sigma + 0.5), as shares of each group's total."""
    radius = int(4 * sigma + 0.5)
    raw = {d: math.exp(-0.5 * d * d / (sigma * sigma)) for d in range(-radius, radius + 1)}
    weights = {d: w / sum(raw.values()) for d, w in raw.items()}
    spread = _spread(_spread(grid.withColumn("n", F.col("n").cast("double")), "ix", bins[0], weights), "iy", bins[1], weights)
    whole = spread.groupBy(*by).agg(F.sum("n").alias("__whole"))
    joined = spread.join(whole, list(by)) if by else spread.crossJoin(F.broadcast(whole))
    return joined.select(*by, "ix", "iy", (F.col("n") / F.col("__whole")).alias("share"))
