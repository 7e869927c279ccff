"""exp, log, atan2 and the step between quantiles to the last bit as C's library computes them, which is what SQL engines call.

Spark's own come from Java's and differ in the last bit at about one place in ten. That matters where values are ranked or cut at each other: mirrored
places have scores that are equal but for that bit. Null stays null; what C answers by an infinity is one here.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


# Functions within functions: they travel to the workers as they are, and these need no copy of the package.
def exp(v: Column) -> Column:
    def of(v: float) -> float:
        try:
            return math.exp(v)
        except OverflowError:
            return math.inf

    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else of(x) for x in v.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(v.cast("double"))


def log(v: Column) -> Column:
    def of(v: float) -> float:
        return math.log(v) if v > 0 else -math.inf if v == 0 else math.nan

    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else of(x) for x in v.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")(v.cast("double"))


def atan2(y: Column, x: Column) -> Column:
    def run(y: pa.Array, x: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else math.atan2(a, b) for a, b in zip(y.to_pylist(), x.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(y.cast("double"), x.cast("double"))


def step(low: Column, high: Column, share: Column) -> Column:
    """What lies so large a share of the way from low to high, rounded once."""

    def of(low: float, high: float, share: float) -> float:
        return low if low == high or share == 0 else math.fma(low, 1 - share, high * share)

    def run(low: pa.Array, high: pa.Array, share: pa.Array) -> pa.Array:
        return pa.array([None if None in row else of(*row) for row in zip(low.to_pylist(), high.to_pylist(), share.to_pylist())], pa.float64())

    return F.arrow_udf(run, "double")(low, high, share)
