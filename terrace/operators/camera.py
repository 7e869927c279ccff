"""Chains of camera matrices of any length, as prefix products by blocks.

A 3 x 3 matrix is an array of nine numbers, rows first, and matters up to a factor, so that inverses are adjugates and products are scaled
as they are made. The prefix products of a sequence are those within blocks of BLOCK matrices, each times the product of all
blocks before it, which is a prefix product of the shorter sequence of the blocks' products. So a row holds a block, and no task a clip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

BLOCK = 64


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value made once a row; an expression that mentions another n times makes it n times, and so on inwards."""
    return F.transform(F.array(value), of)[0]


def product(a: Column, b: Column) -> Column:
    """a and b are columns or bound by ``once``, since each is mentioned 27 times."""
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def scaled(m: Column) -> Column:
    """By its greatest entry, so that long products neither overflow nor vanish."""
    by = lambda w: once(F.array_max(F.transform(w, F.abs)), lambda top: F.transform(w, lambda v: v / F.when(top != 0, top)))
    return once(m, by)


def adjugate(m: Column) -> Column:
    """The inverse up to a factor."""
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    return F.array(
        minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)
    )


def prefix_products(rows: DataFrame, key: tuple[str, ...], longest: int) -> DataFrame:
    """(key, d, p): the product of the matrices m of places 0 to d, for each d of a key's rows (key, d, m); ``longest`` bounds d."""
    if longest < 1:
        return rows.select(*key, "d", F.col("m").alias("p"))
    dealt = rows.groupBy(*key, F.floor(F.col("d") / BLOCK).alias("b")).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("ms"))
    chained = F.aggregate(
        F.slice("ms", 2, BLOCK), F.slice(F.transform("ms", lambda e: e["m"]), 1, 1),
        lambda done, e: F.concat(done, F.array(once(F.struct(F.element_at(done, -1).alias("p"), e["m"].alias("m")), lambda s: once(s["p"], lambda p: once(s["m"], lambda m: scaled(product(p, m))))))),
    )
    blocks = dealt.select(*key, "b", F.transform("ms", lambda e: e["d"]).alias("ds"), chained.alias("ps"))
    if longest < BLOCK:
        return blocks.select(*key, F.explode(F.arrays_zip("ds", "ps")).alias("e")).select(*key, F.col("e.ds").alias("d"), F.col("e.ps").alias("p"))
    blocks = written(blocks, "camera-blocks")
    before = prefix_products(blocks.select(*key, F.col("b").alias("d"), F.element_at("ps", -1).alias("m")), key, longest // BLOCK)
    before = before.select(*[F.col(c).alias(f"__{c}") for c in key], (F.col("d") + 1).alias("__b"), F.col("p").alias("__p"))
    same = F.col("b") == F.col("__b")
    for c in key:
        same &= F.col(c) == F.col(f"__{c}")
    spread = blocks.join(before, same, "left").select(*key, "__p", F.explode(F.arrays_zip("ds", "ps")).alias("e"))
    return spread.select(*key, F.col("e.ds").alias("d"), F.when(F.col("__p").isNull(), F.col("e.ps")).otherwise(scaled(product(F.col("__p"), F.col("e.ps")))).alias("p"))


def camera_maps(steps: DataFrame, reference: int, to_pitch: list[float]) -> DataFrame:
    """(clip, frame, h): each frame's matrix to the pitch.

    steps has clip, frame and h, the matrix from a frame's pixels to the next frame's; to_pitch maps the reference frame. A frame's map
    goes along the clip's steps to the reference, inverted for later frames; frames behind a missing step have none. Steps that are repeated
    or null count as missing. A clip of steps has its reference at least.
    """
    rows = written(steps.groupBy("clip", "frame").agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("times")).where("times = 1 AND h IS NOT NULL").drop("times"), "camera-steps")
    forward = F.col("frame") >= reference
    ahead = rows.select("clip", forward.alias("forward"), F.when(forward, F.col("frame") - reference).otherwise(reference - 1 - F.col("frame")).alias("d"), F.when(forward, adjugate(F.col("h"))).otherwise(F.col("h")).alias("m"))
    # The first place of each direction that is missing ends its chain.
    nexts = ahead.select(F.col("clip").alias("c2"), F.col("forward").alias("f2"), (F.col("d") - 1).alias("d2"))
    ends = ahead.join(nexts, (F.col("clip") == F.col("c2")) & (F.col("forward") == F.col("f2")) & (F.col("d") == F.col("d2")), "left_anti").groupBy("clip", "forward").agg(F.min("d").alias("last"))
    starts = ahead.where("d = 0").select("clip", "forward")
    reach = ends.join(starts, ["clip", "forward"]).select(F.col("clip").alias("c3"), F.col("forward").alias("f3"), "last")
    chains = written(ahead.join(reach, (F.col("clip") == F.col("c3")) & (F.col("forward") == F.col("f3"))).where("d <= last").select("clip", "forward", "d", "m"), "camera-chains")
    longest = chains.agg(F.max("d")).first()[0]
    base = F.array(*[F.lit(float(v)) for v in to_pitch])
    own = steps.select("clip").distinct().select("clip", F.lit(reference).cast("int").alias("frame"), base.alias("h"))
    found = prefix_products(chains, ("clip", "forward"), int(longest or 0)) if longest is not None else chains.select("clip", "forward", "d", F.col("m").alias("p"))
    frame = F.when(F.col("forward"), reference + 1 + F.col("d")).otherwise(reference - 1 - F.col("d")).cast("int")
    maps = found.select("clip", frame.alias("frame"), product(base, F.col("p")).alias("h")).unionByName(own)
    return maps.select("clip", "frame", F.transform("h", lambda v: v / F.nullif(F.col("h")[8], F.lit(0.0))).alias("h"))
