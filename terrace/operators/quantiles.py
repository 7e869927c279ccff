"""Exact quantiles of all groups at once, and exact ranks, without a task that holds a group.

Quantiles are selected by histograms that are refined: the values are counted in BINS equal parts between each group's least and
greatest value (of their magnitudes first, where these differ), the parts that hold a wanted rank are counted again between the least and
greatest value in them, and so on, until a part holds one value or LIMIT values at most, which are then sorted as a list. Counts are combined before they are shuffled, so
a pass moves BINS rows a part and task at most. Values bunched together take more passes, never more memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BINS, LIMIT = 1024, 4096
#: Infinite values count as the greatest finite ones.
_MOST = 1.7976931348623157e308


def _part_of(value: Column) -> Column:
    """The part of the group that the value is in and that is to be refined or sorted; null if none."""
    return F.get(F.filter("parts", lambda i: (i["lo"] < i["hi"]) & value.between(i["lo"], i["hi"])), F.lit(0))


def _magnitude(value: Column) -> Column:
    """Rises with the value and grows with its exponent, so that values of any size part in a pass or two."""
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.log2(F.abs(value)) + 1100))


def _refined(values: DataFrame, state: DataFrame) -> DataFrame:
    hits = values.join(state.select("g", "parts"), "g").select("g", "v", _part_of(F.col("v")).alias("i")).where(F.col("i").isNotNull())
    v, lo, hi = F.col("v"), F.col("i.lo"), F.col("i.hi")
    by_magnitude, by_value = (F.floor((scale(v) - scale(lo)) / F.nullif(scale(hi) - scale(lo), F.lit(0.0)) * BINS) for scale in (_magnitude, lambda c: c / 2))
    k = F.when(_magnitude(hi) - _magnitude(lo) > 2, by_magnitude).otherwise(by_value)
    # Without a distance that can be told, both ends still part.
    k = F.coalesce(F.least(k, F.lit(BINS - 1)), F.when(v == lo, 0).otherwise(BINS - 1))
    counts = hits.groupBy("g", F.col("i.below").alias("base"), k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = Window.partitionBy("g", "base").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    placed = counts.withColumn("below", F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = F.exists("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    kept = placed.join(state.select("g", "ranks"), "g").where(wanted)
    fresh = kept.groupBy("g").agg(F.collect_list(F.struct("lo", "hi", "below", "n")).alias("fresh"))  # one for each rank at most
    done = F.filter("parts", lambda i: i["lo"] == i["hi"])
    joined = state.withColumnRenamed("g", "g0").join(fresh, F.col("g0") == F.col("g"), "left").drop("g").withColumnRenamed("g0", "g")
    return joined.select("g", "n", "ranks", F.concat(done, F.coalesce("fresh", F.expr("array()").cast("array<struct<lo:double,hi:double,below:bigint,n:bigint>>"))).alias("parts"))


def quantiles(rows: DataFrame, column: str, probs: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, quantiles): the quantiles of each group's values, with linear interpolation between neighbours, in the order of ``probs``. Equal to ``percentile``."""
    between = lambda a: F.when(a["low"] == a["high"], a["low"]).otherwise((1 - a["share"]) * a["low"] + a["share"] * a["high"])
    return neighbours(rows, column, probs, by).select(*by, "n", F.transform("around", between).alias("quantiles"))


def neighbours(rows: DataFrame, column: str, probs: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, around): for each of ``probs`` the values low and high that its place lies between, and its share of the way; on a value, both are that value.

    Null and NaN are no values; a group without values has no row; null is a group of its own; repeated values
    count as often as they occur; an empty table gives no rows.
    """
    value = F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.col(column).cast("double")))
    known = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    values = written(known.select(F.struct(*by, F.lit(0).alias("of_all")).alias("g"), value.alias("v")), "quantile-values")
    of = F.array(*[F.lit(float(p)) for p in probs])
    place = lambda p: (F.col("n") - 1) * p
    ranks = F.array_distinct(F.concat(F.transform(of, lambda p: F.floor(place(p))), F.transform(of, lambda p: F.ceil(place(p)))))
    state = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = written(state.select("g", "n", ranks.alias("ranks"), F.array(F.struct("lo", "hi", F.lit(0).cast("long").alias("below"), "n")).alias("parts")), "quantile-parts")
    while (state.agg(F.max(F.array_max(F.transform(F.filter("parts", lambda i: i["lo"] < i["hi"]), lambda i: i["n"])))).first()[0] or 0) > LIMIT:
        state = written(_refined(values, state), "quantile-parts")
    left = values.join(state.select("g", "parts"), "g").select("g", "v", _part_of(F.col("v")).alias("i")).where(F.col("i").isNotNull())
    lists = left.groupBy("g", F.col("i.below").alias("below")).agg(F.array_sort(F.collect_list("v")).alias("values"))  # LIMIT values at most
    sorted_parts = lists.groupBy(F.col("g").alias("g2")).agg(F.collect_list(F.struct("below", "values")).alias("lists"))
    joined = state.join(sorted_parts, F.col("g") == F.col("g2"), "left")

    def at(rank: Column) -> Column:
        part = F.get(F.filter("parts", lambda i: (i["below"] <= rank) & (rank < i["below"] + i["n"])), F.lit(0))
        held = F.get(F.filter("lists", lambda q: q["below"] == part["below"]), F.lit(0))
        return F.coalesce(F.get(held["values"], (rank - part["below"]).cast("int")), part["lo"])

    around = lambda p: F.struct(at(F.floor(place(p))).alias("low"), at(F.ceil(place(p))).alias("high"), (place(p) - F.floor(place(p))).alias("share"))
    return joined.select(*[F.col(f"g.{c}").alias(c) for c in by], "n", F.transform(of, around).alias("around"))


def column_quantiles(rows: DataFrame, columns: tuple[str, ...], probs: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, columns): an array of quantiles for each of the columns, null where a group has no value of it. All columns are worked on together."""
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    melted = rows.select(*by, F.explode(named).alias("of")).select(*by, F.col("of.name").alias("__name"), F.col("of.value").alias("__value"))
    found = quantiles(melted, "__value", probs, (*by, "__name"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == c, F.col("quantiles"))).alias(c) for c in columns])


def ranked(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str = "rank") -> DataFrame:
    """``rows`` with the place, from 0, of each within its group by the columns ``order``, which must tell a group's rows apart.

    Rows are dealt into ranges of (by, order) and numbered within a range; the numbers of rows before it are added. A group may span many ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    group = F.struct(*by, F.lit(0))
    sizes = dealt.groupBy(group.alias("__g"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("__g", "__r", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(group, "__range").orderBy(*order)
    numbered = dealt.withColumn("__at", F.row_number().over(within) - 1).withColumn("__group", group)
    joined = numbered.join(starts, (F.col("__group") == F.col("__g")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn(name, F.col("__at") + F.col("__before")).drop("__at", "__group", "__range", "__g", "__r", "__before")
