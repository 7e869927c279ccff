"""Benchmark decontamination by SimHash of item-sized windows. DataFrame operations only.

Words are lower-cased and cut at ASCII white space; a shingle is SHINGLE words, or the whole item if it has
fewer. A document's windows for an item have as many words as the item, start at every word, and are clipped at the
document's ends. Weighted similarity is the sum of the lesser of both weights over the sum of the greater, a shingle's
weight being how often it occurs. With w shingles in a window and m in an item, SIMILARITY or more takes at least
SIMILARITY * (w + m) / (1 + SIMILARITY) shingles of the window that some item of that length has; windows with fewer
can't be copies and are passed over, by running counts over all starts. All others get a 64-bit SimHash, by running
counts of bits, and meet the items of their length through BLOCKS blocks of bits: within RADIUS = BLOCKS * (FLIPS + 1) - 1 bits some
block differs in at most FLIPS bits, and each item's blocks are listed with all such flips, so that no fingerprint
within the radius is missed. What meets is compared exactly, again by running counts.

At the similarity bound a copy's fingerprint is 10 bits off on average, and beyond the radius in about 1 of 1,000 cases; at a
similarity of 0.9 it is 7 bits off, and exact copies are at distance zero. Of two unrelated fingerprints of one length 15 of 100 meet
in a block and 1 of 1,000 is within the radius.

Cases: null and empty texts have no words and no windows; so have null and empty items; equal items
are compared once and reported each; repeated rows of a document are reported once; documents without
an id are reported with a null id, one row for each text; items and windows may have any length; other columns are never read; an
empty table on either side gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, FLIPS = 4, 4
RADIUS = BLOCKS * (FLIPS + 1) - 1
TENTHS = round(10 * SIMILARITY)
#: Bits j and j + 32 of a hash are counted in the halves of one number.
LANES = 32


def _words(text: str = "text") -> Column:
    cut = F.split(F.lower(common.text_or_empty(text)), common.WS + "+")
    return F.array_remove(cut, "")


def _shingles(words: str, k: int) -> Column:
    """Hashes of the k-word shingles in order; none if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, hashes).otherwise(F.array().cast("array<bigint>"))


def _bit_counts(h: str) -> list[Column]:
    return [F.shiftrightunsigned(F.col(h), j).bitwiseAND(F.lit((1 << 32) + 1)).alias(f"s{j}") for j in range(LANES)]


def _print(size: Column) -> Column:
    """Bits that are set in over half of ``size`` hashes, from the sums s0, s1, ... of their bit counts."""
    sums = F.array(*[F.col(f"s{j}") for j in range(LANES)])
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def bits(s: Column, j: Column) -> Column:
        low = F.when(2 * s.bitwiseAND(F.lit((1 << 32) - 1)) > size, F.call_function("shiftleft", one, j)).otherwise(none)
        high = F.when(2 * F.shiftrightunsigned(s, 32) > size, F.call_function("shiftleft", one, j + LANES)).otherwise(none)
        return low.bitwiseOR(high)

    return F.aggregate(F.transform(sums, bits), none, lambda a, b: a.bitwiseOR(b))


def simhash(lists: DataFrame, *keys: str) -> DataFrame:
    """keys and fp of each row of ``lists``, whose column hashes is not empty; the keys tell rows apart."""
    bits = lists.select(*keys, F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    sums = bits.select(*keys, "size", *_bit_counts("h")).groupBy(*keys, "size").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(LANES)])
    return sums.select(*keys, _print(F.col("size")).alias("fp"))


def _blocks(fp: str) -> Column:
    """(block, key) of each block of bits."""
    width = 64 // BLOCKS
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.col(fp), b * width).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for b in range(BLOCKS)])


def _items(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct sequence of words: item (least id), n_words, k, hashes."""
    words = benchmark.select("item_id", _words().alias("words")).where(F.size("words") > 0)
    kinds = words.groupBy("words").agg(F.min("item_id").alias("item"))
    sized = kinds.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    pick = F.coalesce(*[F.when(F.col("k") == k, _shingles("words", k)) for k in range(1, SHINGLE + 1)])
    return sized.select("item", "words", F.size("words").alias("n_words"), "k", pick.alias("hashes"))


def _with_flips(items: DataFrame) -> DataFrame:
    """(item, n_words, item_fp, block, key) with each key that differs from a block in FLIPS bits or fewer."""
    masks = [sum(1 << i for i in c) for n in range(FLIPS + 1) for c in combinations(range(64 // BLOCKS), n)]
    parts = items.select("item", "n_words", F.col("fp").alias("item_fp"), F.explode(_blocks("fp")).alias("b"))
    return parts.select("item", "n_words", "item_fp", F.col("b.block").alias("block"), F.explode(F.transform(F.lit(masks), lambda m: F.col("b.key").bitwiseXOR(m.cast("bigint")))).alias("key"))


def _at(d: str, h: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("row_hash") == F.col(h))


def _hits(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, row_hash, size, n_words, k, h, pos): the documents' shingles that an item of n_words words has."""
    known = common.written_bitmap(shingles, "h")
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(common.text_or_empty()).alias("row_hash"), _words().alias("words"))
    found = []
    for k in sizes:
        at = texts.select("doc_id", "row_hash", F.size("words").alias("size"), F.posexplode(_shingles("words", k)).alias("pos", "h"))
        maybe = common.with_suspicion(at, "h", known, "suspect").where("suspect").drop("suspect")
        of_size = shingles.where(F.col("k") == k).select(F.col("h").alias("item_h"), "n_words", "k").distinct()
        found.append(maybe.join(of_size, F.col("h") == F.col("item_h")).select("doc_id", "row_hash", "size", "n_words", "k", "h", "pos"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _covered(spans: DataFrame, *keys: str) -> DataFrame:
    """keys, x, upto, n: how many of the spans [low, high] (columns) of a key cover each of x, ..., upto."""
    steps = spans.select(*keys, F.explode(F.array(F.struct(F.col("low").alias("x"), F.lit(1).alias("d")), F.struct((F.col("high") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = steps.groupBy(*keys, F.col("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*keys).orderBy("x")
    return steps.select(*keys, "x", (F.lead("x").over(order) - 1).alias("upto"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def _windows(hits: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_words, k, start, low, high): windows that may be copies; their shingles are low, ..., high - 1."""
    m, keys = F.col("n_words") - F.col("k") + 1, ["doc_id", "row_hash", "size", "n_words", "k"]
    counts = _covered(hits.select(*keys, (F.col("pos") - m + 1).alias("low"), F.col("pos").alias("high")), *keys)
    # A window's shingles are as many as the item's at most, so that copies have at least SIMILARITY of them in common.
    starts = counts.where(10 * F.col("n") >= TENTHS * m).select(*keys, "n", F.explode(F.sequence("x", "upto")).alias("start"))
    placed = starts.withColumn("low", F.greatest("start", F.lit(0))).withColumn("high", F.least(F.col("start") + m, F.col("size") - F.col("k") + 1))
    # Whole numbers on both sides, so that the bound itself isn't lost to rounding.
    enough = (10 + TENTHS) * F.col("n") >= TENTHS * (F.col("high") - F.col("low") + m)
    return placed.where(enough).select("doc_id", "row_hash", "n_words", "k", "start", "low", "high")


def _printed(docs: DataFrame, windows: DataFrame, rows: int) -> DataFrame:
    """``windows`` (some ``rows``) with fp, by running counts of bits over the parts of the texts that windows cover; only texts with windows are moved."""
    of_text = Window.partitionBy("doc_id", "row_hash", "k").orderBy("low", "high")
    reached = F.max("high").over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    parted = windows.withColumn("opens", F.when(reached >= F.col("low"), 0).otherwise(1)).withColumn("part", F.sum("opens").over(of_text.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")
    parted = common.materialize(parted, "parted-windows", rows)
    parts = parted.groupBy("doc_id", "row_hash", "k", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    asked = parts.groupBy(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), "k").agg(F.collect_list(F.struct("part", "low", "high")).alias("asked"))
    held = common.written_bitmap(asked.select("h2").distinct(), "h2")
    texts = docs.select("doc_id", "text", F.xxhash64(common.text_or_empty()).alias("row_hash"))
    texts = common.with_suspicion(texts, "row_hash", held, "suspect").where("suspect").select("doc_id", "row_hash", "text").dropDuplicates(["doc_id", "row_hash"])
    joined = texts.join(asked, _at("d2", "h2")).withColumn("words", _words())
    pick = F.coalesce(*[F.when(F.col("k") == k, _shingles("words", k)) for k in range(1, SHINGLE + 1)])
    cut = F.transform("asked", lambda a: F.struct(a["part"].alias("part"), a["low"].alias("low"), F.slice("hashes", a["low"] + 1, a["high"] - a["low"]).alias("hashes")))
    spread = joined.select("doc_id", "row_hash", "k", pick.alias("hashes"), "asked").select("doc_id", "row_hash", "k", F.explode(cut).alias("c"))
    spread = spread.select("doc_id", "row_hash", "k", "c.part", "c.low", F.posexplode("c.hashes").alias("i", "h"))
    none = F.lit(None)
    places = spread.select("doc_id", "row_hash", "k", "part", (F.col("low") + F.col("i")).alias("pos"), F.lit(0).alias("sign"), none.cast("int").alias("n_words"), none.cast("int").alias("start"), none.cast("int").alias("n"), "h")
    size = F.col("high") - F.col("low")
    ends = [parted.select("doc_id", "row_hash", "k", "part", (at - 1).cast("int").alias("pos"), F.lit(sign).alias("sign"), "n_words", "start", size.cast("int").alias("n"), none.cast("bigint").alias("h")) for at, sign in ((F.col("high"), 1), (F.col("low"), -1))]
    # At one place the hash counts first, then windows that end there are read.
    order = Window.partitionBy("doc_id", "row_hash", "k", "part").orderBy("pos", F.col("h").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    events = places.unionByName(ends[0]).unionByName(ends[1])
    running = events.select("doc_id", "row_hash", "k", "part", "pos", "sign", "n_words", "start", "n", "h", *[F.coalesce(c, F.lit(0)).alias(f"b{j}") for j, c in enumerate(_bit_counts("h"))])
    running = running.select("doc_id", "row_hash", "k", "sign", "n_words", "start", "n", *[F.sum(f"b{j}").over(order).alias(f"r{j}") for j in range(LANES)]).where("sign <> 0")
    sums = running.groupBy("doc_id", "row_hash", "k", "n_words", "start", "n").agg(*[F.sum(F.col("sign") * F.col(f"r{j}")).alias(f"s{j}") for j in range(LANES)])
    return sums.select("doc_id", "row_hash", "k", "n_words", "start", "n", _print(F.col("n")).alias("fp"))


def _near(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(p_words, p_fp, item) of the windows' fingerprints and items of one length within RADIUS bits."""
    listed = common.materialize(_with_flips(items), "item-blocks", 10_068 * items.count(), 16)
    distinct = prints.select("n_words", "fp").distinct()
    asked = distinct.select("n_words", "fp", F.explode(_blocks("fp")).alias("b")).select(F.col("n_words").alias("p_words"), F.col("fp").alias("p_fp"), F.col("b.block").alias("p_block"), F.col("b.key").alias("p_key"))
    met = asked.join(listed, (F.col("p_words") == F.col("n_words")) & (F.col("p_block") == F.col("block")) & (F.col("p_key") == F.col("key")))
    return met.where(F.bit_count(F.col("p_fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("p_words", "p_fp", "item").distinct()


def _similar(candidates: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, row_hash, item, start, similarity) of the candidates (doc_id, row_hash, item, n_words, k, start, n) of SIMILARITY or more.

    An occurrence of a shingle that an item has c times counts for the windows that hold it and not the c-th occurrence
    before it. So each counts for one span of starts, and the spans that cover a start are the weight that window and item have in common.
    """
    weights = items.select("item", F.explode("hashes").alias("h")).groupBy("item", "h").agg(F.count(F.lit(1)).cast("int").alias("c"))
    pairs = candidates.select(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), F.col("item").alias("i2"), "n_words", "k").distinct()
    asked = pairs.join(weights, F.col("i2") == F.col("item")).select("d2", "h2", "item", F.col("n_words").alias("w2"), F.col("h").alias("item_h"), "c")
    met = hits.join(asked, _at("d2", "h2") & (F.col("n_words") == F.col("w2")) & (F.col("h") == F.col("item_h")))
    lists = met.groupBy("doc_id", "row_hash", "item", "n_words", "k", "h", "c").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    before = F.transform("at", lambda p, i: F.struct(p.alias("pos"), F.when(i >= F.col("c"), F.get("at", i - F.col("c"))).alias("last")))
    occurs = lists.select("doc_id", "row_hash", "item", "n_words", "k", F.explode(before).alias("o"))
    low = F.greatest(F.col("o.pos") - (F.col("n_words") - F.col("k")), F.col("o.last") + 1)
    steps = occurs.select("doc_id", "row_hash", "item", F.explode(F.array(F.struct(low.alias("x"), F.lit(1).alias("d")), F.struct((F.col("o.pos") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = steps.select("doc_id", "row_hash", "item", F.col("e.x").alias("x"), F.col("e.d").alias("d"), F.lit(None).cast("int").alias("total"))
    m = F.col("n_words") - F.col("k") + 1
    starts = candidates.select("doc_id", "row_hash", "item", F.col("start").alias("x"), F.lit(0).alias("d"), (F.col("n") + m).cast("int").alias("total"))
    order = Window.partitionBy("doc_id", "row_hash", "item").orderBy("x", F.col("total").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = steps.unionByName(starts).withColumn("shared", F.sum("d").over(order)).where("total IS NOT NULL")
    near = counted.where((10 + TENTHS) * F.col("shared") >= TENTHS * F.col("total"))
    return near.select("doc_id", "row_hash", "item", F.col("x").alias("start"), (F.col("shared") / (F.col("total") - F.col("shared"))).alias("similarity"))


def similar_windows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_hash, item, start, similarity): windows of SIMILARITY or more, and (item, words) of the items that they are of."""
    n = benchmark.count()
    lists = common.materialize(_items(benchmark), "item-lists", n, 2048)
    prints = simhash(lists, "item").select(F.col("item").alias("i2"), "fp")
    items = common.materialize(lists.join(prints, F.col("item") == F.col("i2")).drop("i2"), "items", n, 2048)
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # SHINGLE numbers at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, row_hash long, item long, start int, similarity double"), items.select("item", "words")
    shingles = common.materialize(items.select("n_words", "k", F.explode("hashes").alias("h")).distinct(), "item-shingles", 64 * n)
    hits = common.materialize(_hits(docs, shingles, sizes), "item-hits")
    rows = hits.count()  # windows with enough hits are fewer
    windows = common.materialize(_printed(docs, _windows(hits), rows), "window-prints", rows)
    near = common.materialize(_near(windows, items), "near-prints", rows)
    candidates = common.materialize(windows.join(near, (F.col("n_words") == F.col("p_words")) & (F.col("fp") == F.col("p_fp"))).select("doc_id", "row_hash", "item", "n_words", "k", "start", "n"), "candidates", rows)
    return _similar(candidates, hits, items), items.select("item", "words")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): the most similar window of each document for each item that it holds.

    Of equally similar windows it is the first; start_word counts from 0.
    """
    found, items = similar_windows(docs, benchmark)
    # Documents with an id are told apart by it, the others by their text.
    nameless = F.when(F.col("doc_id").isNull(), F.col("row_hash"))
    first = F.struct("similarity", -F.col("start"))
    best = found.groupBy("doc_id", nameless.alias("nameless"), "item").agg(F.max("similarity").alias("similarity"), F.greatest(F.max_by("start", first), F.lit(0)).cast("long").alias("start_word"))
    ids = benchmark.select("item_id", _words().alias("id_words")).join(items, F.col("id_words") == F.col("words")).select("item_id", F.col("item").alias("kind"))
    return best.join(ids, F.col("item") == F.col("kind")).select("doc_id", "item_id", "similarity", "start_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, those without an id too; all columns stay."""
    return common.without_rows(docs, similar_windows(docs, benchmark)[0].select("doc_id", "row_hash"))
