"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own bytes say so, whatever its script, so that equal passages are cut alike.
A recipe is the ordered list of the chunks' identifiers. Recipes of hashes find
the documents that may have a copy; only those documents' chunks are moved, once,
to verify that a hash stands for one chunk. A hash that stands for several gets
an identifier per chunk, numbered in the order of their bytes. Documents with equal
recipes of verified identifiers are equal.

Cases: a null text counts as empty; an empty text has an empty recipe and equals
other empty texts; of equal texts the smallest doc_id stays and a null doc_id is
the largest; rows that repeat a doc_id with an equal text share its verdict;
columns other than doc_id and text are never read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: From CHUNK_MIN bytes of UTF-8 on, a chunk ends where every second one of the last seven bytes is a marked one, which is so once in some 400 bytes of any script.
CHUNK_MIN, CHUNK_MAX = 512, 8192
MARKED = "[" + "".join(f"\\x{b:02x}" for b in range(256) if (57 * b + 55) % 256 < 72) + "]"
CUT = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?(?:(?<={MARKED}.{MARKED}.{MARKED}.{MARKED})|\z)|.{{1,{CHUNK_MAX}}}"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; the pattern skips runs that are one already."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _chunked(docs: DataFrame) -> DataFrame:
    norm = docs.select("doc_id", normalised(common.text_or_empty()).alias("norm"))
    # Each byte as a letter, so that the pattern sees bytes whatever the script.
    letters = F.decode(F.encode("norm", "UTF-8"), "ISO-8859-1")
    return norm.select("doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), F.regexp_extract_all(letters, F.lit(CUT), F.lit(0)).alias("chunks"))


def _hashes() -> Column:
    return F.transform("chunks", lambda c: F.xxhash64(c))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe: the ordered verified identifiers of each row's chunks."""
    docs = docs.select("doc_id", "text")
    hashed = common.materialize(_chunked(docs).select("doc_id", "text_sha256", _hashes().alias("hashes")), "recipes")
    n = hashed.count()
    # Written, so that the join shuffles both sides anew and a large group can be split at run time.
    shared = common.materialize(hashed.groupBy("hashes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hashes").alias("h2")), "shared-recipes", n)
    suspects = common.materialize(hashed.join(shared, F.col("hashes") == F.col("h2"), "left_semi").select("doc_id"), "copy-suspects", n)
    bits = common.written_bitmap(suspects, "doc_id")
    moved = (
        _chunked(common.with_suspicion(docs, "doc_id", bits, "suspect").where("suspect"))
        .select("doc_id", "text_sha256", F.posexplode("chunks").alias("pos", "chunk"))
        .withColumn("h", F.xxhash64("chunk"))
    )
    several = common.materialize(moved.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h"), "collisions", 0)
    plain = F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("kind")))
    if several.isEmpty():
        return hashed.select("doc_id", "text_sha256", plain.alias("recipe"))
    return numbered(hashed, moved.join(several, "h", "left_semi"))


def numbered(hashed: DataFrame, collided: DataFrame) -> DataFrame:
    """Recipes in which each hash of ``collided`` (doc_id, text_sha256, pos, chunk, h) also tells which of its chunks it is."""
    from pyspark.sql import Window

    kinds = collided.select("h", "chunk").distinct().withColumn("kind", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    at = (
        collided.join(kinds, ["h", "chunk"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.map_from_entries(F.collect_set(F.struct("pos", "kind"))).alias("kinds"))
        .select(F.col("doc_id").alias("d2"), F.col("text_sha256").alias("s2"), "kinds")
    )
    told = hashed.join(at, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_sha256") == F.col("s2")), "left")
    with_kind = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.try_element_at("kinds", i), F.lit(0)).alias("kind")))
    return told.select("doc_id", "text_sha256", with_kind.alias("recipe"))


def copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    lists = common.materialize(recipes(docs), "verified")
    groups = common.materialize(
        lists.groupBy("recipe").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("recipe", "shared"), "copy-groups", lists.count(), 256
    )
    # Groups are few and written, so both sides are shuffled and a large group of copies can be split at run time.
    joined = lists.join(groups, F.col("recipe") == F.col("shared"), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``copies`` doesn't keep: those of which an equal text has a smaller doc_id, rows without an id among them. All columns stay."""
    gone = copies(docs).where(~F.col("kept")).select("doc_id", "text_sha256")
    return common.without_rows(docs, gone, F.sha2(normalised(common.text_or_empty()), 256))
