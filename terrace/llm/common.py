"""Shared helpers: scratch tables in the cluster's shared folder, bitmaps of bounded size, row selection."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path

T = TypeVar("T")
#: ASCII white space as the contracts define it.
WS = r"[\x20\x09-\x0D]"
#: log2 of the bits of the smallest and of the largest bitmap (16 MB, as a broadcast table little more), and numbers of 64 bits in a row of it.
LEAST_LOG2, MOST_LOG2, LANES = 16, 27, 16
#: Bytes, before compression, from which a scratch table gets another file.
FILE_BYTES = 4 << 20
#: Bytes from which Spark ends a batch of rows for Python. By its own setting a batch has 64 MB, which each task holds in the executor and in its worker.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_BYTES at most, and a row more; a session's smaller bound stays. Nothing depends on where batches end."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors then cost a re-read, not a recomputation.

    With a known bound of its rows, a table too small for one file of FILE_BYTES in each shuffle partition is dealt evenly into
    fewer files after it is made, so that the work itself keeps its partitions.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None:
        files = 1 + rows * row_bytes // FILE_BYTES
        if files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Bitmap:
    """Bits of hashes of keys, LANES numbers of 64 bits to a row (bm_word, bm_bits): of bounded size, which makes it safe to broadcast."""

    table: DataFrame
    log2_bits: int


def log2_bits_for(keys: int) -> int:
    """16 bits a key, so that one other key in 16 at most is suspected, within LEAST_LOG2 and MOST_LOG2."""
    return min(MOST_LOG2, max(LEAST_LOG2, (16 * keys).bit_length()))


def written_bitmap(keys: DataFrame, key: str, rows: int | None = None) -> Bitmap:
    """The bitmap of ``key``, sized by ``rows``, a bound of the number of keys, or by their count.

    Beyond 2 ** MOST_LOG2 / 16 keys it fills up: more rows are suspected, and the exact join behind it moves more, up to all.
    """
    log2_bits = log2_bits_for(keys.count() if rows is None else rows)
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << log2_bits))
    words = keys.select(bit.alias("b")).groupBy(F.shiftrightunsigned("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("bits"))
    lanes = [F.coalesce(F.max(F.when(F.col("w") % LANES == k, F.col("bits"))), F.lit(0)) for k in range(LANES)]
    table = words.groupBy(F.floor(F.col("w") / LANES).alias("bm_word")).agg(F.array(*lanes).alias("bm_bits"))
    return Bitmap(materialize(table, "bitmap", (1 << log2_bits) // (64 * LANES), 8 * LANES), log2_bits)


def with_suspicion(df: DataFrame, key: str, bits: Bitmap, name: str) -> DataFrame:
    """Add boolean ``name``: false where ``key`` is surely not among the bitmap's keys. Columns of any other name stay."""
    word, held, bit = (f"{part}_{uuid.uuid4().hex}" for part in ("word", "held", "bit"))
    table = bits.table.select(F.col("bm_word").alias(word), F.col("bm_bits").alias(held))
    kept = [F.col(f"`{c}`") for c in df.columns]
    hit = F.expr(f"(shiftrightunsigned(get({held}, CAST(shiftrightunsigned({bit}, 6) % {LANES} AS INT)), CAST({bit} & 63 AS INT)) & 1) = 1")
    return (
        df.withColumn(bit, F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits.log2_bits)))
        .join(F.broadcast(table), F.floor(F.col(bit) / (64 * LANES)) == F.col(word), "left")
        .select(*kept, F.coalesce(hit, F.lit(False)).alias(name))
    )


def row_hash(text: str = "text") -> Column:
    """With doc_id, what tells a row from others of its id; null counts as empty."""
    return F.xxhash64(text_or_empty(text))


def without_rows(docs: DataFrame, gone: DataFrame, mark: Column | None = None) -> DataFrame:
    """``docs`` less the rows whose doc_id and mark (by default row_hash) are in ``gone``, a table of those two columns, which is written first.

    Null ids are equal to each other. Rows whose id the bitmap clears stay where they are; only suspects get their mark and, texts included, are
    shuffled for the exact anti join.
    """
    of_doc, of_mark = gone.columns
    gone = materialize(gone.distinct(), "dropped-rows", docs.count(), 24)
    suspect, held, key, gone_id, gone_mark = (f"{part}_{uuid.uuid4().hex}" for part in ("suspect", "held", "key", "id", "mark"))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    mark = row_hash() if mark is None else mark
    of = lambda c: F.coalesce(F.col(c).cast("long"), F.lit((1 << 63) - 1))
    marked = with_suspicion(docs.withColumn(key, of("doc_id")), key, written_bitmap(gone.select(of(of_doc).alias(key)).distinct(), key), suspect)
    clear = marked.where(~F.col(suspect)).select(*cols)
    dropped = gone.select(F.col(of_doc).alias(gone_id), F.col(of_mark).alias(gone_mark))
    checked = marked.where(F.col(suspect)).withColumn(held, mark).join(dropped, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(held) == F.col(gone_mark)), "left_anti").select(*cols)
    return clear.unionByName(checked)


_held: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, made once. A worker keeps that of one operator at a time, so that a chain of stages doesn't add them up."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))
