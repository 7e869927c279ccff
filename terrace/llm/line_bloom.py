"""Line deduplication with two Bloom filters.

Each task hashes its lines' keys. The filters are built in shards of bits: the first holds the bits
of keys that were seen, the second those that were seen by a further document, that is, in a
task by two of its documents or by two tasks. A key of which some bit is missing in
the second filter occurs in one document only; its lines stay without further
work. Only suspected keys are shuffled, counted exactly, and given to the smallest doc_id.

The filters have 16 bits for each line and 2 ** MOST_LOG2 at most, which bounds the broadcast. With over 64 million
lines more and more keys are suspected in vain, up to all of them, which costs work and changes no result.

Cases: a null or empty text is one empty line; keys shorter than MIN_KEY code
points are never dropped; rows that repeat a doc_id count as one document for the counts, and each
gets its own result row; a null doc_id counts as the largest; columns other than doc_id and text
are never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .text_bytes import INSIDE, byte_blocks, mixed, powers

MIN_KEY = 10
#: log2 of the bits of the smallest and the largest filter (2 ** 30 bits are 128 MiB), log2 of a shard's bits, and hashes for each key.
LEAST_LOG2, MOST_LOG2, SHARD_LOG2, HASHES = 22, 30, 20, 2
_WS = " \t\n\v\f\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: A number for each byte; a capital A-Z has its small letter's.
_LETTERS = np.random.default_rng(9).integers(1, 1 << 63, 256, np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def key_of(line: str) -> str:
    line = line.strip(_WS)
    return line.lower() if line.isascii() else line.translate(_LOWER)


@dataclass
class Lines:
    """Lines of some rows' texts whose keys are long enough: each one's row and place in its text, and its key's hash."""

    row: np.ndarray
    line: np.ndarray
    hash: np.ndarray


def keyed_lines(column: pa.Array) -> Iterator[Lines]:
    """The column's lines, some TOGETHER bytes at a time; a longer text is alone. Bytes are stripped, lower-cased and hashed side by side."""
    for row, part, heads in byte_blocks(column):
        n = len(part)
        if not n:
            continue
        ends = np.flatnonzero(part == 10)
        begins = np.unique(np.concatenate([heads[heads < n], ends + 1]))
        begins = begins[begins < n]
        stops = np.append(begins[1:], n)
        inside = np.flatnonzero(INSIDE[part])
        if not len(inside):
            continue
        # The first byte behind a line's leading white space, and the last before its trailing one.
        low, high = np.searchsorted(inside, begins), np.searchsorted(inside, stops)
        fit = low < high
        begins, first, last = begins[fit], inside[low[fit]], inside[high[fit] - 1] + 1
        letters = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        fit = letters[last] - letters[first] >= MIN_KEY
        begins, first, last = begins[fit], first[fit], last[fit]
        up, down = powers(n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[part] * up[:n], dtype=np.uint64)])
        of = np.searchsorted(heads, begins, "right") - 1
        before = np.searchsorted(ends, begins) - np.searchsorted(ends, heads[of])
        yield Lines(row + of, before, mixed((total[last] - total[first]) * down[first]))


def _positions(hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """HASHES bit positions of each key."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64((1 << log2_bits) - 1) for i in range(HASHES)], axis=1)


def _seen(log2_bits: int):
    """A map to the positions that a batch's documents set, by shard: in the first filter, and those that two of its documents set by one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(keyed_lines(batch.column(0)))
            row, hashes = (np.concatenate([getattr(f, c) for f in found]) if found else np.empty(0, np.uint64) for c in ("row", "hash"))
            order = np.lexsort((row, hashes))
            row, hashes = row[order], hashes[order]
            new = np.ones(len(hashes), bool)  # a document's keys count once
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            kinds, counts = np.unique(hashes[new], return_counts=True)
            rows = []
            for keys, again in ((kinds, False), (kinds[counts > 1], True)):
                positions = np.unique(_positions(keys, log2_bits).ravel())
                cuts = np.flatnonzero(np.diff(positions >> np.uint64(SHARD_LOG2))) + 1
                for part in np.split(positions, cuts) if len(positions) else []:
                    rows.append((int(part[0] >> np.uint64(SHARD_LOG2)), again, (part & np.uint64((1 << SHARD_LOG2) - 1)).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "again", "bits"]
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter's shards from a partition's rows; each shard is two arrays of fixed size."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for shard, again, bits in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if shard not in once:
                once[shard], twice[shard] = np.zeros(1 << SHARD_LOG2, bool), np.zeros(1 << SHARD_LOG2, bool)
            at = np.frombuffer(bits, np.uint32)
            if again:
                twice[shard][at] = True
            else:
                twice[shard][at] |= once[shard][at]
                once[shard][at] = True
    shards = [(s, np.packbits(t, bitorder="little").tobytes()) for s, t in twice.items() if t.any()]
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in shards], pa.int32()), pa.array([t for _, t in shards], pa.binary())], ["shard", "filter"])


def filter_log2(docs: DataFrame) -> int:
    """log2 of each filter's bits: 16 for each line, within LEAST_LOG2 and MOST_LOG2."""
    lines = docs.agg(F.sum(1 + F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))).first()[0] or 0
    return min(MOST_LOG2, max(LEAST_LOG2, (16 * int(lines)).bit_length()))


def repeat_filter(docs: DataFrame, log2_bits: int) -> bytes:
    """The second filter of 2 ** log2_bits bits."""
    shards = 1 << (log2_bits - SHARD_LOG2)
    rows = docs.select("text").mapInArrow(_seen(log2_bits), "shard int, again boolean, bits binary").repartition(shards, "shard").mapInArrow(_merged, "shard int, filter binary")
    made = bytearray(1 << (log2_bits - 3))
    width = 1 << (SHARD_LOG2 - 3)
    for shard, part in rows.toLocalIterator():  # together the filter's size, MOST_LOG2 bits at most
        made[shard * width : (shard + 1) * width] = part
    return bytes(made)


def suspected(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line, key): lines whose key may be in two documents. line counts from 0."""
    log2_bits = filter_log2(docs)
    second = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, log2_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = np.frombuffer(second.value, np.uint8)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out: tuple[list, list, list, list] = ([], [], [], [])
            for found in keyed_lines(texts):
                places = _positions(found.hash, log2_bits)
                hit = np.flatnonzero((bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1).all(axis=1))
                row, lines, row_hash = -1, [], 0
                for r, n in zip(found.row[hit].tolist(), found.line[hit].tolist()):
                    if r != row:
                        text = texts[r].as_py()
                        row, lines, row_hash = r, text.split("\n"), xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)
                    for column, value in zip(out, (ids[r].as_py(), row_hash, n, key_of(lines[n]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["doc_id", "row_hash", "line", "key"])

    return docs.mapInArrow(run, "doc_id long, row_hash long, line int, key string")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, lines): the lines to drop of each text that loses any. row_hash tells rows of one doc_id apart."""
    lines = common.materialize(suspected(docs), "suspected-lines")
    last = F.lit((1 << 63) - 1)
    holder = F.coalesce("doc_id", last)
    shared = common.materialize(
        lines.groupBy("key").agg(F.min(holder).alias("first"), F.max(holder).alias("latest")).where("first <> latest").select(F.col("key").alias("shared_key"), "first"), "shared-lines", lines.count()
    )
    gone = lines.join(shared, F.col("key") == F.col("shared_key")).where(holder != F.col("first"))
    return gone.groupBy("doc_id", "row_hash").agg(F.collect_set("line").alias("lines"))


def _with_drops(docs: DataFrame) -> DataFrame:
    """doc_id, text, lines (null if all stay). Texts that surely keep all lines aren't shuffled."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drops = common.materialize(repeats(docs), "line-drops")
    id_or_last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    bits = common.written_bitmap(drops.select(id_or_last.alias("id")), "id")
    marked = common.with_suspicion(docs.withColumn("id", id_or_last), "id", bits, "suspect")
    clear = marked.where("NOT suspect").select("doc_id", "text", F.lit(None).cast("array<int>").alias("lines"))
    drops = drops.select(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), "lines")
    checked = marked.where("suspect").mapInArrow(_hashed, "doc_id long, text string, row_hash long")
    checked = checked.join(drops, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("row_hash") == F.col("h2")), "left")
    return clear.unionByName(checked.select("doc_id", "text", "lines"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        found = [xxhash.xxh3_64_intdigest((v.as_py() or "").encode()) - (1 << 63) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text", "row_hash"])


def _kept(text: str | None, drops: list[int] | None) -> tuple[str, int, int]:
    lines = lines_of(text)
    if not drops:
        return text or "", len(lines), 0
    stays = np.ones(len(lines), bool)
    stays[drops] = False
    return "\n".join([lines[i] for i in np.flatnonzero(stays)]), len(lines), len(lines) - int(stays.sum())


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_kept(t.as_py(), d.as_py()) for t, d in zip(batch.column(1), batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64())))], ["doc_id", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines (before), n_dropped."""
    return _with_drops(docs).mapInArrow(_cleaned, "doc_id long, text string, n_lines long, n_dropped long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_kept(t.as_py(), d.as_py()) for t, d in zip(batch.column(1), batch.column(2))]
        sha = pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), sha], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame) -> DataFrame:
    """As dedup_lines, with the kept text's SHA-256 in place of the text."""
    return _with_drops(docs).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
