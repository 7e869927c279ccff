"""Repeated passages by MinHash banding of paragraphs.

Units are the paragraphs (lines) of a text and, so that a passage inside a paragraph is found wherever it starts and
ends, pieces of the whole text that are cut where the content says so: at words whose hash is the least of
those within REACH words, longer gaps in even parts of MOST words at most. Shingles are SHINGLE words, and shorter units are none. A unit's
kind is a sum of its shingles' hashes, so that units of equal shingles are one kind; a second sum, of other hashes, proves it.

A piece has MOST - SHINGLE + 1 = 8 shingles or fewer, so that a Jaccard similarity of 0.8 leaves room for one word at an end
at most: equal shingles are its one band. Paragraphs have BANDS bands of two MinHash values, which miss a pair at 0.8 in
(1 - 0.64) ** 9, about 1 of 10,000. Kinds that share a band are compared by exact Jaccard similarity; a band shared by more than
BLOCK kinds is split into blocks, each pair of blocks compared by itself. Links return as forests, never as all pairs. Components of
kinds that stand in two documents or more are repeats; the smallest doc_id keeps them. Repeated
units of a document that touch are one passage, which is reported from LEAST words on: each paragraph of so many words that is a
near copy of another document's, and passages inside paragraphs as far as whole pieces of theirs repeat. Those lose up to a
piece at both ends: of passages of 50 words in random text about 97 of 100 are found, of 40 words 95, of 30 words 3 of 4.

Cases: null and empty texts have no units; a text that repeats a passage only within itself isn't reported; rows that
repeat a doc_id count as one document; rows without an id teach nothing and are never reported; other
columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .golay import forest
from .text_bytes import INSIDE, MULTIPLIER, TOGETHER, byte_blocks, mixed, powers

SHINGLE, SIMILARITY = 5, 0.8
LEAST, REACH, MOST = 15, 4, 12
BANDS, ROWS = 9, 2
BLOCK = 512
PIECE, PARAGRAPH = 0, 1
_rng = np.random.default_rng(5)
_A, _B = (_rng.integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) for _ in "ab")
_A |= np.uint64(1)
#: A number for each byte, none for white space and the small letter's for a capital; and the factor of proofs.
_BYTES = _rng.integers(1, 1 << 63, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BYTES[~INSIDE] = 0
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that start at ``starts`` in the bytes ``data``; A-Z count as a-z. Bytes are taken in blocks of bounded size."""
    out, cut = [], 0
    while cut < len(starts):
        to = max(cut + 1, int(np.searchsorted(starts, starts[cut] + TOGETHER)))
        part = data[starts[cut] : starts[to] if to < len(starts) else len(data)]
        at = starts[cut:to] - starts[cut]
        up, down = powers(len(part))
        out.append(np.add.reduceat(_BYTES[part] * up[: len(part)], at) * down[at])
        cut = to
    return mixed(np.concatenate(out)) if out else np.empty(0, np.uint64)


@dataclass
class Texts:
    """Some rows' texts as words: the first row, each row's number of words, the words' hashes, and the number of line ends before each word."""

    row: int
    counts: np.ndarray
    hashes: np.ndarray
    lines: np.ndarray


def texts_of(column: pa.Array) -> Iterator[Texts]:
    """The column's texts, some TOGETHER bytes at a time; a longer text is alone."""
    for row, part, heads in byte_blocks(column):
        inside = INSIDE[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads_inside = heads[heads < len(part)]
        begins[heads_inside] |= inside[heads_inside]
        starts = np.flatnonzero(begins)
        counts = np.diff(np.searchsorted(starts, np.append(heads, len(part))))
        yield Texts(row, counts, word_hashes(part, starts), np.searchsorted(np.flatnonzero(part == 10), starts))


def shingles(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SHINGLE + 1
    out = hashes[: max(0, n)].copy()
    for k in range(1, SHINGLE):
        out = out * MULTIPLIER + hashes[k : k + n]
    return mixed(out)


def piece_starts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where pieces start: the texts' starts, the cuts, and even parts of gaps of more than MOST words. No cut leaves fewer words than a shingle at an end."""
    counts = counts[counts > 0]
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.arange(len(hashes)) - np.repeat(first, counts)
    after = np.repeat(counts, counts) - before
    most = np.iinfo(np.uint64).max
    pairs = np.full(len(hashes), most, np.uint64)
    pairs[:-1] = mixed(hashes[:-1] * MULTIPLIER + hashes[1:])
    pairs[after == 1] = most
    padded = np.full(len(hashes) + REACH * (len(counts) + 1), most, np.uint64)
    at = np.arange(len(hashes)) + REACH * (text + 1)
    padded[at] = pairs
    opens = (before >= SHINGLE) & (after >= SHINGLE)
    for k in range(1, REACH + 1):
        opens &= (pairs < padded[at - k]) & (pairs <= padded[at + k])
    opens[first] = True
    cuts = np.flatnonzero(opens)
    gaps = np.diff(np.append(cuts, len(hashes)))
    parts = -(-gaps // MOST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(cuts, parts) + np.repeat(gaps, parts) * nth // np.repeat(parts, parts)


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values over [start, start + size), modulo 2 ** 64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[starts + sizes] - total[starts]


@dataclass
class Units:
    """Paragraphs or pieces: each one's row, start among the words, size, kind and proof. Kind and proof are two hashes of the multiset of shingles."""

    row: np.ndarray
    start: np.ndarray
    size: np.ndarray
    kind: np.ndarray
    proof: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def units_of(texts: Texts, values: np.ndarray, unit: int) -> Units:
    """Units of a shingle or more; no unit reaches over a text's end."""
    n, rows = len(texts.hashes), np.repeat(np.arange(len(texts.counts)), texts.counts)
    if unit == PIECE:
        starts = piece_starts(texts.hashes, texts.counts) if n else np.empty(0, np.int64)
    else:
        starts = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(texts.lines, prepend=-1) != 0))
    sizes = np.diff(np.append(starts, n))
    starts, sizes = starts[sizes >= SHINGLE], sizes[sizes >= SHINGLE]
    kind, proof = (_sums(v, starts, sizes - SHINGLE + 1) for v in (values, mixed(values * _OTHER)))
    return Units(texts.row + rows[starts], starts, sizes, kind ^ np.uint64(unit), proof)


def band_keys(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(units, BANDS) keys of the units' shingles; paragraphs follow each other with gaps, which the odd slices skip."""
    edges = np.stack([starts, starts + sizes], axis=1).ravel()
    if edges[-1] == len(values):
        edges = edges[:-1]
    low = [np.minimum.reduceat(values * a + b, edges)[::2] for a, b in zip(_A, _B)]
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[:, b] = mixed(keys[:, b] * MULTIPLIER + low[b * ROWS + r] + np.uint64(b + 1))
    return keys


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row_hash", "unit", "at", "size", "kind", "proof", "bands"]
    for batch in batches:
        ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
        for texts in texts_of(batch.column(1)):
            values = shingles(texts.hashes)
            first = np.concatenate([np.zeros(texts.row, np.int64), np.cumsum(texts.counts) - texts.counts])
            for unit in (PIECE, PARAGRAPH):
                found = units_of(texts, values, unit)
                n = len(found)
                keys = band_keys(values, found.start, found.size - SHINGLE + 1).view(np.int64).ravel() if n and unit == PARAGRAPH else np.empty(0, np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (BANDS if len(keys) else 0), pa.int32()), pa.array(keys))
                numbers = (ids[found.row], marks[found.row], np.full(n, unit), found.start - first[found.row], found.size, found.kind.view(np.int64), found.proof.view(np.int64))
                kinds = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(k)) for c, k in zip(numbers, kinds)), bands], names)


def _asked_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of the asked paragraphs (start and size in words) of each text."""
    for batch in batches:
        asked, kinds, sets = batch.column(1), [], []
        for texts in texts_of(batch.column(0)):
            values, at = shingles(texts.hashes), 0
            for row, n in enumerate(texts.counts, texts.row):
                own = values[at : at + max(0, n - SHINGLE + 1)]
                for a in asked[row].as_py():
                    part = own[a["at"] : a["at"] + a["size"] - SHINGLE + 1]
                    if int((part.sum(dtype=np.uint64) ^ np.uint64(PARAGRAPH)).astype(np.int64)) == a["kind"]:  # else another row of this doc_id has it
                        kinds.append(a["kind"])
                        sets.append(np.unique(part).tobytes())
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(sets, pa.binary())], ["kind", "shingles"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, kind), sorted, whose key has several kinds; repeated rows are one, and n numbers the rows of a key."""
    last_key, last_kind, n = None, None, 0
    for batch in batches:
        key, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        if not len(key):
            continue
        new = np.concatenate([[(last_key, last_kind) != (key[0], kind[0])], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])])
        key, kind = key[new], kind[new]
        if not len(key):
            continue
        before = np.concatenate([[last_key == key[0]], key[1:] == key[:-1]])
        start = np.maximum.accumulate(np.where(before, -1, np.arange(len(key))))
        number = np.where(start >= 0, np.arange(len(key)) - start, np.arange(len(key)) + n + 1)
        after = np.concatenate([before[1:], [False]])
        out = np.flatnonzero(before | after)
        rows = [(key[out], kind[out], number[out])]
        if before[0] and n == 0:  # the row that ended the last batch has company after all
            rows.insert(0, (np.array([last_key]), np.array([last_kind]), np.array([0])))
        last_key, last_kind, n = key[-1], kind[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows)], ["key", "kind", "n"])


def similar_sets(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (i, j) whose components are those of all pairs of SIMILARITY or more. Each set is counted against all later ones at once, less those tied to it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner, begin = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    root, found, held = np.arange(len(sets)), [], np.zeros(int(at.max(initial=-1)) + 1, bool)
    for i in range(len(sets) - 1):
        later = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        later = later[np.minimum(sizes[later], sizes[i]) >= SIMILARITY * np.maximum(sizes[later], sizes[i])]
        if not len(later):
            continue
        mine, rest = at[begin[i] : begin[i] + sizes[i]], begin[i] + sizes[i]
        held[mine] = True
        shared = np.bincount(owner[rest:][held[at[rest:]]], minlength=len(sets))[later]
        held[mine] = False
        linked = later[shared >= SIMILARITY * (sizes[i] + sizes[later] - shared)]
        if len(linked):
            found.extend((i, int(j)) for j in linked)
            root[np.isin(root, root[linked])] = root[i]
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of the links under each key: exact Jaccard similarity of the kinds' shingles."""
    key, kinds, sets, out = None, [], [], []

    def links() -> list[tuple[int, int]]:
        return [(kinds[i], kinds[j]) for i, j in similar_sets(sets)] if len(sets) > 1 else []

    for batch in batches:
        for k, kind, values in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if k != key:
                out.extend(links())
                key, kinds, sets = k, [], []
            if not kinds or kinds[-1] != kind:
                kinds.append(kind)
                sets.append(np.frombuffer(values, np.uint64))
        if len(out) > 1 << 16:
            yield _rows(out)
            out = []
    yield _rows(out + links())


def _rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
    tied = forest(np.array(found, np.int64).reshape(-1, 2))
    return pa.RecordBatch.from_arrays([pa.array(tied[:, 0], pa.int64()), pa.array(tied[:, 1], pa.int64())], ["a", "b"])


def paragraph_links(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b): links between kinds of paragraphs of SIMILARITY or more."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paragraphs = units.where(F.col("unit") == PARAGRAPH)
    keyed = paragraphs.select(F.explode("bands").alias("key"), "kind").distinct()  # copies of a paragraph are one row of each band
    shared = common.materialize(keyed.repartition(n, "key").sortWithinPartitions("key", "kind").mapInArrow(_shared, "key long, kind long, n long"), "shared-bands")
    rows = shared.count()
    sizes = shared.groupBy("key").agg(F.max("n").alias("last")).where(F.col("last") >= BLOCK).select(F.col("key").alias("wide_key"), F.ceil(2 * F.col("last") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("kind", F.lit(3)), F.col("blocks"))
    dealt = (
        shared.join(common.materialize(sizes, "wide-bands", 2 * rows // BLOCK), F.col("key") == F.col("wide_key"), "left")
        .select("key", F.col("kind").alias("asked"), "blocks", F.coalesce(block, F.lit(0)).alias("block"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
        .select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).alias("key"), "asked")
    )
    # One holder of each kind that has company shows its shingles; only such holders' texts are moved.
    wanted = common.materialize(shared.select(F.col("kind").alias("w")).distinct(), "wanted-kinds", rows, 8)
    held = common.with_suspicion(paragraphs.drop("bands"), "kind", common.written_bitmap(wanted, "w"), "suspect").where("suspect")
    holders = held.groupBy("kind").agg(F.min(F.struct("doc_id", "at", "size")).alias("holder")).join(wanted, F.col("kind") == F.col("w"), "left_semi").select("kind", "holder.*")
    asked = common.materialize(holders.groupBy(F.col("doc_id").alias("d2")).agg(F.collect_list(F.struct("kind", "at", "size")).alias("asked")), "asked-paragraphs", rows)
    doc_bits = common.written_bitmap(asked, "d2")
    texts = common.with_suspicion(docs, "doc_id", doc_bits, "suspect").where("suspect").join(asked, F.col("doc_id") == F.col("d2"))
    sets = texts.select("text", "asked").mapInArrow(_asked_shingles, "kind long, shingles binary").dropDuplicates(["kind"])
    compared = dealt.join(common.materialize(sets, "kind-shingles"), F.col("asked") == F.col("kind")).select("key", "asked", "shingles")
    return compared.repartition(n, "key").sortWithinPartitions("key", "asked").mapInArrow(_compared, "a long, b long")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per repeated passage and row of a document that holds it: doc_id, start_word, n_words, removed, first_doc_id, cluster_id, row_hash.

    Words count from 0 in the row's text, which row_hash tells from others of the id. removed is false in the smallest doc_id that holds a unit; first_doc_id is the smallest among
    the passage's units, cluster_id the component of its first unit.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    # A row that repeats a doc_id is part of that document, but its places count anew.
    units = common.materialize(docs.withColumn("row_hash", common.row_hash()).mapInArrow(_units, "doc_id long, row_hash long, unit int, at int, size int, kind long, proof long, bands array<long>"), "units")
    tied = common.materialize(components(common.materialize(paragraph_links(docs, units), "paragraph-links")).select(F.col("node").alias("linked"), "component"), "paragraph-components")
    ends = units.groupBy("kind", "proof").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("latest"))
    # Kinds in two documents, or tied to another kind; all others are settled here and never moved again.
    of_kind = ends.join(tied, F.col("kind") == F.col("linked"), "left").where(F.col("component").isNotNull() | (F.col("first") != F.col("latest")))
    of_kind = common.materialize(of_kind.select("kind", "proof", F.coalesce("component", "kind").alias("cluster"), F.coalesce("component", "proof").alias("cluster_proof"), "first", "latest"), "kinds")
    n = of_kind.count()
    clusters = of_kind.groupBy("cluster", "cluster_proof").agg(F.min("first").alias("holder"), F.max("latest").alias("latest")).where("holder <> latest")
    clusters = common.materialize(clusters.select(F.col("cluster").alias("c2"), F.col("cluster_proof").alias("p2"), "holder"), "clusters", n)
    repeated = of_kind.join(clusters, (F.col("cluster") == F.col("c2")) & (F.col("cluster_proof") == F.col("p2")))
    repeated = common.materialize(repeated.select(F.col("kind").alias("k2"), F.col("proof").alias("proof2"), "cluster", "holder"), "repeated-kinds", n)
    bits = common.written_bitmap(repeated, "k2")
    found = common.with_suspicion(units.drop("bands"), "kind", bits, "suspect").where("suspect").join(repeated, (F.col("kind") == F.col("k2")) & (F.col("proof") == F.col("proof2")))
    found = found.select("doc_id", "row_hash", "at", (F.col("at") + F.col("size")).alias("end"), (F.col("holder") < F.col("doc_id")).alias("removed"), "holder", "cluster").distinct()
    order = Window.partitionBy("doc_id", "row_hash", "removed").orderBy("at", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(reached >= F.col("at"), 0).otherwise(1)).withColumn("passage", F.sum("opens").over(order))
    passages = opened.groupBy("doc_id", "row_hash", "removed", "passage").agg(
        F.min("at").cast("long").alias("start_word"), (F.max("end") - F.min("at")).cast("long").alias("n_words"), F.min("holder").alias("first_doc_id"), F.min_by("cluster", F.struct("at", "end", "cluster")).alias("cluster_id")
    )
    return passages.where(F.col("n_words") >= LEAST).select("doc_id", "start_word", "n_words", "removed", "first_doc_id", "cluster_id", "row_hash")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts without the passages that another document keeps; white space around a cut goes with it."""
    cuts = repeated_passages(docs).where("removed").groupBy(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("cuts"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_hash", common.row_hash())
    joined = texts.join(cuts, (F.col("doc_id") == F.col("d2")) & (F.col("row_hash") == F.col("h2")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text and gone:
                    drop = {w for c in gone for w in range(c["start_word"], c["start_word"] + c["n_words"])}
                    text = "".join(m.group() for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)) if k not in drop)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return joined.select("doc_id", "text", "cuts").mapInArrow(run, "doc_id long, text string")
