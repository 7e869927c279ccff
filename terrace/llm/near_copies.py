"""Near copies of whole documents: Jaccard similarity of their sets of 5-word shingles, SIMILARITY or more.

Candidates come from two sides. SimHash fingerprints within golay's RADIUS bits, found by Golay-code keys, tie the closest copies. They don't
reach all: at 0.8 they differ in 10 bits on average and in up to 20, within which 1 of 500 random pairs lies too, so that no key of such a
radius is selective. The others are found by BANDS bands of two MinHash values, which miss a pair at 0.8 in 0.36 ** BANDS, about 5 of 1,000,000. Documents that share a
band are likely copies if at least LIKELY of the SKETCH bytes of their sketches are equal (at 0.8 it is 51 on average, with a deviation
of 3); components of both sides' candidates only say which sets of shingles are brought together. There, each pair that is not tied already is compared
by its exact similarity, and the components of the links so verified are the groups of near copies.

Documents of equal sets are one kind, and only kinds are compared. A band or a component of more than BLOCK kinds is split into
blocks, each pair of blocks compared by itself; links return as forests, never as all pairs.

Cases: null and empty texts and those of white space have the empty set, and are copies of each other; fewer words than a shingle make
one shingle; repeated rows are one kind; a row without an id ties others together and counts as the largest; rows of one id are rows of their own;
all columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .golay import fingerprint, forest, links, tied_in_runs
from .passages import BLOCK, SHINGLE, _compared, _shared, shingles, texts_of
from .text_bytes import MULTIPLIER, mixed

BANDS, SKETCH, LIKELY = 12, 64, 32
#: Shingles hashed at a time, and rows of a band compared at a time.
CHUNK, ROWS = 1 << 12, 1 << 15
_rng = np.random.default_rng(8)
_A, _B = (_rng.integers(1, 1 << 63, (SKETCH, 1), np.uint64) for _ in "ab")
_A |= np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct hashes of each text's shingles, in order."""
    for texts in texts_of(column):
        values, at = shingles(texts.hashes), 0
        for n in texts.counts:
            if n >= SHINGLE:
                yield np.unique(values[at : at + n - SHINGLE + 1])
            else:
                out = texts.hashes[at : at + min(n, 1)].copy()
                for k in range(1, n):
                    out = out * MULTIPLIER + texts.hashes[at + k]
                yield mixed(out)
            at += n


def kind_of(values: np.ndarray) -> int:
    return int(mixed(values).sum(dtype=np.uint64).astype(np.int64))


def sketch(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A byte of each MinHash value, and the keys of the bands."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(values), CHUNK):
        low = np.minimum(low, (values[at : at + CHUNK] * _A + _B).min(axis=1))
    keys = mixed(mixed(low[: 2 * BANDS : 2] * MULTIPLIER + low[1 : 2 * BANDS : 2]) + np.arange(1, BANDS + 1, dtype=np.uint64))
    return (mixed(low) & np.uint64(255)).astype(np.uint8).tobytes(), keys.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, sketches, bands, fps = [], [], [], []
        for values, text in zip(shingle_sets(batch.column(1)), batch.column(1)):
            marks, keys = sketch(values)
            kinds.append(kind_of(values))
            sketches.append(marks)
            bands.append(keys)
            fps.append(fingerprint(text.as_py()))
        columns = [batch.column(0), batch.column(2), pa.array(kinds, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_hash", "kind", "sketch", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(map(kind_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["kind", "shingles"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the likely copies under each key; rows are sorted by key."""

    def out(key: np.ndarray, kind: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        moved, root = tied_in_runs(key, lambda i, j: np.count_nonzero(marks[i] == marks[j], axis=1) >= LIKELY)
        tied = forest(np.stack([kind[moved], kind[root]], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(tied[:, 0], pa.int64()), pa.array(tied[:, 1], pa.int64())], ["a", "b"])

    key, kind, marks = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SKETCH), np.uint8)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        kind = np.concatenate([kind, batch.column(1).to_numpy(zero_copy_only=False)])
        marks = np.concatenate([marks, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last >= ROWS:
            yield out(key[:last], kind[:last], marks[:last])
            key, kind, marks = key[last:], kind[last:], marks[last:]
    if len(key):
        yield out(key, kind, marks)


def _dealt(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """``rows`` (key, kind) with a key for each pair of blocks that they are in; ``sizes`` has key and n, the kinds of the key."""
    wide = common.materialize(sizes.where(F.col("n") > BLOCK).select(F.col("key").alias("wide_key"), F.ceil(2 * F.col("n") / BLOCK).cast("int").alias("blocks")), f"wide-{name}")
    marked = common.with_suspicion(rows, "key", common.written_bitmap(wide, "wide_key"), "suspect")
    block = F.pmod(F.xxhash64("kind", F.lit(3)), F.col("blocks")).cast("int")
    split = marked.where("suspect").join(wide, F.col("key") == F.col("wide_key"), "left").select("key", "kind", "blocks", F.coalesce(block, F.lit(0)).alias("block"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    parted = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return marked.where(~F.col("suspect")).select("key", F.col("kind").alias("asked")).unionByName(split.select(parted.alias("key"), F.col("kind").alias("asked")))


def _by_key(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", rows.columns[1])


def fingerprint_links(sketched: DataFrame) -> DataFrame:
    """(a, b): kinds tied by fingerprints that are equal or within golay's RADIUS; a kind may have several."""
    held = common.materialize(sketched.select("fp", "kind").distinct(), "copies-fingerprints")
    least = common.materialize(held.groupBy(F.col("fp").alias("of_fp")).agg(F.min("kind").alias("least")), "copies-distinct-fps")
    alike = held.join(least, F.col("fp") == F.col("of_fp")).select(F.col("kind").alias("a"), F.col("least").alias("b"))
    tied = links(least.select(F.col("of_fp").alias("fp"))).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    near = tied.join(least.select(F.col("of_fp").alias("fp_a"), F.col("least").alias("a")), "fp_a").join(least.select(F.col("of_fp").alias("fp_b"), F.col("least").alias("b")), "fp_b")
    return alike.unionByName(near.select("a", "b")).where("a <> b")


def verified_links(texts: DataFrame, sketched: DataFrame, kinds: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of kinds of SIMILARITY or more."""
    keyed = sketched.select(F.explode("bands").alias("key"), "kind").distinct()
    shared = common.materialize(_by_key(keyed).mapInArrow(_shared, "key long, kind long, n long"), "copies-bands")
    asked = _dealt(shared.select("key", "kind"), shared.groupBy("key").agg((F.max("n") + 1).alias("n")), "bands")
    marked = asked.join(kinds.select("kind", "sketch"), F.col("asked") == F.col("kind")).select("key", "asked", "sketch")
    likely = common.materialize(_by_key(marked).mapInArrow(_likely, "a long, b long").unionByName(fingerprint_links(sketched)), "likely-copies")
    groups = common.materialize(components(likely).select(F.col("component").alias("key"), F.col("node").alias("kind")), "likely-groups")
    # The shingles of a text of each kind that has likely copies; texts of other kinds are never moved.
    kind_bits = common.written_bitmap(groups, "kind")
    holders = common.with_suspicion(kinds, "kind", kind_bits, "suspect").where("suspect").select(F.col("least").alias("doc_id"))
    held = common.with_suspicion(texts, "doc_id", common.written_bitmap(holders, "doc_id"), "suspect").where("suspect").select("text")
    sets = common.with_suspicion(held.mapInArrow(_sets, "kind long, shingles binary"), "kind", kind_bits, "suspect").where("suspect").drop("suspect")
    sets = common.materialize(sets.join(groups.select(F.col("kind").alias("w")), F.col("kind") == F.col("w"), "left_semi").dropDuplicates(["kind"]), "copies-shingles")
    rows = _dealt(groups, groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "groups").join(sets, F.col("asked") == F.col("kind")).select("key", "asked", "shingles")
    return common.materialize(_by_key(rows).mapInArrow(_compared, "a long, b long"), "verified-copies")


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_hash, component_id (smallest doc_id reachable over links; null if no row of the component has an id)."""
    common.bound_batches(docs.sparkSession)
    last = F.lit((1 << 63) - 1)  # for rows without an id
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = common.materialize(texts.withColumn("row_hash", common.row_hash()).mapInArrow(_sketched, "doc_id long, row_hash long, kind long, sketch binary, bands array<long>, fp long"), "sketches")
    n = sketched.count()
    kinds = common.materialize(sketched.groupBy("kind").agg(F.min("doc_id").alias("least"), F.min("sketch").alias("sketch")), "copies-kinds", n)
    tied = components(verified_links(texts, sketched, kinds))
    labelled = common.materialize(kinds.join(tied, F.col("kind") == F.col("node"), "left").select("kind", "least", F.coalesce("component", "kind").alias("root")), "labelled-kinds", n)
    named = common.materialize(labelled.groupBy(F.col("root").alias("named")).agg(F.min("least").alias("component_id")), "named-kinds", n)
    of_kind = common.materialize(labelled.join(named, F.col("root") == F.col("named")).select(F.col("kind").alias("key_kind"), "component_id"), "kind-components", n)
    return sketched.join(of_kind, F.col("kind") == F.col("key_kind")).select(F.nullif("doc_id", last).alias("doc_id"), "row_hash", F.nullif("component_id", last).alias("component_id"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component; all columns stay. Rows without an id stay only where the whole component has none."""
    return common.without_rows(docs, near_copies(docs).where("NOT doc_id <=> component_id").select("doc_id", "row_hash"))
