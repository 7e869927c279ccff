"""Near-duplicates by SimHash fingerprints, found by Golay-code keys.

The perfect binary Golay code puts each of the 2^23 words within 3 bits of just
one codeword. A word's keys are the indices of the codewords within 4 bits of it:
one, or six if the nearest is 3 bits off. Two words at most 2 bits apart have a key in
common (checked by the tests for every case). A fingerprint of 64 bits is cut into three segments
of 22, 21 and 21 bits, padded to 23. If two fingerprints differ in at most 4
bits, at least two of their segments differ in at most 2 each, so that the pair of these
segments' keys meets: 3 pairs of segments with 1 to 36 keys each. Fingerprints
that share a key are compared, and links verified by counting bits.

Only distinct fingerprints are compared. A key shared by more than BLOCK of them is split
into blocks, each pair of blocks compared by itself, so no task holds a large group;
each comparing task returns a spanning forest of the links that it has found, which keeps the
components and never lists all pairs.

Cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle; repeated rows each get a row;
a null doc_id gets a row but never names a component unless it is alone there;
other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code (fixed value).
GENERATOR = 0b101011100011
RADIUS, SHINGLE, SEED = 4, 4, 42
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Most fingerprints under a key that are compared in one go, rows taken at a time, and links held before they are contracted.
BLOCK, ROWS, LINKS = 2048, 1 << 16, 1 << 18


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the words' shingles; blocks keep very long texts within bounded memory."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        last = [ends[min(k + SHINGLE, len(words)) - 1] - 1 for k in (range(at, to) if n > 1 else [0])]
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[at:to], last)), np.uint64, to - at)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(v.as_py()) for v in batch.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])


class Golay:
    """For each remainder, the error words of up to 4 bits that have it: what to flip to reach the codewords nearby."""

    def __init__(self) -> None:
        rest = [self._remainder(1 << i) for i in range(23)]
        errors: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for bits in combinations(range(23), weight):
                r = e = 0
                for i in bits:
                    r, e = r ^ rest[i], e | 1 << i
                errors[r].append(e)
        self.flips = np.array([e + [e[0]] * (6 - len(e)) for e in errors], np.int64)
        low, high = np.arange(1 << 12), np.arange(1 << 11)
        self.rest_low = self._sums(rest[:12], low)
        self.rest_high = self._sums(rest[12:], high)

    @staticmethod
    def _remainder(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    @staticmethod
    def _sums(rest: list[int], words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for i, r in enumerate(rest):
            out ^= np.where(words >> i & 1, r, 0)
        return out

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Six indices (12 bits) for each word; a word with one key has it six times."""
        rest = self.rest_low[words & 4095] ^ self.rest_high[words >> 12]
        return (words[:, None] ^ self.flips[rest]) >> 11


_golay: list[Golay] = []


def code() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each distinct key of each fingerprint; the pair of segments is part of the key."""
    bits = fps.view(np.uint64)
    keys = [code().keys((bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    rows, out = [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        both = (keys[i][:, :, None] << 12 | keys[j][:, None, :]).reshape(len(fps), 36) | p << 24
        both.sort(axis=1)
        new = np.ones(both.shape, bool)
        new[:, 1:] = both[:, 1:] != both[:, :-1]
        row, _ = np.nonzero(new)
        rows.append(row)
        out.append(both[new])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            row, key = pair_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part[row], pa.int64())], ["key", "fp"])


def tied_in_runs(key: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, its root) of the rows that links between rows of one key tie to an earlier one; rows are sorted by key.

    Compares each row with the next, the one after, and so on while the key lasts, but no rows that are tied already;
    ``near`` says which of two lists' rows are linked.
    """
    root, at, lag = np.arange(len(key)), np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        apart = at[root[at] != root[at + lag]]
        found = apart[near(apart, apart + lag)]
        if len(found):
            tied = forest(np.stack([root[found], root[found + lag]], axis=1))
            new = np.arange(len(key))
            new[tied[:, 0]] = tied[:, 1]
            root = new[root]
        lag += 1
    moved = np.flatnonzero(root != np.arange(len(key)))
    return moved, root[moved]


def links_in_runs(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links that tie together what links between rows of one key tie together; rows are sorted by key."""
    moved, root = tied_in_runs(key, lambda i, j: np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= RADIUS)
    return np.stack([fp[moved], fp[root]], axis=1)


def forest(links: np.ndarray) -> np.ndarray:
    """A star for each component of the links: fewer links than nodes, the same components."""
    if not len(links):
        return links
    nodes, at = np.unique(links, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[tied], nodes[root[tied]]], axis=1)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links under the keys of a partition that is sorted by key, and a row (key, its size, true) for a key of more than BLOCK rows.

    A run of one key is held until it ends or is too large; then its rows are only counted.
    """
    links: list[np.ndarray] = []
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    large_key, large = None, 0

    def out(pairs: np.ndarray, is_large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(np.full(len(pairs), is_large))], ["a", "b", "large"])

    def taken(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(key)) + 1
        sizes = np.diff(np.concatenate([[0], cuts, [len(key)]]))
        big = np.repeat(sizes > BLOCK, sizes)
        if big.any():
            heads = np.concatenate([[0], cuts])[sizes > BLOCK]
            yield out(np.stack([key[heads], sizes[sizes > BLOCK]], axis=1), True)
        links.append(links_in_runs(key[~big], fp[~big]))
        if sum(map(len, links)) > LINKS:
            yield out(forest(np.concatenate(links)), False)
            links.clear()

    for batch in batches:
        k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        if large_key is not None:
            same = int(np.searchsorted(k, large_key, "right"))
            large, k, f = large + same, k[same:], f[same:]
            if not len(k):
                continue
            yield out(np.array([[large_key, large]]), True)
            large_key = None
        key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
        if len(key) < ROWS:
            continue
        last = int(np.searchsorted(key, key[-1]))
        yield from taken(key[:last], fp[:last])
        key, fp = key[last:], fp[last:]
        if len(key) > BLOCK:
            large_key, large = key[0], len(key)
            key, fp = key[:0], fp[:0]
    if large_key is not None:
        yield out(np.array([[large_key, large]]), True)
    if len(key):
        yield from taken(key, fp)
    if links:
        yield out(forest(np.concatenate(links)), False)


def _sorted_by(df: DataFrame, *names: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *names).sortWithinPartitions(*names)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints (column fp, distinct) within RADIUS."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").repartition(n).mapInArrow(_keyed, "key long, fp long")
    first = common.materialize(_sorted_by(keyed, "key").mapInArrow(_compared, "a long, b long, large boolean"), "golay-links")
    small = first.where(~F.col("large")).select("a", "b")
    n_large = first.where("large").count()
    if not n_large:
        return small
    # Keys of many fingerprints: each pair of blocks of a key's rows is a key of its own, of 2 * BLOCK rows at most on average.
    wide = common.materialize(first.where("large").groupBy(F.col("a").alias("wide_key")).agg(F.ceil(2 * F.sum("b") / F.lit(BLOCK)).cast("int").alias("blocks")), "golay-wide", n_large)
    bits = common.written_bitmap(wide, "wide_key")
    block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = (
        common.with_suspicion(keyed, "key", bits, "suspect")
        .where("suspect")
        .join(wide, F.col("key") == F.col("wide_key"))
        .select("key", "fp", block.cast("int").alias("block"), other.alias("other"))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp")
    )
    rest = common.materialize(_sorted_by(split, "key").mapInArrow(_compared_all, "a long, b long"), "golay-wide-links")
    return small.unionByName(rest)


def _compared_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links under each key, whatever its size: rows of a key are compared run by run as they stream in."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last >= ROWS // 2:
            yield _star(links_in_runs(key[:last], fp[:last]))
            key, fp = key[last:], fp[last:]
    if len(key):
        yield _star(links_in_runs(key, fp))


def _star(pairs: np.ndarray) -> pa.RecordBatch:
    tied = forest(pairs)
    return pa.RecordBatch.from_arrays([pa.array(tied[:, 0], pa.int64()), pa.array(tied[:, 1], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id (smallest doc_id reachable over links)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = common.materialize(texts.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    n = fps.count()
    distinct = common.materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps", n)
    tied = components(links(distinct))
    labelled = common.materialize(distinct.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "labelled-fps", n)
    named = common.materialize(labelled.groupBy(F.col("root").alias("named")).agg(F.min("least").alias("component_id")), "named", n)
    of_fp = common.materialize(labelled.join(named, F.col("root") == F.col("named")).select(F.col("fp").alias("key_fp"), "component_id"), "fp-components", n)
    return fps.join(of_fp, F.col("fp") == F.col("key_fp")).select("doc_id", "fp", "component_id")
