"""Runs of words that repeat with a period: found, reported and collapsed to their first period.

A run is a stretch of consecutive words with smallest period q, at least LEAST and ROUNDS * q words long, that no neighbouring
word extends. All texts of a block of bytes are worked on together, as arrays of word hashes:

1. Splitting: a word of a run occurs ROUNDS times in it at least. Words that occur more rarely within the current segment split it,
   pieces shorter than LEAST go, and the rest is split again until nothing changes. The first segments are the texts.
2. Lag scan of the segments that are left, by lengths k that double. The stretch of k words at a place of a run with
   period q in (k / 2, k] next occurs exactly q words on, for an earlier copy would give the run a smaller period (two periods in as many
   words give their divisor). So the lag of each stretch's next copy within the segment is the one lag to try, and places
   in a row with one lag are a run, without trying all lags at all places. Stretches that don't occur again end the scan of their length.

Words are compared by hashes of 64 bits, and stretches of k words by hashes of hashes.

Cases: null and empty texts have no words and no runs; runs of different periods may overlap; repeated rows give equal results; a null
doc_id changes nothing; other columns are never read; an empty table gives no rows. All work is within texts: a task holds a batch of
texts, and a text's work grows with n log n of its n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS
from .passages import texts_of
from .text_bytes import MULTIPLIER, mixed

LEAST, ROUNDS = 24, 3
_FIRST = 8  # words; periods up to it are found with stretches of this length, since LEAST - 8 >= 8
RUN = "struct<start:long,length:long,period:long>"


def split(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` that may be in a run, in order, and each one's segment, whose numbers rise; ``segment`` has the first ones."""
    at = np.arange(len(words))
    _, word = np.unique(words, return_inverse=True)
    while len(at):
        # Often enough within the segment, and the segment long enough.
        pair = segment.astype(np.uint64) << np.uint64(32) | word[at].astype(np.uint64)
        _, to, count = np.unique(pair, return_inverse=True, return_counts=True)
        stays = count[to] >= ROUNDS
        new = np.ones(len(at), bool)
        new[1:] = (segment[1:] != segment[:-1]) | ~stays[1:] | ~stays[:-1]
        piece = np.cumsum(new)
        sizes = np.bincount(piece[stays], minlength=int(piece[-1]) + 1)
        stays &= sizes[piece] >= LEAST
        if stays.all():
            break
        at, segment = at[stays], piece[stays]
    return at, segment




def lag_scan(words: np.ndarray, segment: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in the segments, each a stretch of neighbouring places; starts count in ``words``."""
    found: list[np.ndarray] = []
    keys, k = words, 1
    at, of = np.arange(len(words)), segment
    longest = int(np.bincount(segment - segment.min()).max()) if len(segment) else 0
    stop = np.searchsorted(segment, segment, "right")  # where each place's segment ends
    while len(at):
        if k >= _FIRST:
            lag = _next_copy(keys, at, of)
            hit = np.flatnonzero((lag > (k // 2 if k > _FIRST else 0)) & (lag <= k))
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (at[hit][1:] != at[hit][:-1] + 1) | (lag[hit][1:] != lag[hit][:-1]) | (of[hit][1:] != of[hit][:-1])
                first = np.flatnonzero(new)
                rows = np.diff(np.append(first, len(hit)))
                found.append(np.stack([at[hit][first], rows - 1 + k + lag[hit][first], lag[hit][first]], axis=1))
            if ROUNDS * k > longest:
                break
            # Longer stretches that occur again start where these do.
            copies = lag > 0
            copies[np.searchsorted(at, at[copies] + lag[copies])] = True
            at, keys, of = at[copies], keys[copies], of[copies]
        # Stretches of 2 k words: two of k words, k apart.
        partner = np.searchsorted(at, at + k)
        partner[partner == len(at)] = 0
        whole = (at[partner] == at + k) & (at + 2 * k <= stop[at]) if len(at) else np.zeros(0, bool)
        keys = mixed(keys[whole] * MULTIPLIER + keys[partner[whole]])
        at, of = at[whole], of[whole]
        k *= 2
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = rows[rows[:, 1] >= np.maximum(LEAST, ROUNDS * rows[:, 2])]
    return [tuple(r) for r in rows[np.lexsort((rows[:, 2], rows[:, 0]))].tolist()]


def _next_copy(keys: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How far on, in places, each key next occurs in its segment; 0 if it doesn't. Places rise."""
    order = np.lexsort((keys, of))  # stable, so that places rise within a key
    same = (keys[order][1:] == keys[order][:-1]) & (of[order][1:] == of[order][:-1])
    out = np.zeros(len(keys), np.int64)
    out[order[:-1][same]] = (at[order][1:] - at[order][:-1])[same]
    return out


def runs_of(words: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, by start, then period; ``counts`` has the texts' numbers of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    at, segment = split(words, np.repeat(np.arange(len(counts)), counts))
    first = np.cumsum(counts) - counts
    for start, length, period in lag_scan(words[at], segment):
        # A segment's places are neighbours, so a run's are too.
        place = int(at[start])
        text = int(np.searchsorted(first, place, "right")) - 1
        out[text].append((place - int(first[text]), length, period))
    return out


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    words = text.split()  # at ASCII white space
    if runs:
        stays = np.ones(len(words), bool)
        for start, length, period in runs:
            stays[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(stays)]
    return b" ".join(words)


def _densest(runs: list[tuple[int, int, int]]) -> dict | None:
    best = None
    for run in runs:  # by start, then period: of equal ones the first stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best and dict(zip(("start", "length", "period"), best))


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        runs: list[list[tuple[int, int, int]]] = []
        for texts in texts_of(batch.column(1)):
            runs.extend(runs_of(texts.hashes, texts.counts))
        texts = pa.array([collapsed((t.as_py() or "").encode(), r).decode() for t, r in zip(batch.column(1), runs)], pa.string())
        found = pa.array([[dict(zip(("start", "length", "period"), r)) for r in row] for row in runs], pa.list_(run))
        yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array([_densest(r) for r in runs], run), texts], ["doc_id", "runs", "densest", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, runs (by start, then period), densest (the run of most periods; null without one), collapsed (the text without repeats)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_mapped, f"doc_id long, runs array<{RUN}>, densest {RUN}, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in which every tenth text, by its id's CRC-32, repeats words from a place on; others stay as they are."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), f"{WS}+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    drawn = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    drawn = drawn.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    block = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    made = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(block)), F.lit(1), F.col("n")), " ")
    return drawn.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The runs of ``with_periods(docs)``: doc_id, n_runs, start, length, period, exponent_milli of the densest, runs_sha256, collapsed_sha256."""
    found = periodic_runs(with_periods(docs))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "densest.start", "densest.length", "densest.period", F.expr("1000 * densest.length DIV densest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
