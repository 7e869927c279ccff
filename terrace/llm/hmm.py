"""Scoring by a hidden Markov language model.

Tokens are words (A-Z lower-cased, cut at ASCII white space) and one end for each text. The model's states emit
symbols: each of the SYMBOLS most frequent training words, the end, and one symbol for any other
word, which is then spelt out by that word's share among the other words, (c + 1) / (n + v + 1). The probability of
a text is thus that of its symbols, by the scaled forward recursion over the whole text, times
those shares. States are trained by Baum-Welch: tasks sum up expected counts over their documents,
Spark adds the tasks' counts, and the driver, which holds only a table of fixed size, sets the parameters anew.
Training is incremental: a hash deals all training documents to SLICES slices, whatever their number; a step makes one slice's
counts anew under the model so far, in place of that slice's earlier ones, and sets the parameters from the sum of all slices' counts. A sweep of steps
thus goes once through all training documents, and sweeps follow until the likelihood grows by less than LEAST_GAIN of itself, MOST_SWEEPS at
most. The model doesn't depend on the order or partitioning of rows (but for rounding). Counts of a text are those of the whole text, however long.

The base score is that of single words with one added to each count. Words' counts come from all training documents. The
DICTIONARY most frequent words of LONGEST bytes at most are broadcast, which bounds the broadcast; all other words are joined with their counts.

Cases: a null or empty text is one end; a document without an id is in training; rows that repeat a doc_id
are documents of their own; without any training document all counts are 0; other columns are never read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STATES, SYMBOLS, DICTIONARY = 8, 8000, 150_000
#: Bytes of the longest word that is broadcast.
LONGEST = 64
#: Slices of the training documents, sweeps at most, and the share that the log likelihood grows by at least from one sweep to the next.
SLICES, MOST_SWEEPS, LEAST_GAIN = 8, 5, 1e-4
#: Weight of the prior, in counts: the symbols' overall shares for emissions, an even one for moves.
PRIOR = 1.0
#: Tokens between kept forward probabilities; tokens of a padded block that are in work at a time, and of the whole block.
SEGMENT, ROOM, PADDED = 2048, 1 << 19, 1 << 22
END = ""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[bytes] = Counter()
        for v in batch.column(0):
            counts.update(words_of(v.as_py()))
            counts[END.encode()] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents; the end is the empty word."""
    return docs.where(~held_out()).select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame) -> list[tuple[str, int]]:
    """(word, c) of the frequent words, DICTIONARY at most, by falling count, then word.

    Words are those of the highest counts, in steps of a 32nd of a doubling, as many steps as fit; so no task sends more than its own share.
    """
    words, step = counts.where((F.col("word") != END) & (F.octet_length("word") <= LONGEST)), F.floor(F.log2("c") * 32)
    room, least = DICTIONARY, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # some 2,000 steps at most
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(((r["word"], r["c"]) for r in words.where(step >= least).collect()), key=lambda w: (-w[1], w[0]))


class Dictionary:
    """Ids of the symbols and counts of the frequent words."""

    def __init__(self, frequent: list[tuple[str, int]], end: int) -> None:
        self.places = {w.encode(): i for i, (w, _) in enumerate(frequent)}
        self.logs = np.log10(np.array([c for _, c in frequent], float) + 1)
        self.end_count, self.end = end, min(SYMBOLS, len(frequent))
        self.other = self.end + 1


def _encoded_as(dictionary) -> tuple:
    """A map from (doc_id, held_out, text) to symbols, sums over frequent words, and the rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = dictionary.value
        find, end_log = d.places.get, float(np.log10(d.end_count + 1.0))
        for batch in batches:
            rows = []
            for v in batch.column(2):
                words = words_of(v.as_py())
                at = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                rare = [words[k].decode() for k in np.flatnonzero(at < 0)]
                symbols = np.append(np.where((at < 0) | (at >= d.end), d.other, at), d.end).astype(np.uint16)
                spelt, n_spelt = float(d.logs[at[at >= d.end]].sum()), int((symbols == d.other).sum())
                base = end_log + float(d.logs[at[at >= 0]].sum())
                rows.append((len(symbols), base, spelt, n_spelt, len(words) - len(rare) + (d.end_count > 0), symbols.tobytes(), rare))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
            names = ["doc_id", "held_out", "n_tokens", "base", "spelt", "n_spelt", "known", "symbols", "rare"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    return run, "doc_id long, held_out boolean, n_tokens long, base double, spelt double, n_spelt long, known long, symbols binary, rare array<string>"


class Model:
    """start (K), moves (K, K) and emits (K, symbols), each a distribution by rows."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        self.start, self.moves, self.emits = start, moves, emits

    @classmethod
    def first(cls, shares: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emits = shares * rng.gamma(1.0, 1.0, (STATES, len(shares)))
        moves = np.full((STATES, STATES), 1.0) + 4 * STATES * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))

    @classmethod
    def of_counts(cls, start: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Model:
        start, moves, emits = start + PRIOR, moves + PRIOR, emits + PRIOR * shares
        return cls(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))


def blocks(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, symbols (T, B), active columns at each step): sequences of like length together, the longest first."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    at = 0
    while at < len(order):
        length = len(sequences[order[at]])
        rows = order[at : at + max(1, min(ROOM // min(length, SEGMENT), PADDED // length))]
        sizes = np.array([len(sequences[r]) for r in rows])
        x = np.zeros((length, len(rows)), np.uint16)
        for b, r in enumerate(rows):
            x[: sizes[b], b] = sequences[r]
        yield rows, x, np.searchsorted(-sizes, -np.arange(length), "left")
        at += len(rows)


def log10_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Scaled forward recursion over whole sequences (none empty)."""
    out = np.zeros(len(sequences))
    moves = np.ascontiguousarray(model.moves.T)
    for rows, x, active in blocks(sequences):
        scale = np.empty(x.shape)
        a = model.start[:, None] * model.emits[:, x[0]]
        for t in range(len(x)):
            n = active[t]
            if t:
                a = (moves @ a[:, :n]) * np.take(model.emits, x[t, :n], axis=1)
            s = a.sum(axis=0)
            a /= s
            scale[t, :n] = s
            scale[t, n:] = 1
        out[rows] = np.log10(scale).sum(axis=0)
    return out


def expected_counts(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log10 likelihood, summed over the sequences.

    Forward probabilities are kept at every SEGMENT-th token and made anew within a segment on the way back (but for the last ROOM tokens
    of a block, whose are kept), so that memory for a long sequence is bounded and its counts are those of the whole.
    """
    start, moves, emits = np.zeros_like(model.start), np.zeros_like(model.moves), np.zeros_like(model.emits)
    forward_moves, total = np.ascontiguousarray(model.moves.T), 0.0

    def emitted(x: np.ndarray, active: np.ndarray, first: int, last: int) -> np.ndarray:
        return np.take(model.emits, x[first:last, : active[first]], axis=1)

    def ahead_from(a: np.ndarray | None, told: np.ndarray, active: np.ndarray, first: int, last: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scaled forward probabilities and scales of the tokens first, ..., last - 1, given those of the token before."""
        alphas, scales = [], []
        for t in range(first, last):
            n = active[t]
            if t:
                a = (forward_moves @ a[:, :n]) * told[:, t - first, :n]
            else:
                a = model.start[:, None] * told[:, 0]
            s = a.sum(axis=0)
            a /= s
            alphas.append(a)
            scales.append(s)
        return alphas, scales

    for _, x, active in blocks(sequences):
        cuts = [*range(0, len(x), SEGMENT), len(x)]
        left = np.cumsum(active[::-1])[::-1]
        before, kept = [None], {}
        for k, (first, last) in enumerate(zip(cuts, cuts[1:])):
            made = ahead_from(before[-1], emitted(x, active, first, last), active, first, last)
            total += float(np.log10(np.concatenate(made[1])).sum())
            before.append(made[0][-1])
            if left[first] <= ROOM or last == len(x):
                kept[k] = made
        ahead = np.ones((STATES, 0))  # what a token's followers say of its state, at the next token: emission times backward probability by scale
        for k in range(len(cuts) - 2, -1, -1):
            first, last = cuts[k], cuts[k + 1]
            told = emitted(x, active, first, last)
            alphas, scales = kept.pop(k) if k in kept else ahead_from(before[k], told, active, first, last)
            betas, followed, followers = [], [], []
            for t in range(last - 1, first - 1, -1):
                n, after = active[t], ahead.shape[1]
                if after:
                    followed.append(alphas[t - first][:, :after])
                    followers.append(ahead)
                beta = model.moves @ ahead
                if n > after:
                    beta = np.concatenate([beta, np.ones((STATES, n - after))], axis=1)
                betas.append(beta)
                ahead = beta * told[:, t - first, :n]
                ahead /= scales[t - first]
            if followed:
                moves += np.concatenate(followed, axis=1) @ np.concatenate(followers, axis=1).T
            betas.reverse()
            weights = np.concatenate(alphas, axis=1) * np.concatenate(betas, axis=1)
            at = np.concatenate([x[t, : active[t]] for t in range(first, last)])
            for j in range(STATES):
                emits[j] += np.bincount(at, weights[j], emits.shape[1])
        start += weights[:, : active[0]].sum(axis=1)
    return start, moves * model.moves, emits, total


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), np.uint16) for v in column]


def _slice_counts(part: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts over all rows of ``part`` and their log10 likelihood under ``model``.

    Rows: a symbol's counts, or -1 the starts, or -2 - k the moves from k, or -2 - STATES the likelihood.
    """
    told = part.sparkSession.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            counts = expected_counts(told.value, _sequences(batch.column(0)))
            total = counts if total is None else tuple(a + b for a, b in zip(total, counts))
        if total is not None:
            start, moves, emits, likelihood = total
            rows = np.concatenate([emits.T, start[None], moves, np.full((1, STATES), likelihood)])
            keys = np.concatenate([np.arange(emits.shape[1]), -1 - np.arange(STATES + 2)])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(rows[:, k]) for k in range(STATES))], ["row", *names])

    summed = part.select("symbols").mapInArrow(run, "row long, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    start, moves, emits, likelihood = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emits), 0.0
    for r in summed.collect():  # SYMBOLS + STATES + 4 rows at most
        values = [r[n] for n in names]
        if r["row"] >= 0:
            emits[:, r["row"]] = values
        elif r["row"] == -1:
            start[:] = values
        elif r["row"] == -2 - STATES:
            likelihood = values[0]
        else:
            moves[-2 - r["row"]] = values
    told.unpersist()
    return start, moves, emits, likelihood


def train(encoded: DataFrame, shares: np.ndarray) -> Model:
    """Sweeps of steps over the slices of all training rows until the likelihood hardly grows. The driver holds SLICES tables of counts."""
    model, kept, before = Model.first(shares), {}, None
    # A task takes a slice's rows of as many splits as there are slices, so that it has as many texts to move side by side as a task over all rows of a split.
    tasks = -(-encoded.rdd.getNumPartitions() // SLICES)
    for _ in range(MOST_SWEEPS):
        for k in range(SLICES):
            kept[k] = _slice_counts(encoded.where((F.col("slice") == k) & ~F.col("held_out")).coalesce(tasks), model)
            model = Model.of_counts(*(sum(counts[j] for counts in kept.values()) for j in range(3)), shares)
        likelihood = sum(counts[3] for counts in kept.values())
        if before is not None and likelihood - before <= LEAST_GAIN * abs(before):
            break
        before = likelihood
    return model


def score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = common.materialize(word_counts(docs), "word-counts")
    n_all, n_kinds, n_ends = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END, F.col("c")))).first())
    frequent = most_frequent(counts)
    symbol_counts = [c for _, c in frequent[:SYMBOLS]]
    n_other = n_all - n_ends - sum(symbol_counts)
    v_other = n_kinds - len(symbol_counts) - (n_ends > 0)
    shares = np.array([*symbol_counts, n_ends, n_other], float) + 1
    shares /= shares.sum()
    run, schema = _encoded_as(spark.sparkContext.broadcast(Dictionary(frequent, n_ends)))
    told_slice = F.pmod(F.xxhash64("doc_id", "symbols"), F.lit(SLICES)).cast("int")
    coded = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()).withColumn("slice", told_slice)
    encoded = common.materialize(coded.sortWithinPartitions("slice"), "symbols")  # so that a step's scan skips other slices' pages
    model = train(encoded, shares)
    rare = encoded.select("rid", F.explode("rare").alias("rare_word")).groupBy("rid", "rare_word").agg(F.count(F.lit(1)).alias("tf")).join(counts, F.col("rare_word") == F.col("word"), "left")
    sums = rare.groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(F.lit(0))).alias("rare_known")
    ).withColumnRenamed("rid", "rare_rid")
    told = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = log10_likelihoods(told.value, [np.frombuffer(v.as_py(), np.uint16) for v in batch.column(7)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(7)), pa.array(found, pa.float64())], ["rid", "doc_id", "held_out", "n_tokens", "base", "spelt", "known", "forward"])

    plain = encoded.select("rid", "doc_id", "held_out", "n_tokens", "base", (F.col("spelt") - F.col("n_spelt") * np.log10(n_other + v_other + 1.0)).alias("spelt"), "known", "symbols")
    scored = plain.mapInArrow(forward, "rid long, doc_id long, held_out boolean, n_tokens long, base double, spelt double, known long, forward double")
    told_rare = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(sums, F.col("rid") == F.col("rare_rid"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + told_rare - F.col("n_tokens") * float(np.log10(n_all + n_kinds + 1.0))).alias("base_score"),
        (F.col("forward") + F.col("spelt") + told_rare).alias("score"),
    )
