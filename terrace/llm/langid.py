"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of WINDOW bytes, in both directions, and gives each
byte's probabilities of the languages; a document's probabilities are the mean over all its bytes, and
its score is that of the best. It is trained on the driver in numpy, by backpropagation through time, on
at most TRAIN_ROWS windows of each language, which are drawn by a hash of the id (the documented bound of the
sample). Prediction is a map over whole texts, windows of many documents at a time.

Cases: a null text and one without any letter are ``und`` with score 0; rows without a language or
a text teach nothing; without any row to learn from all rows are ``und``; equal texts get equal
results; repeated rows each get a row; other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, HIDDEN = 128, 8
#: Bound of the training sample: windows of each language. Steps, windows in a step, and bytes of a training window.
TRAIN_ROWS, STEPS, BATCH, TRAIN_BYTES = 1500, 240, 64, 64
#: Windows that are run together when predicting.
TOGETHER = 1024
#: The least score with which filtering keeps a document.
LEAST_SCORE = 0.4
#: Letters, and numbers that aren't decimal digits, which the next test tells apart.
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode category of letters is in the text."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Network:
    """Both directions' weights: inputs (256, 3H), states (H, 3H); gates are update, reset, candidate."""

    langs: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    return np.reciprocal(np.add(x, np.float32(1), out=x), out=x)


def _run(x: np.ndarray, inputs: np.ndarray, states: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, B) after each of the bytes x (T, B); keep gets what training needs.

    Rows are features and columns windows, so that each gate is one block of memory.
    """
    size = states.shape[0]
    from_byte, from_state = np.ascontiguousarray(inputs.T), np.ascontiguousarray(states.T)
    h = np.zeros((size, x.shape[1]), np.float32)
    out = np.empty((len(x), size, x.shape[1]), np.float32)
    g, u = np.empty((3 * size, x.shape[1]), np.float32), np.empty((3 * size, x.shape[1]), np.float32)
    for t in range(len(x)):
        np.take(from_byte, x[t], axis=1, out=g, mode="clip")
        np.matmul(from_state, h, out=u)
        g[: 2 * size] += u[: 2 * size]
        zr = _sigmoid(g[: 2 * size])
        z, r, n = zr[:size], zr[size:], g[2 * size :]
        if keep is not None:
            un = u[2 * size :].copy()
        u[2 * size :] *= r
        n += u[2 * size :]
        n *= np.float32(2)
        _sigmoid(n)  # the hyperbolic tangent, by way of the logistic function
        n *= np.float32(2)
        n -= np.float32(1)
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), n.copy(), un))
        new = np.subtract(h, n, out=out[t])
        new *= z
        new += n
        h = new
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the second axis, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def position_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(T, languages, B) for bytes x (T, B)."""
    size = net.states[0].shape[0]
    logits = net.out[:size].T @ _run(x, net.inputs[0], net.states[0])
    logits += (net.out[size:].T @ _run(x[::-1], net.inputs[1], net.states[1]))[::-1]
    logits += net.bias[:, None]
    return _softmax(logits)


def _back(x: np.ndarray, states: np.ndarray, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input and state weights from those of the states (T, H, B)."""
    size = states.shape[0]
    d_inputs, d_states = np.zeros((256, 3 * size), np.float32), np.zeros_like(states)
    d_h = np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, un = kept[t]
        d_h = d_h + d_out[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_gates = np.concatenate([d_h * (h - n) * z * (1 - z), d_n * un * r * (1 - r), d_n])
        np.add.at(d_inputs, x[t], d_gates.T)
        d_u = np.concatenate([d_gates[: 2 * size], d_n * r])
        d_states += h @ d_u.T
        d_h = d_h * z + states @ d_u
    return d_inputs, d_states


def train(windows: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Fit by Adam on windows of bytes, each byte labelled with its window's language."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(langs, [normal(256, 3 * HIDDEN, scale=0.3) for _ in "ab"], [normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5) for _ in "ab"], normal(2 * HIDDEN, len(langs), scale=0.3), np.zeros(len(langs), np.float32))
    by_lang = [[w for w, one in zip(windows, labels) if one == lang] for lang in langs]
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, STEPS + 1):
        y = rng.integers(0, len(langs), BATCH)
        rows = [by_lang[k][rng.integers(len(by_lang[k]))] for k in y]
        x = np.full((TRAIN_BYTES, BATCH), 32, np.uint8)
        for b, row in enumerate(rows):
            at = rng.integers(0, max(1, len(row) - TRAIN_BYTES + 1))
            part = row[at : at + TRAIN_BYTES]
            x[: len(part), b] = np.frombuffer(part, np.uint8)
        kept: list[list] = [[], []]
        forward = _run(x, net.inputs[0], net.states[0], kept[0])
        backward = _run(x[::-1], net.inputs[1], net.states[1], kept[1])
        both = np.concatenate([forward, backward[::-1]], axis=1)
        d_logits = _softmax(net.out.T @ both + net.bias[:, None])
        d_logits[:, y, np.arange(BATCH)] -= 1
        d_logits /= BATCH * TRAIN_BYTES / 8
        d_both = net.out @ d_logits
        i0, s0 = _back(x, net.states[0], kept[0], d_both[:, :HIDDEN])
        i1, s1 = _back(x[::-1], net.states[1], kept[1], d_both[::-1, HIDDEN:])
        d_out = np.tensordot(both, d_logits, axes=([0, 2], [0, 2]))
        grads = [i0, i1, s0, s1, d_out, d_logits.sum(axis=(0, 2))]
        scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads))))
        rate = 0.02 * (1 - step / (STEPS + 1))
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g * scale - m)
            v += 0.01 * ((g * scale) ** 2 - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame) -> Network | None:
    """Learn from the texts and languages of the rows that aren't held out; None if there are none."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    shares = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    if not shares:
        return None
    cut = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, 1.2 * TRAIN_ROWS / r["n"]) * (1 << 30)))) for r in shares])
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut)
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    at = F.pmod(F.xxhash64("doc_id", F.lit("at")), room).cast("int") + 1
    rows = drawn.select("doc_id", "lang", F.substring(F.col("text"), at, F.lit(WINDOW)).alias("part")).limit(2 * TRAIN_ROWS * len(shares)).collect()
    rows.sort(key=lambda r: (str(r["lang"]), r["doc_id"] is None, r["doc_id"] or 0, r["part"]))
    return train([r["part"].encode() for r in rows], [r["lang"] for r in rows]) if rows else None


def pooled(net: Network, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean probabilities (documents, languages) of the texts' bytes, given where each lies in data."""
    counts = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = starts[doc] + nth * WINDOW
    width = np.minimum(WINDOW, sizes[doc] - nth * WINDOW)
    total = np.zeros((len(sizes), len(net.langs)))
    order = np.argsort(-width, kind="stable")  # the full windows first, so that short ones share a shorter run
    for at in range(0, len(order), TOGETHER):
        part = order[at : at + TOGETHER]
        steps = np.arange(int(width[part[0]]))[:, None]
        inside = steps < width[part]
        x = np.where(inside, data[np.minimum(begin[part] + steps, len(data) - 1)], 32)
        p = position_probabilities(net, x)
        if not inside.all():
            p *= inside[:, None, :]
        np.add.at(total, doc[part], p.sum(axis=0).T)
    return total / np.maximum(sizes, 1)[:, None]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, and each text's start and size (0 if null)."""
    column = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return raw, offsets[:-1], np.diff(offsets)


def labelled(net: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Each text's language and score; ``und`` and 0 for null, texts without a letter, and without a network."""
    known = np.array([bool(net) and v.is_valid and has_letter(v.as_py()) for v in texts], bool)
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if known.any():
        data, starts, sizes = _bytes_of(texts)
        p = pooled(net, data, starts[known], sizes[known])
        for row, best, score in zip(np.flatnonzero(known), p.argmax(axis=1), p.max(axis=1)):
            langs[row], scores[row] = net.langs[best], float(min(1.0, score))
    return langs, scores


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of each row; from the text alone."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("langid", dict)  # other operators' tables go
        net = model.value
        for batch in batches:
            langs, scores = labelled(net, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, then predict all: doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are ``und`` or score below LEAST_SCORE, each judged by itself in one pass; all columns stay."""
    common.bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.worker_cache("langid", dict)
        for batch in batches:
            texts = batch.column(at)
            langs, scores = labelled(model.value, texts if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts.cast(pa.string()))
            yield batch.filter(pa.array([lang != "und" and score >= LEAST_SCORE for lang, score in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
