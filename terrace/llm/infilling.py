"""Fill-in-the-middle transformation of texts by rotations of blocks in place.

A text is cut twice between code points into prefix, middle and suffix. The cuts are found by one scan of the
bytes; sentinels are inserted into a bytearray, and segments change places by rotations: reversing two neighbouring blocks, each
by itself and then both together, exchanges them. Restoring finds the sentinels, rotates back and takes them out. Reversals swap
the two ends of a block in pieces of at most SWAP bytes, so that a long text needs no second copy.

The cuts and the form of a text depend on its doc_id only: numbers h1 to h4 are the first four groups of eight hexadecimal digits of
the SHA-256 of ``1:`` and the decimal doc_id.

Cases: null is the empty text, and an empty text is plain, as is one that holds a sentinel; a prefix, middle or suffix may be empty;
a row without an id draws its numbers from ``1:`` alone; repeated rows give equal results; other columns are never read; an empty table
gives no rows. All work is within rows, so that a task holds a batch of texts and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100 texts, those that are transformed, and of 100 of these, those whose suffix comes first.
CUT_OF_100, SPM_OF_100 = 90, 20
SWAP = 1 << 16


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def reverse(data: np.ndarray) -> None:
    """Reverse the bytes in place, some at both ends at a time."""
    low, high = 0, len(data)
    while high - low > 1:
        n = min(SWAP, (high - low) // 2)
        left = data[low : low + n].copy()
        data[low : low + n] = data[high - n : high][::-1]
        data[high - n : high] = left[::-1]
        low, high = low + n, high - n


def rotate(text: bytearray, start: int, cut: int, stop: int) -> None:
    """Exchange the neighbouring blocks [start, cut) and [cut, stop)."""
    view = np.frombuffer(text, np.uint8)  # the array is only resized when this view is gone
    reverse(view[start:cut])
    reverse(view[cut:stop])
    reverse(view[start:stop])


@dataclass
class Infilled:
    output: bytearray
    form: str
    n: int
    prefix: int | None = None
    middle: int | None = None


def infill(text: bytes, numbers: list[int]) -> Infilled:
    """The text (UTF-8) in the form and with the cuts that the four numbers say."""
    heads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # where code points start
    n, out = len(heads), bytearray(text)
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or numbers[2] % 100 >= CUT_OF_100:
        return Infilled(out, PLAIN, n)
    first, second = sorted(h % (n + 1) for h in numbers[:2])
    a, b = (int(heads[c]) if c < n else len(text) for c in (first, second))
    out[b:b], out[a:a], out[0:0] = SUFFIX, MIDDLE, PREFIX
    a, b = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)  # where the middle's and the suffix's sentinels are
    form = SPM if numbers[3] % 100 < SPM_OF_100 else PSM
    rotate(out, 0 if form == SPM else a, b, len(out))
    return Infilled(out, form, n, first, second - first)


def restore(output: bytes, form: str) -> bytearray:
    """The text that ``infill`` made the output of."""
    out = bytearray(output)
    if form == PLAIN:
        return out
    prefix, suffix, middle = (out.find(s) for s in (PREFIX, SUFFIX, MIDDLE))
    # Back to prefix, middle, suffix: the suffix goes to the end.
    rotate(out, suffix, prefix if form == SPM else middle, len(out))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = out.find(sentinel)
        del out[at : at + len(sentinel)]
    return out


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _mapped(value: pa.DataType, of):
    """A map over documents: the transformed text and the restored one, each passed through ``of``."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), value, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                made = infill((text.as_py() or "").encode(), draws(doc_id.as_py()))
                restored = restore(made.output, made.form)
                for column, v in zip(out, (made.n, made.form, made.prefix, made.middle, of(made.output), of(restored))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return run


def transform(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (code points), form, prefix_chars, middle_chars (null if plain), output, restored."""
    return _texts(docs).mapInArrow(_mapped(pa.string(), lambda b: b.decode()), SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """As transform, with SHA-256 of output and restored text in place of the texts, made where the texts are."""
    found = _texts(docs).mapInArrow(_mapped(pa.string(), lambda b: hashlib.sha256(b).hexdigest()), SCHEMA)
    return found.withColumnsRenamed({"output": "output_sha256", "restored": "restored_sha256"})
