"""Byte-level BPE encoding by backtracking, decoding by an offset table.

The text is cut into pieces by the vocabulary's pattern. A walk down the tokens'
trie finds the longest token that starts at each byte. The encoder goes from left
to right and takes the longest token that is compatible with the one before it,
else that token's next shorter prefix, else it steps back; a byte from which no
way leads on is marked and not tried again, so the time is linear. Two tokens are
compatible if merging their joined bytes gives just these two, which tables of
merges answer. A sequence whose neighbours are all compatible is the one that
applying the merges in order gives. The new pieces of many texts go side by side,
in numpy: a round takes one token or steps back once in each. Decoding looks up
where each token's bytes lie in one byte string.

Cases: a null text counts as empty and has no tokens; special strings in a text
become their special token, as in the tokenizers library; rows are independent, so
repeated rows, ties and columns other than doc_id and text play no part; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The byte-level pre-tokenizer's pattern (fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space below U+0100 as the format has it.
LATIN_SPACE = r"\t-\r\x20\x85\xa0"
#: Pieces whose encoding a worker keeps until there are more, and the longest piece that it keeps.
KEPT_PIECES, KEPT_LENGTH = 80_000, 32
#: Pairs of the compatibility table that a worker keeps for long pieces.
KEPT_PAIRS = 80_000
#: Pieces from which those gathered so far are looked up together, and letters from which a new piece is long: encoded alone, not side by side with others.
TOGETHER, LONG = 50_000, 256
#: log2 of the slots that tell most pairs without a merge.
PAIR_SLOTS_LOG2 = 20
#: Code points of a text that are encoded at a time; a cut moves to the next piece's start.
BLOCK = 1 << 20


def byte_letters() -> dict[str, int]:
    """The format writes a byte as its Latin-1 letter if printable, else as the next free letter from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


class Codec:
    """Tables of one vocabulary, made from the text of its tokenizer file."""

    def __init__(self, spec: str) -> None:
        import regex

        made = json.loads(spec)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        id_of = {to_bytes(s): i for s, i in made["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        bytes_of = {i: b for b, i in id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        # pair: when it is merged; token: when and from what it is made
        self.merged_at: dict[int, int] = {}  # a pair a, b is a << 20 | b
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(made["model"]["merges"]):
            a, b = (to_bytes(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            left, right, whole = id_of[a], id_of[b], id_of[a + b]
            self.merged_at[left << 20 | right] = rank
            self.parts[whole] = rank, left, right
        self.never = len(self.merged_at)
        self.compatible_pairs: dict[int, bool] = {}
        size = max(bytes_of) + 1
        self._make_trie(id_of)
        self._make_pair_tables(size)
        self.shorter: list[int | None] = [None] * size
        for b, i in id_of.items():
            self.shorter[i] = next((x for n in range(len(b) - 1, 0, -1) if (x := id_of.get(b[:n])) is not None), None)
        self.next_shorter = np.array([-1 if x is None else x for x in self.shorter], np.int32)
        lengths = np.array([len(bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.length = lengths.tolist()
        self.starts, self.lengths = np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths
        self.store = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.pieces = regex.compile(PIECES)
        of_kind = lambda kind: "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind)
        # The same pattern for texts of Latin-1 letters, for which the plain engine is several times as fast; its own \s has U+001C to U+001F too.
        latin = PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^{LATIN_SPACE}{of_kind('L')}{of_kind('N')}]").replace(r"\p{L}", f"[{of_kind('L')}]").replace(r"\p{N}", f"[{of_kind('N')}]")
        self.latin_pieces = re.compile(latin.replace(r"\S", f"[^{LATIN_SPACE}]").replace(r"\s", f"[{LATIN_SPACE}]"))
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.decimals = [str(i) for i in range(size)]
        self.kept: dict[str, bytes] = {}

    def _make_trie(self, id_of: dict[bytes, int]) -> None:
        """The trie's rows of children, laid over each other: node n has a child for byte c if owner[base[n] + c] is n, and the child is base[n] + c."""
        child: dict[int, int] = {}  # by n << 8 | c
        token = [-1]
        for b, i in id_of.items():
            n = 0
            for c in b:
                n = child.setdefault(n << 8 | c, len(token))
                if n == len(token):
                    token.append(-1)
            token[n] = i
        for key, n in child.items():  # parents come before their children
            if token[n] < 0:
                token[n] = token[key >> 8]
        keys = np.sort(np.fromiter(child.keys(), np.int64, len(child)))
        parents, first_of = np.unique(keys >> 8, return_index=True)
        rows = np.split((keys & 255).astype(np.uint8), first_of[1:])
        used, base_of = bytearray(8 * len(token) + 512), np.zeros(len(token), np.int32)
        used[:256] = b"\1" * 256  # so that no base is below 0
        free = hole = 256
        for k in sorted(range(len(rows)), key=lambda k: -len(rows[k])):
            first, *rest = rows[k].tolist()
            if rest:
                at = used.index(0, free)
                while any([used[at - first + c] for c in rest]):
                    at = used.index(0, at + 1)
                free = at  # the holes before it are left to the rows of one child
            else:
                at = hole = used.index(0, hole)
            base_of[parents[k]] = at - first
            for c in (first, *rest):
                used[at - first + c] = 1
        above, below = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        slot = np.zeros(len(token), np.int32)
        slot[below] = base_of[above >> 8] + (above & 255)
        size = int(slot.max()) + 257
        self.base, self.owner, self.longest_token = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[slot], self.longest_token[slot], self.owner[slot[below]] = base_of, token, slot[above >> 8]

    def longest_tokens(self, data: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest token that starts at each byte and ends at that byte's ``stop`` or before it; all bytes walk down the trie side by side."""
        deepest, on, node, step = np.zeros(len(data), np.int32), np.arange(len(data)), np.zeros(len(data), np.int32), 0
        while len(on):
            below = self.base[node] + data[on + step]
            found = self.owner[below] == node
            on, node, step = on[found], below[found], step + 1
            deepest[on] = node
            inside = on + step < stop[on]
            on, node = on[inside], node[inside]
        return self.longest_token[deepest]

    def _make_pair_tables(self, size: int) -> None:
        """Of each token, its outermost parts at its end (side 0) and at its start (side 1), itself first, each with the time at which it is merged away."""
        made = np.full((3, size), -1, np.int32)
        if self.parts:
            made[:, list(self.parts)] = np.array(list(self.parts.values())).T
        self.outer: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for inner in (2, 1):
            of = part = np.arange(size, dtype=np.int32)
            until, levels = np.full(size, self.never, np.int32), []
            while len(of):
                levels.append((of, part, until))
                is_made = made[0, part] >= 0
                of, until, part = of[is_made], made[0, part[is_made]], made[inner, part[is_made]]
            of, part, until = map(np.concatenate, zip(*levels))
            order, counts = np.argsort(of, kind="stable"), np.bincount(of, minlength=size)
            self.outer.append((part[order], until[order], np.cumsum(counts) - counts, counts))
        keys = np.fromiter(self.merged_at.keys(), np.int64, self.never)
        order = np.argsort(keys)
        self.merge_keys, self.merge_times = keys[order], np.fromiter(self.merged_at.values(), np.int32, self.never)[order]
        self.may_merge = np.zeros(1 << PAIR_SLOTS_LOG2, bool)
        self.may_merge[_pair_slot(keys)] = True

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of each pair: every part at a's end against every part at b's start."""
        (ends, ends_until, ends_at, ends_n), (heads, heads_until, heads_at, heads_n) = self.outer
        across = heads_n[b]
        n = ends_n[a] * across
        pair = np.repeat(np.arange(len(a)), n)
        i, j = np.divmod(np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n), across[pair])
        i += ends_at[a][pair]
        j += heads_at[b][pair]
        key = ends[i].astype(np.int64) << 20 | heads[j]
        maybe = np.flatnonzero(self.may_merge[_pair_slot(key)])
        key, i, j, pair = key[maybe], i[maybe], j[maybe], pair[maybe]
        at = np.minimum(np.searchsorted(self.merge_keys, key), self.never - 1)
        time = self.merge_times[at]
        merged = (self.merge_keys[at] == key) & (time < ends_until[i]) & (time <= heads_until[j])
        out = np.ones(len(a), bool)
        out[pair[merged]] = False
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` apart: nothing at a's end is merged with anything at b's start while both exist.

        At equal times the merge further left comes first.
        """
        key = a << 20 | b
        known = self.compatible_pairs.get(key)
        if known is None:
            known = self._apart(a, b)
            if len(self.compatible_pairs) > KEPT_PAIRS:
                self.compatible_pairs.clear()
            self.compatible_pairs[key] = known
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Goes through the outermost parts at a's end and at b's start, each with the time at which it is merged away."""
        merged_at, parts = self.merged_at, self.parts
        heads, until = [(b, self.never)], self.never
        while (made := parts.get(b)) is not None:
            until, b = made[0], made[1]
            heads.append((b, until))
        until = self.never
        while True:
            row = a << 20
            for y, y_until in heads:
                at = merged_at.get(row | y)
                if at is not None and at < until and at <= y_until:
                    return False
            made = parts.get(a)
            if made is None:
                return True
            until, _, a = made

    def encode_piece(self, piece: bytes) -> list[int]:
        size = len(piece)
        longest = self.longest_tokens(np.frombuffer(piece, np.uint8), np.full(size, size)).tolist()
        taken: list[int] = []
        dead: set[int] = set()
        pos, token, length, shorter, pairs, last = 0, longest[0], self.length, self.shorter, self.compatible_pairs, None
        while True:
            if token is None:  # no token leads on from here
                dead.add(pos)
                token = taken.pop()
                pos -= length[token]
                last = taken[-1] if taken else None
                token = shorter[token]
                continue
            after = pos + length[token]
            if after not in dead:
                fits = True if last is None else pairs.get(last << 20 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    taken.append(token)
                    if after == size:
                        return taken
                    pos, last, token = after, token, longest[after]
                    continue
            token = shorter[token]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as bytes. ``encode_piece`` of all side by side, a round for each step of its loop."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        longest = self.longest_tokens(data, np.repeat(ends, sizes))
        taken, before, dead = np.full(len(data), -1, np.int32), np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, bool)
        start, end = ends - sizes, ends
        pos, token, last = start.copy(), longest[start], np.full(len(pieces), -1, np.int32)
        while len(pos):
            after = np.where(token < 0, pos, pos + self.lengths[token])
            fits = (token >= 0) & ~dead[after]
            asked = np.flatnonzero(fits & (last >= 0))
            fits[asked] = self.all_compatible(last[asked], token[asked])
            stuck = np.flatnonzero(token < 0)  # no token leads on from here
            took, rest = np.flatnonzero(fits), np.flatnonzero(~fits & (token >= 0))
            taken[pos[took]] = token[took]
            before[after[took]] = pos[took]
            token[rest] = self.next_shorter[token[rest]]
            if len(stuck):
                dead[pos[stuck]] = True
                back = before[pos[stuck]]
                token[stuck] = self.next_shorter[taken[back]]
                taken[back] = -1
                pos[stuck] = back
                last[stuck] = np.where(back > start[stuck], taken[before[back]], -1)
            last[took] = token[took]
            pos[took] = after[took]
            going = pos < end
            pos, token, last, start, end = pos[going], token[going], last[going], start[going], end[going]
            onward = np.flatnonzero(fits[going])
            token[onward] = longest[pos[onward]]
        at = np.flatnonzero(taken >= 0)
        ids, cuts = taken[at].tobytes(), [0, *(4 * np.searchsorted(at, ends)).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _looked_up(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodings of these pieces and of others. They are kept for the next pieces unless they have become too many; a long one isn't."""
        found = self.kept
        new = list(pieces.difference(found))
        short = [p for p in new if len(p) < LONG]
        found |= zip(short, self.encode_pieces([p.encode() for p in short]))
        found |= {p: array("i", self.encode_piece(p.encode())).tobytes() for p in new if len(p) >= LONG}
        if len(found) > KEPT_PIECES:
            self.kept = {}
        elif long := [p for p in new if len(p) > KEPT_LENGTH]:
            self.kept = found.copy()
            for p in long:
                del self.kept[p]
        return found

    def blocks(self, text: str) -> Iterator[list[str] | int]:
        """Pieces of the text in lists of bounded size; a special token alone, as its id."""
        for k, part in enumerate(self.special_cut.split(text) if self.special_cut else [text]):
            if k % 2:
                yield self.special[part]
                continue
            pieces = self.latin_pieces if _is_latin(part) else self.pieces
            if len(part) <= BLOCK:
                yield pieces.findall(part)
            else:
                held: list[str] = []
                for m in pieces.finditer(part):
                    held.append(m.group())
                    if len(held) >= BLOCK // 4:
                        yield held
                        held = []
                yield held

    def encode_texts(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids of its next block), one or more of each text in order. Pieces of short texts are looked up together."""
        held: list[tuple[int, list[str] | int]] = []
        n = 0
        for k, text in enumerate(texts):
            for block in self.blocks(text):
                held.append((k, block))
                n += 1 if isinstance(block, int) else len(block)
                if n >= TOGETHER:
                    yield from self._encoded(held)
                    held, n = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[tuple[int, list[str] | int]]) -> Iterator[tuple[int, np.ndarray]]:
        found = self._looked_up(set(chain.from_iterable(block for _, block in held if not isinstance(block, int))))
        for k, block in held:
            yield k, np.array([block], np.int32) if isinstance(block, int) else np.frombuffer(b"".join(map(found.__getitem__, block)), np.int32)

    def encode_blocks(self, text: str) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each block, as numbers and as comma-joined decimals."""
        for _, ids in self.encode_texts([text]):
            if len(ids):
                yield ids, self.decimal(ids)

    def decimal(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimals.__getitem__, ids.tolist()))

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([ids for _, ids in self.encode_texts([text])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered by the offset table."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.store[at].tobytes()


def _pair_slot(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_SLOTS_LOG2)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _codec(spec) -> Codec:
    """The worker's codec of a broadcast tokenizer file; it outlives a task."""
    return common.worker_cache(f"bpe {hash(spec.value)}", lambda: Codec(spec.value))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(docs: DataFrame, path: str, rows, schema: str) -> DataFrame:
    """Apply ``rows(codec, values)`` to the second of two columns; the tokenizer file is broadcast, so only the driver reads it."""
    common.bound_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec)
        for batch in batches:
            made = list(rows(codec, (v.as_py() for v in batch.column(1))))
            names = [f.split()[0] for f in schema.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            columns = [pa.array([r[k] for r in made], kinds[f.split()[1]]) for k, f in enumerate(schema.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.mapInArrow(run, schema)


def _blocks_by_text(codec: Codec, texts: Iterable[str | None]) -> Iterator[Iterator[np.ndarray]]:
    for _, blocks in groupby(codec.encode_texts(t or "" for t in texts), itemgetter(0)):
        yield (ids for _, ids in blocks)


def _encoded(codec: Codec, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray]]:
    return ((np.concatenate(list(blocks)),) for blocks in _blocks_by_text(codec, texts))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _mapped(texts, path, _encoded, "doc_id long, ids array<int>")


def _decoded(codec: Codec, rows: Iterable[list[int] | None]) -> Iterator[tuple[str]]:
    return ((codec.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace"),) for ids in rows)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row of ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    return _mapped(encoded.select(F.col("doc_id").cast("long"), F.col("ids")), path, _decoded, "doc_id long, text string")


def _digests(codec: Codec, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
    for blocks in _blocks_by_text(codec, texts):
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in blocks:
            if len(ids):
                ids_hash.update((codec.decimal(ids) if n == 0 else "," + codec.decimal(ids)).encode())
                text_hash.update(codec.decode(ids))
                n += len(ids)
        yield n, ids_hash.hexdigest(), text_hash.hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids_sha256 (of comma-joined ids), decoded_sha256."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _mapped(texts, path, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
