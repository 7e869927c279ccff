"""Jaccard join, fill-in-the-middle and periodic runs against brute force, and on awkward rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from terrace.llm import infilling, jaccard_join, periodic_runs, registry

from .test_near_copies import brute_set
from .test_operators import EXTRA, bag, words


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute_join(rows):
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if linked(sets[i], sets[j]):
            parent[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def join_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one two", "One  two", "one two three", "é b", "É b", "a b c d e", "a b c d e f", "a b c d e f g h i", "a b c d e f g h", "x " * 300, "x " * 500]
    for k in range(25):
        base = words(rng, rng.randint(30, 300)).split()
        texts.append(" ".join(base))
        for share in (0.006, 0.012, 0.018, 0.022, 0.03):
            w = list(base)
            for i in range(3, len(w), max(1, round(1 / share))):
                w[i] = "changed" + str(k)
            texts.append(" ".join(w))
    shared = words(rng, 60)
    texts += [shared + " " + words(rng, rng.randint(4, 40)) for _ in range(60)]  # a passage that many hold
    base = words(rng, 120).split()
    for k in range(60):  # a large group, whose members are tied by their common source more than by each other
        w = list(base)
        for i in rng.sample(range(120), rng.randint(0, 3)):
            w[i] = f"own{k}"
        texts.append(" ".join(w))
    chain = words(rng, 100).split()
    texts += [" ".join(chain[a : a + 60]) for a in range(0, 40, 3)]
    half = [words(rng, 50) for _ in range(5)]
    texts += [a + " " + b for a, b in itertools.permutations(half, 2)]  # all shingles shared, none similar
    return texts


@pytest.mark.parametrize("seed, block, heavy, pack, shard", [(1, 256, 16, 1 << 20, 1 << 21), (2, 8, 3, 500, 2000), (3, 4, 2, 3000, 1 << 21)])
def test_jaccard_join(spark, monkeypatch, seed, block, heavy, pack, shard):
    for name, value in (("BLOCK", block), ("HEAVY", heavy), ("PACK", pack), ("SHARD", shard)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = join_texts(seed)
    rows = list(enumerate(texts)) + [(None, texts[20]), (None, words(random.Random(9), 50)), (9, texts[9]), (9, texts[30]), (None, None)]
    extra = tuple([None] * len(EXTRA.split(", ")))
    df = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(3)
    assert bag(jaccard_join.jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_join(rows)
    if seed == 1:
        assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_prefixes_of_similar_sets_meet_under_every_order():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 60)
        a = rng.sample(range(500), n)
        b = list({*a[rng.randint(0, n // 8) :], *rng.sample(range(500), rng.randint(0, 6))})
        if not linked(set(a), set(b)):
            continue
        held = np.array([rng.choice((2, 2, 3, 9, 255)) for _ in range(500)])
        both = []
        for s in (a, b):
            s = np.array(s, np.uint64)
            both.append(jaccard_join.orders_of(s, held[s.astype(int)], len(s) - jaccard_join.need_of(len(s)) + 1))
        assert all(set(x.tolist()) & set(y.tolist()) for x, y in zip(*both))


def test_cells_skip_ties_and_unasked_pairs():
    s = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 1, 2, 40)]
    every = [np.tile(x.astype(np.uint32), jaccard_join.ORDERS) for x in s]
    links = jaccard_join.cell_links(s, every, np.arange(4), np.ones(4, bool))
    assert sorted(links) == [(0, 1), (0, 2)]
    assert jaccard_join.cell_links(s, every, np.array([7, 7, 7, 8]), np.ones(4, bool)) == []
    assert jaccard_join.cell_links(s, every, np.arange(4), np.array([False, False, False, True])) == []
    none = [np.full(20 * jaccard_join.ORDERS, k, np.uint32) for k in range(4)]  # no prefix in common: not compared
    assert jaccard_join.cell_links(s, none, np.arange(4), np.ones(4, bool)) == []


def brute_infill(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:x], text[x:y], text[y:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, x, y - x, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", text


def test_infilling(spark, monkeypatch):
    monkeypatch.setattr(infilling, "SWAP", 5)
    rng = random.Random(2)
    texts = [None, "", "a", "é日本🎉", "x<P>y", "<S>", "<M", "a\nb\r\n\0c", "<", "P>", "🎉" * 50] + ["".join(rng.choice("ab <PSM>é日🎉\n") for _ in range(rng.randint(0, 90))) for _ in range(300)] + ["long é" * 40_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "a row of a repeated id"), (3, texts[3]), (-5, "below zero")]
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], "doc_id long, text string, output string, form string, n long").repartition(3)
    want = [brute_infill(*r) for r in rows]
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    assert bag(infilling.transform(df), *names, "output", "restored") == Counter(want)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert bag(infilling.digests(df), *names, "output_sha256", "restored_sha256") == Counter((*w[:5], sha(w[5]), sha(w[6])) for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert infilling.digests(df.limit(0)).count() == 0


def test_rotation_exchanges_blocks():
    for a, b, c, swap in itertools.product((0, 1, 7), (0, 2, 9), (0, 1, 30), (1, 4, 1 << 16)):
        text = bytearray(b"head" + b"a" * a + bytes(range(b)) + bytes(range(100, 100 + c)) + b"tail")
        want = text[: 4 + a] + text[4 + a + b : 4 + a + b + c] + text[4 + a : 4 + a + b] + b"tail"
        view_before = infilling.SWAP
        infilling.SWAP = swap
        infilling.rotate(text, 4 + a, 4 + a + b, 4 + a + b + c)
        infilling.SWAP = view_before
        assert text == want


def brute_runs(w):
    """By the definition: every maximal stretch of each period, whose smallest period it is."""
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(24, 3 * q) and not any(all(w[k] == w[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_periods(doc_id, text):
    w = (text or "").translate({c: None for c in ()}).encode().split()
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def periodic_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a", "a " * 23, "a " * 24, "a " * 500, "a b " * 12, "a b " * 11 + "a b c", "é 日 " * 30, "a b " * 24, ("x y z " * 7 + "x ") + "w " + "x y z " * 9]
    for _ in range(120):
        made = []
        for _ in range(rng.randint(1, 6)):
            block = [rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 7, 8, 9, 12, 16, 17, 20)))]
            inner = block + block[: rng.randint(0, len(block))] if rng.random() < 0.4 else block
            made += (inner * 9)[: rng.randint(1, 3) * len(inner) + rng.randint(0, 2 * len(inner))] if rng.random() < 0.8 else [f"u{rng.randint(0, 99)}" for _ in range(20)]
        texts.append(rng.choice((" ", "\n", " \t ")).join(made))
    texts += [" ".join(rng.choice("ab") for _ in range(200)) for _ in range(30)]
    texts += [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 400))) for _ in range(120)]  # for the ids whose words are made periodic
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_periodic_runs(spark, seed):
    texts = periodic_texts(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[40]), (4, texts[40]), (-1, texts[41])]
    want = [brute_periods(*r) for r in rows]
    assert sum(w[1] for w in want) > 40
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and want[i][1] for i in range(len(texts)))
    df = spark.createDataFrame([(*r, None, "x", None) for r in rows], "doc_id long, text string, runs string, w string, n long").repartition(3)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = periodic_runs.digests(df)
    assert tuple(got.columns) == names
    assert bag(got, *names) == Counter(want)
    assert periodic_runs.digests(df.limit(0)).count() == 0


def test_runs_of_many_texts_at_once():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = rng.integers(0, 120, rng.integers(1, 12))
        w = []
        for c in counts:
            unit = rng.integers(0, 5, max(1, rng.integers(1, 30)))
            t = np.tile(unit, 1 + int(c) // len(unit))[: int(c)]
            t[rng.random(len(t)) < 0.03] = 9
            w.append(t.astype(np.uint64))
        got = periodic_runs.runs_of(np.concatenate(w), counts)
        assert got == [brute_runs(t.tolist()) for t in w]


def test_registered(spark, tmp_path):
    """The queries read the whole documents table."""
    spark.createDataFrame([(i, t) for i, t in enumerate(periodic_texts(5))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op11_multi_order_jaccard", "op12_rotated_infilling", "op13_frequency_split_runs"):
        assert registry.QUERIES[name](spark, str(tmp_path)).count() == len(periodic_texts(5))
