"""The pipeline's near-dedup against exact 5-word Jaccard similarity of all pairs."""

import itertools
import random

import pyarrow as pa

from terrace.llm import near_copies, passages

from .test_operators import brute_fingerprint, words


def brute_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "One  two", "one two three", "é b"]
    for k in range(40):
        base = words(rng, rng.randint(60, 400)).split()
        texts.append(" ".join(base))
        for share in (0.006, 0.012, 0.018, 0.022, 0.03):  # of the words changed, apart: similarity from 0.94 to under 0.8
            w = list(base)
            for i in range(3, len(w), max(1, round(1 / share))):
                w[i] = "changed" + str(k)
            texts.append(" ".join(w))
    shared = words(rng, 100)
    texts += [shared + " " + words(rng, 8) for _ in range(30)]  # a large group
    chain = words(rng, 100).split()
    texts += [" ".join(chain[a : a + 60]) for a in range(0, 40, 5)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(None, texts[20], "x"), (None, words(rng, 50), "x"), rows[9]]
    sets, parent = [brute_set(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in pairs:
        parent[find(i)] = find(j)
    assert any((brute_fingerprint(rows[i][1]) ^ brute_fingerprint(rows[j][1])).bit_count() > 4 for i, j in pairs)
    least: dict[int, int] = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    want = sorted((d is None, d or 0) for i, (d, *_) in enumerate(rows) if (d is None and find(i) not in least) or (d is not None and d == least[find(i)]))
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)
    got = near_copies.dedup(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == want
    assert near_copies.dedup(df.limit(0)).count() == 0


def test_fingerprints_bring_copies_together(spark, monkeypatch):
    """Close copies are found by their fingerprints alone, when the bands give no candidates; others that fingerprints tie are left alone."""

    def none(batches):
        for _ in batches:
            pass
        yield from ()

    monkeypatch.setattr(near_copies, "_likely", none)
    rng = random.Random(4)
    base = words(rng, 1500).split()
    close = next(w for i in range(100, 1400) if (brute_fingerprint(" ".join(w := [*base[:i], "changed", *base[i + 1 :]])) ^ brute_fingerprint(" ".join(base))).bit_count() <= 4)
    loop = words(rng, 13).split()
    other = loop * 200 + words(rng, 60).split()  # dominated by the loop's shingles, so that its fingerprint is the loop's, but of another set
    rows = [(1, " ".join(base)), (2, " ".join(close)), (3, " ".join(loop * 200)), (4, " ".join(other)), (5, words(rng, 200))]
    assert (brute_fingerprint(rows[2][1]) ^ brute_fingerprint(rows[3][1])).bit_count() <= 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(r["doc_id"] for r in near_copies.dedup(df).collect()) == [1, 3, 4, 5]


def test_shared_rows_in_any_batches():
    rng = random.Random(2)
    rows = sorted((rng.randint(0, 30), rng.randint(0, 6)) for _ in range(120)) + [(50, 1), (50, 1), (51, 1), (51, 2)]
    kinds: dict[int, list[int]] = {}
    for key, kind in rows:
        if kind not in kinds.setdefault(key, []):
            kinds[key].append(kind)
    want = [(key, kind, n) for key, k in kinds.items() if len(k) > 1 for n, kind in enumerate(k)]
    for size in (1, 2, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[at : at + size]], pa.int64()) for c in (0, 1)], ["key", "kind"]) for at in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in passages._shared(iter(batches)) for r in b.to_pylist()]
        assert got == want
