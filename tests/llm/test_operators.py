"""The training-data operators against brute force, and on awkward rows: nulls, empty and long texts, repeats, ties, clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer
from tokenizers.trainers import BpeTrainer

from terrace.llm import bpe, decontaminate, exact_chunks, golay, hmm, langid, line_bloom, passages, pii, url_reputation
from terrace.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = "kept boolean, fp long, h long, pos int, key string, spans string, word string, n long, recipe string, base string, symbols string, at int, suspect boolean, bm_word long, bm_bits long, __bit long, __suspect boolean, labels string, gone long"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): awkward rows among copies and near copies."""
    rng = random.Random(1)
    long_text = words(rng, 30_000)
    base = [words(rng, rng.randint(20, 200)) for _ in range(30)]
    texts = [None, "", "   \n\t ", "\n\n", "12 34 !!", "é日本🎉", "x" * 50_000, long_text, "a\u00a0b c", "a b  c", "a b\nc", *base, base[0], base[0] + " ", base[1].replace(" ", "\n", 3), None]
    for k in range(6):
        w = base[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    made = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(texts)]
    return [*made, made[12], made[12], (None, base[3], "en", "s"), (None, None, "en", "s")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = tuple([None] * len(EXTRA.split(", ")))
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def bag(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def by_min(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_empty_pipeline_and_clashing_columns(spark, tmp_path, docs, empty):
    import corpus_pipeline

    for name, df in (("none", empty), ("some", docs)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/some").count() > 20


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5), (None, 3)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if None not in (a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for link in links if None not in link and link[0] != link[1] for x in link}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact(docs, rows, empty):
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t, *_ in rows:
        ids = groups[norm(t)]
        want[i, by_min(ids), len(ids), i == by_min(ids), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert bag(exact_chunks.copies(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_chunks.dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {by_min(v) for v in groups.values() if by_min(v) is not None}
    assert exact_chunks.copies(empty).count() == 0


def test_exact_tells_colliding_chunks_apart(spark):
    hashed = spark.createDataFrame([(1, "s1", [7, 8]), (2, "s2", [7, 8]), (3, "s1", [7, 8]), (None, "s2", [7, 8])], "doc_id long, text_sha256 string, hashes array<long>")
    collided = spark.createDataFrame([(1, "s1", 0, "x", 7), (2, "s2", 0, "y", 7), (3, "s1", 0, "x", 7), (None, "s2", 0, "y", 7)], "doc_id long, text_sha256 string, pos int, chunk string, h long")
    got = {r["doc_id"]: str(r["recipe"]) for r in exact_chunks.numbered(hashed, collided).collect()}
    assert got[1] == got[3] != got[2] == got[None]


def test_chunks_of_any_script_meet_again_after_an_insertion(spark):
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz ", "абвгдежзийклмнопрстуфхцчшщ ", "".join(map(chr, range(0x4E00, 0x5200)))):
        text = "".join(rng.choice(letters) for _ in range(40_000))
        df = spark.createDataFrame([(0, text), (1, text[:500] + rng.choice(letters) + text[500:])], "doc_id long, text string")
        chunks = {r["doc_id"]: r["chunks"] for r in exact_chunks._chunked(df).collect()}
        assert "".join(chunks[0]).encode("latin-1").decode() == re.sub(" +", " ", text)
        assert len(chunks[0]) > 15 and len(set(chunks[0]) & set(chunks[1])) > 0.7 * len(chunks[0])


def test_bpe(spark, docs, rows, empty):
    lib = Tokenizer.from_file(BPE)
    texts = {i: t or "" for i, t, *_ in rows}
    got = bpe.round_trip(docs, BPE).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, BPE), BPE)
    assert {r["doc_id"]: r["text"] for r in back.collect() if r["doc_id"] is not None} == {i: t for i, t in texts.items() if i is not None}
    assert bpe.round_trip(empty, BPE).count() == 0


def test_bpe_codec_on_odd_strings():
    codec, lib, rng = bpe.Codec(bpe.read_spec(BPE)), Tokenizer.from_file(BPE), random.Random(2)
    odd = ["<|endoftext|>a<|endoftext|>", "'s'll 'S", "\x1c\x85 \u00a0\u200b\ufeff", "½²٣ ª", "".join(map(chr, range(1, 0x300)))]
    for text in odd + ["".join(rng.choice("abthe in's .,0é日🎉\n\t<|>") for _ in range(rng.randint(1, 80))) for _ in range(1500)]:
        ids = codec.encode(text)
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids).decode() == text


def test_bpe_codec_with_a_small_memory(monkeypatch):
    """Generations of kept pieces and the table of pairs are replaced many times; a piece is kept as its ids' bytes alone."""
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    codec, lib, rng = bpe.Codec(bpe.read_spec(BPE)), Tokenizer.from_file(BPE), random.Random(6)
    for _ in range(300):
        text = words(rng, rng.randint(1, 30)) + rng.choice(("", " naïve 日本 " * 3, " the the of"))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids and ",".join(d for _, d in codec.encode_blocks(text)) == ",".join(map(str, ids))
        assert len(codec.kept) <= 3 and all(isinstance(v, bytes) for v in codec.kept.values())


def test_bpe_codec_takes_pieces_of_many_texts_together(monkeypatch):
    codec, lib, rng = bpe.Codec(bpe.read_spec(BPE)), Tokenizer.from_file(BPE), random.Random(7)
    monkeypatch.setattr(bpe, "TOGETHER", 500)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 400)
    groups, look_up = [], codec._looked_up
    monkeypatch.setattr(codec, "_looked_up", lambda pieces: groups.append(pieces) or look_up(pieces))
    long = "".join(rng.choice("abcdefgh") for _ in range(3 * bpe.LONG))
    texts = [rng.choice(("", "<|endoftext|>", long, " " * 700, long[:40] + "é日", "x<|endoftext|>")) + words(rng, rng.randint(0, 20)) for _ in range(200)]
    got = {}
    for k, ids in codec.encode_texts(texts):
        got.setdefault(k, []).extend(ids.tolist())
    assert list(got.items()) == list(enumerate(lib.encode(t, add_special_tokens=False).ids for t in texts))
    assert 2 < len(groups) < 20 and max(map(len, codec.kept), default=0) <= bpe.KEPT_LENGTH and len(codec.kept) <= 400


def test_bpe_side_by_side_steps_back_as_alone():
    """Small vocabularies learned from random words, where the longest token often leads nowhere."""
    rng, steps_back = random.Random(8), 0
    for _ in range(20):
        lib = Tokenizer.from_str(json.dumps(json.loads(bpe.read_spec(BPE)) | {"added_tokens": []}))
        some = ["".join(rng.choice("aabc") for _ in range(rng.randint(2, 9))) for _ in range(60)]
        lib.train_from_iterator(some, BpeTrainer(vocab_size=256 + 60, initial_alphabet=list(bpe.byte_letters()), show_progress=False))
        codec = bpe.Codec(lib.to_str())
        pieces = ["".join(rng.choice("aabc") for _ in range(rng.randint(1, 40))) for _ in range(200)]
        want = [lib.encode(p, add_special_tokens=False).ids for p in pieces]
        assert [codec.encode_piece(p.encode()) for p in pieces] == want
        assert [np.frombuffer(ids, np.int32).tolist() for ids in codec.encode_pieces([p.encode() for p in pieces])] == want
        sizes = np.array([*map(len, pieces)])
        longest = codec.longest_tokens(np.frombuffer("".join(pieces).encode(), np.uint8), np.repeat(np.cumsum(sizes), sizes))
        steps_back += sum(int(longest[at]) != ids[0] for at, ids in zip(np.cumsum(sizes) - sizes, want))
    assert steps_back > 100


def test_bpe_codec_beside_white_space():
    codec, lib = bpe.Codec(bpe.read_spec(BPE)), Tokenizer.from_file(BPE)
    for c in map(chr, range(256)):
        for text in (f"a\n\n{c}b", f"a {c}b", f"a{c}{c} b", f"{c} {c}", f" {c}{c}\n", f"1{c}\x85\xa0{c}2", f".{c}\t{c}."):
            assert codec.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_golay_keys_meet():
    code = golay.code()
    vectors = np.arange(2048, dtype=np.int64)  # a vector of each remainder: the code is linear, so these are all cases
    keys = [set(k) for k in code.keys(vectors).tolist()]
    assert len({int(r) for r in code.rest_low[vectors]}) == 2048
    for n in (1, 2):
        for bits in itertools.combinations(range(23), n):
            other = code.keys(vectors ^ sum(1 << b for b in bits))
            assert all(keys[i] & set(o) for i, o in enumerate(other.tolist()))


def test_golay_finds_all_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = np.unique(np.concatenate([base, *(base ^ np.int64(sum(1 << int(b) for b in rng.choice(63, k, replace=False))) for k in (1, 2, 3, 4, 4, 5) for _ in range(3))]))
    row, key = golay.pair_keys(fps)
    order = np.argsort(key, kind="stable")
    found = golay.links_in_runs(key[order], fps[row[order]])
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= golay.RADIUS
    want = golay.forest(np.stack([fps[x] for x in np.nonzero(np.triu(near, 1))], axis=1))
    star = lambda links: {tuple(x) for x in golay.forest(links).tolist()}
    assert star(found) == star(want)


def test_golay_large_runs(monkeypatch):
    monkeypatch.setattr(golay, "BLOCK", 8)
    monkeypatch.setattr(golay, "ROWS", 16)
    key = np.repeat([1, 2, 3], [5, 40, 6])
    fp = np.arange(51, dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 7]), pa.array(fp[a : a + 7])], ["key", "fp"]) for a in range(0, 51, 7)]
    out = [r for b in golay._compared(iter(batches)) for r in b.to_pylist()]
    assert [(r["a"], r["b"]) for r in out if r["large"]] == [(2, 40)]
    assert {x for r in out if not r["large"] for x in (r["a"], r["b"])} == {*range(5), *range(45, 51)}
    whole = [r for b in golay._compared_all(iter(batches)) for r in b.to_pylist()]
    assert {x for r in whole for x in (r["a"], r["b"])} == set(range(51))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_near_duplicates(docs, rows, empty):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    want = Counter((rows[i][0], fps[i] - (1 << 64) * (fps[i] >> 63), by_min(members[find(i)])) for i in range(len(rows)))
    assert bag(golay.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert golay.near_duplicates(empty).count() == 0


def test_lines(spark, docs, rows, empty):
    rng = random.Random(8)
    shared = ["  A shared line of text\t", "another line, twice here"]
    more = [(1000 + i, "\n".join([words(rng, 5), shared[i % 2].upper() if i % 3 else shared[i % 2], "short", shared[i % 2], words(rng, 4)])) for i in range(12)]
    table = [(i, t) for i, t, *_ in rows] + more + [(1003, "other text of a repeated id\n" + shared[0])]
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\v\f\r").translate(lower)
    last = (1 << 63) - 1
    holders = defaultdict(set)
    for i, t in table:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if i is None else i)
    want = Counter()
    for i, t in table:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (last if i is None else i)]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert bag(line_bloom.line_digests(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert bag(line_bloom.dedup_lines(df), "doc_id", "n_lines", "n_dropped") == Counter((a, b, c) for (a, b, c, _), n in want.items() for _ in range(n))
    assert line_bloom.line_digests(docs).count() == len(rows) and line_bloom.line_digests(empty).count() == 0


def test_leaks(spark, docs, rows, empty):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randint(12, 40))) for i in range(12)] + [(50, None), (51, ""), (52, "one two three")]
    items.append((60, items[0][1].upper()))
    texts = []
    for i in range(40):
        w = items[i % 12][1].split()
        if i % 4 == 1:
            w[0] = "changed"
        if i % 4 == 2:
            w[len(w) // 2] = "changed"
        if i % 4 == 3:
            w.insert(2, "added")
        texts.append((2000 + i, words(rng, 30) + "  " + "\n".join(w) + " " + words(rng, 10)))
    for i in range(12):
        w = items[i][1].split()
        texts.append((2100 + i, " ".join(w[:-1])))  # shorter than the item
        texts.append((2200 + i, words(rng, 9) + " " + " ".join(w[: len(w) - 2])))  # cut by the document's end
        texts.append((2300 + i, " ".join(w[1:]) + " " + words(rng, 9)))
    long = words(rng, 100).split()
    items.append((70, " ".join(long)))
    texts += [(2400, words(rng, 5) + " " + " ".join(long[50:] + long[:50]) + " " + words(rng, 5)), (2401, " ".join(long[30:] + long[:30]))]  # halves swapped
    items.append((71, "a b c d e " * 8))
    texts += [(2402, "x " + "a b c d e " * 30), (2403, "a b c d e " * 5 + "f g h"), (2404, "a b c d e " * 7)]
    texts += [(3000, "xx One two THREE yy"), (3001, items[0][1]), (3001, items[0][1]), (None, items[2][1]), (3002, "the " * 500)]
    cut = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
    shingles = lambda w, k: [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    of = {i: cut(t) for i, t in items if cut(t)}
    want = {}
    for i, t in texts + [(i, t) for i, t, *_ in rows]:
        w = cut(t)
        for item, v in of.items():
            k = min(5, len(v))
            have, ask = shingles(w, k), shingles(v, k)
            for start in range(1 - len(ask), len(have)) if set(have) & set(ask) else ():
                window = have[max(start, 0) : start + len(ask)]
                shared = sum((Counter(window) & Counter(ask)).values())
                similarity = shared / (len(window) + len(ask) - shared)
                if similarity >= 0.8:
                    best = want.get((i, item), (0, 0))
                    want[i, item] = max(best, (similarity, -max(start, 0)))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, start int")
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start_word"]) for r in decontaminate.leaks(all_docs, benchmark).collect()}
    assert {(2400, 70), (2401, 70), (2402, 71), (2404, 71), (2100, 0)} <= want.keys()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert decontaminate.leaks(empty, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_without_ids(spark):
    rng = random.Random(4)
    item, other = words(rng, 30), words(rng, 30)
    df = spark.createDataFrame([(None, item), (None, item + " x"), (None, item), (1, item), (1, other), (2, None)], "doc_id long, text string")
    got = decontaminate.leaks(df, spark.createDataFrame([(0, item), (1, other)], "item_id long, text string"))
    assert bag(got, "doc_id", "item_id") == Counter({(None, 0): 2, (1, 0): 1, (1, 1): 1})


def test_very_long_item(spark):
    rng = random.Random(14)
    w = words(rng, 70_000).split()
    equal = "one two three four five " * 14_000
    items = spark.createDataFrame([(0, " ".join(w)), (1, equal)], "item_id long, text string")
    df = spark.createDataFrame([(0, " ".join(w[35_000:] + w[:35_000])), (1, "x y z " + equal), (2, " ".join(w[:60_000])), (3, words(rng, 50))], "doc_id long, text string")
    assert bag(decontaminate.leaks(df, items), "doc_id", "item_id") == Counter({(0, 0): 1, (1, 1): 1, (2, 0): 1})


def test_simhash_counts(spark):
    rng = np.random.default_rng(5)
    lists = [rng.integers(-(1 << 63), 1 << 63, n).tolist() for n in (1, 2, 3, 40, 41)] + [[7] * 70_000, [-1] * 3 + [1] * 2]
    got = {r["k"]: r["fp"] for r in decontaminate.simhash(spark.createDataFrame(list(enumerate(lists)), "k int, hashes array<long>"), "k").collect()}
    for k, values in enumerate(lists):
        bits = [sum(v >> j & 1 for v in values) * 2 > len(values) for j in range(64)]
        assert got[k] % (1 << 64) == sum(1 << j for j in range(64) if bits[j])


def brute_spans(text):
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    found = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(patterns) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_personal_data(spark, docs, rows, empty):
    rng = random.Random(2)
    parts = ["1", "2", "9", "0", "a@b", "@", ".", "-", " ", "+", "(", "4111111111111111", "x", "é", "255", ".12", "a.b@c.org"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(40))) for i in range(250)] + [(900, "a@" * 2000 + "b.c"), (901, "1 " * 3000), (902, "m@x.yz " * 2500)]
    got = {r["doc_id"]: r for r in pii.digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        assert got[i]["base_sha256"] == hashlib.sha256(brute_spans(t).encode()).hexdigest()
        assert (got[i]["n_email"] + got[i]["n_ip"] + got[i]["n_card"] + got[i]["n_phone"]) == len([s for s in brute_spans(t).split(",") if s])
    assert pii.digests(docs).count() == len(rows) and pii.digests(empty).count() == 0


def test_telling_terms(spark):
    texts = [(i, words(random.Random(i), 30) + " and on the") for i in range(60)]
    texts += [(100, "mail Alice Wonder today a.w@c.org and the rest"), (101, "so alice wrote from a.w@c.org on the web"), (102, "the end")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "lice" not in clean[100] + clean[101] and "a.w@c.org" not in clean[100] + clean[101] and "the" in clean[100]
    assert clean[102] == "the end" and clean[5] == texts[5][1]
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(df).collect()}
    assert "term:5:10" in spans[100] and spans[102] == ""


def test_shares(spark):
    """Shares against plain counting; only whole words are terms, and counts are of documents."""
    rng = random.Random(8)
    vocabulary = ["anna", "annab", "otto", "the", "and", "maria", "web", "mail"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) + (f" {rng.choice('pq')}@x.org " if i % 3 == 0 else " ") + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    texts += [(300, "zz" + "y" * 77 + " p@x.org " + "q" * 200), (301, None), texts[0]]
    texts += [(400 + i, f"{rng.choice(['secret', 'secrets', 'secular'])} {i} p@x.org and") for i in range(6)] + [(500 + i, f"secure {i} q@x.org") for i in range(3)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["entity"], r["term"]): (r["share"], r["kept"]) for r in pii.disclosures(df, pii.protected(df)).collect()}
    rows = [(k, i, t or "") for k, (i, t) in enumerate(texts)]
    cut = lambda t: {w for w in re.split(r"[^a-z]+", t.lower()) if len(w) > 1}
    holders = defaultdict(set)
    for d in rows:
        for e in re.findall(r"[pq]@x\.org", d[2]):
            holders[f"email:{e}"].add(d)
    any_holder = set().union(*holders.values())

    def share(e, held, n):
        both = len(holders[e] & held)
        return math.log2(both * n / (len(holders[e]) * len(held))) / math.log2(n / len(holders[e])) if both else -math.inf

    want = {}
    for e in holders:
        near = defaultdict(set)
        for d in holders[e]:
            at = d[2].index(e[6:])
            a, b = d[2][:at], d[2][at + 7 :]
            window = (re.sub("^[a-z]+", "", a[-81:]) if len(a) > 80 else a) + " " + (re.sub("[a-z]+$", "", b[:81]) if len(b) > 80 else b)
            for w in cut(window):
                near[w].add(window)
        for w, contexts in near.items():
            of = share(e, {d for d in rows if w in cut(d[2])}, len(rows))
            if len(contexts) >= 2 and of >= pii.GENERALISE:
                kept = [n for n in pii.CLASSES if len(w) > n and of < pii.REMOVE and share(e, {d for d in any_holder if any(len(v) > n and v[:n] == w[:n] for v in cut(d[2]))}, len(any_holder)) < pii.GENERALISE]
                want[e, w] = of, max(kept, default=0)
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_generalisation(spark):
    rows = [(i, f"{'markus' if i < 8 else 'markt'} {i} " + words(random.Random(i), 5, "xyz") + (" m.k@c.org" if i < 5 else f" n{i % 7}@c.org")) for i in range(80)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0].startswith("mark* 0 ") and "[EMAIL]" in clean[0] and clean[20].startswith("markt") and "@" not in clean[20]


def test_urls(spark):
    pages = [(1, "http://a.example.com/en/x?y#z"), (2, "https://www.Example.COM/en/1"), (3, "http://b.net/fr/2"), (4, "http://b.net/de/2"), (5, None), (6, "nothing"), (7, "http://c.org"), (8, "x://evil.org/1"), (8, "x://evil.org/1"), (9, "http://1.2.3.4:80/p"), (None, "http://notexample.com/en/")]
    pages += [(100 + i, f"http://evil.org/{i}") for i in range(60)] + [(200 + i, f"http://good.org/{i}") for i in range(400)]
    outcomes = [(100 + i, i % 10 != 0) for i in range(60)] + [(200 + i, i % 10 == 0) for i in range(400)] + [(100, None), (101, False), (101, True)]
    p = spark.createDataFrame([(*x, "h", 0.5) for x in pages], "page_id long, url string, host string, bound double")
    o = spark.createDataFrame(outcomes, "page_id long, bad boolean")
    got = defaultdict(list)
    for r in url_reputation.judge(p, o).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("a.example.com", "/en/x", "example.com/en/", "block")] and got[2] == [("www.example.com", "/en/1", "www.example.com/en/", "allow")]
    assert got[3] == [("b.net", "/fr/2", "net/fr/", "block")] and got[4][0][2] is None
    assert got[5] == got[6] == [("", "", None, "allow")] and got[7] == [("c.org", "", None, "allow")]
    assert got[8] == [("evil.org", "/1", None, "block")] * 2 and got[210][0][3] == "allow" and got[None][0][2] == "com/"
    assert url_reputation.judge(p.limit(0), o).count() == 0
    assert {r["verdict"] for r in url_reputation.judge(p, o.limit(0)).where("rule IS NULL").collect()} <= {"allow", "block"}


def test_language(spark, empty):
    rng = random.Random(5)
    speak = {"aa": "abcdefg", "bb": "opqrstu", "cc": "éèàüöñç"}
    made = [(i, words(rng, rng.randint(5, 60), speak[lang]), lang) for i, lang in enumerate(rng.choices(list(speak), k=400))]
    made += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (1003, words(rng, 20_000, speak["bb"]), None), (5, made[5][1], None)]
    df = spark.createDataFrame([(*r, "s", 0.0) for r in made], "doc_id long, text string, lang string, source string, score double")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    held = [i for i, _, _ in made[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and not got[1000]["held_out"] == (zlib.crc32(b"1000") % 4 != 2)
    assert sum(got[i]["lang_pred"] == made[i][2] for i in held) / len(held) > 0.95
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1003]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in made} - {1000, 1001, 1002}
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df.limit(5), None).collect()} == {"und"}


def test_gradient():
    """The network's loss falls along its gradient as finite differences say."""
    rng = np.random.default_rng(0)
    inputs, states = rng.normal(0, 0.3, (256, 12)).astype(np.float32), rng.normal(0, 0.3, (4, 12)).astype(np.float32)
    x, weight = rng.integers(0, 9, (6, 3)).astype(np.uint8), rng.normal(size=(6, 4, 3)).astype(np.float32)
    kept: list = []
    langid._run(x, inputs, states, kept)
    d_inputs, d_states = langid._back(x, states, kept, weight)
    for table, grad in ((inputs, d_inputs), (states, d_states)):
        for at in [(int(x[2, 1]) if table is inputs else 2, c) for c in (0, 5, 9)]:
            old = table[at]
            table[at] = old + 1e-2
            up = (langid._run(x, inputs, states) * weight).sum()
            table[at] = old - 1e-2
            down = (langid._run(x, inputs, states) * weight).sum()
            table[at] = old
            assert (up - down) / 2e-2 == pytest.approx(grad[at], abs=2e-2)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    model = hmm.Model.first(rng.dirichlet(np.ones(6)))
    sequences = [np.array(s, np.uint16) for s in ([0], [1, 2, 5], [3, 3, 1, 5], [5])]
    got = hmm.log10_likelihoods(model, sequences)
    for s, value in zip(sequences, got):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(s)):
            p = model.start[path[0]] * model.emits[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.moves[a, b] * model.emits[b, x]
            total += p
        assert value == pytest.approx(math.log10(total))
    start, moves, emits, total = hmm.expected_counts(model, sequences)
    assert total == pytest.approx(got.sum())
    want = [np.zeros_like(x) for x in (start, moves, emits)]
    for s, value in zip(sequences, got):
        for path in itertools.product(range(hmm.STATES), repeat=len(s)):
            p = model.start[path[0]] * model.emits[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= model.moves[a, b] * model.emits[b, x]
            p /= 10**value
            want[0][path[0]] += p
            for a, b in zip(path, path[1:]):
                want[1][a, b] += p
            for a, x in zip(path, s):
                want[2][a, x] += p
    assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip((start, moves, emits), want))
    assert start.sum() == pytest.approx(4) and moves.sum() == pytest.approx(sum(len(s) - 1 for s in sequences)) and emits.sum() == pytest.approx(sum(map(len, sequences)))


def test_counts_of_long_sequences_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    model = hmm.Model.first(rng.dirichlet(np.ones(50)))
    sequences = [rng.integers(0, 50, n).astype(np.uint16) for n in (5000, 4096, 2049, 2048, 2047, 1, 700)]
    monkeypatch.setattr(hmm, "SEGMENT", 1 << 20)
    whole = hmm.expected_counts(model, sequences)
    for segment in (1, 7, 2048):
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        assert all(np.allclose(a, b, rtol=1e-9, atol=0) for a, b in zip(hmm.expected_counts(model, sequences), whole))


def test_scores(spark, docs, rows, empty):
    rng = random.Random(6)
    made = [(i, " ".join(rng.choice(["the", "a", "b", "c"] if k % 2 else ["dog", "cat", "x", "y"]) for k in range(rng.randint(2, 40)))) for i in range(300)]
    made += [(400, None), (401, ""), (403, "the " + "w" * 100_000 + " dog"), (402, "unseen WORDS the"), (None, "the dog"), (5, made[5][1]), (7, "another text of an id")]
    got = hmm.score(spark.createDataFrame([(*r, 1.0, "w") for r in made], "doc_id long, text string, base double, word string")).collect()
    counts, train = Counter(), lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    for i, t in made:
        if train(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, not train(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in made)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # words alternate, which states learn
    assert all(r["score"] < 0 for r in got)
    assert hmm.score(docs).count() == len(rows) and hmm.score(empty).count() == 0


def brute_hmm_scores(made):
    """The model's log10 probability of each text by plain loops: words' shares, sweeps of steps over slices with unscaled forward and backward sums."""
    tokens = [(t or "").encode().lower().split() for _, t in made]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in made]
    counts = Counter(w for ws, t in zip(tokens, train) if t for w in ws)
    ends = sum(train)
    top = sorted((w for w in counts if len(w) <= hmm.LONGEST), key=lambda w: (-counts[w], w))[: hmm.SYMBOLS]
    end, other = len(top), len(top) + 1
    n_other, v_other = sum(c for w, c in counts.items() if w not in top), len(counts) - len(top)
    shares = np.array([*(counts[w] for w in top), ends, n_other], float) + 1
    shares /= shares.sum()
    coded = [[*(top.index(w) if w in top else other for w in ws), end] for ws in tokens]
    slices = []
    for (i, _), s in zip(made, coded):
        seed = 42 if i is None else xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(np.array(s, np.uint16).tobytes(), seed)
        slices.append((h - (1 << 64) if h >> 63 else h) % hmm.SLICES)
    model, K = hmm.Model.first(shares), range(hmm.STATES)

    def sums(s):
        ahead = [[model.start[k] * model.emits[k, s[0]] for k in K]]
        for x in s[1:]:
            ahead.append([sum(ahead[-1][j] * model.moves[j, k] for j in K) * model.emits[k, x] for k in K])
        back = [[1.0 for _ in K]]
        for x in s[:0:-1]:
            back.insert(0, [sum(model.moves[k, j] * model.emits[j, x] * back[0][j] for j in K) for k in K])
        return ahead, back, sum(ahead[-1])

    kept, before = {}, None
    for _ in range(hmm.MOST_SWEEPS):
        for part in range(hmm.SLICES):
            start, moves, emits, likelihood = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, len(shares))), 0.0
            for s, at, t in zip(coded, slices, train):
                if t and at == part:
                    ahead, back, p = sums(s)
                    likelihood += math.log10(p)
                    for k in K:
                        start[k] += ahead[0][k] * back[0][k] / p
                        for n, x in enumerate(s):
                            emits[k, x] += ahead[n][k] * back[n][k] / p
                            if n:
                                for j in K:
                                    moves[j, k] += ahead[n - 1][j] * model.moves[j, k] * model.emits[k, x] * back[n][k] / p
            kept[part] = start, moves, emits, likelihood
            start, moves, emits = (sum(c[j] for c in kept.values()) + hmm.PRIOR * (shares if j == 2 else 1) for j in range(3))
            model = hmm.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
        likelihood = sum(c[3] for c in kept.values())
        if before is not None and likelihood - before <= hmm.LEAST_GAIN * abs(before):
            break
        before = likelihood
    spelt = [sum(math.log10((counts[w] + 1) / (n_other + v_other + 1)) for w in ws if w not in top) for ws in tokens]
    return [math.log10(sums(s)[2]) + e for s, e in zip(coded, spelt)]


def test_scores_are_those_of_plain_loops_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 4)
    monkeypatch.setattr(hmm, "LONGEST", 5)
    rng = random.Random(12)
    made = [(i, " ".join(rng.choice(["The", "a", "b", "longer-word"] if k % 2 else ["dog", "cat", "x", "\u00e9"]) for k in range(rng.randint(0, 12)))) for i in range(40)]
    made += [(50, None), (None, "the dog"), (3, made[3][1]), (7, "unseen longer-word"), (9, "never-in-training dog")]
    want = Counter((i, round(p, 6)) for (i, _), p in zip(made, brute_hmm_scores(made)))
    for order, parts in ((made, 3), (rng.sample(made, len(made)), 5)):
        got = hmm.score(spark.createDataFrame(order, "doc_id long, text string").repartition(parts)).collect()
        assert Counter((r["doc_id"], round(r["score"], 6)) for r in got) == want


def brute_paragraphs(texts):
    """Documents with a line of LEAST words or more that another document has a copy of at 0.8, transitively; (doc_id, first doc_id)."""
    lines, parent = [], {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            w = line.lower().split()
            if len(w) >= 5:
                lines.append((i, len(w), {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        x, y = lines[a][2], lines[b][2]
        if len(x & y) >= 0.8 * len(x | y):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, n, _) in enumerate(lines):
        groups[find(k)].append((i, n))
    return {i for g in groups.values() if len({i for i, _ in g}) > 1 for i, n in g if n >= passages.LEAST}


def test_paragraphs_against_brute_force(spark):
    rng = random.Random(17)
    texts = []
    for i in range(120):
        made = []
        for _ in range(rng.randint(1, 5)):
            w = words(random.Random(rng.randint(0, 60)), 10 + rng.randint(0, 3) * 12).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 3))
            made.append(" ".join(w))
        texts.append((i, "\n".join(made)))
    texts += [(200, None), (201, ""), (202, "a b c d"), (203, words(rng, 16)), (203, words(rng, 20))]
    got = passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    ids = {r["doc_id"] for r in got}
    want = brute_paragraphs(texts)
    assert want <= ids and len(want) > 40
    # Beside near copies of whole paragraphs, only documents that share a run of words are named.
    runs = defaultdict(set)
    for i, t in texts:
        w = (t or "").lower().split()
        for k in range(len(w) - 9):
            runs[tuple(w[k : k + 10])].add(i)
    assert ids - want <= {i for s in runs.values() if len(s) > 1 for i in s}


def test_pieces_do_not_depend_on_their_neighbours():
    rng = random.Random(5)
    texts = [words(rng, n) for n in (3, 4, 5, 12, 13, 30, 400)] + ["", None, "a b\nc d e f g\n", "the " * 200, "x" * 300_000, words(rng, 60_000)]

    def found(column, at):
        out = defaultdict(list)
        for t in passages.texts_of(column):
            first = np.cumsum(t.counts) - t.counts
            for unit in (passages.PIECE, passages.PARAGRAPH):
                u = passages.units_of(t, passages.shingles(t.hashes), unit)
                for row, start, size, kind in zip(u.row, u.start, u.size, u.kind):
                    out[at + row].append((unit, start - first[row - t.row], size, kind))
        return {k: sorted(v) for k, v in out.items()}

    together = found(pa.array(texts, pa.string()), 0)
    alone = {}
    for k, t in enumerate(texts):
        alone |= found(pa.array([t], pa.string()), k)
    assert together == alone == found(pa.array(["skipped", *texts], pa.string())[1:], 0)
    for k, t in enumerate(texts):  # pieces cover the text, each of 5 to 12 words
        pieces = [(a, n) for u, a, n, _ in alone.get(k, []) if u == passages.PIECE]
        n = len((t or "").split())
        assert sum(n for _, n in pieces) == (n if n >= 5 else 0) and all(5 <= n <= 12 for _, n in pieces)


def test_word_hashes_are_of_the_words():
    texts = ["The CAT", "the cat", "x\ty\nz", "é É", "a" * 1000 + " " + "a" * 999]
    of = [h for t in passages.texts_of(pa.array(texts)) for h in t.hashes.tolist()]
    names = [w for t in texts for w in t.encode().lower().split()]
    assert len(of) == len(names) and all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(zip(of, names), 2))


def test_recall_of_inner_passages(spark):
    rng = random.Random(23)
    for size, least in ((40, 0.9), (51, 0.95)):
        texts = []
        for k in range(150):
            passage = words(rng, size)
            texts += [(2 * k + j, words(rng, rng.randint(5, 60)) + " " + passage + " " + words(rng, 20)) for j in (0, 1)]
        found = {r["doc_id"] for r in passages.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert len(found) >= least * len(texts)


def test_similar_sets():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < keep], rng.integers(0, 1 << 60, 5).astype(np.uint64)])) for keep in rng.uniform(0.5, 1, 60)] + [base[:0], base[:0]]
    brute = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]

    def groups(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
        return {frozenset(k for k, r in enumerate(root) if r == x) for x in root}

    assert groups(passages.similar_sets(sets)) == groups(brute) and set(passages.similar_sets(sets)) <= set(brute)


def test_passages(spark, docs, rows, empty):
    rng = random.Random(7)
    texts, planted, clean = [], [], []
    for k in range(20):
        passage = words(rng, 55)
        for _ in range(3):
            planted.append(10_000 + len(texts))
            texts.append((10_000 + len(texts), words(rng, rng.randint(5, 60)) + ("\n" if k % 2 else " ") + passage + " " + words(rng, 20)))
    for _ in range(30):
        clean.append(10_000 + len(texts))
        texts.append((10_000 + len(texts), words(rng, 150) + "\na short line that many share\n" + words(rng, 30)))
    near = words(rng, 90).split()
    for k in range(4):
        texts.append((20_000 + k, words(rng, 10) + "\n" + " ".join(w for i, w in enumerate(near) if i != 20 * k + 1) + "\n" + words(rng, 10)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    ids = {r["doc_id"] for r in got}
    assert len(ids & set(planted)) >= 0.95 * len(planted) and not ids & set(clean) and {20_000 + k for k in range(4)} <= ids
    assert all(r["removed"] == (r["first_doc_id"] < r["doc_id"]) for r in got)
    cut = {r["doc_id"]: r["text"] for r in passages.dedup_passages(df).collect()}
    assert all(cut[i] == t for i, t in texts if i in clean) and sum(len(cut[i]) < len(t) for i, t in texts) >= 36
    assert {r["doc_id"] for r in passages.repeated_passages(docs).collect()} <= {i for i, *_ in rows if i is not None}
    assert passages.repeated_passages(empty).count() == 0


def test_telling_terms_of_whole_documents(spark):
    """Spans against plain counting: all words of a document with an entity, far from it and in one document too."""
    rng = random.Random(5)
    vocabulary = [words(random.Random(k), 1, "abcdefg") + "xyzuvw"[k % 6] * 2 for k in range(60)]
    fill = lambda: " ".join(rng.choice(vocabulary[: rng.choice((10, 60))]) for _ in range(rng.randint(3, 60)))
    texts = [(i, fill() + rng.choice(("", " p@x.org ", " p@x.org, q@x.org ", f" n{i}@x.org ")) + " " + fill()) for i in range(150)]
    texts += [(200, "Farthest " + "the " * 60 + "one@x.org two@x.org"), (201, None), (None, "unnamed p@x.org " + fill()), texts[3], (3, "another q@x.org row")]
    texts += [(300 + i, f"{'markus' if i < 8 else 'markt'} " + "web " * 30 + ("m@x.org" if i < 5 else f"n{i % 7}@x.org")) for i in range(80)]
    cut = lambda t: {w for w in re.split(r"[^a-z]+", t.lower()) if len(w) > 1}
    rows = [(k, t or "") for k, (_, t) in enumerate(texts)]
    holders = defaultdict(set)
    for d in rows:
        for e in re.findall(r"\w+@x\.org", d[1]):
            holders[e].add(d)
    any_holder = set().union(*holders.values())

    def share(e, held, n):
        return math.log2(len(holders[e] & held) * n / (len(holders[e]) * len(held))) / math.log2(n / len(holders[e]))

    want = []
    for d in rows:
        base = [m.span() for m in re.finditer(r"\w+@x\.org", d[1])]
        kept = {}
        for e in holders:
            for w in cut(d[1]) if d in holders[e] else ():
                of = share(e, {r for r in rows if w in cut(r[1])}, len(rows))
                if of >= pii.GENERALISE:
                    stays = [n for n in pii.CLASSES if len(w) > n and of < pii.REMOVE and share(e, {r for r in any_holder if any(len(v) > n and v[:n] == w[:n] for v in cut(r[1]))}, len(any_holder)) < pii.GENERALISE]
                    kept[w] = min(kept.get(w, 99), max(stays, default=0))
        found = [(m.start(), m.end(), w[: kept[w]] + "*" if kept[w] else "") for m in re.finditer("[A-Za-z]+", d[1]) if (w := m.group().lower()) in kept and not any(a < m.end() and m.start() < b for a, b in base)]
        want.append((texts[d[0]][0], found))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], [(s["start"], s["end"], s["value"].lower()) for s in r["extra"]]) for r in pii.spans(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dict(got)[200][0] == (0, 8, "") and dict(got)[300] == [(0, 6, "mark*")]


@pytest.mark.parametrize("several", [True, False])
def test_classes_are_counted_in_all_documents(spark, several):
    """What a class of words reveals, against plain counting in all documents and in those with an entity."""
    rng = random.Random(3)
    vocabulary = [words(rng, 1, "abc")[:5] + rng.choice("abcd") for _ in range(40)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 12))) + (f" e{rng.randint(0, 6)}@x.org" if several and i % 8 == 0 else "")) for i in range(160)]
    if several:  # a class that few documents but those with an entity have: among these alone it tells little
        texts += [(200 + i, f"{'markus' if i < 4 else 'markt'} m{'' if i < 2 else i}@x.org" if i < 8 else "mango") for i in range(38)]
    else:  # the one entity is all that documents with an entity hold: among these alone nothing is left to tell
        texts += [(200 + i, "markus m@x.org" if i < 4 else "markus" if i < 8 else "markt") for i in range(38)]
    texts += [texts[0], (0, None)]
    rows = [(k, t or "") for k, (_, t) in enumerate(texts)]
    cut = {d: {w for w in re.split(r"[^a-z]+", d[1]) if len(w) > 1} for d in rows}
    holders = defaultdict(set)
    for d in rows:
        for e in re.findall(r"\w+@x\.org", d[1]):
            holders[e].add(d)
    any_holder = set().union(*holders.values())

    def share(e, held, among):
        held, n = held & among, len(among)
        return math.log2(len(holders[e] & held) * n / (len(holders[e]) * len(held))) / math.log2(n / len(holders[e])) if n > len(holders[e]) else 0

    want = {}
    for e in holders:
        for w in set().union(*(cut[d] for d in holders[e])):
            of = share(e, {d for d in rows if w in cut[d]}, set(rows))
            if of >= pii.GENERALISE:
                like = {n: {d for d in rows if any(len(v) > n and v[:n] == w[:n] for v in cut[d])} for n in pii.CLASSES if len(w) > n}
                want[f"email:{e}", w] = max((n for n in like if of < pii.REMOVE and max(share(e, like[n], set(rows)), share(e, like[n], any_holder)) < pii.GENERALISE), default=0)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = pii.protected(df)
    got = pii._disclosed(df, found, pii._held_terms(df, found), pii._entities(found))
    assert {(r["entity"], r["term"]): r["kept"] for r in got.collect()} == want
    assert want["email:m@x.org", "markus"] == (2 if several else 4)
