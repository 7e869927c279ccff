"""The corpus pipeline against a version of plain loops."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .test_near_copies import brute_set
from .test_operators import words


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    speak = {"aa": "abcdefg", "bb": "opqrstu"}
    texts = [(words(rng, rng.randint(30, 120), speak[lang]), lang) for lang in rng.choices(list(speak), k=120)]
    items = [(k, words(rng, 25, "abcdefg")) for k in range(4)]
    texts += [(None, "aa"), ("123 ...", "aa"), (texts[0][0], "aa"), (texts[1][0].replace(" ", "\n", 2), "aa")]
    texts += [(words(rng, 20, "abcdefg") + " " + t + " " + words(rng, 9, "abcdefg"), "aa") for _, t in items]
    w = (words(rng, 600, "abcdefg")).split()
    texts += [(" ".join(w), "aa"), (" ".join([*w[:300], "abc", *w[301:]]), "aa")]
    texts += [("\u00bd \u00b2 12 \u2160", "aa")]  # numbers, but no letter
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(texts)]
    # Rows of one id are judged one by one; those without an id by their copies.
    rows += [(5, words(rng, 80, "opqrstu"), "bb", "s", 0), (5, texts[6][0], "bb", "s", 0), (None, texts[7][0], "aa", "s", 0), (None, words(rng, 90, "abcdefg"), "aa", "s", 0), (None, words(rng, 30, "abcdefg") + " " + items[2][1], "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    left = [(i, t) for i, t, *_ in rows if t and any(unicodedata.category(c)[0] == "L" for c in t)]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    least: dict[str, int] = {}
    for i, t in left:
        least[norm(t)] = min(least.get(norm(t), i), i, key=lambda v: (v is None, v))
    left = [(i, t) for i, t in left if least[norm(t)] == i]
    kept: list[tuple[int, str, set]] = []
    for i, t in left:  # the groups here are pairs, so the first of each stays
        own = brute_set(t)
        if all(100 * len(own & s) < 80 * len(own | s) for *_, s in kept):
            kept.append((i, t, own))
    kept = [(i, t, s) for i, t, s in kept if not any(x in t for _, x in items)]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in kept:
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want and {i for i, *_ in got} >= {5, None}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "bpe"]


def test_batches_for_python_are_bounded_by_bytes(spark):
    """A default batch of these texts would have 24 MB in each task."""
    import pyarrow as pa

    from terrace.llm import bpe, common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mb": [batch.nbytes / (1 << 20)]})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('word', 1024) AS text")
    bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert max(r["mb"] for r in docs.mapInArrow(sizes, "mb double").collect()) <= common.BATCH_BYTES / (1 << 20) + 0.1
    spark.conf.set(name, "1m")
    common.bound_batches(spark)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
