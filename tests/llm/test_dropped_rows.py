"""Stages that drop rows judge each row by itself: rows of one id, and rows without an id."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.llm import common, decontaminate, exact_chunks, langid, near_copies, passages, url_reputation

from .test_operators import words

SCHEMA = "doc_id long, text string, gone string, held long"


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(2)


def test_exact_copies(spark):
    df = frame(spark, [(1, "a b"), (2, "a  b"), (2, "a text that is nobody else's"), (None, "a b"), (None, "alone"), (3, "a text of 3"), (3, "a text of 3")])
    got = exact_chunks.dedup(df)
    assert got.columns == df.columns
    assert texts(got) == sorted([(1, "a b"), (2, "a text that is nobody else's"), (None, "alone"), (3, "a text of 3"), (3, "a text of 3")], key=str)


def test_near_copies(spark):
    rng = random.Random(4)
    base, other, third = (words(rng, 80) for _ in range(3))
    near = base + " more"
    df = frame(spark, [(1, base), (2, near), (2, other), (None, near + " yet"), (None, third), (None, third + " once")])
    assert texts(near_copies.dedup(df)) == sorted([(1, base), (2, other), (None, third), (None, third + " once")], key=str)


def test_leaks(spark):
    rng = random.Random(5)
    item, clean, lone = (words(rng, n) for n in (25, 60, 60))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    df = frame(spark, [(1, clean + " " + item), (1, clean), (None, item), (None, lone)])
    assert texts(decontaminate.decontaminate(df, bench)) == sorted([(1, clean), (None, lone)], key=str)
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == 4


def test_languages(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, 40, "abcdef" if k % 2 else "uvwxyz"), "aa" if k % 2 else "bb") for k in range(80)]
    odd = [(3, "\u00bd \u00b2 12 \u2160", "aa"), (None, "12 34", "aa"), (None, rows[1][1], "aa"), (4, None, "bb"), (5, "", "bb")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(2)
    got = langid.keep_identified(df)
    assert got.columns == df.columns and texts(got) == sorted([r[:2] for r in rows] + [(None, rows[1][1])], key=str)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df.where("text IS NULL OR NOT text RLIKE '[a-z]'")).collect()}
    assert set(found.values()) == {"und"}


@pytest.mark.parametrize("text, letter", [("\u00bd \u00b2 12", False), ("\u2160\u2161", False), ("12_", False), ("\u00aa", True), ("a", True), ("1 \u65e5", True), ("\u02b0", True), ("", False)])
def test_letters(text, letter):
    assert langid.has_letter(text) == letter


def test_passages_of_rows_of_one_id(spark):
    rng = random.Random(7)
    passage, own, third = words(rng, 60), words(rng, 60), words(rng, 30)
    df = frame(spark, [(1, passage), (2, passage + "\n" + third), (2, own), (None, passage)])
    assert texts(passages.dedup_passages(df)) == sorted([(1, passage), (2, third), (2, own), (None, passage)], key=str)
    hot = frame(spark, [(k, passage) for k in range(300)])
    assert passages.repeated_passages(hot).where("removed").count() == 299


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", True), (None, "x", False)], "page_id long, url string, blocked boolean")
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    assert url_reputation.keep_allowed(pages, outcomes).columns == pages.columns


def test_without_rows_by_another_mark(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (None, "a"), (2, None)])
    gone = spark.createDataFrame([(1, "a"), (None, "a")], "doc_id int, mark string")
    assert texts(common.without_rows(df, gone, F.col("text"))) == sorted([(1, "b"), (2, None)], key=str)
