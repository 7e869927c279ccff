"""Registered queries of the training-data operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_chunks, golay, hmm, infilling, jaccard_join, langid, line_bloom, passages, periodic_runs, pii, url_reputation
from .common import table


def op1_term_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op3_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_exact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_chunks.copies(table(spark, sf_dir, "documents")).drop("n_chunks")


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label of its number says toxic or low quality."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_bloom.line_digests(table(spark, sf_dir, "documents"))


def op10_window_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op11_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op12_rotated_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(table(spark, sf_dir, "documents"))


def op13_frequency_split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_term_disclosure": op1_term_disclosure,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_byte_gru": op3_byte_gru,
    "op4_exact_chunks": op4_exact_chunks,
    "op5_paragraph_minhash": op5_paragraph_minhash,
    "op6_backtracking_bpe": op6_backtracking_bpe,
    "op7_host_reputation": op7_host_reputation,
    "op8_golay_simhash": op8_golay_simhash,
    "op9_line_bloom": op9_line_bloom,
    "op10_window_simhash": op10_window_simhash,
    "op11_multi_order_jaccard": op11_multi_order_jaccard,
    "op12_rotated_infilling": op12_rotated_infilling,
    "op13_frequency_split_runs": op13_frequency_split_runs,
}

SQL: dict[str, str] = {
    "op4_exact_chunks": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)""",
    "op7_host_reputation": r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
k AS (SELECT doc_id, max((toxic = 1 OR quality = 0)::INT) AS bad FROM labels WHERE (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(k.bad), 0)::DOUBLE AS bad, count(k.bad)::DOUBLE AS n FROM p LEFT JOIN k ON page_id = k.doc_id GROUP BY host),
h1 AS (SELECT *, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS l FROM h0),
h2 AS (SELECT *, CASE WHEN regexp_full_match(array_to_string(l[-2:], '.'), '(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org)[.][a-z][a-z]') THEN 2 ELSE 1 END AS w, regexp_full_match(array_to_string(l, '.'), '[0-9.]+') AS number FROM h1),
h AS (SELECT host, bad, n, CASE WHEN number THEN array_to_string(l, '.') ELSE array_to_string(l[-(w + 1):], '.') END AS domain,
             CASE WHEN number THEN '' ELSE array_to_string(l[-w:], '.') END AS suffix FROM h2),
d0 AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d0 GROUP BY suffix),
s1 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM d0) AS prior FROM s0),
s2 AS (SELECT least(greatest(coalesce((sum(n * power(bad / n - prior, 2)) / sum(n) - sum(prior * (1 - prior)) / sum(n)) / nullif(sum(n * prior * (1 - prior)) / sum(n), 0), 0.001), 0.001), 0.5) AS rho FROM s1 WHERE n > 0),
s AS (SELECT suffix, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean FROM s1, s2),
d1 AS (SELECT d0.*, mean AS prior FROM d0 JOIN s USING (suffix)),
d2 AS (SELECT least(greatest(coalesce((sum(n * power(bad / n - prior, 2)) / sum(n) - sum(prior * (1 - prior)) / sum(n)) / nullif(sum(n * prior * (1 - prior)) / sum(n), 0), 0.001), 0.001), 0.5) AS rho FROM d1 WHERE n > 0),
d AS (SELECT domain, (bad + (1 - rho) / rho * prior) / (n + (1 - rho) / rho) AS mean FROM d1, d2),
g1 AS (SELECT h.*, mean AS prior FROM h JOIN d USING (domain)),
g2 AS (SELECT least(greatest(coalesce((sum(n * power(bad / n - prior, 2)) / sum(n) - sum(prior * (1 - prior)) / sum(n)) / nullif(sum(n * prior * (1 - prior)) / sum(n), 0), 0.001), 0.001), 0.5) AS rho FROM g1 WHERE n > 0),
g3 AS (SELECT host, bad + (1 - rho) / rho * prior AS a, n - bad + (1 - rho) / rho * (1 - prior) AS b FROM g1, g2),
g AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / (power(a + b, 2) * (a + b + 1))) AS bound FROM g3),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(verdict, rule_host, rule_path)),
f AS (SELECT DISTINCT ON (host, path) host, path, rule_host || rule_path AS rule, verdict
      FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
      ORDER BY host, path, length(rule_host || rule_path) DESC)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN bound > 0.4 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN g ON p.host = g.host LEFT JOIN f ON p.host = f.host AND p.path = f.path""",
    "op9_line_bloom": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first IS NOT NULL AND doc_id <> first) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id""",
    "op10_window_simhash": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
it AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM it),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, ks),
ds AS (SELECT doc_id, len(w) AS size, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM dp),
ip AS (SELECT item_id, w, n, k, unnest(range(1, n - k + 2)) AS p FROM it),
sh AS (SELECT item_id, n, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM ip),
ht AS (SELECT DISTINCT ds.doc_id, size, item_id, n, ds.k, ds.p, ds.s FROM ds JOIN sh ON ds.k = sh.k AND ds.s = sh.s),
st AS (SELECT DISTINCT doc_id, item_id, size, n, k, unnest(range(p - (n - k), p + 1)) AS start FROM ht),
wc AS (SELECT st.doc_id, st.item_id, st.size, st.n, st.k, st.start, ht.s, count(*) AS c FROM st JOIN ht ON st.doc_id = ht.doc_id AND st.item_id = ht.item_id AND ht.p BETWEEN st.start AND st.start + st.n - st.k GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM sh GROUP BY ALL),
sd AS (SELECT doc_id, wc.item_id, start, n - k + 1 + least(start + n - k, size - k + 1) - greatest(start, 1) + 1 AS total, sum(least(wc.c, ic.c)) AS shared
       FROM wc JOIN ic ON wc.item_id = ic.item_id AND wc.s = ic.s GROUP BY doc_id, wc.item_id, start, n, k, size),
sim AS (SELECT doc_id, item_id, start - 1 AS start, shared / (total - shared)::DOUBLE AS similarity FROM sd)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, CAST(greatest(arg_max(start, (similarity, -start)), 0) AS BIGINT) AS start_word
FROM sim WHERE similarity >= 0.8e0 GROUP BY doc_id, item_id""",
    "op12_rotated_infilling": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS c1, ('0x' || d[9:16])::BIGINT % (n + 1) AS c2, ('0x' || d[17:24])::BIGINT % 100 AS h3, ('0x' || d[25:32])::BIGINT % 100 AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
             least(c1, c2) AS x, greatest(c1, c2) AS y FROM h),
p AS (SELECT *, substring(text, 1, x) AS a, substring(text, x + 1, y - x) AS b, substring(text, y + 1) AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || c || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
}
