"""URL filtering by rules and by empirical-Bayes host reputation. DataFrame operations only.

Labelled pages give each host a count of pages and of bad ones. A host's bad rate has a beta prior with the
mean of its registered domain, a domain's has that of its suffix, a suffix's has that of all pages; how strongly a level
is shrunk follows from how much its members differ beyond chance (method of moments). A host is
blocked if the lower bound of its posterior, mean less Z standard deviations, is over BLOCK_RATE. Rules come first.

Cases: a null url and one without :// have an empty host and path, and the empty host is a host like any other; a
page without a label counts in no rate and gets its host's verdict; a page with several
labels is bad if one says so; null labels are none; repeated pages each get a row; other columns are never
read; without pages there are no rows, without labels all hosts are at the mean of nothing, one half.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path); the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Names are registered under these labels of a country's two letters (co.uk, com.br); other suffixes are the last label.
SECOND_LABELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
Z, BLOCK_RATE = 1.645, 0.4
LEAST_RHO, MOST_RHO = 0.001, 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    pattern, text = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(text, pattern, 2)


def _ruled(host: Column, path: Column, rules: tuple, value: int) -> Column:
    """The rule's text (value 0) or verdict (1), null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2])) for r in ordered]
    return F.coalesce(*[F.when(fit, F.lit((r[1] + r[2], r[0])[value])) for fit, r in zip(fits, ordered)])


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; a number address is its own domain."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.rlike(rf"^(?:{'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$")
    number = name.rlike(r"^[0-9.]+$")
    domain = F.when(number, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(number, F.lit("")).when(long, two).otherwise(F.substring_index(name, ".", -1))


def _shrunk(members: DataFrame) -> DataFrame:
    """members (bad, n, prior and more) with strength: how many pages the prior is worth, alike for all members.

    rho is the share of variance between members; its estimate is bounded on both sides.
    """
    rate = F.col("bad") / F.nullif(F.col("n"), F.lit(0))
    spread = F.col("prior") * (1 - F.col("prior"))
    seen = members.where("n > 0").agg(
        (F.sum(F.col("n") * F.pow(rate - F.col("prior"), 2)) / F.sum("n")).alias("between"), (F.sum(spread) / F.sum("n")).alias("chance"), (F.sum(F.col("n") * spread) / F.sum("n")).alias("whole")
    )
    rho = F.least(F.greatest(F.coalesce((F.col("between") - F.col("chance")) / F.nullif(F.col("whole"), F.lit(0.0)), F.lit(LEAST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    return members.crossJoin(F.broadcast(seen.select(((1 - rho) / rho).alias("strength"))))  # one row


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, bad, mean, bound) of each host of ``pages``; outcomes has page_id, bad (boolean)."""
    named = pages.select("page_id", parts(F.col("url"))[0].alias("host"))
    known = outcomes.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("labelled")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = named.join(known, F.col("page_id") == F.col("labelled"), "left")
    domain, suffix = domain_of(F.col("host"))
    hosts = common.materialize(labelled.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    n = hosts.count()
    domains = common.materialize(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "domains", n)
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    whole = domains.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("prior"))
    mean = (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    of_suffix = common.materialize(_shrunk(suffixes.crossJoin(F.broadcast(whole))).select(F.col("suffix").alias("s2"), mean.alias("prior")), "suffix-means", n)
    of_domain = common.materialize(_shrunk(domains.join(of_suffix, F.col("suffix") == F.col("s2"))).select(F.col("domain").alias("d2"), mean.alias("prior")), "domain-means", n)
    judged = _shrunk(hosts.join(of_domain, F.col("domain") == F.col("d2")))
    a = F.col("bad") + F.col("strength") * F.col("prior")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    deviation = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return judged.select("host", "domain", "suffix", "n", "bad", (a / (a + b)).alias("mean"), (a / (a + b) - Z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict."""
    known = common.materialize(reputations(pages, outcomes).select(F.col("host").alias("known_host"), "bound"), "host-bounds")
    host, path = parts(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    by_method = F.when(F.col("bound") > BLOCK_RATE, "block").otherwise("allow")
    return named.join(known, F.col("host") == F.col("known_host"), "left").select(
        "page_id", "host", "path", _ruled(F.col("host"), F.col("path"), rules, 0).alias("rule"), F.coalesce(_ruled(F.col("host"), F.col("path"), rules, 1), by_method).alias("verdict")
    )


def keep_allowed(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` whose verdict is allow, with all columns; pages without an id stay."""
    name = f"blocked_{uuid.uuid4().hex}"
    blocked = judge(pages, outcomes, rules).where("verdict = 'block' AND page_id IS NOT NULL").select(F.col("page_id").alias(name)).distinct()
    return pages.join(blocked, F.col("page_id") == F.col(name), "left_anti")
