"""Information-theoretic sanitisation of personal data. DataFrame operations only.

Base spans come from patterns (email, ip, card, phone). Their values are the protected entities. A
term, any whole word of a document that holds an entity, however far from it, reveals of it what the corpus shows: with
n(e) documents that hold the entity, n(t) that hold the term and n(e, t) that hold both, of N, the pointwise mutual information
log2(n(e, t) * N / (n(e) * n(t))) as a share of the entity's information log2(N / n(e)).
From GENERALISE on a term is generalised, wherever it stands in documents that hold the entity: to the first letters that it has in common with
so many words that together they reveal less than GENERALISE, among all documents and among those that hold any entity, since a mark in its place tells that
a document does. If no such class of words does, and from REMOVE on, it is removed. Every term of every document with an entity is judged, so a word that stands in such a document alone tells all of the entity. Entities that the same
documents hold have the same shares, and are judged once. ``disclosures`` by itself judges less, for a look at an entity's surroundings: the words
within REACH characters in SUPPORT differing contexts; no query uses it.

Cases: a null text counts as empty; an empty text has no spans; the term spans of a text never overlap its base spans;
rows that repeat a doc_id and text count as documents and each get a row; rows are told apart by doc_id and text, so
that repeated ids do no harm; a null doc_id counts as one document per text; other columns are never read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that failing starts cost one step: possessive, and started only where a match can start.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # The longest chains of digits that have 12 to 19 of them; shorter and longer ones would be dropped anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
REACH, SUPPORT, GENERALISE, REMOVE = 80, 2, 0.6, 0.9
#: Numbers of first letters that a class of words may share.
CLASSES = (4, 3, 2, 1)
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: Spans that are held in one list.
BLOCK = 1000
#: Parts that a text's telling terms are dealt to, so that looking one up doesn't go through all of them.
PARTS = 64
_SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(match, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n_digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    if kind == "ip":
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(match)
    return n_digits.between(9, 15) if kind == "phone" else F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["value"])


def _placed(text: Column, pattern: Column, kind: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the pattern's matches, or of those that are wanted: the pieces between matches tell where each starts.

    Each list is made once and gone through once; spans are put away in blocks, so that a text with very many matches takes linear time.
    """
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    steps = F.filter(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"))), lambda s: s["m"].isNotNull())
    none, no_blocks = F.array().cast(_SPAN), F.array().cast(f"array<{_SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("now"), no_blocks.alias("done"))

    def add(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + F.length(s["m"])
        longer = F.concat(acc["now"], F.array(F.struct(begin.alias("start"), end.alias("end"), kind.alias("kind"), s["m"].alias("value"))))
        full = F.size(acc["now"]) >= BLOCK
        taken = F.struct(end.alias("at"), F.when(full, F.slice(longer, F.lit(BLOCK + 1), F.lit(1))).otherwise(longer).alias("now"), F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"))
        passed = F.struct(end.alias("at"), acc["now"].alias("now"), acc["done"].alias("done"))
        return F.when(wanted(s["m"]), taken).otherwise(passed) if wanted else taken

    return F.aggregate(steps, start, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))


def base_spans(text: str = "text") -> Column:
    """All kinds' spans that pass their checks, in the order of kinds."""
    found = []
    for kind in KINDS:
        spans = F.filter(_placed(F.col(text), F.lit(PATTERNS[kind]), F.lit(kind)), _check(kind))
        if NEEDED[kind]:
            spans = F.when(F.contains(F.col(text), F.lit(NEEDED[kind])), spans).otherwise(F.array().cast(_SPAN))
        found.append(spans)
    return F.concat(*found)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), kind).cast("int")


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("row_hash", F.xxhash64("text"))


def protected(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, copies, spans, near): the documents with base spans; near has each entity with the whole words around it, copies is how many rows are the same."""
    spans = _texts(docs).withColumn("spans", base_spans()).where(F.size("spans") > 0)
    size = F.length("text")

    def around(s: Column) -> Column:
        # One more character on each side tells whether the outermost word is cut; such a word is left out.
        before = F.substring(F.col("text"), F.greatest(s["start"] - REACH - 1, F.lit(0)) + 1, F.least(s["start"], F.lit(REACH + 1)))
        after = F.substring(F.col("text"), s["end"] + 1, F.lit(REACH + 1))
        whole_before = F.when(s["start"] > REACH, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
        whole_after = F.when(size - s["end"] > REACH, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
        return F.concat_ws(" ", whole_before, whole_after)

    near = F.transform("spans", lambda s: F.struct(_entity(s).alias("entity"), around(s).alias("around")))
    rows = spans.select("doc_id", "row_hash", "spans", near.alias("near"))
    return rows.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("copies"), F.any_value("spans").alias("spans"), F.any_value("near").alias("near"))


def _terms(text: Column) -> Column:
    """Distinct lower-cased words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 1))


def _classes(term: Column) -> list[Column]:
    """What a term may be generalised to: its first letters, for all words that start with them."""
    return [F.when(F.length(term) > n, F.concat(F.substring(term, 1, n), F.lit("*"))) for n in CLASSES]


def _classes_of(terms: Column) -> Column:
    """The distinct classes of terms."""
    return F.array_compact(F.array_distinct(F.flatten(F.transform(terms, lambda t: F.array(*_classes(t))))))


def _terms_and_classes(text: Column) -> Column:
    terms = _terms(text)
    return F.concat(terms, _classes_of(terms))


def _same(d: str, h: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("row_hash") == F.col(h))


#: Which rows of ``_held_terms`` are words, and which are classes of words.
IS_WORD, IS_CLASS = "NOT endswith(held, '*')", "endswith(held, '*')"


def _entities(found: DataFrame) -> DataFrame:
    """(doc_id, row_hash, copies, entity): which documents hold which entities."""
    return found.select("doc_id", "row_hash", "copies", F.explode("near").alias("n")).select("doc_id", "row_hash", "copies", F.col("n.entity").alias("entity")).distinct()


def _one_of_alike(entities: DataFrame, n: int) -> DataFrame:
    """``entities`` with only the least of those that the same documents hold: all counts of the others are the same."""
    held = common.materialize(entities, "held-entities", n)
    mark = lambda salt: F.bit_xor(F.xxhash64("doc_id", "row_hash", F.lit(salt)))
    holders = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("a"), mark(2).alias("b"))
    kept = common.materialize(holders.groupBy("n", "a", "b").agg(F.min("entity").alias("least")).select("least"), "alike-entities", n)
    return held.join(kept, F.col("entity") == F.col("least"), "left_semi")


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, share, kept) of the terms within REACH characters of an entity in SUPPORT differing contexts; see ``_disclosed``."""
    held = found.select(F.explode("near").alias("n")).select("n.entity", "n.around")
    n = found.agg(F.coalesce(F.sum(F.size("near")), F.lit(0))).first()[0]
    pairs = held.select("entity", F.xxhash64("around").alias("context"), F.explode(_terms(F.col("around"))).alias("term"))
    # Contexts are made distinct before they are counted, so that a common entity is summed up in its tasks.
    judged = pairs.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= SUPPORT).select("entity", "term")
    judged = common.materialize(judged, "judged-terms", n * (2 * REACH // 3 + 2))  # words of two letters or more and what parts them
    return _disclosed(docs, found, _held_terms(docs, found), common.materialize(_entities(found), "entity-documents", n), judged)


def _held_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, row_hash, weight, held): terms and classes of the documents that hold entities."""
    found = found.select(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), "copies")
    with_entity = common.with_suspicion(_texts(docs), "row_hash", common.written_bitmap(found, "h2"), "suspect").where("suspect").join(found, _same("d2", "h2"))
    rows = with_entity.dropDuplicates(["doc_id", "row_hash"]).select("doc_id", "row_hash", F.col("copies").alias("weight"), F.explode(_terms_and_classes(F.col("text"))).alias("held"))
    return common.materialize(rows, "entity-terms")


def _with_entities(holds: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, row_hash, copies, entity, term): each term of ``holds`` with each entity of its document."""
    wanted = entities.select(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), "copies", "entity")
    return holds.join(wanted, _same("d2", "h2")).select("doc_id", "row_hash", "copies", "entity", F.col("held").alias("term"))


def _disclosed(docs: DataFrame, found: DataFrame, holds: DataFrame, entities: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """(entity, term, share, kept): how much of each entity's information each judged term reveals, where that is GENERALISE or more.

    Judged are the given (entity, term), or all terms of the documents that hold the entity. kept is how many letters of the term may stay:
    those of its largest class that reveals less than GENERALISE both among all documents and among those with any entity, or 0. Where all of them
    hold the entity, nothing is left to reveal. All counts are of documents that hold the entity, the term, or both, wherever they stand.
    """
    texts = _texts(docs)
    of_entity = entities.groupBy(F.col("entity").alias("e3")).agg(F.sum("copies").alias("n_entity"))
    n_all, n_held = texts.count(), int(found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])

    def counted(held: Column, asked: DataFrame, name: str) -> DataFrame:
        """(word, n_term): how many of all documents have each of the asked terms or classes, given those of a text."""
        words = texts.select(F.explode(held).alias("word"))
        suspects = common.with_suspicion(words, "word", common.written_bitmap(common.materialize(asked, f"asked-{name}"), asked.columns[0]), "suspect").where("suspect")
        return common.materialize(suspects.groupBy("word").agg(F.count(F.lit(1)).alias("n_term")), f"{name}-counts")

    def told(holds: DataFrame, asked: DataFrame | None, counts: DataFrame) -> DataFrame:
        """(entity, term, both, n_entity) and counts of the asked pairs, or of all terms with all entities of their documents, given (word, counts)."""
        # By document first: the pairs of a common entity's documents with all its terms would be many times the text.
        rows = _with_entities(holds, entities)
        joined = rows if asked is None else rows.join(asked.select(F.col("entity").alias("e2"), F.col("term").alias("t2")), (F.col("entity") == F.col("e2")) & (F.col("term") == F.col("t2")), "left_semi")
        both = joined.groupBy("entity", "term").agg(F.sum("copies").alias("both"))
        return both.join(of_entity, F.col("entity") == F.col("e3")).join(counts, F.col("term") == F.col("word"))

    def share(n_term: str, total: int) -> Column:
        return F.log2(F.col("both") * F.lit(float(total)) / (F.col("n_entity") * F.col(n_term))) / F.nullif(F.log2(F.lit(float(total)) / F.col("n_entity")), F.lit(0.0))

    asked_terms = judged.select("term").distinct() if judged is not None else holds.where(IS_WORD).select(F.col("held").alias("term")).distinct()
    of_term = counted(_terms(F.col("text")), asked_terms, "terms")
    telling = told(holds.where(IS_WORD), judged, of_term).select("entity", "term", share("n_term", n_all).alias("share"))
    telling = common.materialize(telling.where(F.col("share") >= GENERALISE), "telling")
    # A term that is removed at any rate has no need of classes.
    open_to = F.when(F.col("share") < REMOVE, F.array_compact(F.array(F.lit(""), *_classes(F.col("term"))))).otherwise(F.array(F.lit("")))
    classes = telling.select("entity", "term", "share", F.explode(open_to).alias("class"))
    asked = classes.where("class <> ''").select("entity", F.col("class").alias("term")).distinct()
    in_all = counted(_classes_of(_terms(F.col("text"))), asked.select("term").distinct(), "classes")
    of_asked = holds.where(IS_CLASS).join(asked.select(F.col("term").alias("asked")).distinct(), F.col("held") == F.col("asked"), "left_semi")
    in_held = of_asked.groupBy(F.col("held").alias("class")).agg(F.sum("weight").alias("n_class"))
    counts = in_all.join(in_held, F.col("word") == F.col("class")).drop("class")
    worse = F.greatest(share("n_term", n_all), share("n_class", n_held))  # of a null and a share, the share
    of_class = common.materialize(told(of_asked, asked, counts).select(F.col("entity").alias("e4"), F.col("term").alias("t4"), worse.alias("class_share")), "class-shares")
    graded = classes.join(of_class, (F.col("entity") == F.col("e4")) & (F.col("class") == F.col("t4")), "left")
    mild = (F.col("class") != "") & (F.col("class_share") < GENERALISE) & (F.col("share") < REMOVE)
    return graded.groupBy("entity", "term", "share").agg(F.max(F.when(mild, F.length("class") - 1).otherwise(F.lit(0))).alias("kept"))


def spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_hash, base, extra (spans of terms; value is the replacement)."""
    found = common.materialize(protected(docs), "protected")
    n = found.count()
    n_entities = found.agg(F.coalesce(F.sum(F.size("near")), F.lit(0))).first()[0]
    held = common.materialize(_one_of_alike(_entities(found), n_entities), "entity-documents", n_entities)
    holds = _held_terms(docs, found)
    telling = common.materialize(_disclosed(docs, found, holds, held), "disclosures").select(F.col("entity").alias("e2"), F.col("term").alias("t2"), "kept")
    of_doc = _with_entities(holds.where(IS_WORD), held).join(telling, (F.col("entity") == F.col("e2")) & (F.col("term") == F.col("t2"))).groupBy("doc_id", "row_hash", "term").agg(F.min("kept").alias("kept"))
    extra = common.materialize(_term_spans(docs, found, common.materialize(of_doc, "telling-terms")), "term-spans", n, 512)
    marked = found.select(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), F.col("spans").alias("base"))
    marked = marked.join(extra.select(F.col("doc_id").alias("d3"), F.col("row_hash").alias("h3"), "extra"), F.col("d2").eqNullSafe(F.col("d3")) & (F.col("h2") == F.col("h3")), "left").drop("d3", "h3")
    none = F.array().cast(_SPAN)
    rows = _texts(docs).select("doc_id", "row_hash")
    joined = rows.join(common.materialize(marked, "all-spans", n, 512), _same("d2", "h2"), "left")
    return joined.select("doc_id", "row_hash", F.coalesce("base", none).alias("base"), F.coalesce("extra", none).alias("extra"))


def _term_spans(docs: DataFrame, found: DataFrame, of_doc: DataFrame) -> DataFrame:
    """(doc_id, row_hash, extra): where the telling terms stand; only the documents that have any are moved."""
    bits = common.written_bitmap(of_doc.select("row_hash").distinct(), "row_hash")
    texts = common.with_suspicion(_texts(docs), "row_hash", bits, "suspect").where("suspect").drop("suspect").dropDuplicates(["doc_id", "row_hash"])
    part = lambda word: F.pmod(F.crc32(word), F.lit(PARTS))
    dealt = of_doc.groupBy("doc_id", "row_hash", part(F.col("term")).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("term", "kept"))).alias("terms"))
    asked = dealt.groupBy(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2")).agg(F.map_from_entries(F.collect_list(F.struct("part", "terms"))).alias("kept"))
    kept = lambda word: F.try_element_at(F.try_element_at(F.col("kept"), part(word)), word)
    base = found.select(F.col("doc_id").alias("d4"), F.col("row_hash").alias("h4"), "spans")
    joined = texts.join(asked, _same("d2", "h2")).join(base, _same("d4", "h4"))
    told = joined.withColumn("extra", _placed(F.col("text"), F.lit(r"\p{L}+"), F.lit("term"), lambda m: kept(F.lower(m)).isNotNull()))
    clear = F.filter("extra", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))

    def said(t: Column) -> Column:
        n = kept(F.lower(t["value"]))
        word = F.when(n > 0, F.concat(F.substring(t["value"], F.lit(1), n), F.lit("*"))).otherwise(F.lit(""))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["kind"].alias("kind"), word.alias("value"))

    return told.select("doc_id", "row_hash", F.transform(clear, said).alias("extra")).where(F.size("extra") > 0)


def sanitise(docs: DataFrame) -> DataFrame:
    """(doc_id, text): base spans as a general word of their kind, telling terms generalised or removed. Of overlapping spans the first is replaced."""
    told = spans(docs).where((F.size("base") > 0) | (F.size("extra") > 0)).dropDuplicates(["doc_id", "row_hash"]).select(F.col("doc_id").alias("d2"), F.col("row_hash").alias("h2"), "base", "extra")
    texts = _texts(docs).join(told, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("row_hash") == F.col("h2")), "left")
    words = F.create_map(*[x for k, v in GENERAL.items() for x in (F.lit(k), F.lit(v))])
    general = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), words[s["kind"]].alias("word")))
    extra = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("word")))
    ordered = F.array_sort(F.concat(general, extra))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, s["word"])).alias("out")))

    made = F.aggregate(ordered, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return texts.select("doc_id", F.when(F.col("base").isNull(), F.col("text")).otherwise(made).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row."""
    kinds = F.transform("base", lambda s: s["kind"])
    counted = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return spans(docs).select("doc_id", *counted, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"))
