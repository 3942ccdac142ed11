"""Personal data by information-theoretic sanitisation, with Spark expressions only.

Base entities (mail addresses, IP addresses, card and phone numbers) are found by pattern and check in every whole text.
Corpus co-occurrence then tells how strongly other words reveal an entity. With p taken over all distinct texts,

    disclosure(word, entity) = pmi(word, entity) / -log p(entity) = 1 + log p(entity | word) / -log p(entity)

is the part of the entity's information that the word gives away: 1 where the entity is in every text with the word.
Both are counted over whole texts, however far word and entity stand apart; what is only inside an entity is no word of a
text. Entities of any count take part. So that words of its texts don't pass by chance, a word must be with the entity in
two texts, and so often that among all words of the corpus fewer than `CHANCE` would be so by chance (by the Chernoff
bound n * KL(p(entity | word) || p(entity)) of the binomial tail). A word that a mail address spells out before its @ is
one of few, not of all words; for it one text can be enough. No other word of an entity's only text can be told from
chance by counts, and none is touched. A word whose disclosure for some entity exceeds `GENERALISE` is sanitised wherever it
stands: it is generalised to a neutral word, and removed beyond `REMOVE`.

Positions are code points; a pattern's places follow from the lengths of what it splits a text into, so no text is
scanned twice and no Python runs.

Edge cases: null texts count as empty and have no spans; very long runs of digits, letters or separators are matched
without recursion; equal texts have equal spans and count once in the statistics; repeated rows, ties and null ids give
a row each; an empty table gives no rows; extra columns stay as they are in `sanitised`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import blocks, bound, cut, distinct, free_name, part, running, text_key

CHANCE = 0.01
MIN_PART = 3  # characters of a spelt-out word
GENERALISE = 0.9
REMOVE = 0.99
BROADCAST_TERMS = 500_000
MIN_TERM = 2
NOT_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
KINDS = ("email", "ip", "card", "phone")
BASE = "array<struct<kind:string,begin:int,end:int>>"

# The patterns of the base entities. Possessive repeats match the same runs without recursion; the
# look-behinds only skip beginnings inside a run whose first beginning has failed already.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must have for the pattern to find anything valid.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}[0-9]", "phone": r"\+[0-9]"}


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right is doubled, less 9 beyond 9."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(hit)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _walk(text: Column, pattern: Column, kind: str, valid) -> Column:
    """Spans of the valid matches: begin and end add up from the lengths of gaps and matches."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def placed(ps: Column) -> Column:
        chars = lambda p: F.coalesce(F.length(p["hit"]), F.lit(0))
        before = running(F.transform(ps, lambda p: F.length(p["gap"]) + chars(p)), lambda a, b: a + b)

        def span(p: Column, at: Column) -> Column:
            begin = at + F.length(p["gap"])
            good = F.when(p["hit"].isNotNull(), valid(p["hit"])).otherwise(False)
            return F.when(good, F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), (begin + chars(p)).alias("end")))
        return F.filter(F.zip_with(ps, before, span), lambda s: s.isNotNull())

    return bound(pieces, placed)


def base_spans(text: Column) -> Column:
    """Spans of all base entities, by kind and then by begin. text must not be null."""
    found = []
    for kind in KINDS:
        hint = text.contains("@") if kind == "email" else text.rlike(_HINTS[kind])
        spans = _walk(text, F.lit(PATTERNS[kind]), kind, lambda hit, kind=kind: _valid(kind, hit))
        found.append(F.when(hint, spans).otherwise(F.array().cast(BASE)))
    return F.concat(*found)


def term_spans(text: Column, terms: Column) -> Column:
    """Spans of the words `terms` (lower case) in a text, in any case."""
    edge = r"[0-9A-Za-z\x{80}-\x{10ffff}]"
    either = F.array_join(F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(rf"(?iu)(?<!{edge})(?:"), either, F.lit(rf")(?!{edge})"))
    return _walk(text, pattern, "term", lambda hit: F.lit(True))


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), NOT_WORD)), lambda w: F.length(w) >= MIN_TERM)


def _outside(text: Column, spans: Column) -> Column:
    """What a text holds outside of the spans."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))))

    def gaps(os: Column, b: Column) -> Column:
        return F.zip_with(os, _covered(os), lambda s, at: part(b, at, F.greatest(F.lit(0), s["begin"] - at)))

    return bound(ordered, lambda os: bound(blocks(text), lambda b: F.concat_ws(" ", gaps(os, b), _rest(text, os))))


def _covered(ordered: Column) -> Column:
    """For every span of an ordered array where those before it end."""
    return running(F.transform(ordered, lambda s: s["end"]), lambda a, b: F.greatest(a, b))


def _rest(text: Column, spans: Column) -> Column:
    """The text behind all spans."""
    return F.substring(text, F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)) + 1, F.length(text))


def entity_texts(texts: DataFrame) -> DataFrame:
    """(key, entities, terms, hidden) of every text with base entities: its entities with the words that they spell, its
    words outside of them, and the words that are only inside. texts: key, text."""
    spans = texts.select("key", "text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    name = lambda s, b: F.concat(s["kind"], F.lit(":"), F.lower(part(b, s["begin"], s["end"] - s["begin"])))
    spelt = lambda s, b: F.when(s["kind"] == "email", F.filter(_words(F.substring_index(name(s, b).substr(F.lit(7), F.length(name(s, b))), "@", 1)), lambda w: F.length(w) >= MIN_PART)).otherwise(F.array().cast("array<string>"))
    named = bound(blocks(F.col("text")), lambda b: F.transform("spans", lambda s: F.struct(F.xxhash64(name(s, b)).alias("entity"), spelt(s, b).alias("spelt"))))
    split = spans.select(
        "key", distinct(named).alias("entities"),
        _words(_outside(F.col("text"), F.col("spans"))).alias("terms"), _words(F.col("text")).alias("words"))
    return split.select("key", "entities", "terms", F.array_except("words", "terms").alias("hidden")).dropDuplicates(["key"])


def disclosing(docs: DataFrame) -> DataFrame:
    """(key, term, level) of the words that disclose an entity, in every text that has them. docs: key, text.

    Texts are counted once however many documents share them. All counts are aggregations with map-side folding.
    """
    near = cut(entity_texts(docs.where("text is not null")))
    n_texts = max(docs.where("text is not null").select("key").distinct().count(), 1)
    information = -F.log(F.col("n_entity") / F.lit(n_texts))
    within = near.select("key", F.explode("entities").alias("e")).select("key", "e.entity")
    entities = cut(within.groupBy("entity").agg(F.count("*").alias("n_entity")))
    spelt = cut(near.select(F.explode("entities").alias("e")).select("e.entity", F.size("e.spelt").alias("n_spelt"), F.explode("e.spelt").alias("term")).distinct())
    # A word discloses an entity only if it is in fewer texts than this. Candidates beyond it go by their number of
    # texts with entities; of the others an estimate by sketch, six standard errors wide, sorts out those that are in
    # far more, before words and texts are listed and counted exactly.
    limits = within.join(entities, "entity").groupBy("key").agg(F.max(F.col("n_entity") * F.exp((1 - GENERALISE) * information)).alias("limit"))
    beside = near.select("key", F.explode("terms").alias("term")).join(limits, "key").groupBy("term").agg(F.count("*").alias("n_near"), F.max("limit").alias("limit"))
    inside = near.select(F.explode("hidden").alias("term")).groupBy("term").agg(F.count("*").alias("n_hidden"))
    often = beside.join(spelt.select("term").distinct().withColumn("named", F.lit(True)), "term", "left").where((F.col("n_near") >= 2) | F.col("named"))
    candidates = cut(often.where(F.col("n_near") <= F.col("limit")).join(inside, "term", "left").select(
        "term", (F.col("limit") + F.coalesce("n_hidden", F.lit(0))).alias("limit")))
    words = docs.where("text is not null").select("key", F.explode(_words(F.col("text"))).alias("term"))
    n_words = words.agg(F.approx_count_distinct("term")).first()[0] if candidates.count() else 0
    few = candidates.count() <= BROADCAST_TERMS  # else words and candidates meet by hash
    estimated = words.join(F.broadcast(candidates) if few else candidates, "term").groupBy("term", "limit").agg(F.approx_count_distinct("key", 0.05).alias("n"))
    rare = cut(estimated.where(F.col("n") * 0.7 <= F.col("limit")).select("term"))
    listed = words.join(F.broadcast(rare) if few else rare, "term", "left_semi").distinct()
    hidden = near.select("key", F.explode("hidden").alias("term")).join(F.broadcast(rare) if few else rare, "term", "left_semi")
    present = cut(listed.join(hidden, ["key", "term"], "left_anti"))
    of_term = present.groupBy("term").agg(F.count("*").alias("n_term"))
    together = present.join(within, "key").groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    part = F.when(information > 0, 1 + F.log(F.col("n_both") / F.col("n_term")) / information).otherwise(0.0)
    share, least = F.col("n_both") / F.col("n_term"), F.col("n_entity") / F.lit(n_texts)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - least))).otherwise(0.0)
    surprise = F.col("n_term") * (share * F.log(share / least) + rest)
    by_name = F.col("n_spelt").isNotNull() & (surprise >= F.log(F.col("n_spelt") / CHANCE))
    by_count = (F.col("n_both") >= 2) & (surprise >= F.log(F.lit(max(n_words, 1) / CHANCE)))
    pairs = together.join(entities, "entity").join(of_term, "term").join(spelt, ["entity", "term"], "left").where((share > least) & (by_name | by_count))
    levels = pairs.groupBy("term").agg(F.max(part).alias("level")).where(F.col("level") > GENERALISE)
    return present.join(levels, "term").select("key", "term", "level")


def spotted(docs: DataFrame) -> DataFrame:
    """(key, terms, removed) of the texts with disclosing words: all of them, and those beyond `REMOVE`."""
    found = disclosing(docs)
    return found.groupBy("key").agg(
        F.sort_array(F.collect_list("term")).alias("terms"),
        F.sort_array(F.collect_list(F.when(F.col("level") > REMOVE, F.col("term")))).alias("removed"),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, number of base entities by kind, base_sha256, and all spans, of every document."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key("text").alias("key"))
    base = keyed.select("doc_id", "key", base_spans(F.col("text")).alias("base")).select(
        "doc_id", "key",
        *[_count(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS],
        _listed(F.col("base")).alias("listed"),
    )
    terms = cut(spotted(keyed.select("key", "text")))
    texts = keyed.select("key", "text").join(terms.select("key", "terms"), "key")
    more = texts.select("key", _listed(term_spans(F.col("text"), F.col("terms"))).alias("more")).dropDuplicates(["key"])
    return base.join(more, "key", "left").select(
        "doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2("listed", 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif("listed", F.lit("")), F.nullif("more", F.lit(""))).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `text` replaced: entities by their kind in brackets, generalised words by `[TERM]`,
    removed ones by nothing. A span that begins inside another is covered by that one. n_chars follows the text."""
    key, terms, removed = (free_name(docs, c) for c in ("text_key", "pii_terms", "pii_removed"))
    keyed = docs.withColumn(key, text_key("text"))
    found = cut(spotted(keyed.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))))
    with_terms = keyed.join(found.select(F.col("key").alias(key), F.col("terms").alias(terms), F.col("removed").alias(removed)), key, "left")
    text = F.col("text")
    spans = F.concat(base_spans(text), F.when(F.col(terms).isNotNull(), term_spans(text, F.col(terms))).otherwise(F.array().cast(BASE)))
    ordered = F.array_sort(spans, lambda a, b: F.when(a["begin"] != b["begin"], a["begin"] - b["begin"]).otherwise(b["end"] - a["end"]))

    def replaced(s: Column, at: Column, b: Column) -> Column:
        word = F.lower(part(b, s["begin"], s["end"] - s["begin"]))
        mark = (
            F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            .when(F.array_contains(F.col(removed), word), F.lit("")).otherwise(F.lit("[TERM]"))
        )
        # A span that reaches beyond the one it overlaps leaves nothing of its rest.
        return F.when(s["begin"] >= at, F.concat(part(b, at, s["begin"] - at), mark)).otherwise("")

    def joined(os: Column, b: Column) -> Column:
        parts = F.zip_with(os, _covered(os), lambda s, at: replaced(s, at, b))
        return F.concat(F.array_join(parts, ""), _rest(text, os))

    whole = bound(ordered, lambda os: bound(blocks(text), lambda b: joined(os, b)))
    new = F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(whole)
    out = with_terms.withColumn(removed + "_text", new)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(removed + "_text").alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            columns.append(F.when(F.col("n_chars").isNotNull() & text.isNotNull(), F.length(removed + "_text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
