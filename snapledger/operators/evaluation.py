"""Checks of saved drafts against the context they were written from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.text import DRAFT_WORD_EN, DRAFT_WORD_TH
from snapledger.operators.reports import CONTEXT_FIELDS

# Words a draft must not use, headings it must have, shapes of secrets.
FORBIDDEN_TERMS = (
    "severity", "impact", "priority", "SLA", "consequence", "criticality",
)
SECTION_MARKS = ("(1)", "(2)", "(3)", "(4)", "(5)")
SECRET_PATTERN = r"(sk-[A-Za-z0-9_-]{16,}|OPENAI_API_KEY|Bearer\s+[A-Za-z0-9._-]{16,})"
NUMBER_PATTERN = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
WORD_PATTERN = r"[\p{L}\p{N}]+"


def numbers_in(drafts: DataFrame) -> DataFrame:
    """Distinct (summary_id, source_run_id, number) of each draft; thousands commas removed."""
    found = F.regexp_extract_all(F.col("summary_text"), F.lit(NUMBER_PATTERN), F.lit(0))
    plain = F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))
    return drafts.select("summary_id", "source_run_id", F.explode(plain).alias("number"))


def context_numbers(contexts: DataFrame) -> DataFrame:
    """(source_run_id, number) of every number in the JSON payload that was sent: counts, rates, dates, days.

    contexts: source_run_id, payload. A rate also stands for its percentage with one decimal, as texts spell it.
    """
    found = F.regexp_extract_all(F.col("payload"), F.lit(NUMBER_PATTERN), F.lit(0))
    plain = F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")))
    number = contexts.select("source_run_id", F.explode(F.array_distinct(plain)).alias("number"))
    rate = F.col("number").cast("double")
    percent = number.where((rate > 0) & (rate < 1)).select("source_run_id", F.format_number(rate * 100, 1).alias("number"))
    return number.unionByName(percent).distinct()


def unexpected_fields(contexts: DataFrame, list_name: str = "top_overdue_actions", allowed: Sequence[str] = CONTEXT_FIELDS) -> DataFrame:
    """EV-05: (source_run_id, field) of fields in a payload's rows that the whitelist lacks."""
    rows = F.from_json(F.get_json_object("payload", f"$.{list_name}"), "array<map<string,string>>")
    fields = F.array_distinct(F.flatten(F.transform(rows, F.map_keys)))
    found = contexts.select("source_run_id", F.explode(fields).alias("field"))
    return found.where(~F.col("field").isin(*allowed)).distinct()


def ungrounded_numbers(drafts: DataFrame, context_numbers: DataFrame) -> DataFrame:
    """EV-01: numbers of a draft that its run's context does not contain.

    `context_numbers` is (source_run_id, number); it folds to distinct pairs first.
    """
    known = context_numbers.select("source_run_id", "number").distinct()
    return numbers_in(drafts).join(known, ["source_run_id", "number"], "left_anti").select(
        "summary_id", "source_run_id", "number"
    )


def forbidden_terms(drafts: DataFrame, terms: Sequence[str] = FORBIDDEN_TERMS) -> DataFrame:
    """EV-02: one row per draft and forbidden term it contains, any case."""
    text = F.lower("summary_text")
    hits = F.array_compact(F.array(*[
        F.when(text.contains(t.lower()), F.lit(t)) for t in terms
    ]))
    return drafts.select("summary_id", F.explode(hits).alias("term"))


def structure(drafts: DataFrame, marks: Sequence[str] = SECTION_MARKS) -> DataFrame:
    """EV-03: does each draft carry the label and every section mark."""
    head = F.substring("summary_text", 1, 200)
    label = head.contains(DRAFT_WORD_TH) | F.lower(head).contains(DRAFT_WORD_EN)
    present = sum((F.contains(F.col("summary_text"), F.lit(m)).cast("int") for m in marks), F.lit(0))
    return drafts.select(
        "summary_id", label.alias("has_label"), present.alias("sections_present"),
        (label & (present == len(marks))).alias("complete"),
    )


def _grams(words: Column) -> Column:
    """Words and pairs of neighbours of an array of words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.filter(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda p: p.isNotNull()))


def name_candidates(drafts: DataFrame, names: DataFrame) -> DataFrame:
    """(summary_id, project_name): drafts that hold the rarest part of a name. No mention is missed.

    A name of several words is made of the pairs of neighbours in it, a name of one word of that word, and a name
    without words of its characters. Parts are counted over all drafts and each name is looked up by the one that fewest
    drafts hold, so a word that many names share costs nothing; a name with a part that no draft holds is mentioned
    nowhere. Drafts give only parts that some name has; their texts do not move.
    """
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))
    marks = F.array_distinct(F.split(F.regexp_replace("text", WORD_PATTERN, ""), ""))
    parts = names.select("project_name", F.col("project_name").alias("text")).distinct().withColumn("words", words)
    of_name = F.when(F.size("words") > 1, F.filter(_grams(F.col("words")), lambda g: F.contains(g, F.lit(" "))))
    parts = parts.select("project_name", F.explode(
        of_name.when(F.size("words") == 1, F.col("words")).otherwise(marks)).alias("part")).where("part <> ''").distinct()
    said = drafts.select("summary_id", F.col("summary_text").alias("text")).select(
        "summary_id", F.explode(F.array_distinct(F.concat(_grams(words), marks))).alias("part"))
    said = said.join(parts.select("part").distinct(), "part", "left_semi")
    known = said.groupBy("part").agg(F.count(F.lit(1)).alias("drafts"))
    weighed = parts.join(known, "part", "left").withColumn("drafts", F.coalesce("drafts", F.lit(0)))
    rarest = weighed.groupBy("project_name").agg(F.min(F.struct("drafts", "part")).alias("least"))
    keys = rarest.where("least.drafts > 0").select("project_name", F.col("least.part").alias("part"))
    return said.join(keys, "part").select("summary_id", "project_name")


def out_of_scope_projects(drafts: DataFrame, projects: DataFrame) -> DataFrame:
    """EV-04: project names a filtered draft mentions although its filter is another project.

    Candidates come from the rarest part of each name; in them the whole name is looked for in the text. An empty name
    is none.
    """
    filtered = drafts.where(F.col("project_filter").isNotNull()).select("summary_id", "project_filter", "summary_text")
    pairs = name_candidates(filtered, projects.select("project_name"))
    quoted = F.replace(F.col("project_name"), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}])\Q"), quoted, F.lit(r"\E($|[^\p{L}\p{N}])"))
    hits = pairs.join(filtered, "summary_id").where(
        (F.col("project_name") != F.col("project_filter"))
        & F.rlike(F.col("summary_text"), pattern)
    )
    return hits.select("summary_id", "project_filter", "project_name")


def privacy(drafts: DataFrame) -> DataFrame:
    """EV-05: drafts that contain something shaped like a secret."""
    leak = F.col("summary_text").rlike(SECRET_PATTERN)
    return drafts.select("summary_id", leak.alias("has_secret"))


def unexpected_context_fields(context_rows: DataFrame) -> list[str]:
    """Fields of the context rows beyond the allowed ones; a schema check, reads no data."""
    return [c for c in context_rows.columns if c not in CONTEXT_FIELDS]


def draft_versions(drafts: DataFrame) -> DataFrame:
    """EV-06: each (provider, model, prompt) in the order it appeared and what changed.

    Drafts fold to one row per version before the ordering window.
    """
    versions = drafts.groupBy("provider", "model_name", "prompt_version").agg(
        F.count(F.lit(1)).alias("drafts"),
        F.min(F.struct("created_at", "summary_id")).alias("first"),
    )
    order = Window.orderBy("first")

    def changed(c: str):
        return F.when(F.lag(c).over(order).isNull(), F.lit(False)).otherwise(
            F.lag(c).over(order) != F.col(c)
        )

    return versions.select(
        "provider", "model_name", "prompt_version", "drafts",
        F.col("first.created_at").alias("first_created_at"),
        *[changed(c).alias(f"{c}_changed") for c in ("provider", "model_name", "prompt_version")],
    )
