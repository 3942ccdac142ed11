"""Benchmark decontamination by spaced-seed hashing, with Spark expressions only.

A seed is a fixed mask over ten or seven successive words that looks at six of them. The two masks together hit every
run of `WINDOW` words in which at most two were substituted, wherever those are. Hashes of the seen words are joined
between benchmark items and documents; a hit fixes an alignment (diagonal) of item and document. Each alignment is then
verified on the words themselves: an item leaks where some window of `WINDOW` aligned words agrees in `SHARE` of them. Items
of fewer than `WINDOW` words are verified as a whole, and have masks of their own over their whole length: where `spare`
words may differ, the words are dealt into `spare` + 2 groups, and every mask leaves out `spare` of these, so some mask
leaves out all changed words.

The benchmark side is broadcast if its seeds are counted to be at most `BROADCAST_SEEDS`; beyond that the join shuffles
both sides by hash and adaptive execution splits frequent hashes.

Words are lower-cased runs of ASCII letters and digits and of non-ASCII characters.

Edge cases: null, empty and wordless texts leak nothing, and such items are never found; equal texts are looked at once;
items of one text count each; a null item_id is reported as null; repeated rows and ties don't change the result; empty
tables give no rows; extra columns don't matter.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import cut, free_name, text_key

MASKS = ((0, 1, 5, 7, 8, 9), (0, 1, 2, 3, 5, 6))
WINDOW = 13
SHARE = 0.8
BROADCAST_SEEDS = 1_000_000
NOT_WORD = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text: Column) -> Column:
    """Hash of every word of a text, in order."""
    return F.transform(F.array_remove(F.split(F.lower(text), NOT_WORD), ""), lambda w: F.xxhash64(w))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over an item of `n` words, below `WINDOW`, that hit it however many words verification lets differ."""
    spare = n - math.ceil(n * SHARE)
    groups = min(n, spare + 2)
    return [tuple(o for o in range(n) if o % groups not in out) for out in combinations(range(groups), spare)]


def _seed(found: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(found, at + o) for o in mask])


def _numbered(lengths: list[int]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(length, number, mask) of the masks of short items."""
    return [(n, -100 * n - k, mask) for n in lengths for k, mask in enumerate(short_masks(n))]


def seeds(found: Column, lengths: list[int]) -> Column:
    """All seed hashes by position: of each mask, and of those of the short `lengths`. Null where one is too long."""

    def at(i: Column) -> Column:
        own = [F.when(i + mask[-1] < F.size(found), _seed(found, i, number, mask)) for number, mask in enumerate(MASKS)]
        own += [F.when(i + n <= F.size(found), _seed(found, i, number, mask)) for n, number, mask in _numbered(lengths)]
        return F.array(*own)

    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.size(found) - 1), at))


def _positions(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, at, seed) of every seed. rows: id, words."""
    n = len(MASKS) + len(_numbered(lengths))
    each = rows.select("id", F.posexplode(F.flatten(seeds(F.col("words"), lengths))).alias("k", "seed"))
    return each.where("seed is not null").select("id", F.floor(F.col("k") / n).cast("int").alias("at"), "seed")


def _agreement(found: Column, item: Column, shift: Column) -> Column:
    """Which words of the item agree with the document's, aligned by `shift`, over the aligned part of the item."""
    begin = F.greatest(F.lit(0), -shift)
    end = F.least(F.size(item), F.size(found) - shift)
    each = F.transform(F.sequence(begin, end - 1), lambda q: (F.get(item, q) == F.get(found, q + shift)).cast("int"))
    return F.when(end > begin, each).otherwise(F.array().cast("array<int>"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, matched, n_words, item_words) of every benchmark item in a text. docs: key, text; key by text."""
    docs = docs.where("text is not null")
    items = (
        benchmark.where("text is not null").select("item_id", words(F.col("text")).alias("item")).where("size(item) > 0")
        .select(F.xxhash64("item").alias("id"), "item_id", "item")
    )
    items = cut(items)
    short = sorted(r[0] for r in items.where(F.size("item") < WINDOW).select(F.size("item")).distinct().collect())  # below WINDOW
    single = items.dropDuplicates(["id"]).select("id", F.col("item").alias("words"))
    of_items = _positions(single.where(F.size("words") >= WINDOW), [])
    if short:  # masks of the items of just that length
        own = [F.when(F.size("words") == n, _seed(F.col("words"), F.lit(0), number, mask)) for n, number, mask in _numbered(short)]
        each = single.where(F.size("words") < WINDOW).select("id", F.lit(0).alias("at"), F.explode(F.array(*own)).alias("seed"))
        of_items = of_items.unionByName(each.where("seed is not null"))
    of_items = of_items.select(F.col("id").alias("item"), F.col("at").alias("item_at"), "seed")
    of_items = cut(of_items.distinct())
    few = of_items.count() <= BROADCAST_SEEDS
    of_docs = _positions(docs.select(F.col("key").alias("id"), words(F.col("text")).alias("words")), short)
    hits = of_docs.join(F.broadcast(of_items) if few else of_items, "seed")
    aligned = cut(hits.groupBy(F.col("id").alias("key"), "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("hits")).drop("hits"))
    # Copies fold to one row in the tasks that read them, before any text moves.
    texts = docs.dropDuplicates(["key"]).join(aligned.select("key").distinct(), "key", "left_semi")
    of_item = items.dropDuplicates(["id"]).select(F.col("id").alias("item"), F.col("item").alias("item_words"))
    compared = (
        aligned.join(texts.select("key", words(F.col("text")).alias("found")), "key")
        .join(F.broadcast(of_item) if few else of_item, "item")
        .select("key", "item", F.size("item_words").alias("n"), _agreement(F.col("found"), F.col("item_words"), F.col("shift")).alias("same"))
    )
    width = F.least(F.lit(WINDOW), F.col("n"))
    enough = F.ceil(width * SHARE)
    window = lambda s: F.aggregate(F.slice("same", s + 1, width), F.lit(0), lambda a, x: a + x)
    leaking = F.when(F.size("same") >= width, F.exists(F.sequence(F.lit(0), F.size("same") - width), lambda s: window(s) >= enough)).otherwise(False)
    found = (
        compared.where(leaking).select("key", "item", "n", F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("matched"))
        .groupBy("key", "item").agg(F.max("matched").alias("matched"), F.first("n").alias("item_words"))
    )
    names = items.select(F.col("id").alias("item"), "item_id")
    return found.join(F.broadcast(names) if few else names, "item").select("key", "item_id", "matched", "item_words")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, item_words) of every benchmark item that a document holds."""
    keyed = docs.select("doc_id", "text", text_key("text").alias("key"))
    found = cut(leaks(keyed.select("key", "text"), benchmark))
    return keyed.select("doc_id", "key").join(found, "key").drop("key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark item."""
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, text_key("text"))
    found = cut(leaks(keyed.select(F.col(key).alias("key"), "text"), benchmark).select(F.col("key").alias(key)).distinct())
    return keyed.join(found, key, "left_anti").drop(key)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
