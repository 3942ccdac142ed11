"""Helpers the operators share: text keys, lineage cuts, connected components, bounded slices of Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.sources.folders import shared_folder

CHUNK_BYTES = 1 << 20
BLOCK_CHARS = 1024


def folder(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`); a temporary one only where it is unset on a local master."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so later steps survive lost executors without recomputing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def text_key(text: Column | str) -> Column:
    """16 bytes of the SHA-256 of a text: equal for equal texts only; null for null."""
    return F.unhex(F.substring(F.sha2(F.col(text) if isinstance(text, str) else text, 256), 1, 32))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` or a function over an array in it names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(text: Column) -> Column:
    """A text in blocks of `BLOCK_CHARS` code points, for `part`."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK_CHARS), F.lit(0))


def part(of_blocks: Column, begin: Column, chars: Column) -> Column:
    """`chars` code points from `begin` (0 first) on; unlike `substring` it doesn't walk the text from its start."""
    at = lambda where: F.floor(where / BLOCK_CHARS).cast("int")
    near = F.array_join(F.slice(of_blocks, at(begin) + 1, at(begin + chars) - at(begin) + 1), "")
    return F.substring(near, begin - at(begin) * BLOCK_CHARS + 1, chars)


def running(values: Column, merge: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For every element of an array of integers what `merge` (a sum, a maximum) makes of 0 and all elements before it.

    `aggregate` copies what it has gathered at each step, so it can't gather an array over a long one. Here elements are
    merged within blocks, and blocks with each other.
    """
    total = lambda c: F.aggregate(c, F.lit(0), merge)
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda j: F.slice(values, j * block + 1, F.lit(block)))

    def spread(parts: Column) -> Column:
        def from_sums(sums: Column) -> Column:
            def one(c: Column, j: Column) -> Column:
                return bound(total(F.slice(sums, F.lit(1), j)), lambda base: F.transform(
                    c, lambda x, i: merge(base, total(F.slice(c, F.lit(1), i)))))
            return F.flatten(F.transform(parts, one))
        return bound(F.transform(parts, total), from_sums)

    return F.when(F.size(values) > 0, bound(cut_up, spread)).otherwise(F.array().cast("array<int>"))


def distinct(items: Column) -> Column:
    """The different elements of an array in order; for structs, whose `array_distinct` compares all pairs."""
    return bound(F.sort_array(items), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def held_out(doc_id: Column | str) -> Column:
    """The fold that is never learnt from; a null id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); the component is its least node. Any orderable id type.

    Alternating large-star and small-star steps: each hangs neighbours below a least node, which needs one
    aggregation with map-side minima and one join, so a hub of any degree is never gathered in one place. Every
    round is cut; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a != b").distinct())
        # Stars only, and the same ones as before: nothing moves any more.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def worker_memo(operator: str, name: str = "") -> dict:
    """A dictionary that a Python worker keeps from task to task; functions travel by value, so their globals don't last.

    It keeps those of one operator at a time: an operator that asks frees what another one left.
    """
    module = sys.modules.setdefault("_llm_worker_memo", types.ModuleType("_llm_worker_memo"))
    kept = module.__dict__.setdefault("kept", {})
    if operator not in kept:
        for memo in [m for memos in kept.values() for m in memos.values()]:
            memo.clear()
        kept.clear()
    return kept.setdefault(operator, {}).setdefault(name, {})


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        yield batch.slice(begin)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have."""
    names = {c.lower() for c in df.columns}
    while base.lower() in names:
        base = "_" + base
    return base
