"""Snapshot files (CSV text) as DataFrames, with the counts a strict reader needs.

Spark's CSV source drops blank lines, renames repeated headers and hides true field counts, so
records are split from the file's bytes. Files above the size cap are refused before their
content is read; below it, one task splits one file and hands rows on in small Arrow batches.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.sources.folders import listed_in_bulk, path_texts
from snapledger.schemas import (
    MAX_FIELD_CHARS,
    MAX_FILE_BYTES,
    SOURCE_COLUMNS,
    TEXT_COLUMNS,
)

BATCH_ROWS = 8192

RECORD_SCHEMA = (
    "file_no long, source_hash string, source_row_number int, "
    + ", ".join(f"{c} string" for c in TEXT_COLUMNS)
    + ", field_count int, header_count int, header_ok boolean, header array<string>, problem string"
)
_ARROW_SCHEMA = pa.schema(
    [("file_no", pa.int64()), ("source_hash", pa.string()), ("source_row_number", pa.int32())]
    + [(c, pa.string()) for c in TEXT_COLUMNS]
    + [
        ("field_count", pa.int32()), ("header_count", pa.int32()), ("header_ok", pa.bool_()),
        ("header", pa.list_(pa.string())), ("problem", pa.string()),
    ]
)


def read_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of every file under `path`, nested folders too."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    with listed_in_bulk(spark):
        return reader.option("recursiveFileLookup", "true").load(path)


def hidden_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files under `paths` whose names Spark's listing passes over: those that begin with `_` or `.`.

    Markers of finished jobs aren't snapshots. Files in hidden folders are not looked for.
    """
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for text in paths:
        pattern = jvm.org.apache.hadoop.fs.Path(text)
        fs = pattern.getFileSystem(conf)
        for root in fs.globStatus(pattern) or []:
            top = root.getPath().toString()
            for path in _paths_below(spark, fs, root.getPath()):
                *folders, name = path.rsplit("/", 1)[-1:] if path == top else path.removeprefix(top).split("/")
                if name[0] in "_." and name != "_SUCCESS" and not any(f[:1] in ("_", ".") for f in folders):
                    found.append(path)
    return sorted(found)


def _paths_below(spark: SparkSession, fs, root) -> list[str]:
    """Paths of all files under a folder, listed a level at a time; a file that is listed gives itself."""
    to_paths = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths
    level, before = to_paths(fs.listStatus(root)), None
    while (now := path_texts(spark, level)) != before:
        level, before = to_paths(fs.listStatus(level)), now
    return now


def visible_copies(spark: SparkSession, hidden: list[str], folder: str) -> dict[str, str]:
    """Copies of hidden files below `folder`, under names that Spark lists: copy -> original. Bytes pass through in pieces."""
    fs_api, conf, copies = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), {}
    for n, text in enumerate(hidden):
        source, target = fs_api.Path(text), fs_api.Path(f"{folder}/{n}.csv")
        fs_api.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
        copies[target.getFileSystem(conf).makeQualified(target).toString()] = text
    return copies


def file_name(path_column: str = "path"):
    return F.element_at(F.split(F.col(path_column), "/"), -1)


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, source_file, length, source_hash): identical bytes give the same hash."""
    return files.select(
        "path", file_name().alias("source_file"), "length",
        F.sha2(F.col("content"), 256).alias("source_hash"),
    )


def _batch(file: tuple, head: dict, numbers: range, columns: list, counts: pa.Array) -> pa.RecordBatch:
    n = len(numbers)
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(file[0], pa.int64()), n), pa.repeat(pa.scalar(file[1], pa.string()), n),
            pa.array(np.arange(numbers.start, numbers.stop, dtype=np.int32)),
            *columns,
            counts,
            pa.repeat(pa.scalar(head["count"], pa.int32()), n),
            pa.repeat(pa.scalar(head["ok"], pa.bool_()), n),
            pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.string()),
        ],
        schema=_ARROW_SCHEMA,
    )


def _marker(file: tuple, header: list[str] | None, head: dict, problem: str | None) -> pa.RecordBatch:
    """The header record (row number 0), or a problem that refuses the whole file."""
    row = {
        "file_no": file[0], "source_hash": file[1], "source_row_number": 0, "header": header,
        "header_count": head["count"], "header_ok": head["ok"], "problem": problem,
    }
    return pa.RecordBatch.from_pylist(
        [{name: row.get(name) for name in _ARROW_SCHEMA.names}], schema=_ARROW_SCHEMA
    )


def _bind(records: list, sizes: list[int], places: list[int], width: int) -> list[pa.Array]:
    """The required columns in order; '' and fields a short record lacks are NULL."""
    if min(sizes) == max(sizes) == width:
        table = list(zip(*records))
        columns = [table[i] if i >= 0 else [None] * len(records) for i in places]
    else:
        columns = [[r[i] if 0 <= i < n else None for r, n in zip(records, sizes)] for i in places]
    arrays = [pa.array(values, pa.string()) for values in columns]
    return [pc.if_else(pc.equal(a, ""), pa.scalar(None, pa.string()), a) for a in arrays]


def _is_plain(content: bytes) -> bool:
    """No quotes, no blank lines and no bare CR: every reader agrees on such a file's records."""
    return not (
        b'"' in content or b"\n\n" in content or b"\n\r" in content
        or content.startswith((b"\n", b"\r")) or content.count(b"\r") != content.count(b"\r\n")
    )


def _plain_table(content: bytes, width: int) -> pa.Table | None:
    """Rows of a plain file, read by Arrow; None when a record or field needs the strict reader."""
    names = [str(i) for i in range(width)]
    try:
        table = pa_csv.read_csv(
            pa.BufferReader(content),
            read_options=pa_csv.ReadOptions(column_names=names, skip_rows=1, use_threads=False),
            parse_options=pa_csv.ParseOptions(quote_char=False, ignore_empty_lines=False),
            convert_options=pa_csv.ConvertOptions(
                column_types=dict.fromkeys(names, pa.string()), null_values=[""],
                strings_can_be_null=True,
            ),
        )
    except pa.ArrowInvalid:
        return None
    longest = (pc.max(pc.binary_length(c)).as_py() or 0 for c in table.columns)
    return table if max(longest) <= MAX_FIELD_CHARS else None


def _plain_batches(file: tuple, head: dict, places: list[int], table: pa.Table) -> Iterator[pa.RecordBatch]:
    number = 0
    for rows in table.to_batches(BATCH_ROWS):
        n = rows.num_rows
        columns = [rows.column(i) if i >= 0 else pa.nulls(n, pa.string()) for i in places]
        counts = pa.repeat(pa.scalar(head["count"], pa.int32()), n)
        yield _batch(file, head, range(number + 1, number + 1 + n), columns, counts)
        number += n


def _split_one(file: tuple, content: bytes) -> Iterator[pa.RecordBatch]:
    """Records of one file: header first, then rows bound by header name, '' as NULL."""
    csv.field_size_limit(MAX_FIELD_CHARS)
    head = {"count": 0, "ok": False}
    try:
        text = io.TextIOWrapper(io.BytesIO(content), encoding="utf-8-sig", newline="")
        reader = csv.reader(text)
        header = next(reader, None)
        if header is None:
            yield _marker(file, None, head, "empty")
            return
        where = {name: i for i, name in enumerate(header)}
        places = [where.get(c, -1) for c in SOURCE_COLUMNS]
        head = {
            "count": len(header),
            "ok": -1 not in places and len(where) == len(header),
        }
        table = _plain_table(content, len(header)) if _is_plain(content) else None
        yield _marker(file, header, head, None)
        if table is not None:
            yield from _plain_batches(file, head, places, table)
            return
        number = 0
        while records := list(islice(reader, BATCH_ROWS)):
            sizes = list(map(len, records))
            numbers = range(number + 1, number + 1 + len(records))
            columns = _bind(records, sizes, places, len(header))
            yield _batch(file, head, numbers, columns, pa.array(sizes, pa.int32()))
            number += len(records)
    except UnicodeDecodeError:
        yield _marker(file, None, head, "invalid_utf8")
    except csv.Error:
        yield _marker(file, None, head, "unreadable")


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch holds the files of one scan partition, whose bytes Spark bounds when it packs it."""
    for batch in batches:
        for number, digest, content in zip(*(batch.column(i) for i in range(3))):
            yield from _split_one((number.as_py(), digest.as_py()), content.as_py())


def split_records(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Header and row records of all files within the size cap; `files` carries a file_no.

    The length filter reaches the file source, so content above the cap is never read.
    """
    small = files.where(F.col("length") <= F.lit(max_bytes))
    content = small.select("file_no", F.sha2(F.col("content"), 256).alias("source_hash"), "content")
    return content.mapInArrow(_split, RECORD_SCHEMA)


def file_markers(records: DataFrame) -> DataFrame:
    """Per file its hash, header size and state, and what makes it unreadable, if anything."""
    marks = records.where(F.col("source_row_number") == 0)
    return marks.groupBy("file_no").agg(
        F.max("source_hash").alias("source_hash"), F.max("problem").alias("problem"),
        F.max("header_ok").alias("header_ok"), F.max("header_count").alias("header_count"),
    )


def file_summary(files: DataFrame, records: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """One row per file: admission, hash, header and row count.

    admission is 'ok' or why the file is refused before any run exists: too_large, empty,
    invalid_utf8, unreadable (for example an over-long field), header_only.
    """
    sizes = records.groupBy("file_no").agg(F.max("source_row_number").alias("source_row_count"))
    folded = file_markers(records).join(sizes, "file_no")
    listed = files.select("file_no", "path", "length")
    return listed.join(folded, "file_no", "left").select(
        "file_no", file_name().alias("source_file"), "length", "source_hash",
        admission(max_bytes).alias("admission"),
        F.coalesce("source_row_count", F.lit(0)).alias("source_row_count"),
    )


def admission(max_bytes: int):
    """Why a file is refused, or 'ok', from its length, problem and row count."""
    return (
        F.when(F.col("length") > F.lit(max_bytes), "too_large")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.coalesce("source_row_count", F.lit(0)) == 0, "header_only")
        .otherwise("ok")
    )


def header_lists(records: DataFrame, key: str = "file_no") -> DataFrame:
    """(key, names): the header of each file as one array."""
    heads = records.where((F.col("source_row_number") == 0) & F.col("header").isNotNull())
    return heads.select(key, F.col("header").alias("names"))


def header_columns(records: DataFrame, key: str = "file_no") -> DataFrame:
    """(key, position, column_name): header names as they are, repeats kept."""
    heads = records.where((F.col("source_row_number") == 0) & F.col("header").isNotNull())
    return heads.select(key, F.posexplode("header").alias("position", "column_name"))


def data_rows(records: DataFrame) -> DataFrame:
    return records.where(F.col("source_row_number") > 0).drop("header", "problem")
