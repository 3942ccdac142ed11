"""What larger tables bring: far timestamps, great keys, many files."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import HEADER, REF, write_csv
from snapledger.functions.time import hours_between, ntz
from snapledger.operators import ingest as loading
from snapledger.plans import testdata as td
from snapledger.plans.catalog import QUERIES
from snapledger.sources import folders, snapshot_files as src, warehouse
from snapledger.sources.folders import fresh_folder
from snapledger.streaming import file_drop
import oracle

SF = "/root/testdata/sf0.001"


def with_table(folder, **paths: str) -> str:
    """A folder with the given tables, some of them replaced."""
    for name in oracle.TABLES:
        if name not in paths:
            os.symlink(f"{SF}/{name}.parquet", folder / f"{name}.parquet")
    return str(folder)


def test_hours_between_timestamps_centuries_apart(spark):
    far = spark.sql("select timestamp_ntz '2300-01-01 00:30:00' as a, timestamp_ntz '1700-01-01 00:00:00' as b")
    row = far.select(hours_between(F.col("a"), ntz(datetime(2001, 9, 1))).alias("x"), hours_between(F.col("b"), F.col("a")).alias("y")).first()
    first, second, at = datetime(2300, 1, 1, 0, 30), datetime(1700, 1, 1), datetime(2001, 9, 1)
    assert (row.x, row.y) == ((at - first).total_seconds() / 3600, (first - second).total_seconds() / 3600)


def test_drafts_and_freshness_with_great_conversation_ids(spark, tmp_path):
    spark.read.parquet(f"{SF}/conversations.parquet").withColumn("conv_id", F.col("conv_id") + 60_000_000).write.parquet(
        str(tmp_path / "conversations.parquet"))
    sf = with_table(tmp_path, conversations="")
    expected = (datetime(2024, 1, 1) - datetime(2001, 9, 1)).total_seconds() / 3600
    latest = spark.read.parquet(f"{sf}/conversations.parquet").agg(F.max(F.expr("conv_id * 37 + turn"))).first()[0]
    ages = {r.sla_id: r.age_hours for r in QUERIES["freshness_report"].build(spark, sf).collect()}
    assert ages["FR-05"] == -(expected + latest)
    assert ages["FR-01"] is not None and td.drafts(spark, sf).count() > 0


def snapshots(folder, number: int, wrong: int = 0) -> str:
    """Files of three rows; the first `wrong` have a row without an owner and one without a status."""
    folder.mkdir(exist_ok=True)
    for n in range(number):
        rows = [[f"{n}-{i}", "Mill", "Oil", "mina", "2031-02-27", "todo"] for i in range(3)]
        if n < wrong:
            rows[0][HEADER.index("owner")] = rows[1][HEADER.index("status")] = ""
        write_csv(folder / f"{n:03}.csv", rows)
    return str(folder)


def test_small_files_share_tasks_and_large_ones_get_their_own(spark, tmp_path):
    files = src.read_files(spark, snapshots(tmp_path / "in", 60))
    listed = loading.list_files(files)
    records = loading.split_files(files, listed, 1 << 20)
    assert records.rdd.getNumPartitions() == 1 and records.where("source_row_number > 0").count() == 180
    mixed = [{"file_no": n, "length": size} for n, size in enumerate([10, 1 << 30, 20, 0, 30, 40 << 20, 40 << 20])]
    first, width, total = loading._slots(mixed, 1 << 28, 8)
    assert width == {0: 1, 1: 4, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert (first, total) == ({0: 0, 1: 1, 2: 5, 3: 5, 4: 5, 5: 5, 6: 6}, 7)


def test_findings_of_a_run_are_in_one_file(spark, wh, tmp_path):
    with pytest.MonkeyPatch.context() as m:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        m.setattr(loading, "MIN_SLOT_BYTES", 16)
        loading.ingest(wh, snapshots(tmp_path / "in", 6, wrong=6), REF)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert wh.findings().count() == 12 and len(wh.findings().inputFiles()) == 6


def test_rows_of_many_runs_are_read_without_naming_each(spark, wh, tmp_path, monkeypatch):
    monkeypatch.setattr(warehouse, "MANY_RUNS", 2)
    loading.ingest(wh, snapshots(tmp_path / "in", 5), REF)
    some = wh.read_runs("stg_actions", [1, 2, 4, 9])
    assert sorted({r.run_id for r in some.collect()}) == [1, 2, 4] and some.count() == 9
    assert wh.read_runs("stg_actions", [3]).count() == 3
    assert wh.folders("stg_actions") >= {f"run_id={n}" for n in range(1, 6)}


def test_listing_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get(folders._LISTING_TASKS)
    with folders.listed_in_bulk(spark):
        assert int(spark.conf.get(folders._LISTING_TASKS)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(folders._LISTING_TASKS) == before


def test_hidden_files_are_found_at_any_depth_by_few_calls(spark, tmp_path, monkeypatch):
    for name in ("a.csv", "_b.csv", "x/.c.csv", "x/y/_d e.csv", "x/_SUCCESS", "_z/e.csv", "_z/_f.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    (tmp_path / "empty").mkdir()
    snapshots(tmp_path / "many", 40)
    calls, send = [], spark.sparkContext._gateway._gateway_client.send_command
    monkeypatch.setattr(spark.sparkContext._gateway._gateway_client, "send_command", lambda *a, **k: calls.append(a) or send(*a, **k))
    found = src.hidden_files(spark, [str(tmp_path), str(tmp_path / "_b.csv")])
    assert [f.removeprefix(f"file:{tmp_path}/") for f in found] == ["_b.csv", "_b.csv", "x/.c.csv", "x/y/_d e.csv"]
    assert len(calls) < 150


def test_the_stream_loads_once_for_many_batches_and_goes_on_after_a_stop(spark, wh, tmp_path, monkeypatch):
    calls = []
    real = file_drop.ingest
    landing, state = snapshots(tmp_path / "in", 5), fresh_folder(spark, "stream")
    monkeypatch.setattr(file_drop, "ingest", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        file_drop.start(wh, landing, state, REF, 2).awaitTermination()
    monkeypatch.setattr(file_drop, "ingest", lambda wh, paths, *a, **k: calls.append(len(paths)) or real(wh, paths, *a, **k))
    snapshots(tmp_path / "in", 7)
    file_drop.start(wh, landing, state, REF, 1).awaitTermination()
    assert calls == [7] and wh.runs().where("status = 'succeeded'").count() == 7 and wh.facts().count() == 21
    file_drop.start(wh, landing, state, REF, 1).awaitTermination()
    assert calls == [7]


def test_findings_of_the_latest_run_have_their_place_in_its_list(spark):
    rows = QUERIES["findings_of_run"].build(spark, "/root/testdata/sf0.01").collect()
    listed = sorted(rows, key=lambda r: (r.check_name, r.quality_result_id))
    assert len(rows) > 1 and [r.place for r in listed] == list(range(1, len(rows) + 1))
