"""Plan shapes: no cross joins, no Python in metric paths, pruning, pushed filters, no clock."""

import pathlib
import re

import pytest

import snapledger
from snapledger.plans.catalog import QUERIES
from snapledger.operators import metrics
from snapledger.plans import testdata as td

SF = "/root/testdata/sf0.001"
FILE_QUERIES = {
    "src_rows", "src_header", "file_fingerprint", "file_admission", "ingest_ledger", "ingest_findings",
    "ingest_facts", "stream_ingest", "saved_drafts", "weekly_report", "orphan_folders", "ri_01_stored", "latest_stored_facts",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FILE_QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name].build(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas", plan)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FILE_QUERIES))
def test_every_query_reads_a_given_table(spark, name):
    plan = QUERIES[name].build(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan, plan


def test_columns_and_filters_reach_the_scan(spark):
    plan = plan_of(metrics.by_owner(td.facts(spark, SF)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "o_totalprice" not in schema and "o_orderpriority" not in schema
    assert "PushedFilters: [" in plan and "o_orderstatus" in plan.split("PushedFilters")[1]


def test_run_folders_are_pruned(golden):
    facts = golden.facts_at(1)
    assert len(facts.inputFiles()) >= 1
    pinned = golden.read("stg_actions").where("run_id = 99")
    assert "PartitionFilters: [isnotnull(run_id" in plan_of(pinned) and pinned.count() == 0


def test_the_latest_run_is_chosen_inside_the_plan(golden):
    df = golden.latest_facts()
    assert re.search(r"PartitionFilters: \[[^]]*Subquery", plan_of(df)) and df.count() == 9


def test_metrics_read_no_clock():
    root = pathlib.Path(snapledger.__file__).parent
    for path in [*root.glob("operators/*.py"), *root.glob("functions/*.py")]:
        if path.name == "ingest.py":
            continue  # audit stamps only
        assert not re.search(r"current_date|current_timestamp|\bnow\(|datetime\.now|today\(", path.read_text()), path


def test_no_local_checkpoints_or_unbounded_collects():
    root = pathlib.Path(snapledger.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" in path.parts:
            continue  # tested with that package
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text and ".toPandas(" not in text
        if path.name not in ("ingest.py", "warehouse.py", "file_drop.py"):
            assert ".collect()" not in text, path


def scans(spark, name: str) -> int:
    """Reads of orders in the initial plan, scalar subqueries not counted twice."""
    return plan_of(QUERIES[name].build(spark, SF)).split("Subqueries")[0].count("FileScan parquet")


@pytest.mark.parametrize("name,most", [
    ("all_findings", 2), ("pack_findings", 2), ("pack_counts", 4), ("severity_counts", 2), ("findings_matrix", 2), ("drift_report", 2), ("dimension_counts", 2),
    ("finding_ids", 2), ("validation_counts", 1), ("gate_files", 2), ("validation_preview", 2), ("ri_03", 3), ("ingest_report", 3), ("quality_summary", 3),
    ("retention_plan", 6), ("dq_03", 1), ("dq_09", 1),
])
def test_rules_read_their_input_once(spark, name, most):
    assert scans(spark, name) <= most
