"""One id, owner, project or run holding a third of all rows changes neither results nor task bounds."""

import pytest
from pyspark.sql import functions as F

from snapledger.operators import integrity, metrics, rules, staging

N = 60_000


@pytest.fixture(scope="module")
def hot_rows(spark):
    """Run 1 and id 'HOT' each hold about a third of the rows."""
    return spark.range(0, N, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(2 + F.col("id") % 5).cast("long").alias("run_id"),
        (F.col("id") + 1).cast("int").alias("source_row_number"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("A"), "id")).alias("action_id"),
        F.lit("P").alias("project_name"), F.lit("n").alias("action_name"),
        F.when(F.col("id") % 3 == 0, F.lit("boss")).otherwise(F.concat(F.lit("O"), F.col("id") % 50)).alias("owner"),
        F.lit("2026-01-01").alias("due_date_raw"),
        F.when(F.col("id") % 7 == 0, F.lit("odd")).otherwise(F.lit("todo")).alias("status"),
        F.lit(6).alias("field_count"), F.lit(6).alias("header_count"),
    )


def test_a_hot_duplicate_id(hot_rows):
    (dup,) = rules.duplicate_ids(hot_rows).collect()
    assert (dup.run_id, dup.action_id, dup.n) == (1, "HOT", N // 3)
    assert dup.first_rows == [1 + 3 * i for i in range(20)]
    counts = {r.run_id: r.invalid_row_count for r in rules.validation_counts(hot_rows).collect()}
    assert counts.pop(1) == N // 3 and set(counts.values()) == {0}
    assert rules.unknown_statuses(hot_rows).count() == 6


def test_a_hot_id_is_cut_before_it_moves_and_listed_whole_elsewhere(hot_rows):
    plan = rules.duplicate_ids(hot_rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # on both sides of the exchange
    members = rules.duplicate_members(hot_rows)
    assert members.where("action_id = 'HOT'").count() == N // 3


def test_hot_groups_in_metrics_and_integrity(spark, hot_rows):
    raw = hot_rows.select("run_id", "action_id", "project_name", "action_name", "owner", "due_date_raw", "status")
    runs = spark.range(1, 7).select(F.col("id").alias("run_id"), F.to_date(F.lit("2026-06-01")).alias("reference_date"))
    facts = staging.stage(raw, runs)
    row = metrics.portfolio(facts).first()
    assert (row.total_actions, row.overdue_actions, row.owners_with_overdue_actions) == (N, N, 51)
    owners = metrics.by_owner(facts).first()
    assert tuple(owners) == ("boss", N // 3)
    assert integrity.facts_without_raw(facts, raw).isEmpty()
    assert [tuple(r) for r in integrity.repeated_fact_keys(facts).collect()] == [(1, "HOT")]
