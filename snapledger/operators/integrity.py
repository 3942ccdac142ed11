"""Reconciliation and referential-integrity checks over all runs at once.

Each returns the violating keys; an empty result means the check holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.operators.metrics import ADDITIVE, counts

_SUMS_AGREE = " and ".join(f"sum_{c} <=> all_{c}" for c in ADDITIVE)
_COUNTS_AGREE = (
    "source_row_count = valid_row_count + invalid_row_count"
    " and valid_row_count = coalesce(raw_rows, 0) and valid_row_count = coalesce(fact_rows, 0)"
)


def _rows_per_run(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))


def count_mismatches(runs: DataFrame, raw: DataFrame, facts: DataFrame) -> DataFrame:
    """DQ-10: runs whose source, valid, raw and fact counts do not agree.

    Both tables fold to one row per run before they are joined. As in three-valued logic, a run
    with unknown counts is not reported.
    """
    sized = (
        runs.join(_rows_per_run(raw, "raw_rows"), "run_id", "left")
        .join(_rows_per_run(facts, "fact_rows"), "run_id", "left")
    )
    return sized.where(f"not ({_COUNTS_AGREE})").select("run_id")


def _rollup(facts: DataFrame) -> DataFrame:
    """Per run: sum_* over projects and all_* of the run itself, from one pass."""
    grouped = facts.groupingSets(
        [[F.col("run_id"), F.col("project_name")], [F.col("run_id")]], "run_id", "project_name"
    ).agg(F.grouping("project_name").alias("is_total"), *counts())
    return grouped.groupBy("run_id").agg(
        *[F.expr(f"sum(if(is_total = 0, {c}, null)) as sum_{c}") for c in ADDITIVE],
        *[F.expr(f"max(if(is_total = 1, {c}, null)) as all_{c}") for c in ADDITIVE],
    )


def rollup_mismatches(facts: DataFrame) -> DataFrame:
    """Runs where the five counts summed over projects differ from the run's own counts."""
    return _rollup(facts).where(f"not ({_SUMS_AGREE})").select("run_id")


def restatement_problems(facts: DataFrame, restated: DataFrame) -> DataFrame:
    """(run_id, missing, added, repeated) of runs whose restated facts are not the same actions, each once.

    Rows of both sides fold by key in one aggregation.
    """
    sides = facts.select("run_id", "action_id", F.lit(0).alias("new")).unionByName(
        restated.select("run_id", "action_id", F.lit(1).alias("new")))
    keys = sides.groupBy("run_id", "action_id").agg(
        F.count_if(F.col("new") == 0).alias("before"), F.count_if(F.col("new") == 1).alias("after"))
    sized = keys.groupBy("run_id").agg(
        F.expr("count_if(after = 0) as missing"), F.expr("count_if(before = 0) as added"), F.expr("count_if(after > 1) as repeated"))
    return sized.where("missing + added + repeated > 0")


def load_problems(expected: DataFrame, raw: DataFrame, facts: DataFrame) -> DataFrame:
    """(run_id, counts_differ, sums_differ, raw_key_repeats, fact_key_repeats) of freshly loaded runs where a check fails.

    DQ-10, the roll-up, and the primary keys of both tables (RI-05 for the facts). Rows of both tables fold by key in
    one aggregation, which also counts them.
    """
    parts = expected.unionByName(_keyed_counts(raw, facts), allowMissingColumns=True).unionByName(
        _rollup(facts), allowMissingColumns=True
    )
    sized = parts.groupBy("run_id").agg(
        *[F.expr(f"max({c}) as {c}") for c in parts.columns if c != "run_id"]
    )
    out = sized.withColumnRenamed("all_total_actions", "fact_rows").selectExpr(
        "run_id", f"not ({_COUNTS_AGREE}) as counts_differ",
        f"not ({_SUMS_AGREE.replace('all_total_actions', 'fact_rows')}) as sums_differ",
        "coalesce(raw_repeats, 0) > 0 as raw_key_repeats", "coalesce(fact_repeats, 0) > 0 as fact_key_repeats",
    )
    return out.where("counts_differ or sums_differ or raw_key_repeats or fact_key_repeats")


def _keyed_counts(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """Per run: raw_rows, and the rows of either table beyond the first of their primary key."""
    keyed = raw.select("run_id", F.lit("raw").alias("side"), F.col("source_row_number").cast("string").alias("key")).unionByName(
        facts.select("run_id", F.lit("fact").alias("side"), F.col("action_id").alias("key")))
    per_key = keyed.groupBy("run_id", "side", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("run_id").agg(
        F.sum(F.when(F.col("side") == "raw", F.col("n"))).alias("raw_rows"),
        *[F.sum(F.when(F.col("side") == side, F.col("n") - 1)).alias(f"{side}_repeats") for side in ("raw", "fact")],
    )


def rollup_by_run(facts: DataFrame) -> DataFrame:
    """Both sides of the roll-up comparison per run and count, with their equality."""
    grouped = facts.groupingSets(
        [[F.col("run_id"), F.col("project_name")], [F.col("run_id")]], "run_id", "project_name"
    ).agg(F.grouping("project_name").alias("is_total"), *counts())
    long = grouped.select(
        "run_id", "is_total",
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in ADDITIVE]), F.array(*[F.col(c) for c in ADDITIVE])
        )).alias("metric", "value"),
    )
    sides = long.groupBy("run_id", "metric").agg(
        F.sum(F.when(F.col("is_total") == 0, F.col("value"))).alias("sum_of_projects"),
        F.max(F.when(F.col("is_total") == 1, F.col("value"))).alias("portfolio"),
    )
    return sides.withColumn("agrees", F.col("sum_of_projects") == F.col("portfolio"))


def facts_without_success(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """RI-01: run ids in the facts whose run is missing or did not succeed."""
    ok = runs.where(F.col("status") == "succeeded").select("run_id")
    return facts.select("run_id").distinct().join(ok, "run_id", "left_anti")


def facts_without_raw(facts: DataFrame, raw: DataFrame) -> DataFrame:
    """RI-02: (run_id, action_id) of facts that no raw row has.

    Both sides fold to distinct keys and meet in one aggregation, so a repeated key moves once
    per task instead of meeting itself in a join.
    """
    sides = facts.select("run_id", "action_id", F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(
        raw.select("run_id", "action_id", F.lit(0).alias("f"), F.lit(1).alias("r"))
    )
    keys = sides.groupBy("run_id", "action_id").agg(F.max("f").alias("f"), F.max("r").alias("r"))
    return keys.where("f = 1 and r = 0").select("run_id", "action_id")


def findings_without_run(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """RI-03: one row per finding whose run does not exist."""
    return findings.select("run_id").join(runs.select("run_id"), "run_id", "left_anti")


def summaries_without_run(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """RI-04: summaries whose source run does not exist."""
    known = runs.select(F.col("run_id").alias("source_run_id"))
    return summaries.select("summary_id", "source_run_id").join(
        known, "source_run_id", "left_anti"
    ).select("summary_id")


def repeated_fact_keys(facts: DataFrame) -> DataFrame:
    """RI-05: (run_id, action_id) that occur more than once in the facts."""
    keys = facts.groupBy("run_id", "action_id").agg(F.count(F.lit(1)).alias("n"))
    return keys.where("n > 1").select("run_id", "action_id")
