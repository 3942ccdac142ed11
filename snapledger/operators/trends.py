"""Cross-run comparisons and freshness conditions.

All input is ledger-sized: one row per run, already aggregated. The windows below order those
rows, never facts. Thresholds are parameters; None means the rule is off and never fires.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.time import hours_between, ntz
from snapledger.operators.runs import succeeded


def overdue_per_run(facts: DataFrame) -> DataFrame:
    return facts.groupBy("run_id").agg(F.count_if("is_overdue").alias("overdue_actions"))


def _fires(measure: Column, threshold: float | None) -> Column:
    if threshold is None:
        return F.lit(False)
    return F.coalesce(F.abs(measure) > F.lit(threshold), F.lit(False))


def change_from_previous(series: DataFrame, value: str) -> DataFrame:
    """Add previous_value, change and change_pct against the run before (by run id)."""
    prev = F.lag(value).over(Window.orderBy("run_id"))
    out = series.withColumn("previous_value", prev)
    change = F.col(value) - F.col("previous_value")
    pct = F.when(F.col("previous_value") != 0, change * 100.0 / F.col("previous_value"))
    return out.withColumn("change", change).withColumn("change_pct", F.round(pct, 6))


def volume_change(runs: DataFrame, threshold_pct: float | None = None) -> DataFrame:
    """AN-01: change of the source row count against the previous successful run, in percent."""
    series = succeeded(runs).select("run_id", F.col("source_row_count").cast("bigint").alias("source_row_count"))
    out = change_from_previous(series, "source_row_count")
    return out.withColumn("fires", _fires(F.col("change_pct"), threshold_pct))


def overdue_change(runs: DataFrame, facts: DataFrame, threshold: float | None = None) -> DataFrame:
    """AN-02: change of the overdue count against the previous successful run."""
    series = succeeded(runs).select("run_id").join(overdue_per_run(facts), "run_id", "left")
    series = series.withColumn("overdue_actions", F.coalesce("overdue_actions", F.lit(0).cast("bigint")))
    out = change_from_previous(series, "overdue_actions").drop("change_pct")
    return out.withColumn("fires", _fires(F.col("change"), threshold))


def rolling_deviation(
    series: DataFrame, value: str, window: int, sigmas: float | None = None
) -> DataFrame:
    """AN-03: distance from the mean of the `window` runs before, in their standard deviations."""
    before = Window.orderBy("run_id").rowsBetween(-window, -1)
    out = series.withColumns(
        {
            "rolling_mean": F.round(F.avg(value).over(before), 6),
            "rolling_std": F.round(F.stddev_samp(value).over(before), 6),
            "runs_before": F.count(value).over(before),
        }
    )
    full = (F.col("runs_before") == window) & (F.col("rolling_std") > 0)
    score = F.when(full, (F.col(value) - F.col("rolling_mean")) / F.col("rolling_std"))
    out = out.withColumn("deviation", F.round(score, 4)).drop("runs_before")
    return out.withColumn("fires", _fires(F.col("deviation"), sigmas))


def stale_success(runs: DataFrame, as_of: datetime, tolerance_hours: float | None = None) -> DataFrame:
    """AL-01: age of the latest successful run at a given time; one row, never the clock."""
    last = succeeded(runs).agg(F.max_by("completed_at", "run_id").alias("completed_at"))
    age = hours_between(F.col("completed_at"), ntz(as_of))
    aged = last.select("completed_at", age.alias("age_hours"))
    return aged.withColumn("fires", _fires(F.col("age_hours"), tolerance_hours))


def unresolved_failure(runs: DataFrame) -> DataFrame:
    """AL-02: the newest failed run with no success after it; one row."""
    state = runs.agg(
        F.max(F.when(F.col("status") == "failed", F.col("run_id"))).alias("last_failed"),
        F.max(F.when(F.col("status") == "succeeded", F.col("run_id"))).alias("last_succeeded"),
    )
    open_failure = F.col("last_failed") > F.coalesce("last_succeeded", F.lit(-1).cast("bigint"))
    return state.withColumn("fires", F.coalesce(open_failure, F.lit(False)))


def no_success_yet(runs: DataFrame) -> DataFrame:
    """AL-03: no successful run at all; one row."""
    seen = runs.agg(F.count_if(F.col("status") == "succeeded").alias("succeeded_runs"))
    return seen.withColumn("fires", F.col("succeeded_runs") == 0)


# Datasets with their criticality class.
FRESHNESS_REGISTER = (
    ("FR-01", "ingestion_runs:latest", "P0"),
    ("FR-02", "stg_actions", "P0"),
    ("FR-03", "raw_actions", "P1"),
    ("FR-04", "ingestion_runs+data_quality_results", "P1"),
    ("FR-05", "executive_summaries", "P2"),
)


def freshness_report(runs: DataFrame, summaries: DataFrame, as_of: datetime) -> DataFrame:
    """Age of each registered dataset at `as_of`, with its criticality."""
    def age(col: Column) -> Column:
        return hours_between(col, ntz(as_of))

    load = succeeded(runs).agg(F.max_by("completed_at", "run_id").alias("c")).select(age(F.col("c")))
    tried = runs.agg(F.max("started_at").alias("c")).select(age(F.col("c")))
    drafted = summaries.agg(F.max("created_at").alias("c")).select(age(F.col("c")))
    ages = {"FR-04": tried, "FR-05": drafted}
    spark = runs.sparkSession
    rows = spark.createDataFrame(list(FRESHNESS_REGISTER), "sla_id string, dataset string, criticality string")
    value = load.scalar()
    for sla, df in ages.items():
        value = F.when(F.col("sla_id") == sla, df.scalar()).otherwise(value)
    return rows.withColumn("age_hours", value)
