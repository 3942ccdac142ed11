"""Run ledger: folding events, choosing runs, planning loads, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.operators import rules
from snapledger.schemas import INGESTION_RUNS, SEVERITIES

RUN_COLUMNS = tuple(INGESTION_RUNS.names)


def run_state(events: DataFrame) -> DataFrame:
    """One row per run: its last event. Folded before the shuffle."""
    payload = F.struct(*[c for c in RUN_COLUMNS if c != "run_id"])
    last = events.groupBy("run_id").agg(F.max_by(payload, F.col("event_seq")).alias("s"))
    return last.select("run_id", "s.*")


def succeeded(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "succeeded")


def latest_run(runs: DataFrame) -> DataFrame:
    """Highest successful run id in one row; NULL when there is none yet."""
    return succeeded(runs).agg(F.max("run_id").alias("run_id"))


def of_latest_run(df: DataFrame, runs: DataFrame, column: str = "run_id") -> DataFrame:
    """Rows of the latest successful run, by a scalar subquery that prunes partitions."""
    return df.where(F.col(column) == latest_run(runs).scalar())


def latest_attempt(runs: DataFrame) -> DataFrame:
    """The newest run whatever its status."""
    return runs.orderBy(F.desc("run_id")).limit(1)


def run_info(runs: DataFrame) -> DataFrame:
    """The latest successful run with its dates as text; no row when there is none."""
    row = of_latest_run(runs, runs)
    dates = {"reference_date": "yyyy-MM-dd"}
    stamps = {c: "yyyy-MM-dd'T'HH:mm:ss" for c in ("started_at", "completed_at")}
    return row.withColumns({c: F.date_format(c, f) for c, f in {**dates, **stamps}.items()})


def visible(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of successful runs only; whatever a failed load left behind stays unseen."""
    return df.join(succeeded(runs).select("run_id"), "run_id", "left_semi")


def idempotency_plan(incoming: DataFrame, runs: DataFrame) -> DataFrame:
    """Per incoming file: no-op with the old run id, or load.

    `incoming` has source_file, source_hash, reference_date. Only successful runs short-circuit;
    they fold to one row per (hash, reference date) first.
    """
    done = succeeded(runs).groupBy("source_hash", "reference_date").agg(
        F.max("run_id").alias("prior_run_id")
    )
    return incoming.join(done, ["source_hash", "reference_date"], "left").withColumn(
        "action", F.when(F.col("prior_run_id").isNotNull(), F.lit("noop")).otherwise(F.lit("load"))
    )


def latest_config(entries: DataFrame) -> DataFrame:
    """Last value per key; of values written at one time the greatest."""
    last = entries.groupBy("config_key").agg(
        F.max(F.struct("updated_at", "config_value")).alias("s")
    )
    return last.select("config_key", "s.config_value", "s.updated_at")


def attempts_by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_distinct("reference_date").alias("reference_dates"),
    )


def ingest_report(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per run: status, row counts and findings by severity (zero when there are none)."""
    per_run = rules.by_severity(findings, [f"{s}_findings" for s in SEVERITIES])
    joined = runs.join(per_run, "run_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "run_id", "status", "source_row_count", "valid_row_count", "invalid_row_count",
        *[
            F.coalesce(F.col(f"{s}_findings"), zero).alias(f"{s}_findings")
            for s in ("blocking", "warning", "investigation")
        ],
    )
