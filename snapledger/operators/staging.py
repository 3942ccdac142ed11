"""Raw projection and the only place where the date-relative flags are derived."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger import schemas
from snapledger.functions.time import ntz

# Version of facts as they were loaded.
ORIGINAL = "original"

FACT_COLUMNS = (
    "run_id", "action_id", "project_name", "action_name", "owner", "due_date", "status",
    "is_completed", "is_open", "is_overdue", "days_overdue",
)


def raw_rows(rows: DataFrame, loaded_at: datetime | Column) -> DataFrame:
    """Validated input rows as raw rows: values untouched, due date still text."""
    return rows.select(
        "run_id", *schemas.TEXT_COLUMNS, "source_row_number",
        ntz(loaded_at).alias("loaded_at"),
    )


def parse_due_date(rows: DataFrame, column: str = "due_date_raw") -> DataFrame:
    """Strict ISO parse; a bad value raises because validation already refused such files."""
    return rows.withColumn("due_date", F.to_date(F.col(column), "yyyy-MM-dd"))


def with_flags(rows: DataFrame, reference_date: date | Column) -> DataFrame:
    """Add is_completed, is_open, is_overdue, days_overdue relative to a given date.

    A due date equal to the reference date is not overdue. Unknown statuses are open.
    """
    ref = reference_date if isinstance(reference_date, Column) else F.lit(reference_date)
    is_open = F.col("status") != "done"
    late = is_open & (F.col("due_date") < ref)
    return rows.withColumns(
        {
            "is_completed": F.col("status") == "done",
            "is_open": is_open,
            "is_overdue": late,
            "days_overdue": F.when(late, F.datediff(ref, F.col("due_date"))).otherwise(F.lit(0)),
        }
    )


def stage(raw: DataFrame, runs: DataFrame) -> DataFrame:
    """Facts of every run present in `raw`, each against its own run's reference date.

    The ledger side has one row per run. No broadcast hint: Spark broadcasts it when its size is
    under the session threshold and otherwise splits hot runs in the sort-merge join.
    """
    dated = parse_due_date(raw).join(runs.select("run_id", "reference_date"), "run_id")
    return with_flags(dated, F.col("reference_date")).select(
        *FACT_COLUMNS, *[c for c in ("loaded_at",) if c in raw.columns]
    )


def restate(raw: DataFrame, runs: DataFrame, definition_version: str, inclusive: bool) -> DataFrame:
    """Rebuild old facts from raw under a changed definition, kept beside the old ones.

    `inclusive` treats a due date equal to the reference date as overdue already.
    """
    shift = 1 if inclusive else 0
    dated = parse_due_date(raw).join(runs.select("run_id", "reference_date"), "run_id")
    moved = with_flags(dated, F.date_add(F.col("reference_date"), shift))
    days = F.when(F.col("is_overdue"), F.datediff("reference_date", "due_date")).otherwise(0)
    return moved.withColumn("days_overdue", days).select(
        *FACT_COLUMNS, F.lit(definition_version).alias("definition_version")
    )


def with_versions(facts: DataFrame, restated: DataFrame, restatements: DataFrame) -> DataFrame:
    """Old facts, as version `ORIGINAL`, and the restated ones side by side; restatements that never ended stay unseen."""
    old = facts.select(*FACT_COLUMNS, F.lit(ORIGINAL).alias("definition_version"))
    done = restatements.select("run_id", "definition_version").distinct()
    return old.unionByName(restated.select(*old.columns).join(done, ["run_id", "definition_version"], "left_semi"))


def as_version(facts: DataFrame, restated: DataFrame, restatements: DataFrame, version: str) -> DataFrame:
    """Each run once: under `version` where it was restated so, else as it was loaded.

    The version is a literal on a partition column and the ledger has a row per run, so only folders in use are read.
    """
    if version == ORIGINAL:
        return facts.select(*FACT_COLUMNS, F.lit(ORIGINAL).alias("definition_version"))
    of_version = F.col("definition_version") == F.lit(version)
    done = restatements.where(of_version).select("run_id").distinct()
    return with_versions(facts.join(done, "run_id", "left_anti"), restated.where(of_version), restatements.where(of_version))


def sweep_reference_dates(snapshot: DataFrame, dates: Sequence[date]) -> DataFrame:
    """Portfolio counts of one snapshot for several reference dates.

    Rows are first folded to (due date, completed, owner) counts, so only those groups are
    repeated per date, never the snapshot itself.
    """
    folded = snapshot.groupBy(
        "due_date", (F.col("status") == "done").alias("is_completed"), "owner"
    ).agg(F.count(F.lit(1)).alias("n"))
    dated = folded.withColumn("reference_date", F.explode(F.array(*[F.lit(d) for d in dates])))
    late = ~F.col("is_completed") & (F.col("due_date") < F.col("reference_date"))
    days = F.when(late, F.datediff("reference_date", "due_date"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))

    return dated.groupBy("reference_date").agg(
        F.sum("n").alias("total_actions"),
        total(F.col("is_completed")).alias("completed_actions"),
        total(~F.col("is_completed")).alias("open_actions"),
        total(late).alias("overdue_actions"),
        total(~F.col("is_completed") & ~late).alias("open_not_overdue_actions"),
        F.count_distinct(F.when(late, F.col("owner"))).alias("owners_with_overdue_actions"),
        F.coalesce(F.max(days), F.lit(0)).alias("max_days_overdue"),
    )
