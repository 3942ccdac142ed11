"""Portfolio, group, owner and detail metrics over staged facts.

Nothing here reads a clock: all dates are properties of the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import is_blank, is_real_iso_date
from snapledger.schemas import ALL_PROJECTS, TEXT_COLUMNS

DETAIL_COLUMNS = (
    "action_id", "project_name", "action_name", "owner", "due_date", "status", "days_overdue",
)
ADDITIVE = (
    "total_actions", "completed_actions", "open_actions", "overdue_actions",
    "open_not_overdue_actions",
)


def scope_name(project: str | None) -> str | None:
    """The project a scope is limited to; the label of the whole portfolio names none."""
    if project is not None and type(project) is not str:
        raise TypeError(f"a scope is named by text, not by {type(project).__name__}")
    return {ALL_PROJECTS: None}.get(project, project)


def in_scope(facts: DataFrame, project: str | None = None, run_id: int | None = None) -> DataFrame:
    """Restrict to a project and/or a run. The name is a literal, never part of SQL text."""
    name = scope_name(project)
    if run_id is not None:
        facts = facts.where(F.col("run_id") == F.lit(run_id))
    return facts if name is None else facts.where(F.col("project_name") == F.lit(name))


def counts() -> list[Column]:
    """The five additive counts."""
    return [
        F.count(F.lit(1)).alias("total_actions"),
        F.count_if("is_completed").alias("completed_actions"),
        F.count_if("is_open").alias("open_actions"),
        F.count_if("is_overdue").alias("overdue_actions"),
        F.count_if(F.col("is_open") & ~F.col("is_overdue")).alias("open_not_overdue_actions"),
    ]


def owners_late() -> Column:
    """Exact distinct owners with at least one overdue action; not additive over groups."""
    return F.count_distinct(F.when(F.col("is_overdue"), F.col("owner"))).alias(
        "owners_with_overdue_actions"
    )


def rate(done: str = "completed_actions", total: str = "total_actions") -> Column:
    """Completion rate with a zero for an empty scope."""
    return (
        F.when(F.col(total) == 0, F.lit(0.0))
        .otherwise(F.col(done).cast("double") / F.col(total))
        .alias("completion_rate")
    )


def portfolio(facts: DataFrame, project: str | None = None, run_id: int | None = None) -> DataFrame:
    """Always one row, also for an empty scope."""
    return in_scope(facts, project, run_id).agg(*counts(), owners_late()).select("*", rate())


def by(facts: DataFrame, dims: Sequence[str], owners: bool = False) -> DataFrame:
    """The counts and the rate per group of any of the fact's dimensions."""
    extra = [owners_late()] if owners else []
    return facts.groupBy(*dims).agg(*counts(), *extra).select("*", rate())


def by_project(facts: DataFrame, project: str | None = None, run_id: int | None = None) -> DataFrame:
    return by(in_scope(facts, project, run_id), ["project_name"]).orderBy("project_name")


def by_owner(facts: DataFrame, project: str | None = None, run_id: int | None = None) -> DataFrame:
    """Overdue actions per owner; owners without any are not listed."""
    late = in_scope(facts, project, run_id).where("is_overdue")
    per_owner = late.groupBy("owner").agg(F.count(F.lit(1)).alias("overdue_actions"))
    return per_owner.orderBy(F.desc("overdue_actions"), "owner")


def top_owners(facts: DataFrame, n: int, project: str | None = None) -> DataFrame:
    """The first n owners of by_owner; a negative n gives none."""
    return by_owner(facts, project).limit(max(n, 0))


def overdue_rows(facts: DataFrame, project: str | None = None, run_id: int | None = None) -> DataFrame:
    return in_scope(facts, project, run_id).where("is_overdue").select(*DETAIL_COLUMNS)


def detail_order() -> list[Column]:
    """Most overdue first; the action id breaks ties, so the order is total."""
    return [F.desc("days_overdue"), F.asc("due_date"), F.asc("action_id")]


def overdue_detail(
    facts: DataFrame, project: str | None = None, owner: str | None = None,
    run_id: int | None = None,
) -> DataFrame:
    """Overdue rows in total order, optionally of one owner inside the scope."""
    rows = overdue_rows(facts, project, run_id)
    if owner is not None:
        rows = rows.where(F.col("owner") == F.lit(owner))
    return rows.orderBy(*detail_order())


def top_overdue(facts: DataFrame, n: int = 10, project: str | None = None) -> DataFrame:
    return overdue_detail(facts, project).limit(n)


def max_days_overdue(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.coalesce(F.max(F.when(F.col("is_overdue"), F.col("days_overdue"))), F.lit(0)).alias(
            "max_days_overdue"
        )
    )


def list_projects(facts: DataFrame) -> DataFrame:
    return facts.select("project_name").distinct().orderBy("project_name")


def project_options(facts: DataFrame) -> DataFrame:
    """The "all" label first, then each non-empty project once, in name order."""
    names = facts.select(F.col("project_name").alias("label")).distinct()
    names = names.where((F.col("label") != "") & (F.col("label") != ALL_PROJECTS))
    first = facts.sparkSession.range(1).select(F.lit(ALL_PROJECTS).alias("label"))
    both = first.withColumn("section", F.lit(0)).unionByName(names.withColumn("section", F.lit(1)))
    return both.orderBy("section", "label").select("section", "label")


def snapshot_profile(rows: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows, statuses, distinct projects/owners, date range, duplicate ids and blanks per run.

    Duplicate ids are counted from per-id partial counts, so a hot id is folded before it moves.
    """
    blanks = sum((is_blank(c).cast("int") for c in TEXT_COLUMNS[1:]), is_blank("action_id").cast("int"))
    due = F.when(
        is_real_iso_date("due_date_raw"), F.try_to_date("due_date_raw", "yyyy-MM-dd")
    )
    main = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("status") == "done").alias("status_done"),
        F.count_if(F.col("status") == "in_progress").alias("status_in_progress"),
        F.count_if(F.col("status") == "todo").alias("status_todo"),
        F.count_distinct("project_name").alias("projects"),
        F.count_distinct("owner").alias("owners"),
        F.min(due).alias("first_due_date"),
        F.max(due).alias("last_due_date"),
        F.sum(blanks).alias("blank_fields"),
    )
    ids = rows.where(~is_blank("action_id")).groupBy(*keys, "action_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    dups = ids.groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    return main.join(dups, list(keys), "left").withColumn(
        "duplicate_ids", F.coalesce("duplicate_ids", F.lit(0).cast("bigint"))
    )
