"""Datasets behind charts, KPI rows, the quality summary and the context document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import (
    is_blank,
    render_count,
    render_percent,
    sanitize,
    with_draft_label,
)
from snapledger.operators import metrics, rules, runs as ledger
from snapledger.schemas import SEVERITIES

DEFAULT_TOP_N = 10
CONTEXT_FIELDS = (
    "action_id", "project_name", "action_name", "owner", "due_date", "days_overdue",
)
FREE_TEXT_FIELDS = ("action_name", "owner", "project_name")
CHART_METRICS = ("total_actions", "completed_actions", "overdue_actions", "completion_rate")
COMPOSITION = ("completed_actions", "open_not_overdue_actions", "overdue_actions")


def rows_shown(wanted: str | int | None = None) -> int:
    """`wanted` where it spells a whole number above zero, else the default."""
    digits = f"{wanted}".strip().lstrip("0")
    return int(digits) if digits.isascii() and digits.isdigit() else DEFAULT_TOP_N


# --- charts and cards ------------------------------------------------------------------------


def _long(groups: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ]
    return groups.select(key, F.inline(F.array(*pairs)))


def chart_series(by_project: DataFrame, names: Sequence[str] = CHART_METRICS) -> DataFrame:
    """(metric, project_name, value), highest first within a metric, names break ties."""
    long = _long(by_project, "project_name", names).withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )
    return long.orderBy("metric", F.desc("value"), "project_name")


def composition(by_project: DataFrame) -> DataFrame:
    """The three parts of each project, larger projects first."""
    pairs = [F.struct(F.lit(n).alias("part"), F.col(n).alias("value")) for n in COMPOSITION]
    long = by_project.select("project_name", "total_actions", F.inline(F.array(*pairs)))
    return long.orderBy(F.desc("total_actions"), "project_name", "part")


def scope_state(run_id: Column, portfolio: DataFrame) -> DataFrame:
    """Which message a scope shows: no run, no data, no overdue work, or its numbers."""
    state = (
        F.when(run_id.isNull(), "no_run")
        .when(F.col("total_actions") == 0, "no_data")
        .when(F.col("overdue_actions") == 0, "no_overdue")
        .otherwise("ok")
    )
    return portfolio.select("total_actions", "overdue_actions", state.alias("state"))


def kpi_row(portfolio: DataFrame) -> DataFrame:
    """Rendered KPI texts; the rate of an empty scope is '-' and not 0%."""
    shown_rate = F.when(F.col("total_actions") > 0, F.col("completion_rate"))
    return portfolio.select(
        *[render_count(c).alias(c) for c in
          ("total_actions", "completed_actions", "open_actions", "overdue_actions")],
        render_percent(shown_rate).alias("completion_rate"),
    )


def overdue_kpis(portfolio: DataFrame) -> DataFrame:
    return portfolio.select(
        *[render_count(c).alias(c) for c in ("overdue_actions", "owners_with_overdue_actions")]
    )


# --- quality summary -------------------------------------------------------------------------


def findings_of_run(findings: DataFrame, run_id: Column) -> DataFrame:
    """Findings of one run by check and id."""
    ids = rules.with_result_ids(findings) if "quality_result_id" not in findings.columns else findings
    return ids.where(F.col("run_id") == run_id).orderBy("check_name", "quality_result_id").select(
        "quality_result_id", "check_name", "record_key", "severity_class", "message"
    )


def _one(row: DataFrame, name: str) -> Column:
    """A one-row result as a struct column, through a scalar subquery."""
    return row.select(F.struct("*")).scalar().alias(name)


def quality_summary(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: latest successful run, latest attempt, findings of the run by severity.

    `findings` are stored ones, or counts by run, check and severity. The ledger is read once.
    """
    stored = "findings" not in findings.columns  # only the run's folder is read
    found = rules.by_severity(ledger.of_latest_run(findings, runs) if stored else findings)
    ok = F.when(F.col("status") == "succeeded", F.col("run_id"))
    return runs.join(found, "run_id", "left").agg(
        F.max(ok).alias("run_id"),
        *[F.max_by(c, ok).alias(c) for c in ("reference_date", "source_row_count", "valid_row_count", "invalid_row_count")],
        F.max("run_id").alias("latest_attempt_run_id"), F.max_by("status", "run_id").alias("latest_attempt_status"),
        *[F.coalesce(F.max_by(s, ok), F.lit(0).cast("bigint")).alias(s) for s in SEVERITIES],
    )


# --- context document ------------------------------------------------------------------------


def context_rows(facts: DataFrame, n: int = DEFAULT_TOP_N, project: str | None = None) -> DataFrame:
    """Top overdue rows with only the allowed fields, free text sanitised."""
    top = metrics.top_overdue(facts, n, project)
    return top.select(
        *[sanitize(c).alias(c) if c in FREE_TEXT_FIELDS else F.col(c) for c in CONTEXT_FIELDS]
    )


def _sorted_structs(fields: Sequence[str], order: Sequence[Column]) -> Column:
    """Array of structs in the order of the leading sort keys, keys dropped again."""
    keyed = F.struct(
        *[k.alias(f"k{i}") for i, k in enumerate(order)],
        F.struct(*[F.col(f) for f in sorted(fields)]).alias("v"),
    )
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"])


def context_document(
    facts: DataFrame, runs: DataFrame, n: int | str | None = None, project: str | None = None
) -> DataFrame:
    """One row with portfolio, projects, top overdue rows and totals of the latest success.

    No row when there is no successful run. The arrays hold one entry per project and at most
    n rows; fields are in name order, as the JSON form needs them.
    """
    size = rows_shown(n)
    name = metrics.scope_name(project) or None
    run = ledger.of_latest_run(runs, runs).select("run_id", "reference_date")
    current = ledger.of_latest_run(facts, runs)
    totals = metrics.portfolio(current, project)
    groups = metrics.by(metrics.in_scope(current, project), ["project_name"]).withColumn(
        "project_name", sanitize("project_name")
    )
    projects = groups.agg(
        _sorted_structs(groups.columns, [F.col("project_name")]).alias("projects")
    )
    top = context_rows(current, size, project).withColumn(
        "due_date", F.date_format("due_date", "yyyy-MM-dd")
    )
    rows = top.agg(
        _sorted_structs(
            CONTEXT_FIELDS, [-F.col("days_overdue"), F.col("due_date"), F.col("action_id")]
        ).alias("top_overdue_actions")
    )
    totals = totals.select(*sorted(totals.columns))
    doc = run.select(
        "*", _one(totals, "portfolio"), projects.scalar().alias("projects"),
        rows.scalar().alias("top_overdue_actions"),
    )
    return doc.select(
        F.col("portfolio.overdue_actions").alias("overdue_total"),
        "portfolio",
        F.lit(name).cast("string").alias("project_filter"),
        "projects",
        F.date_format("reference_date", "yyyy-MM-dd").alias("reference_date"),
        F.col("run_id").alias("source_run_id"),
        F.lit(size).alias("top_n"),
        "top_overdue_actions",
    )


def context_json(document: DataFrame) -> DataFrame:
    """The document as one JSON text with keys in name order and NULLs kept."""
    body = F.struct(*sorted(document.columns))
    return document.select(
        "source_run_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload")
    )


# --- saved drafts ----------------------------------------------------------------------------


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """Newest draft per project filter; no filter is its own group. Folded before the shuffle."""
    newest = F.struct("created_at", "summary_id")
    payload = F.struct(*[c for c in summaries.columns if c != "project_filter"])
    last = summaries.groupBy("project_filter").agg(F.max_by(payload, newest).alias("s"))
    return last.select("project_filter", "s.*")


def latest_summary(summaries: DataFrame, project: str | None = None) -> DataFrame:
    """The newest draft written for exactly this filter; None means the one for all projects."""
    same = F.col("project_filter").eqNullSafe(F.lit(metrics.scope_name(project)))
    return summary_history(summaries.where(same), 1)


def summary_history(summaries: DataFrame, limit: int = 10) -> DataFrame:
    return summaries.orderBy(F.desc("created_at"), F.desc("summary_id")).limit(limit)


def stale_summaries(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Drafts with a flag telling whether their run is no longer the latest success."""
    latest = ledger.latest_run(runs).scalar()
    return summaries.select(
        "summary_id", "project_filter", "source_run_id", latest.alias("latest_run_id"),
        F.coalesce(F.col("source_run_id") != latest, F.lit(False)).alias("is_stale"),
    )


def draft_rows(
    texts: DataFrame, provider: str, model_name: str, prompt_version: str
) -> DataFrame:
    """Generated texts as storable drafts: blank texts are refused, a missing label is added."""
    return texts.where(~is_blank("summary_text")).withColumns(
        {
            "summary_text": with_draft_label("summary_text"),
            "provider": F.lit(provider),
            "model_name": F.lit(model_name),
            "prompt_version": F.lit(prompt_version),
        }
    )


def weekly_report(
    facts: DataFrame, runs: DataFrame, findings: DataFrame, project: str | None = None
) -> dict[str, DataFrame]:
    """The six report sections, all from the latest successful run."""
    current = ledger.of_latest_run(facts, runs)
    run_id = ledger.latest_run(runs).scalar()
    return {
        "header": ledger.run_info(runs),
        "portfolio_summary": metrics.portfolio(current, project),
        "by_project": metrics.by_project(current, project),
        "overdue_detail": metrics.overdue_detail(current, project),
        "overdue_by_owner": metrics.by_owner(current, project),
        "data_notes": findings_of_run(findings, run_id).groupBy("check_name", "severity_class").agg(
            F.count(F.lit(1)).alias("findings")
        ),
    }
