"""Masking, tokens, row scope, retention, erasure and audit roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapledger.functions.time import ntz

# Roles that see confidential text as it is, and those limited to their own rows.
CLEAR_ROLES = ("ROLE-03", "ROLE-06")
OWN_ROWS_ROLE = "ROLE-04"
UNMASKED_ROLE = "ROLE-06"
# Order in which the tables of an expired run are emptied.
PURGE_ORDER = (
    "data_quality_results", "stg_actions", "raw_actions", "executive_summaries", "ingestion_runs",
)


def token(col: Column | str, salt: str) -> Column:
    """Salted one-way token of a value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sha2(F.concat(F.lit(salt), c), 256)


def masked(rows: DataFrame, role: str, salt: str, subject: str | None = None) -> DataFrame:
    """Detail rows as a role may see them.

    Clear roles see all; the own-rows role sees its own owner value and no action names; other
    roles get owner tokens and no action names.
    """
    if role in CLEAR_ROLES:
        return rows
    owner = token("owner", salt)
    if role == OWN_ROWS_ROLE and subject is not None:
        owner = F.when(F.col("owner") == F.lit(subject), F.col("owner")).otherwise(owner)
    return rows.withColumns({"owner": owner, "action_name": F.lit(None).cast("string")})


def masked_findings(findings: DataFrame, role: str) -> DataFrame:
    """Findings as a role may see them: keys and messages are for the unmasked role alone, others see which check fired."""
    if role == UNMASKED_ROLE:
        return findings
    return findings.withColumns({c: F.lit(None).cast("string") for c in ("record_key", "message")})


# --- what a role may see ---------------------------------------------------------------------

CLEAR, TOKEN, HIDDEN = "clear", "token", "hidden"


@dataclass(frozen=True)
class Mask:
    """A policy row: how a column of a table looks to roles that don't see it clear."""

    table: str
    column: str
    clear: tuple[str, ...]
    otherwise: str


# The roles, what limits a role's rows, and the policy rows.
ROLES = ("ROLE-01", "ROLE-02", "ROLE-03", "ROLE-04", "ROLE-05", "ROLE-06")
ROW_LIMITS = {"ROLE-02": "project_name", "ROLE-04": "owner"}
MASKS = tuple(
    Mask(table, column, clear, otherwise)
    for table in ("stg_actions", "raw_actions")
    for column, clear, otherwise in (("owner", ("ROLE-03", "ROLE-04", "ROLE-06"), TOKEN), ("action_name", ("ROLE-03", "ROLE-06"), HIDDEN))
) + (
    Mask("data_quality_results", "record_key", ("ROLE-06",), HIDDEN),
    Mask("data_quality_results", "message", ("ROLE-06",), HIDDEN),
    Mask("executive_summaries", "summary_text", ("ROLE-01", "ROLE-02", "ROLE-03", "ROLE-05", "ROLE-06"), HIDDEN),
)


def bound(
    rows: DataFrame, table: str, actor: str, role: str, salt: str, entitlements: DataFrame, masks: Sequence[Mask] = MASKS
) -> DataFrame:
    """Rows of a table as an actor in a role may see them: first the rows of their scope, then masked columns.

    A role with limited rows sees those whose limiting column holds a value that `entitlements` (actor and that
    column) gives the actor, and nothing of a table without the column. A value in scope is one's own, so it is clear
    where the policy says so. A role or treatment that is not known is an error, never an open door.
    """
    if role not in ROLES:
        raise ValueError(f"unknown role: {role}")
    limit = ROW_LIMITS.get(role)
    if limit is not None:
        rows = row_scope(rows, entitlements, actor, limit) if limit in rows.columns else rows.where(F.lit(False))
    shown = {}
    for m in masks:
        if m.table == table and role not in m.clear:
            if m.otherwise not in (TOKEN, HIDDEN):
                raise ValueError(f"unknown treatment: {m.otherwise}")
            shown[m.column] = token(m.column, salt) if m.otherwise == TOKEN else F.lit(None).cast("string")
    return rows.withColumns(shown) if shown else rows


def subject_rows(subject: str) -> dict[str, Column]:
    """Per table the condition that a row is about a person: the owner, or a text that names them."""
    who = F.lit(subject)
    hits = {
        "stg_actions": F.col("owner") == who,
        "restated_actions": F.col("owner") == who,
        "raw_actions": F.col("owner") == who,
        "data_quality_results": (F.col("record_key") == who) | F.contains(F.col("message"), who),
        "executive_summaries": F.contains(F.col("summary_text"), who),
    }
    return {name: F.coalesce(hit, F.lit(False)) for name, hit in hits.items()}


def tokenized_owners(rows: DataFrame, salt: str) -> DataFrame:
    return rows.withColumn("owner", token("owner", salt))


def row_scope(rows: DataFrame, entitlements: DataFrame, actor: str, on: str = "owner") -> DataFrame:
    """Rows an actor is entitled to; the actor's keys fold to distinct values first."""
    keys = entitlements.where(F.col("actor") == F.lit(actor)).select(on).distinct()
    return rows.join(keys, on, "left_semi")


def retention_plan(
    runs: DataFrame, tables: dict[str, DataFrame], completed_before: datetime
) -> DataFrame:
    """(step, table_name, run_id, rows) that a purge would delete; the dry run.

    Runs that completed before the cutoff expire, but never the latest success. Each table, read once, folds to one row
    per run (findings may come as counts), and these rows and the ledger's meet in windows: over a run, and over all
    runs for the latest success.
    """
    parts = []
    for step, name in enumerate(PURGE_ORDER, start=1):
        if name == "ingestion_runs":
            sized = runs.select("run_id", F.lit(1).cast("bigint").alias("rows"), "completed_at", "status")
        elif name in tables:
            df = tables[name]
            rows = F.sum("findings") if "findings" in df.columns else F.count(F.lit(1))
            key = "source_run_id" if name == "executive_summaries" else "run_id"
            sized = df.groupBy(F.col(key).alias("run_id")).agg(rows.alias("rows"))
        else:
            continue
        parts.append(sized.withColumns({"step": F.lit(step), "table_name": F.lit(name)}))
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    good = F.when(F.col("status") == "succeeded", F.col("run_id"))
    dated = everything.withColumns({
        "completed": F.max("completed_at").over(Window.partitionBy("run_id")),
        "keep": F.coalesce(F.max(good).over(Window.partitionBy()), F.lit(-1).cast("bigint")),
    })
    expired = dated.where((F.col("completed") < ntz(completed_before)) & (F.col("run_id") != F.col("keep")))
    return expired.select("step", "table_name", "run_id", "rows")


def erasure_report(
    subject: str, raw: DataFrame, facts: DataFrame, findings: DataFrame, summaries: DataFrame,
    restated: DataFrame | None = None,
) -> DataFrame:
    """Per table and run: rows, rows of the subject and rows left after erasing them."""
    hits = subject_rows(subject)

    def count(df: DataFrame, name: str, key: str = "run_id") -> DataFrame:
        sizes = df.groupBy(F.col(key).alias("run_id")).agg(
            F.count(F.lit(1)).alias("rows_before"), F.count_if(hits[name]).alias("subject_rows"),
        )
        return sizes.where("subject_rows > 0").select(F.lit(name).alias("table_name"), "*")

    parts = [
        count(facts, "stg_actions"), count(raw, "raw_actions"), count(findings, "data_quality_results"),
        count(summaries, "executive_summaries", "source_run_id"),
    ]
    if restated is not None:
        parts.insert(1, count(restated, "restated_actions"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rows_after", F.col("rows_before") - F.col("subject_rows"))


def audit_rollup(log: DataFrame) -> DataFrame:
    """Events, distinct actors and rows returned per event type and dataset."""
    return log.groupBy("event_type", "dataset").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("actor_id").alias("actors"),
        F.sum("row_count").alias("rows_returned"),
    )
