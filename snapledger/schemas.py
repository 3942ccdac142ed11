"""Table schemas, enumerations and write-time contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DateType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# The file contract, the enumerations and the label for "no project filter".
SOURCE_COLUMNS = ("action_id", "project_name", "action_name", "owner", "due_date", "status")
ACTION_STATUSES = ("done", "in_progress", "todo")
RUN_STATUSES = ("running", "succeeded", "failed")
# Ledger mark of a run whose rows were deleted; readers never see such runs.
PURGED = "purged"
SEVERITIES = ("blocking", "warning", "investigation")
AUDIT_EVENTS = ("query", "export", "change", "erasure", "ai_context_send")
ALL_PROJECTS = "All Projects"
MAX_FILE_BYTES = 256 * 1024 * 1024
MAX_FIELD_CHARS = 131_072

# The six text columns as they are named once read (due_date is still unparsed text).
TEXT_COLUMNS = ("action_id", "project_name", "action_name", "owner", "due_date_raw", "status")


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind(), null) for name, kind, null in fields])


REQUIRED, OPTIONAL = False, True

INPUT_ROWS = _table(
    ("run_id", LongType, REQUIRED),
    ("source_row_number", IntegerType, REQUIRED),
    *((c, StringType, OPTIONAL) for c in TEXT_COLUMNS),
    ("field_count", IntegerType, REQUIRED),
    ("header_count", IntegerType, REQUIRED),
)

RUN_EVENTS = _table(
    ("run_id", LongType, REQUIRED),
    ("event_seq", IntegerType, REQUIRED),
    ("source_file", StringType, REQUIRED),
    ("source_hash", StringType, REQUIRED),
    ("reference_date", DateType, REQUIRED),
    ("started_at", TimestampNTZType, REQUIRED),
    ("completed_at", TimestampNTZType, OPTIONAL),
    ("source_row_count", IntegerType, OPTIONAL),
    ("valid_row_count", IntegerType, OPTIONAL),
    ("invalid_row_count", IntegerType, OPTIONAL),
    ("status", StringType, REQUIRED),
)

INGESTION_RUNS = StructType([f for f in RUN_EVENTS if f.name != "event_seq"])

RAW_ACTIONS = _table(
    ("run_id", LongType, REQUIRED),
    *((c, StringType, OPTIONAL) for c in TEXT_COLUMNS),
    ("source_row_number", IntegerType, REQUIRED),
    ("loaded_at", TimestampNTZType, REQUIRED),
)

STG_ACTIONS = _table(
    ("run_id", LongType, REQUIRED),
    ("action_id", StringType, REQUIRED),
    ("project_name", StringType, REQUIRED),
    ("action_name", StringType, REQUIRED),
    ("owner", StringType, REQUIRED),
    ("due_date", DateType, REQUIRED),
    ("status", StringType, REQUIRED),
    ("is_completed", BooleanType, REQUIRED),
    ("is_open", BooleanType, REQUIRED),
    ("is_overdue", BooleanType, REQUIRED),
    ("days_overdue", IntegerType, REQUIRED),
    ("loaded_at", TimestampNTZType, REQUIRED),
)

DATA_QUALITY_RESULTS = _table(
    ("quality_result_id", LongType, REQUIRED),
    ("run_id", LongType, REQUIRED),
    ("check_name", StringType, REQUIRED),
    ("record_key", StringType, OPTIONAL),
    ("severity_class", StringType, REQUIRED),
    ("message", StringType, REQUIRED),
    ("created_at", TimestampNTZType, REQUIRED),
)

EXECUTIVE_SUMMARIES = _table(
    ("summary_id", LongType, REQUIRED),
    ("created_at", TimestampNTZType, REQUIRED),
    ("reference_date", DateType, REQUIRED),
    ("project_filter", StringType, OPTIONAL),
    ("source_run_id", LongType, REQUIRED),
    ("summary_text", StringType, REQUIRED),
    ("provider", StringType, REQUIRED),
    ("model_name", StringType, REQUIRED),
    ("prompt_version", StringType, REQUIRED),
)

APP_CONFIG = _table(
    ("config_key", StringType, REQUIRED),
    ("config_value", StringType, REQUIRED),
    ("updated_at", TimestampNTZType, REQUIRED),
)

AUDIT_LOG = _table(
    ("audit_id", LongType, REQUIRED),
    ("event_time", TimestampNTZType, REQUIRED),
    ("actor_id", StringType, REQUIRED),
    ("role_id", StringType, REQUIRED),
    ("event_type", StringType, REQUIRED),
    ("dataset", StringType, REQUIRED),
    ("run_id", LongType, OPTIONAL),
    ("query_ref", StringType, REQUIRED),
    ("columns_accessed", StringType, REQUIRED),
    ("row_count", LongType, REQUIRED),
)

PURGE_STEPS = _table(
    ("purge_id", StringType, REQUIRED),
    ("step", IntegerType, REQUIRED),
    ("table_name", StringType, REQUIRED),
    ("run_id", LongType, REQUIRED),
    ("rows", LongType, REQUIRED),
    ("state", StringType, REQUIRED),
    ("at", TimestampNTZType, REQUIRED),
)

# Facts of old runs under another definition, kept beside the old ones, and the mark that makes them visible.
RESTATED_ACTIONS = StructType(
    [f for f in STG_ACTIONS if f.name != "loaded_at"] + [StructField("definition_version", StringType(), REQUIRED)]
)
RESTATEMENTS = _table(
    ("run_id", LongType, REQUIRED),
    ("definition_version", StringType, REQUIRED),
    ("fact_rows", LongType, REQUIRED),
    ("restated_at", TimestampNTZType, REQUIRED),
)

TABLES = {
    "run_events": RUN_EVENTS,
    "raw_actions": RAW_ACTIONS,
    "stg_actions": STG_ACTIONS,
    "data_quality_results": DATA_QUALITY_RESULTS,
    "executive_summaries": EXECUTIVE_SUMMARIES,
    "app_config": APP_CONFIG,
    "audit_log": AUDIT_LOG,
    "purge_steps": PURGE_STEPS,
    "restated_actions": RESTATED_ACTIONS,
    "restatements": RESTATEMENTS,
}

# Column -> allowed values, per table.
CHECKS = {
    "run_events": {"status": (*RUN_STATUSES, PURGED)},
    "ingestion_runs": {"status": RUN_STATUSES},
    "data_quality_results": {"severity_class": SEVERITIES},
    "audit_log": {"event_type": AUDIT_EVENTS},
    "purge_steps": {"state": ("planned", "done")},
}


# Columns that tell the rows of a table apart. Those of a run's rows are proved before the run is committed.
PRIMARY_KEYS = {
    "run_events": ("run_id", "event_seq"),
    "raw_actions": ("run_id", "source_row_number"),
    "stg_actions": ("run_id", "action_id"),
    "restated_actions": ("run_id", "definition_version", "action_id"),
    "restatements": ("run_id", "definition_version"),
    "data_quality_results": ("quality_result_id",),
    "executive_summaries": ("summary_id",),
    "audit_log": ("audit_id",),
}

# What must hold between a row's columns, per table: SQL conditions.
ROW_CHECKS = {
    "stg_actions": (
        "is_completed <> is_open", "is_open or not is_overdue", "is_overdue = (days_overdue > 0)", "days_overdue >= 0",
    ),
    # What counts as overdue may differ by definition, so an overdue row may have no day yet.
    "restated_actions": (
        "is_completed <> is_open", "is_open or not is_overdue", "is_overdue or days_overdue = 0", "days_overdue >= 0",
    ),
    "raw_actions": ("source_row_number >= 1",),
    "run_events": ("completed_at is null or completed_at >= started_at",),
}


class ContractError(ValueError):
    """A DataFrame does not have the columns or types its table declares."""


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project `df` onto the declared columns and types; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def enforced(df: DataFrame, name: str) -> DataFrame:
    """`df` as table `name` declares it; writing a row that breaks the declaration fails the job.

    NOT NULL, value lists and row conditions are tested in the pass that writes, so no file of a faulty write is
    committed. The message names the column or condition, never a value.
    """
    schema = TABLES[name]
    rows = conform(df, schema)
    tests = [(F.col(f.name).isNull(), f"{f.name} is NULL") for f in schema if not f.nullable]
    tests += [(~F.col(c).isin(*values), f"{c} is outside its value list") for c, values in CHECKS.get(name, {}).items()]
    tests += [(~F.expr(test), f"not ({test})") for test in ROW_CHECKS.get(name, ())]
    problem = F.coalesce(*[F.when(bad, F.lit(f"{name}: {text}")) for bad, text in tests])
    first = schema[0]
    stopped = F.when(problem.isNotNull(), F.raise_error(problem).cast(first.dataType)).otherwise(F.col(first.name))
    return rows.select(stopped.alias(first.name), *schema.names[1:])


def contract_violations(
    df: DataFrame, schema: StructType, allowed: dict[str, tuple[str, ...]] | None = None, key: tuple[str, ...] = ()
) -> DataFrame:
    """(column_name, check, violations) per NOT NULL and value-list constraint and of the primary key, in one pass.

    A key's violations are the rows beyond the first of each key. Rows fold to their key before they move.
    """
    tests = [(f.name, "not_null", F.col(f.name).isNull()) for f in schema if not f.nullable]
    for name, values in (allowed or {}).items():
        tests.append((name, "allowed_values", ~F.col(name).isin(*values)))
    folded = [F.count_if(bad).alias(f"v{i}") for i, (_, _, bad) in enumerate(tests)]
    if key:
        by_key = df.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]).agg(*folded, (F.count(F.lit(1)) - 1).alias(f"v{len(tests)}"))
        tests.append((", ".join(key), "primary_key", None))
        counts = by_key.agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0)).cast("bigint").alias(f"v{i}") for i in range(len(tests))])
    else:
        counts = df.agg(*folded)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(check).alias("check"),
                F.col(f"v{i}").alias("violations"),
            )
            for i, (name, check, _) in enumerate(tests)
        ]
    )
    return counts.select(F.inline(rows))
