"""Snapshot-shaped views of the given tables, each with the same view as DuckDB SQL.

`orders` gives the work items, `conversations` the saved drafts, `events` the configuration and
audit logs, `customer` the entitlements. Faults are put into rows, whole tables are always used.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.operators import staging
from snapledger.schemas import SOURCE_COLUMNS
from snapledger.sources import snapshot_files as src
from snapledger.sources.folders import fresh_folder

REFERENCE_DATE = date(1998, 8, 2)
AS_OF = datetime(2001, 9, 1)
LAST_RUN = 80
FILE_ROWS = 1000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _select(columns: str, source: DataFrame) -> DataFrame:
    return source.sparkSession.sql(f"select {columns} from {{source}}", source=source)


# --- clean snapshot --------------------------------------------------------------------------

_ITEM = """
    o_orderkey as k,
    concat('A', lpad(cast(o_orderkey as {S}), 12, '0')) as action_id,
    o_orderpriority as project_name,
    concat('Order ', cast(o_orderkey as {S})) as action_name,
    concat('Owner-', lpad(cast(o_custkey % 97 as {S}), 3, '0')) as owner,
    cast(o_orderdate as date) as due_date,
    case o_orderstatus when 'F' then 'done' when 'P' then 'in_progress' else 'todo' end as status,
    cast((year(o_orderdate) - 1995) * 12 + month(o_orderdate) as bigint) as run_id
"""
SQL_ITEMS = "items as (select" + _ITEM.format(S="varchar") + "from orders)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    """One work item per order; run_id is its month, so a run grows with the data."""
    return _select(_ITEM.format(S="string"), table(spark, sf, "orders"))


_FLAGS = """
    status = 'done' as is_completed, status <> 'done' as is_open,
    status <> 'done' and due_date < {ref} as is_overdue,
    cast(case when status <> 'done' and due_date < {ref}
              then date_diff('day', due_date, {ref}) else 0 end as integer) as days_overdue
"""
SQL_FACTS = (
    SQL_ITEMS
    + ", facts as (select action_id, project_name, action_name, owner, due_date, status, run_id,"
    + _FLAGS.format(ref="date '1998-08-02'") + "from items)"
)


def facts(spark: SparkSession, sf: str, reference_date: date = REFERENCE_DATE) -> DataFrame:
    """The whole table as one snapshot, staged against one reference date."""
    return staging.with_flags(items(spark, sf), reference_date)


# --- runs ------------------------------------------------------------------------------------

_CALENDAR = """
    make_date({year}, {month}, 21) as reference_date,
    case when run_id % 7 = 3 then 'failed' when run_id = 80 then 'running' else 'succeeded' end
        as status
"""
SQL_CALENDAR = (
    "calendar as (select run_id,"
    + _CALENDAR.format(year="1995 + (run_id - 1) // 12", month="(run_id - 1) % 12 + 1")
    + "from (select unnest(range(1, 81)) as run_id))"
)


def calendar(spark: SparkSession) -> DataFrame:
    """The control side of the ledger: 80 monthly runs with reference date and status."""
    return spark.range(1, LAST_RUN + 1).withColumnRenamed("id", "run_id").selectExpr(
        "run_id",
        "make_date(cast(1995 + (run_id - 1) div 12 as int), cast((run_id - 1) % 12 + 1 as int), 21)"
        " as reference_date",
        "case when run_id % 7 = 3 then 'failed' when run_id = 80 then 'running' else 'succeeded' end"
        " as status",
    )


SQL_LEDGER = SQL_ITEMS + ", " + SQL_CALENDAR + """
, sized as (select run_id, count(*) as n, sum(k) as key_sum from items group by run_id)
, ledger as (
    select c.run_id, 'snapshot-' || c.run_id || '.csv' as source_file,
           sha256(c.run_id || ':' || coalesce(key_sum, 0)) as source_hash, reference_date,
           cast(reference_date as timestamp) + interval 8 hour as started_at,
           case when status <> 'running'
                then cast(reference_date as timestamp) + interval 9 hour end as completed_at,
           cast(coalesce(n, 0) as integer) as source_row_count,
           cast(coalesce(n, 0) - bad + (case when c.run_id % 13 = 6 then 1 else 0 end) as integer)
               as valid_row_count,
           cast(bad as integer) as invalid_row_count, status
    from (select *, case when status = 'failed' then 1 + run_id % 5 else 0 end as bad
          from calendar) c join sized using (run_id))
"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run that has items; sizes and content hashes come from them."""
    sized = items(spark, sf).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum")
    )
    return calendar(spark).join(sized, "run_id").selectExpr(
        "run_id", "concat('snapshot-', run_id, '.csv') as source_file",
        "sha2(concat(run_id, ':', coalesce(key_sum, 0)), 256) as source_hash", "reference_date",
        "cast(reference_date as timestamp_ntz) + interval '8' hour as started_at",
        "case when status <> 'running' then cast(reference_date as timestamp_ntz)"
        " + interval '9' hour end as completed_at",
        "cast(coalesce(n, 0) as int) as source_row_count",
        "cast(coalesce(n, 0) - (case when status = 'failed' then 1 + run_id % 5 else 0 end)"
        " + (case when run_id % 13 = 6 then 1 else 0 end) as int) as valid_row_count",
        "cast(case when status = 'failed' then 1 + run_id % 5 else 0 end as int) as invalid_row_count",
        "status",
    )


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger history: registered, counted, finished."""
    final = ledger(spark, sf).withColumn(
        "event_seq", F.explode(F.expr("if(status = 'running', array(0, 1), array(0, 1, 2))"))
    )
    early = F.col("event_seq") == 0
    return final.withColumns(
        {
            "status": F.when(F.col("event_seq") < 2, F.lit("running")).otherwise(F.col("status")),
            "completed_at": F.when(F.col("event_seq") == 2, F.col("completed_at")),
            **{c: F.when(~early, F.col(c)) for c in
               ("source_row_count", "valid_row_count", "invalid_row_count")},
        }
    )


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows of all runs; the key stands in for the source row number."""
    return items(spark, sf).select(
        "run_id", "action_id", "project_name", "action_name", "owner",
        F.date_format("due_date", "yyyy-MM-dd").alias("due_date_raw"), "status", "k",
    )


SQL_RUN_FACTS = SQL_LEDGER + ", run_facts as (select run_id, action_id, project_name, action_name," \
    " owner, due_date, i.status as status," + _FLAGS.format(ref="reference_date").replace(
        "status", "i.status") + "from items i join calendar c using (run_id))"


def run_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of all runs, each against its run's reference date."""
    return staging.stage(raw_rows(spark, sf), calendar(spark))


SQL_BROKEN_FACTS = SQL_LEDGER + """
, broken as (
    select case when k % 997 = 0 then 1000 + k % 5 else run_id end as run_id,
           case when k % 31 = 0 then 'DUP-' || k % 2
                when k % 211 = 0 then 'X' || action_id else action_id end as action_id
    from items)
"""


def broken_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Fact keys with unknown runs, keys absent from raw, and repeated keys."""
    return items(spark, sf).selectExpr(
        "case when k % 997 = 0 then 1000 + k % 5 else run_id end as run_id",
        "case when k % 31 = 0 then concat('DUP-', k % 2)"
        " when k % 211 = 0 then concat('X', action_id) else action_id end as action_id",
    )


# --- dirty snapshots -------------------------------------------------------------------------

_DIRTY = """
    run_id, cast(k + 1 as integer) as source_row_number,
    case when hit and k % 101 = 0 then '' when hit and k % 103 = 0 then concat('DUP-', k % 3)
         else action_id end as action_id,
    case when hit and k % 107 = 0 then '   ' else project_name end as project_name,
    case when hit and k % 109 = 0 then null when k % 113 = 0 then concat('bell', chr(7))
         else action_name end as action_name,
    case when hit and k % 127 = 0 then chr(9) when hit and k % 131 = 0 then {nbsp}
         else owner end as owner,
    case when hit and k % 137 = 0 then '2026-02-30'
         when hit and k % 139 = 0 then replace({iso}, '-', '/')
         when hit and k % 149 = 0 then concat({iso}, chr(10)) else {iso} end as due_date_raw,
    case when hit and k % 151 = 0 then '' when k % 157 = 0 then 'Done' when k % 163 = 0 then ' todo '
         else status end as status,
    cast(header_size + (case when hit and k % 167 = 0 then 1 when hit and k % 173 = 0 then -2
                             else 0 end) as integer) as field_count
"""
_HEADER_SIZE = "case run_id % 10 when 1 then 5 when 2 then 7 when 3 then 7 else 6 end"
SQL_HEADERS = """
headers as (
    select run_id, unnest(case run_id % 10
        when 1 then ['action_id', 'project_name', 'action_name', 'due_date', 'status']
        when 2 then ['action_id', 'project_name', 'action_name', 'owner', 'due_date', 'status', 'priority']
        when 3 then ['action_id', 'project_name', 'action_name', 'owner', 'due_date', 'status', 'owner']
        when 4 then ['status', 'due_date', 'owner', 'action_name', 'project_name', 'action_id']
        when 5 then ['Action_ID', 'project_name', 'action_name', 'owner', 'due_date', 'status']
        else ['action_id', 'project_name', 'action_name', 'owner', 'due_date', 'status'] end)
        as column_name
    from (select distinct run_id from items))
"""
SQL_DIRTY = (
    SQL_LEDGER + ", " + SQL_HEADERS + ", dirty as (select"
    + _DIRTY.format(nbsp="chr(160)", iso="strftime(due_date, '%Y-%m-%d')")
    + f"from (select *, run_id % 3 <> 0 as hit, {_HEADER_SIZE} as header_size from items))"
    + ", usable as (select *, cast(case run_id % 10 when 2 then 7 else 6 end as integer)"
    + " as header_count from dirty where run_id % 10 not in (1, 3, 5))"
)


def dirty_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Input rows of all runs with faults of every rule; every third run has no blocking fault."""
    source = items(spark, sf).selectExpr(
        "*", "run_id % 3 <> 0 as hit", f"{_HEADER_SIZE} as header_size"
    )
    text = _DIRTY.format(
        nbsp="decode(unhex('C2A0'), 'UTF-8')", iso="date_format(due_date, 'yyyy-MM-dd')"
    )
    return _select(text, source)


def read_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with the state of their run's header, as the file source puts it on every record."""
    return dirty_rows(spark, sf).selectExpr(
        "*", f"cast({_HEADER_SIZE} as int) as header_count", "run_id % 10 not in (1, 3, 5) as header_ok")


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, position, column_name) with missing, extra, repeated and misspelt names."""
    runs = items(spark, sf).select("run_id").distinct()
    full = list(SOURCE_COLUMNS)

    def names(values: list[str]):
        return F.array(*map(F.lit, values))

    kind = F.col("run_id") % 10
    columns = (
        F.when(kind == 1, names([c for c in full if c != "owner"]))
        .when(kind == 2, names([*full, "priority"]))
        .when(kind == 3, names([*full, "owner"]))
        .when(kind == 4, names(full[::-1]))
        .when(kind == 5, names(["Action_ID", *full[1:]]))
        .otherwise(names(full))
    )
    return runs.select("run_id", F.posexplode(columns).alias("position", "column_name"))


# --- drafts, logs, entitlements --------------------------------------------------------------

_DRAFT = """
    conv_id * 100 + turn as summary_id,
    {t0} + {hours} as created_at,
    date '2001-07-21' as reference_date,
    case conv_id % 3 when 0 then null when 1 then '1-URGENT' else '5-LOW' end as project_filter,
    cast(1 + conv_id % 90 as bigint) as source_run_id,
    concat(case when conv_id % 6 = 0 then 'DRAFT: ' else '' end, text,
           chr(10), '(1) total ', cast(15 + conv_id % 7 as {S}), ', overdue 1,', cast(100 + turn as {S}),
           case when conv_id % 4 = 0 then ' high Priority' else '' end,
           case when conv_id % 5 = 0 then ' see 3-MEDIUM.' when conv_id % 5 = 1 then ' 1-URGENT'
                else '' end,
           case when conv_id % 11 = 0 then ' key sk-abcdefghijklmnop1234' else '' end,
           case when turn % 2 = 1 then ' (2) (3) (4) (5)' else '' end) as summary_text,
    case when conv_id % 20 = 7 then 'provider-b' else 'provider-a' end as provider,
    concat('model-', cast(conv_id % 2 as {S})) as model_name,
    case when conv_id > 50 then 'exec-summary-v2' else 'exec-summary-v1' end as prompt_version
"""
SQL_DRAFTS = "drafts as (select" + _DRAFT.format(
    S="varchar", t0="timestamp '2024-01-01 00:00:00'",
    hours="to_hours(cast(conv_id * 37 + turn as bigint))",
) + "from conversations)"


def drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Saved drafts: every turn, with numbers, terms, names and secrets appended."""
    text = _DRAFT.format(
        S="string", t0="timestamp_ntz '2024-01-01 00:00:00'",
        hours="(conv_id * 37 + turn) * interval '1' hour",
    )
    return _select(text, table(spark, sf, "conversations"))


SQL_AUDIT = """
audit as (
    select event_id as audit_id, ts as event_time, 'user-' || user_id as actor_id,
           case event_type when 'click' then 'query' when 'view' then 'query'
                when 'purchase' then 'export' when 'signup' then 'change' else 'erasure' end
               as event_type,
           case event_id % 3 when 0 then 'stg_actions' when 1 then 'raw_actions'
                else 'executive_summaries' end as dataset,
           cast(floor(value) as bigint) as row_count
    from events)
"""


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id as audit_id", "ts as event_time", "concat('user-', user_id) as actor_id",
        "case event_type when 'click' then 'query' when 'view' then 'query' when 'purchase'"
        " then 'export' when 'signup' then 'change' else 'erasure' end as event_type",
        "case event_id % 3 when 0 then 'stg_actions' when 1 then 'raw_actions'"
        " else 'executive_summaries' end as dataset",
        "cast(floor(value) as bigint) as row_count",
    )


def config_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Configuration writes: each user's event overwrites that user's key."""
    return table(spark, sf, "events").selectExpr(
        "concat('user-', user_id) as config_key", "event_type as config_value",
        "cast(ts as timestamp_ntz) as updated_at",
    )


def entitlements(spark: SparkSession, sf: str) -> DataFrame:
    """Owners each actor (a nation) may see."""
    return table(spark, sf, "customer").selectExpr(
        "concat('nation-', c_nationkey) as actor",
        "concat('Owner-', lpad(cast(c_custkey % 97 as string), 3, '0')) as owner",
    )


# --- files -----------------------------------------------------------------------------------

# Fields in source order, then a line built from them. Files differ: CRLF ends, an extra column,
# reversed columns, a missing column; one file in three also has faulty rows and blank lines.
_FIELDS = """
    k, k // {n} as file_no, action_id as f_id, project_name as f_project,
    case when k % 17 = 0 then concat('Order "', k, '", first', {nl}, 'second') else action_name end
        as f_name,
    case when (k // {n}) % 3 = 1 and k % 307 = 0 then '' else owner end as f_owner,
    case when (k // {n}) % 3 = 1 and k % 311 = 0 then '1998-02-30' else {iso} end as f_due,
    case when k % 157 = 0 then 'Done' else status end as f_status,
    case when (k // {n}) % 4 = 1 then chr(13) else '' end as line_end,
    (k // {n}) % 3 = 1 and k % 401 = 0 as has_spill,
    (k // {n}) % 3 = 1 and k % 409 = 0 as blank_after
"""
_LINE = """
    concat(case (file_no % 35)
        {variants}
        end, case when has_spill then ',spill' else '' end, line_end)
"""


def _quoted(expr: str) -> str:
    return f"concat('\"', replace({expr}, '\"', '\"\"'), '\"')"


def _variant(file_no: int) -> tuple[list[str], list[str]]:
    """(header names, row expressions) of a file."""
    names = list(SOURCE_COLUMNS)
    values = ["f_id", "f_project", _quoted("f_name"), "f_owner", "f_due", "f_status"]
    if file_no % 7 == 4:
        return names[:3] + names[4:], values[:3] + values[4:]
    if file_no % 5 == 2:
        return [*names, "priority"], [*values, "'p'"]
    if file_no % 5 == 3:
        return names[::-1], values[::-1]
    return names, values


def _case(pick) -> str:
    return "\n".join(f"when {m} then {pick(*_variant(m))}" for m in range(35))


def _row_sql() -> str:
    return _LINE.format(variants=_case(lambda _n, v: "concat(" + ", ',', ".join(v) + ")"))


def _header_sql() -> str:
    variants = _case(lambda n, _v: "'" + ",".join(n) + "'")
    return f"concat(case (file_no % 35) {variants} end, line_end)"


def _lines_sql(fields: str) -> str:
    return (
        f"fields as (select {fields} from items), "
        f"lines as (select file_no, k * 2 + 1 as ord, {_row_sql()} as line from fields"
        f" union all select file_no, k * 2 + 2, line_end from fields where blank_after"
        f" union all select file_no, -1, {_header_sql()} from"
        f" (select distinct file_no, line_end from fields))"
    )


SQL_LINES = SQL_ITEMS + ", " + _lines_sql(
    _FIELDS.format(n=FILE_ROWS, nl="chr(13) || chr(10)", iso="strftime(due_date, '%Y-%m-%d')")
)
SQL_FILES = SQL_LINES + (
    ", files as (select file_no, string_agg(line || chr(10), '' order by ord) as content"
    " from lines group by file_no)"
)


def write_files(spark: SparkSession, sf: str, folder: str | None = None) -> str:
    """Write the orders as CSV snapshot files of 1,000 rows each; gives the folder."""
    out = folder or fresh_folder(spark, "files")
    text = _FIELDS.format(
        n=FILE_ROWS, nl="chr(13), chr(10)", iso="date_format(due_date, 'yyyy-MM-dd')"
    ).replace("//", "div")
    query = "with " + _lines_sql(text).replace("from items", "from {items}")
    lines = spark.sql(query + " select file_no, ord, line from lines", items=items(spark, sf))
    placed = lines.repartition("file_no").sortWithinPartitions("file_no", "ord")
    placed.select("file_no", "line").write.partitionBy("file_no").text(out)
    return out


def file_number(path_column: str = "path"):
    return F.regexp_extract(path_column, "file_no=([0-9]+)", 1).cast("bigint")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return src.read_files(spark, write_files(spark, sf), "*.txt").withColumn("file_no", file_number())


def file_records(spark: SparkSession, sf: str) -> DataFrame:
    return src.split_records(files(spark, sf))
