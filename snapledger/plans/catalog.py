"""Every query by name: a Spark plan over the given tables and the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger import schemas
from snapledger.functions import text
from snapledger.operators import (
    evaluation,
    governance,
    ingest,
    integrity,
    metrics,
    reports,
    rules,
    staging,
    trends,
)
from snapledger.operators import runs as ledger_ops
from snapledger.plans import testdata as td
from snapledger.sources import snapshot_files as src
from snapledger.sources.numbering import number_rows
from snapledger.sources.folders import fresh_folder
from snapledger.sources.warehouse import Warehouse

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def _query(name: str, sql: str | None, *ctes: str) -> Callable[[Build], Build]:
    full = None if sql is None else ("with " + ", ".join(ctes) + " " if ctes else "") + sql

    def register(build: Build) -> Build:
        QUERIES[name] = Query(build, full)
        return build

    return register


def _ranked(rows: DataFrame, *order) -> DataFrame:
    """Add the place of each row; only for results that a limit has already bounded."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


SALT = "pepper"
PROJECT = "1-URGENT"
OWNER = "Owner-007"
_COUNTS = """
    count(*) as total_actions, count(*) filter (is_completed) as completed_actions,
    count(*) filter (is_open) as open_actions, count(*) filter (is_overdue) as overdue_actions,
    count(*) filter (is_open and not is_overdue) as open_not_overdue_actions
"""
_OWNERS = "count(distinct owner) filter (is_overdue) as owners_with_overdue_actions"
_RATE = """case when count(*) = 0 then 0.0::double
    else (count(*) filter (is_completed))::double / count(*) end as completion_rate"""
_DETAIL = "action_id, project_name, action_name, owner, due_date, status, days_overdue"

# --- metrics over the whole table as one snapshot --------------------------------------------

_query("portfolio", f"select {_COUNTS}, {_OWNERS}, {_RATE} from facts", td.SQL_FACTS)(
    lambda s, d: metrics.portfolio(td.facts(s, d)))
_query("portfolio_filtered",
       f"select {_COUNTS}, {_OWNERS}, {_RATE} from facts where project_name = '{PROJECT}'", td.SQL_FACTS)(
    lambda s, d: metrics.portfolio(td.facts(s, d), PROJECT))
_query("portfolio_empty_scope",
       f"select {_COUNTS}, {_OWNERS}, {_RATE} from facts where project_name = 'x'' or ''1''=''1'",
       td.SQL_FACTS)(lambda s, d: metrics.portfolio(td.facts(s, d), "x' or '1'='1"))
_query("by_project", f"select project_name, {_COUNTS}, {_RATE} from facts group by 1", td.SQL_FACTS)(
    lambda s, d: metrics.by_project(td.facts(s, d)))
_query("by_status", f"select status, {_COUNTS}, {_RATE} from facts group by 1", td.SQL_FACTS)(
    lambda s, d: metrics.by(td.facts(s, d), ["status"]))
_query("by_due_date", f"select due_date, {_COUNTS}, {_RATE} from facts group by 1", td.SQL_FACTS)(
    lambda s, d: metrics.by(td.facts(s, d), ["due_date"]))
_query("by_owner_full", f"select owner, {_COUNTS}, {_RATE} from facts group by 1", td.SQL_FACTS)(
    lambda s, d: metrics.by(td.facts(s, d), ["owner"]))
_query("by_project_owner",
       f"select project_name, owner, {_COUNTS}, {_OWNERS}, {_RATE} from facts group by 1, 2", td.SQL_FACTS)(
    lambda s, d: metrics.by(td.facts(s, d), ["project_name", "owner"], owners=True))
_query("by_owner", "select owner, count(*) as overdue_actions from facts where is_overdue group by 1",
       td.SQL_FACTS)(lambda s, d: metrics.by_owner(td.facts(s, d)))
_query("overdue_detail", f"select {_DETAIL} from facts where is_overdue", td.SQL_FACTS)(
    lambda s, d: metrics.overdue_detail(td.facts(s, d)))
_query("overdue_detail_owner", f"select {_DETAIL} from facts where is_overdue and owner = '{OWNER}'",
       td.SQL_FACTS)(lambda s, d: metrics.overdue_detail(td.facts(s, d), owner=OWNER))
_query("overdue_detail_iso",
       f"select * replace (strftime(due_date, '%Y-%m-%d') as due_date) from (select {_DETAIL}"
       " from facts where is_overdue)", td.SQL_FACTS)(
    lambda s, d: metrics.overdue_detail(td.facts(s, d)).withColumn(
        "due_date", F.date_format("due_date", "yyyy-MM-dd")))
_query("max_days_overdue",
       "select coalesce(max(days_overdue) filter (is_overdue), 0) as max_days_overdue from facts",
       td.SQL_FACTS)(lambda s, d: metrics.max_days_overdue(td.facts(s, d)))
_query("list_projects", "select distinct project_name from facts", td.SQL_FACTS)(
    lambda s, d: metrics.list_projects(td.facts(s, d)))
_query("project_options",
       "select 0 as section, 'All Projects' as label union all select distinct 1, project_name from facts",
       td.SQL_FACTS)(lambda s, d: metrics.project_options(td.facts(s, d)))
_TOP = "row_number() over (order by days_overdue desc, due_date, action_id)"
_query("top_overdue",
       f"select {_DETAIL}, cast({_TOP} as integer) as rank from facts where is_overdue qualify rank <= 10",
       td.SQL_FACTS)(lambda s, d: _ranked(metrics.top_overdue(td.facts(s, d)), *metrics.detail_order()))
_query("top_owners",
       "select *, cast(row_number() over (order by overdue_actions desc, owner) as integer) as rank from"
       " (select owner, count(*) as overdue_actions from facts where is_overdue group by 1)"
       " qualify rank <= 15", td.SQL_FACTS)(
    lambda s, d: _ranked(metrics.top_owners(td.facts(s, d), 15), F.desc("overdue_actions"), "owner"))
_BY_PROJECT = f"groups as (select project_name, {_COUNTS}, {_RATE} from facts group by 1)"
_query("chart_series", " union all ".join(
    f"select project_name, '{m}' as metric, {m}::double as value from groups" for m in reports.CHART_METRICS),
    td.SQL_FACTS, _BY_PROJECT)(lambda s, d: reports.chart_series(metrics.by_project(td.facts(s, d))))
_query("composition", " union all ".join(
    f"select project_name, total_actions, '{m}' as part, {m} as value from groups"
    for m in reports.COMPOSITION), td.SQL_FACTS, _BY_PROJECT)(
    lambda s, d: reports.composition(metrics.by_project(td.facts(s, d))))
_PORTFOLIO = f"p as (select {_COUNTS}, {_OWNERS}, {_RATE} from facts)"
_query("kpi_rendered", """
    select format('{:,}', total_actions) as total_actions,
           format('{:,}', completed_actions) as completed_actions,
           format('{:,}', open_actions) as open_actions,
           format('{:,}', overdue_actions) as overdue_actions,
           case when total_actions > 0 then format('{:.1f}%', completion_rate * 100) else '-' end
               as completion_rate from p""", td.SQL_FACTS, _PORTFOLIO)(
    lambda s, d: reports.kpi_row(metrics.portfolio(td.facts(s, d))))
_query("kpi_overdue", """
    select format('{:,}', overdue_actions) as overdue_actions,
           format('{:,}', owners_with_overdue_actions) as owners_with_overdue_actions from p""",
       td.SQL_FACTS, _PORTFOLIO)(lambda s, d: reports.overdue_kpis(metrics.portfolio(td.facts(s, d))))


@_query("scope_state", """
    select scope, count(*) filter (is_scope) as total_actions,
           count(*) filter (is_scope and is_overdue) as overdue_actions,
           case when count(*) filter (is_scope) = 0 then 'no_data'
                when count(*) filter (is_scope and is_overdue) = 0 then 'no_overdue' else 'ok' end as state
    from (select f.*, v.scope, case v.scope when 'all' then true when 'none' then false
                 else is_completed end as is_scope
          from facts f, (values ('all'), ('none'), ('done')) v(scope)) group by scope""", td.SQL_FACTS)
def _scope_state(spark: SparkSession, sf: str) -> DataFrame:
    facts = td.facts(spark, sf)
    scopes = {"all": facts, "none": metrics.in_scope(facts, ""), "done": facts.where("is_completed")}
    parts = [
        reports.scope_state(F.lit(1), metrics.portfolio(rows)).withColumn("scope", F.lit(name))
        for name, rows in scopes.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SWEEP = [date(1994, 1, 1), date(1996, 6, 30), date(1998, 8, 2), date(2000, 2, 29), date(2002, 1, 1)]
_query("reference_date_sweep", f"""
    select d as reference_date, count(*) as total_actions,
           count(*) filter (status = 'done') as completed_actions,
           count(*) filter (status <> 'done') as open_actions,
           count(*) filter (late) as overdue_actions,
           count(*) filter (status <> 'done' and not late) as open_not_overdue_actions,
           count(distinct owner) filter (late) as owners_with_overdue_actions,
           cast(coalesce(max(date_diff('day', due_date, d)) filter (late), 0) as integer) as max_days_overdue
    from (select *, status <> 'done' and due_date < d as late from items,
          (select unnest([{', '.join(f"date '{x}'" for x in SWEEP)}]) as d)) group by d""", td.SQL_ITEMS)(
    lambda s, d: staging.sweep_reference_dates(td.items(s, d), SWEEP))
_query("stg_flags", "select * from facts", td.SQL_FACTS)(lambda s, d: td.facts(s, d).drop("k"))

# --- text ------------------------------------------------------------------------------------

_SPACED = "regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f\\x{2028}\\x{2029}]', ' ', 'g')"
_SAFE = f"substring(regexp_replace({_SPACED}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), 1, 200)"
_query("sanitize_text", f"select doc_id, {_SAFE} as safe_text from documents")(
    lambda s, d: td.table(s, d, "documents").select("doc_id", text.sanitize("text").alias("safe_text")))
_query("draft_label", """
    select summary_id, case when contains(substring(summary_text, 1, 200), 'ร่าง')
        or contains(lower(substring(summary_text, 1, 200)), 'draft') then summary_text
        else '[ร่าง (DRAFT)]' || chr(10) || summary_text end as summary_text from drafts""", td.SQL_DRAFTS)(
    lambda s, d: td.drafts(s, d).select("summary_id", text.with_draft_label("summary_text").alias("summary_text")))
_query("control_characters", """
    select doc_id, regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') as has_control,
           regexp_matches(text, '^[\\s\\p{Z}\\x{200B}\\x{FEFF}]*$') as is_blank from documents""")(
    lambda s, d: td.table(s, d, "documents").select(
        "doc_id", text.has_control("text").alias("has_control"), text.is_blank("text").alias("is_blank")))

# --- staging and runs ------------------------------------------------------------------------

_query("raw_load", """
    select run_id, action_id, project_name, action_name, owner, due_date_raw, status, source_row_number,
           timestamp '2001-08-02 10:00:00' as loaded_at from dirty""", td.SQL_DIRTY)(
    lambda s, d: staging.raw_rows(td.dirty_rows(s, d), datetime(2001, 8, 2, 10)))
_FACT = ", ".join(c for c in staging.FACT_COLUMNS)
_query("stg_multi_run", f"select {_FACT} from run_facts", td.SQL_RUN_FACTS)(
    lambda s, d: td.run_facts(s, d))
_query("latest_run", "select max(run_id) as run_id from ledger where status = 'succeeded'", td.SQL_LEDGER)(
    lambda s, d: ledger_ops.latest_run(td.ledger(s, d)))
_query("latest_attempt", "select * from ledger order by run_id desc limit 1", td.SQL_LEDGER)(
    lambda s, d: ledger_ops.latest_attempt(td.ledger(s, d)))
_query("run_state", "select * from ledger", td.SQL_LEDGER)(
    lambda s, d: ledger_ops.run_state(td.run_events(s, d)))
_query("run_info", """
    select * replace (strftime(reference_date, '%Y-%m-%d') as reference_date,
                      strftime(started_at, '%Y-%m-%dT%H:%M:%S') as started_at,
                      strftime(completed_at, '%Y-%m-%dT%H:%M:%S') as completed_at)
    from ledger where run_id = (select max(run_id) from ledger where status = 'succeeded')""",
       td.SQL_LEDGER)(lambda s, d: ledger_ops.run_info(td.ledger(s, d)))
_query("runs_by_status", """
    select status, count(*) as attempts, count(distinct reference_date) as reference_dates
    from ledger group by 1""", td.SQL_LEDGER)(lambda s, d: ledger_ops.attempts_by_status(td.ledger(s, d)))
_query("config_latest", """
    select config_key, last(config_value order by updated_at, config_value) as config_value, max(updated_at) as updated_at
    from (select 'user-' || user_id as config_key, event_type as config_value, ts as updated_at from events)
    group by 1""")(lambda s, d: ledger_ops.latest_config(td.config_entries(s, d)))
_query("surrogate_keys", """
    select action_id, due_date, 80 + row_number() over (order by due_date, action_id) as summary_id
    from items""", td.SQL_ITEMS)(
    lambda s, d: number_rows(
        td.items(s, d).select("action_id", "due_date"), ["due_date", "action_id"], 80, "summary_id")[0])
_RESENT = """
    resent as (select 're-' || source_file as source_file,
        case when run_id % 5 = 0 then sha256('changed' || source_hash) else source_hash end as source_hash,
        case when run_id % 4 = 0 then reference_date + 7 else reference_date end as reference_date
        from ledger)"""


@_query("idempotency_plan", """
    select r.*, p.run_id as prior_run_id, case when p.run_id is null then 'load' else 'noop' end as action
    from resent r left join (select source_hash, reference_date, max(run_id) as run_id from ledger
        where status = 'succeeded' group by 1, 2) p using (source_hash, reference_date)""",
        td.SQL_LEDGER, _RESENT)
def _idempotency(spark: SparkSession, sf: str) -> DataFrame:
    runs = td.ledger(spark, sf)
    resent = runs.selectExpr(
        "concat('re-', source_file) as source_file",
        "case when run_id % 5 = 0 then sha2(concat('changed', source_hash), 256) else source_hash end"
        " as source_hash",
        "case when run_id % 4 = 0 then date_add(reference_date, 7) else reference_date end as reference_date",
    )
    return ledger_ops.idempotency_plan(resent, runs)


_OK_RUNS = "(select run_id from calendar where status = 'succeeded')"
_LATEST = "(select max(run_id) from calendar where status = 'succeeded')"
_query("visible_facts", f"select {_FACT} from run_facts where run_id in {_OK_RUNS}", td.SQL_RUN_FACTS)(
    lambda s, d: ledger_ops.visible(td.run_facts(s, d), td.calendar(s)))
_query("latest_run_facts", f"select {_FACT} from run_facts where run_id = {_LATEST}", td.SQL_RUN_FACTS)(
    lambda s, d: ledger_ops.of_latest_run(td.run_facts(s, d), td.calendar(s)))
_query("portfolio_at_run", f"select {_COUNTS}, {_OWNERS}, {_RATE} from run_facts where run_id = 12",
       td.SQL_RUN_FACTS)(lambda s, d: metrics.portfolio(td.run_facts(s, d), run_id=12))
_query("portfolio_per_run", f"select run_id, {_COUNTS}, {_OWNERS}, {_RATE} from run_facts group by 1",
       td.SQL_RUN_FACTS)(lambda s, d: metrics.by(td.run_facts(s, d), ["run_id"], owners=True))
_query("restated_facts", """
    select run_id, action_id, project_name, action_name, owner, due_date, i.status as status,
           i.status = 'done' as is_completed, i.status <> 'done' as is_open,
           i.status <> 'done' and due_date <= reference_date as is_overdue,
           cast(case when i.status <> 'done' and due_date <= reference_date
                then date_diff('day', due_date, reference_date) else 0 end as integer) as days_overdue,
           'inclusive' as definition_version
    from items i join calendar c using (run_id)""", td.SQL_ITEMS, td.SQL_CALENDAR)(
    lambda s, d: staging.restate(td.raw_rows(s, d), td.calendar(s), "inclusive", True))

_INCLUSIVE = """restated as (
    select run_id, action_id, project_name, owner, i.status = 'done' as is_completed, i.status <> 'done' as is_open,
           i.status <> 'done' and due_date <= reference_date as is_overdue, 'inclusive' as definition_version
    from items i join calendar c using (run_id) where c.status = 'succeeded' and run_id % 3 = 0)"""
_ALL_VERSIONS = f"""
    select run_id, project_name, owner, is_completed, is_open, is_overdue, 'original' as definition_version
    from run_facts where run_id in {_OK_RUNS}
    union all select run_id, project_name, owner, is_completed, is_open, is_overdue, definition_version from restated"""


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visible facts, facts of every run restated, and marks of every third successful run: the others never ended."""
    runs = td.calendar(spark)
    restated = staging.restate(td.raw_rows(spark, sf), runs, "inclusive", True)
    done = ledger_ops.succeeded(runs).where("run_id % 3 = 0").withColumn("definition_version", F.lit("inclusive"))
    return ledger_ops.visible(td.run_facts(spark, sf), runs), restated, done


_query("portfolio_by_version", f"""
    select run_id, definition_version, {_COUNTS}, {_OWNERS}, {_RATE} from ({_ALL_VERSIONS}) group by 1, 2""",
       td.SQL_RUN_FACTS, _INCLUSIVE)(
    lambda s, d: metrics.by(staging.with_versions(*_versions(s, d)), ["run_id", "definition_version"], owners=True))
_query("projects_as_version", f"""
    select project_name, definition_version, {_COUNTS}, {_OWNERS}, {_RATE} from ({_ALL_VERSIONS})
    where definition_version = 'inclusive' or run_id not in (select run_id from restated) group by 1, 2""",
       td.SQL_RUN_FACTS, _INCLUSIVE)(
    lambda s, d: metrics.by(staging.as_version(*_versions(s, d), "inclusive"), ["project_name", "definition_version"], owners=True))

# --- quality rules ---------------------------------------------------------------------------

_BLANK = "'^[\\s\\p{Z}\\x{200B}\\x{FEFF}]*$'"


def _blank_sql(c: str) -> str:
    return f"({c} is null or regexp_matches({c}, {_BLANK}))"


_ROW_TESTS = {
    "DQ-02": (_blank_sql("action_id"), "blocking", "action_id is empty", ""),
    "DQ-04": (_blank_sql("project_name"), "blocking", "project_name is empty", ""),
    "DQ-05": (_blank_sql("action_name"), "blocking", "action_name is empty", ""),
    "DQ-06": (_blank_sql("owner"), "blocking", "owner is empty", ""),
    "DQ-07": (_blank_sql("due_date_raw") + " or not regexp_matches(due_date_raw,"
              " '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') or try_strptime(due_date_raw, '%Y-%m-%d') is null",
              "blocking", "due_date is empty or not a real ISO YYYY-MM-DD date", ""),
    "DQ-08": (_blank_sql("status"), "blocking", "status is empty", ""),
    "DQ-11": ("field_count <> header_count", "blocking",
              "record has a different number of fields than the header", ""),
    "DQ-12": ("regexp_matches(concat(action_id, project_name, action_name, owner, due_date_raw, status),"
              " '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')", "warning",
              "control character (e.g. NUL) in a field", "; kept as-is"),
}


def _row_sql(check: str) -> str:
    test, severity, message, tail = _ROW_TESTS[check]
    return (
        f"select run_id, '{check}' as check_name, source_row_number::varchar as record_key,"
        f" '{severity}' as severity_class, '{message} at source row ' || source_row_number || '{tail}'"
        f" as message, source_row_number::bigint as position from usable where {test}"
    )


_REQUIRED = "(values " + ", ".join(f"('{c}')" for c in schemas.SOURCE_COLUMNS) + ") t(c)"
_NAMES = ", ".join(f"'{c}'" for c in schemas.SOURCE_COLUMNS)
_MISSING_SQL = f"""
    select run_id, 'DQ-01' as check_name, c as record_key, 'blocking' as severity_class,
           'required column ''' || c || ''' is missing from the header' as message, 0::bigint as position
    from (select distinct run_id from headers) r, {_REQUIRED}
    where not exists (select 1 from headers h where h.run_id = r.run_id and h.column_name = c)
"""
_EXTRA_SQL = f"""
    select run_id, 'DQ-01' as check_name, column_name as record_key, 'warning' as severity_class,
           'unexpected extra column ''' || column_name || ''' (not loaded)' as message,
           1073741824::bigint as position
    from headers where column_name not in ({_NAMES})"""
_REPEAT_SQL = """
    select run_id, 'DQ-01' as check_name, column_name as record_key, 'blocking' as severity_class,
           'column ''' || column_name || ''' appears more than once in the header' as message,
           2147483648::bigint as position
    from headers group by run_id, column_name having count(*) > 1"""
_DUP_SQL = f"""
    select run_id, 'DQ-03' as check_name, action_id as record_key, 'blocking' as severity_class,
           'action_id is duplicated ' || count(*) || ' times (source rows '
           || array_to_string(list(source_row_number order by source_row_number)[1:20], ', ') || ')' as message,
           min(source_row_number)::bigint as position
    from usable where not {_blank_sql('action_id')} group by run_id, action_id having count(*) > 1"""
_STATUS_SQL = f"""
    select run_id, 'DQ-09' as check_name, status as record_key, 'investigation' as severity_class,
           'status value is not in enum action_status; kept as-is and counted as open' as message,
           min(source_row_number)::bigint as position
    from usable where not {_blank_sql('status')} and status not in ('done', 'in_progress', 'todo')
    group by run_id, status"""
_ALL_SQL = " union all ".join([_MISSING_SQL, _EXTRA_SQL, _REPEAT_SQL, *map(_row_sql, _ROW_TESTS), _DUP_SQL, _STATUS_SQL])
_CHECKS = ", ".join(f"'{c}'" for c in rules.CHECK_ORDER)
_FINDINGS = f"findings as ({_ALL_SQL})"


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    return rules.header_lists(td.headers(spark, sf))


def _usable(spark: SparkSession, sf: str) -> DataFrame:
    return td.read_rows(spark, sf).where("header_ok")


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return rules.all_findings(_usable(spark, sf), _headers(spark, sf))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.finding_counts(_usable(spark, sf), _headers(spark, sf))


_query("dq_01_missing", _MISSING_SQL, td.SQL_DIRTY)(lambda s, d: rules.missing_columns(_headers(s, d)))
_query("dq_01_extra", _EXTRA_SQL, td.SQL_DIRTY)(lambda s, d: rules.extra_columns(_headers(s, d)))
_query("dq_01_duplicate", _REPEAT_SQL, td.SQL_DIRTY)(lambda s, d: rules.repeated_columns(_headers(s, d)))
for _check in _ROW_TESTS:
    _query(_check.lower().replace("-", "_"), _row_sql(_check), td.SQL_DIRTY)(
        lambda s, d, check=_check: rules.findings_of_check(_usable(s, d), check))
_query("dq_03", f"""
    select run_id, action_id, count(*) as n,
           array_to_string(list(source_row_number order by source_row_number)[1:20], ',') as first_rows
    from usable where not {_blank_sql('action_id')} group by 1, 2 having count(*) > 1""", td.SQL_DIRTY)(
    lambda s, d: rules.duplicate_ids(_usable(s, d)).withColumn(
        "first_rows", F.array_join(F.col("first_rows").cast("array<string>"), ",")))
_query("dq_03_members", f"""
    select run_id, action_id, unnest(list(source_row_number)) as source_row_number, count(*) as n
    from usable where not {_blank_sql('action_id')} group by 1, 2 having count(*) > 1""", td.SQL_DIRTY)(
    lambda s, d: rules.duplicate_members(_usable(s, d)))
_query("dq_03_messages", _DUP_SQL, td.SQL_DIRTY)(lambda s, d: rules.duplicate_findings(_usable(s, d)))
_query("dq_09", _STATUS_SQL, td.SQL_DIRTY)(lambda s, d: rules.unknown_statuses(_usable(s, d)))
_query("all_findings", "select * from findings", td.SQL_DIRTY, _FINDINGS)(_findings)
# Ids rise with check and position inside a run, and no two are equal: a repeated id would repeat its rank.
_query("finding_ids", """
    select run_id, check_name, record_key, cast(row_number() over (
        partition by run_id order by check_name, position) as integer) as place from findings""", td.SQL_DIRTY, _FINDINGS)(
    lambda s, d: rules.with_result_ids(_findings(s, d)).select(
        "run_id", "check_name", "record_key",
        F.rank().over(Window.partitionBy("run_id").orderBy("quality_result_id")).alias("place")))
_query("severity_counts", "select run_id, severity_class, count(*) as findings from findings group by 1, 2",
       td.SQL_DIRTY, _FINDINGS)(lambda s, d: rules.severity_counts(_counts(s, d)))
_query("findings_matrix", "select check_name, severity_class, count(*) as findings from findings group by 1, 2",
       td.SQL_DIRTY, _FINDINGS)(lambda s, d: rules.findings_matrix(_counts(s, d)))
_query("drift_report", """
    select run_id, drift, count(*) as findings from (select run_id, case
        when check_name = 'DQ-01' and severity_class = 'blocking' then 'column_lost'
        when check_name = 'DQ-01' and severity_class = 'warning' then 'column_added'
        when check_name = 'DQ-07' then 'date_format_changed' when check_name = 'DQ-09' then 'new_status'
        end as drift from findings) where drift is not null group by 1, 2""", td.SQL_DIRTY, _FINDINGS)(
    lambda s, d: rules.drift_report(_counts(s, d)))
_query("dimension_counts", """
    select run_id, dimension, count(*) as findings from findings join (values
        ('DQ-01','completeness'), ('DQ-02','completeness'), ('DQ-04','completeness'), ('DQ-05','completeness'),
        ('DQ-06','completeness'), ('DQ-08','completeness'), ('DQ-07','validity'), ('DQ-09','validity'),
        ('DQ-03','uniqueness')) m(check_name, dimension) using (check_name) group by 1, 2""",
       td.SQL_DIRTY, _FINDINGS)(lambda s, d: rules.dimension_counts(_counts(s, d)))
_BAD = " or ".join(f"({t[0]})" for t in _ROW_TESTS.values() if t[1] == "blocking")
_COUNTED = f"""
    counted as (select run_id, count(*) as source_row_count,
        count(*) filter (not coalesce(bad, false)) as valid_row_count,
        count(*) filter (coalesce(bad, false)) as invalid_row_count
        from (select run_id, ({_BAD}) or (not {_blank_sql('action_id')}
              and count(*) over (partition by run_id, action_id) > 1) as bad from usable) group by 1)"""
_query("validation_counts", "select * from counted", td.SQL_DIRTY, _COUNTED)(
    lambda s, d: rules.validation_counts(_usable(s, d)))
_GATE = """
    gate as (select r.run_id, u.run_id is not null as header_ok, r.n as source_row_count,
        valid_row_count, invalid_row_count, u.run_id is not null and invalid_row_count = 0 as accepted
        from (select run_id, count(*) as n from dirty group by 1) r
        left join (select distinct run_id from usable) u using (run_id)
        left join counted c on c.run_id = r.run_id)"""
_query("gate_files", "select * from gate", td.SQL_DIRTY, _COUNTED, _GATE)(
    lambda s, d: rules.gate(td.read_rows(s, d), _headers(s, d)))


@_query("validation_preview", """
    select g.*, coalesce(blocking, 0) as blocking, coalesce(warning, 0) as warning,
           coalesce(investigation, 0) as investigation
    from gate g left join (select run_id, count(*) filter (severity_class = 'blocking') as blocking,
        count(*) filter (severity_class = 'warning') as warning,
        count(*) filter (severity_class = 'investigation') as investigation
        from findings group by 1) using (run_id)""", td.SQL_DIRTY, _FINDINGS, _COUNTED, _GATE)
def _preview(spark: SparkSession, sf: str) -> DataFrame:
    return rules.preview(td.read_rows(spark, sf), _headers(spark, sf))




# A pack with rules of a user's own: one about rows, two about sets.
OWN_PACK = rules.STANDARD.with_rules(
    rules.RowRule(
        "OWN-01", rules.WARNING, lambda: F.coalesce((F.col("status") != "done") & (F.col("due_date_raw") < "1996-01-01"), F.lit(False)),
        lambda row: F.concat(F.lit("open since before 1996 at source row "), row.cast("string"))),
    rules.SetRule(
        "OWN-02", rules.BLOCKING, "action_name", where=lambda: F.col("project_name") != "1-URGENT", fails=lambda g: g["n"] > 1, shows_rows=True,
        message=lambda g: F.concat(F.lit("one name for "), g["n"].cast("string"), F.lit(" actions (source rows "), g["rows"], F.lit(")"))),
    rules.SetRule(
        "OWN-03", rules.INVESTIGATION, "project_name", where=lambda: F.col("project_name").isNotNull(), fails=lambda g: g["open"] * 2 > g["n"],
        measures=(("open", "sum", "case when status = 'done' then 0 else 1 end"), ("last", "max", "due_date_raw")),
        message=lambda g: F.concat(g["open"].cast("string"), F.lit(" of "), g["n"].cast("string"), F.lit(" actions are not done, the last due "), g["last"])),
)
_OWN_SQL = """
    select run_id, 'OWN-01' as check_name, source_row_number::varchar as record_key, 'warning' as severity_class,
           'open since before 1996 at source row ' || source_row_number as message, source_row_number::bigint as position
    from usable where status <> 'done' and due_date_raw < '1996-01-01'
    union all
    select run_id, 'OWN-02', action_name, 'blocking', 'one name for ' || count(*) || ' actions (source rows '
           || array_to_string(list(source_row_number order by source_row_number)[1:20], ', ') || ')', min(source_row_number)
    from usable where project_name <> '1-URGENT' and action_name is not null group by run_id, action_name having count(*) > 1
    union all
    select run_id, 'OWN-03', project_name, 'investigation', count(*) filter (status is distinct from 'done') || ' of ' || count(*)
           || ' actions are not done, the last due ' || max(due_date_raw), min(source_row_number)
    from usable where project_name is not null group by run_id, project_name having 2 * count(*) filter (status is distinct from 'done') > count(*)"""
_OWN_CHECKS = _CHECKS + ", 'OWN-01', 'OWN-02', 'OWN-03'"
_query("pack_findings", f"""
    select *, run_id * (1::bigint << 37) + list_position([{_OWN_CHECKS}], check_name) * (1::bigint << 32) + position as quality_result_id
    from (select * from findings union all select * from own)""", td.SQL_DIRTY, _FINDINGS, f"own as ({_OWN_SQL})")(
    lambda s, d: rules.with_result_ids(rules.all_findings(_usable(s, d), _headers(s, d), OWN_PACK), OWN_PACK))
_query("pack_counts", "select run_id, check_name, severity_class, count(*) as findings from (from findings union all from own) group by all",
       td.SQL_DIRTY, _FINDINGS, f"own as ({_OWN_SQL})")(
    lambda s, d: rules.finding_counts(_usable(s, d), _headers(s, d), OWN_PACK))
_query("pack_gate", f"""
    select run_id, count(*) as source_row_count, count(*) filter (not coalesce(bad, false)) as valid_row_count,
           count(*) filter (coalesce(bad, false)) as invalid_row_count
    from (select run_id, ({_BAD}) or (not {_blank_sql('action_id')} and count(*) over (partition by run_id, action_id) > 1)
            or (coalesce(project_name <> '1-URGENT', false) and action_name is not null
                and count(*) filter (project_name <> '1-URGENT') over (partition by run_id, action_name) > 1) as bad
          from usable) group by 1""", td.SQL_DIRTY)(lambda s, d: rules.validation_counts(_usable(s, d), OWN_PACK))


def _findings_at(spark: SparkSession, sf: str, run_id: Column) -> DataFrame:
    """Findings of one run, which restricts the rows before any rule looks at them."""
    rows, names = (t(spark, sf).where(F.col("run_id") == run_id) for t in (_usable, td.headers))
    return rules.all_findings(rows, rules.header_lists(names))


@_query("findings_of_run", f"""
    select cast(row_number() over (order by check_name, position) as integer) as place,
           run_id * (1::bigint << 37) + list_position([{_CHECKS}], check_name) * (1::bigint << 32) + position
           as quality_result_id, check_name, record_key, severity_class, message from findings where run_id = {_LATEST}""",
        td.SQL_DIRTY, _FINDINGS)
def _findings_of_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The findings with their place in the run's list, counted without bringing them into one task."""
    latest = ledger_ops.latest_run(td.ledger(spark, sf)).scalar()
    of_run = reports.findings_of_run(_findings_at(spark, sf, latest), latest)
    placed, _ = number_rows(of_run, ["check_name", "quality_result_id"], 0, "place")
    return placed.select(F.col("place").cast("int").alias("place"), *of_run.columns)


_query("snapshot_profile", f"""
    select run_id, count(*) as total_rows, count(*) filter (status = 'done') as status_done,
           count(*) filter (status = 'in_progress') as status_in_progress,
           count(*) filter (status = 'todo') as status_todo,
           count(distinct project_name) as projects, count(distinct owner) as owners,
           min(due) as first_due_date, max(due) as last_due_date, cast(sum(blanks) as bigint) as blank_fields,
           (select count(*) from (select action_id from dirty d where d.run_id = x.run_id
               and not {_blank_sql('action_id')} group by 1 having count(*) > 1)) as duplicate_ids
    from (select *, case when regexp_matches(due_date_raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
                then try_strptime(due_date_raw, '%Y-%m-%d')::date end as due,
            {' + '.join(f'{_blank_sql(c)}::int' for c in schemas.TEXT_COLUMNS)} as blanks from dirty) x
    group by run_id""", td.SQL_DIRTY)(lambda s, d: metrics.snapshot_profile(td.dirty_rows(s, d)))


@_query("contract_check", """
    select column_name, 'not_null' as "check", case column_name when 'action_id' then 0
        when 'action_name' then (select count(*) from dirty where action_name is null)
        else 0 end::bigint as violations
    from (values ('run_id'), ('source_row_number'), ('action_id'), ('project_name'), ('action_name'),
                 ('owner'), ('due_date_raw'), ('status'), ('field_count')) t(column_name)
    union all select 'status', 'allowed_values', (select count(*) from dirty
        where status not in ('done', 'in_progress', 'todo'))
    union all select 'run_id, action_id', 'primary_key', (select count(*) - count(distinct (run_id, action_id)) from dirty)""", td.SQL_DIRTY)
def _contract(spark: SparkSession, sf: str) -> DataFrame:
    fields = [f for f in schemas.INPUT_ROWS if f.name != "header_count"]
    strict = schemas.StructType([schemas.StructField(f.name, f.dataType, False) for f in fields])
    return schemas.contract_violations(
        td.dirty_rows(spark, sf), strict, {"status": schemas.ACTION_STATUSES}, schemas.PRIMARY_KEYS["stg_actions"])


# --- integrity -------------------------------------------------------------------------------

_query("dq_10", """
    select l.run_id from ledger l
    left join (select run_id, count(*) as n from items group by 1) r using (run_id)
    left join (select run_id, count(*) as n from broken group by 1) f using (run_id)
    where not (source_row_count = valid_row_count + invalid_row_count
               and valid_row_count = coalesce(r.n, 0) and valid_row_count = coalesce(f.n, 0))""",
       td.SQL_BROKEN_FACTS)(
    lambda s, d: integrity.count_mismatches(td.ledger(s, d), td.raw_rows(s, d), td.broken_facts(s, d)))
_query("ri_01", f"select distinct run_id from broken where run_id not in {_OK_RUNS}", td.SQL_BROKEN_FACTS)(
    lambda s, d: integrity.facts_without_success(td.broken_facts(s, d), td.calendar(s)))
_query("ri_02", "select run_id, action_id from broken except select run_id, action_id from items",
       td.SQL_BROKEN_FACTS)(
    lambda s, d: integrity.facts_without_raw(td.broken_facts(s, d), td.raw_rows(s, d)))
_query("ri_03", "select run_id from moved where run_id not in (select run_id from calendar)",
       td.SQL_DIRTY, _FINDINGS,
       "moved as (select case when position % 9 = 0 then 2000 + run_id else run_id end as run_id from findings)")(
    lambda s, d: integrity.findings_without_run(
        _findings(s, d).withColumn("run_id", F.expr(
            "case when position % 9 = 0 then 2000 + run_id else run_id end")), td.calendar(s)))
_query("ri_04", "select summary_id from drafts where source_run_id not in (select run_id from calendar)",
       td.SQL_CALENDAR, td.SQL_DRAFTS)(
    lambda s, d: integrity.summaries_without_run(td.drafts(s, d), td.calendar(s)))
_query("ri_05", "select run_id, action_id from broken group by 1, 2 having count(*) > 1",
       td.SQL_BROKEN_FACTS)(lambda s, d: integrity.repeated_fact_keys(td.broken_facts(s, d)))
_ADDITIVE = ", ".join(f"'{c}'" for c in metrics.ADDITIVE)
_query("reconcile_rollup", " union all ".join(f"""
    select run_id, '{c}' as metric, cast(sum({c}) as bigint) as sum_of_projects,
           cast(max(whole) as bigint) as portfolio, sum({c}) = max(whole) as agrees
    from per_project join (select run_id, {c} as whole from per_run) using (run_id) group by 1"""
    for c in metrics.ADDITIVE), td.SQL_RUN_FACTS,
    f"per_project as (select run_id, project_name, {_COUNTS} from run_facts group by 1, 2)",
    f"per_run as (select run_id, {_COUNTS} from run_facts group by 1)")(
    lambda s, d: integrity.rollup_by_run(td.run_facts(s, d)))
_query("ingest_report", """
    select l.run_id, status, source_row_count, valid_row_count, invalid_row_count,
           count(f.run_id) filter (severity_class = 'blocking') as blocking_findings,
           count(f.run_id) filter (severity_class = 'warning') as warning_findings,
           count(f.run_id) filter (severity_class = 'investigation') as investigation_findings
    from ledger l left join findings f using (run_id) group by all""", td.SQL_DIRTY, _FINDINGS)(
    lambda s, d: ledger_ops.ingest_report(td.ledger(s, d), _counts(s, d)))

# --- trends and freshness --------------------------------------------------------------------

_query("an_01", """
    select run_id, source_row_count, previous_value, source_row_count - previous_value as change,
           round((source_row_count - previous_value) * 100.0::double / nullif(previous_value, 0), 6) as change_pct,
           coalesce(abs(round((source_row_count - previous_value) * 100.0::double
                    / nullif(previous_value, 0), 6)) > 15, false) as fires
    from (select run_id, source_row_count::bigint as source_row_count,
                 lag(source_row_count::bigint) over (order by run_id) as previous_value
          from ledger where status = 'succeeded')""", td.SQL_LEDGER)(
    lambda s, d: trends.volume_change(td.ledger(s, d), 15.0))
_OVERDUE = """
    series as (select c.run_id, count(f.run_id) filter (is_overdue) as overdue_actions
        from calendar c left join run_facts f using (run_id) where c.status = 'succeeded' group by 1)"""
_query("an_02", """
    select *, overdue_actions - previous_value as change,
           coalesce(abs(overdue_actions - previous_value) > 10, false) as fires
    from (select *, lag(overdue_actions) over (order by run_id) as previous_value from series)""",
       td.SQL_RUN_FACTS, _OVERDUE)(
    lambda s, d: trends.overdue_change(td.calendar(s), td.run_facts(s, d), 10))
_query("an_02_off", """
    select *, overdue_actions - previous_value as change, false as fires
    from (select *, lag(overdue_actions) over (order by run_id) as previous_value from series)""",
       td.SQL_RUN_FACTS, _OVERDUE)(
    lambda s, d: trends.overdue_change(td.calendar(s), td.run_facts(s, d)))
_query("an_03", """
    select run_id, source_row_count, rolling_mean, rolling_std, deviation,
           coalesce(abs(deviation) > 2, false) as fires
    from (select *, round(case when n = 6 and rolling_std > 0
                          then (source_row_count - rolling_mean) / rolling_std end, 4) as deviation
          from (select run_id, source_row_count, round(avg(source_row_count) over w, 6) as rolling_mean,
                       round(stddev_samp(source_row_count) over w, 6) as rolling_std,
                       count(source_row_count) over w as n
                from ledger where status = 'succeeded'
                window w as (order by run_id rows between 6 preceding and 1 preceding)))""", td.SQL_LEDGER)(
    lambda s, d: trends.rolling_deviation(
        ledger_ops.succeeded(td.ledger(s, d)).select("run_id", "source_row_count"),
        "source_row_count", 6, 2.0))
_query("al_01", """
    select completed_at, age_hours, age_hours > 1000 as fires from (
        select arg_max(completed_at, run_id) as completed_at,
               round(date_diff('second', arg_max(completed_at, run_id), timestamp '2001-09-01') / 3600.0::double, 6)
                   as age_hours from ledger where status = 'succeeded')""", td.SQL_LEDGER)(
    lambda s, d: trends.stale_success(td.ledger(s, d), td.AS_OF, 1000))
_query("al_02", """
    select *, coalesce(last_failed > coalesce(last_succeeded, -1), false) as fires from (
        select max(run_id) filter (status = 'failed') as last_failed,
               max(run_id) filter (status = 'succeeded') as last_succeeded from ledger)""", td.SQL_LEDGER)(
    lambda s, d: trends.unresolved_failure(td.ledger(s, d)))
_query("al_03", """
    select count(*) filter (status = 'succeeded') as succeeded_runs,
           count(*) filter (status = 'succeeded') = 0 as fires from ledger""", td.SQL_LEDGER)(
    lambda s, d: trends.no_success_yet(td.ledger(s, d)))
_AGE = "round(date_diff('second', {c}, timestamp '2001-09-01') / 3600.0::double, 6)"
_query("freshness_report", f"""
    select sla_id, dataset, criticality, case sla_id
        when 'FR-04' then (select {_AGE.format(c='max(started_at)')} from ledger)
        when 'FR-05' then (select {_AGE.format(c='max(created_at)')} from drafts)
        else (select {_AGE.format(c='arg_max(completed_at, run_id)')} from ledger where status = 'succeeded')
        end as age_hours
    from (values ('FR-01', 'ingestion_runs:latest', 'P0'), ('FR-02', 'stg_actions', 'P0'),
                 ('FR-03', 'raw_actions', 'P1'), ('FR-04', 'ingestion_runs+data_quality_results', 'P1'),
                 ('FR-05', 'executive_summaries', 'P2')) t(sla_id, dataset, criticality)""",
       td.SQL_LEDGER, td.SQL_DRAFTS)(
    lambda s, d: trends.freshness_report(td.ledger(s, d), td.drafts(s, d), td.AS_OF))

# --- reports ---------------------------------------------------------------------------------

_query("quality_summary", f"""
    select l.run_id, reference_date, source_row_count, valid_row_count, invalid_row_count,
           (select max(run_id) from ledger) as latest_attempt_run_id,
           (select arg_max(status, run_id) from ledger) as latest_attempt_status,
           count(*) filter (severity_class = 'blocking') as blocking,
           count(*) filter (severity_class = 'warning') as warning,
           count(*) filter (severity_class = 'investigation') as investigation
    from ledger l left join findings f using (run_id) where l.run_id = {_LATEST} group by all""",
       td.SQL_DIRTY, _FINDINGS)(lambda s, d: reports.quality_summary(td.ledger(s, d), _counts(s, d)))
_CURRENT = f"cur as (select * from run_facts where run_id = {_LATEST})"


def _safe_sql(c: str) -> str:
    return _SAFE.replace("text,", f"{c},", 1)


_query("context_rows", f"""
    select action_id, {_safe_sql('project_name')} as project_name, {_safe_sql('action_name')} as action_name,
           {_safe_sql('owner')} as owner, due_date, days_overdue
    from facts where is_overdue order by days_overdue desc, due_date, action_id limit 10""", td.SQL_FACTS)(
    lambda s, d: reports.context_rows(td.facts(s, d)))
_DOC_FIELDS = ", ".join(f"'{c}', {c}" for c in sorted(
    [*metrics.ADDITIVE, "owners_with_overdue_actions", "completion_rate"]))


@_query("context_document", f"""
    select {_LATEST} as source_run_id, '2001-07-21' as reference_date, null::varchar as project_filter,
        10::integer as top_n, p.overdue_actions as overdue_total, p.total_actions, p.completion_rate,
        (select string_agg(project_name || '=' || overdue_actions, ';' order by project_name)
         from (select project_name, {_COUNTS} from cur group by 1)) as projects,
        (select string_agg(action_id || '/' || days_overdue, ';' order by days_overdue desc, due_date, action_id)
         from (select * from cur where is_overdue order by days_overdue desc, due_date, action_id limit 10))
         as top_overdue_actions
    from p""", td.SQL_RUN_FACTS, _CURRENT, f"p as (select {_COUNTS}, {_OWNERS}, {_RATE} from cur)")
def _context(spark: SparkSession, sf: str) -> DataFrame:
    doc = reports.context_document(td.run_facts(spark, sf), td.calendar(spark))
    return doc.select(
        "source_run_id", "reference_date", "project_filter", "top_n", "overdue_total",
        "portfolio.total_actions", "portfolio.completion_rate",
        F.array_join(F.transform("projects", lambda p: F.concat(
            p["project_name"], F.lit("="), p["overdue_actions"].cast("string"))), ";").alias("projects"),
        F.array_join(F.transform("top_overdue_actions", lambda r: F.concat(
            r["action_id"], F.lit("/"), r["days_overdue"].cast("string"))), ";").alias("top_overdue_actions"),
    )


_PROJECT_JSON = ", ".join(f"'{c}', {c}" for c in sorted([*metrics.ADDITIVE, "project_name"]))
_ROW_JSON = "'action_id', action_id, 'action_name', action_name, 'days_overdue', days_overdue," \
    " 'due_date', strftime(due_date, '%Y-%m-%d'), 'owner', owner, 'project_name', project_name"


@_query("context_json", f"""
    select {_LATEST} as source_run_id, cast(json_object(
        'overdue_total', overdue_actions, 'portfolio', json_object({', '.join(f"'{c}', {c}" for c in sorted(
            [*metrics.ADDITIVE, "owners_with_overdue_actions"]))}),
        'project_filter', null::varchar,
        'projects', (select cast('[' || string_agg(json_object({_PROJECT_JSON})::varchar, ',' order by project_name)
                     || ']' as json) from (select project_name, {_COUNTS} from cur group by 1)),
        'reference_date', '2001-07-21', 'source_run_id', {_LATEST}, 'top_n', 10,
        'top_overdue_actions', (select cast('[' || string_agg(json_object({_ROW_JSON})::varchar, ','
              order by days_overdue desc, due_date, action_id) || ']' as json) from (select * from cur where is_overdue order by days_overdue desc, due_date, action_id limit 10))
        ) as varchar) as payload from p""", td.SQL_RUN_FACTS, _CURRENT,
        f"p as (select {_COUNTS}, {_OWNERS}, {_RATE} from cur)")
def _context_json(spark: SparkSession, sf: str) -> DataFrame:
    # Doubles have engine-specific text forms, so the compared payload leaves the rates out.
    doc = reports.context_document(td.run_facts(spark, sf), td.calendar(spark))
    slim = doc.withColumns({
        "portfolio": F.col("portfolio").dropFields("completion_rate"),
        "projects": F.transform("projects", lambda p: p.dropFields("completion_rate")),
    })
    return reports.context_json(slim)


_query("latest_summary", """
    select * from drafts qualify row_number() over (
        partition by project_filter order by created_at desc, summary_id desc) = 1""", td.SQL_DRAFTS)(
    lambda s, d: reports.latest_summaries(td.drafts(s, d)))
_query("summary_history", """
    select *, cast(row_number() over (order by created_at desc, summary_id desc) as integer) as rank
    from drafts qualify rank <= 10""", td.SQL_DRAFTS)(
    lambda s, d: _ranked(reports.summary_history(td.drafts(s, d)), F.desc("created_at"), F.desc("summary_id")))
_query("stale_summaries", f"""
    select summary_id, project_filter, source_run_id, {_LATEST} as latest_run_id,
           source_run_id <> {_LATEST} as is_stale from drafts""", td.SQL_CALENDAR, td.SQL_DRAFTS)(
    lambda s, d: reports.stale_summaries(td.drafts(s, d), td.calendar(s)))
_query("saved_drafts", """
    select cast(row_number() over (order by conv_id, turn) as bigint) as summary_id,
        case when contains(lower(substring(text, 1, 200)), 'draft') or contains(substring(text, 1, 200), 'ร่าง')
             then text else '[ร่าง (DRAFT)]' || chr(10) || text end as summary_text,
        'p' as provider, 'm' as model_name, 'v1' as prompt_version
    from conversations
      where not regexp_matches(text, '^[\\s\\p{Z}\\x{200B}\\x{FEFF}]*$')""")(
    lambda s, d: _saved_drafts(s, d))


def _saved_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Store every generated text in a fresh warehouse and read the table back."""
    turns = td.table(spark, sf, "conversations")
    texts = turns.selectExpr(
        "text as summary_text", "1 + conv_id % 80 as source_run_id", "date '2001-07-21' as reference_date",
        "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id * 37 + turn as int)) as created_at",
        "cast(null as string) as project_filter",
    )
    wh = Warehouse(spark, fresh_folder(spark, "drafts"))
    wh.save_drafts(reports.draft_rows(texts, "p", "m", "v1"))
    return wh.summaries().select("summary_id", "summary_text", "provider", "model_name", "prompt_version")


@_query("weekly_report", f"""
    select 'header' as section, source_file as item, run_id as figure from ledger where run_id = {_LATEST}
    union all select 'portfolio_summary', unnest(['total_actions', 'overdue_actions', 'owners_with_overdue_actions']),
        unnest([count(*), count(*) filter (is_overdue), count(distinct owner) filter (is_overdue)]) from cur
    union all select 'by_project', project_name, count(*) filter (is_overdue) from cur group by 2
    union all select 'overdue_detail', action_id, days_overdue from cur where is_overdue
    union all select 'overdue_by_owner', owner, count(*) from cur where is_overdue group by 2
    union all select 'data_notes', check_name || ' ' || severity_class, count(*)
        from findings where run_id = {_LATEST} group by 2""",
        td.SQL_RUN_FACTS, td.SQL_DIRTY.replace(td.SQL_LEDGER + ", ", ""), _FINDINGS, _CURRENT)
def _weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Write the six sections and read from each what its rows are about and a figure of theirs."""
    out = fresh_folder(spark, "report")
    runs = td.ledger(spark, sf)
    latest = ledger_ops.latest_run(runs).scalar()
    sections = reports.weekly_report(td.run_facts(spark, sf), runs, _findings_at(spark, sf, latest))
    shown = {
        "header": ("source_file", "run_id"), "by_project": ("project_name", "overdue_actions"),
        "overdue_detail": ("action_id", "days_overdue"), "overdue_by_owner": ("owner", "overdue_actions"),
        "data_notes": ("concat_ws(' ', check_name, severity_class)", "findings"),
        "portfolio_summary": None,
    }
    parts = []
    for name, rows in sections.items():
        rows.write.parquet(f"{out}/{name}")
        stored = spark.read.parquet(f"{out}/{name}")
        if shown[name] is None:
            item, figure = "item", "figure"
            stored = stored.unpivot([], ["total_actions", "overdue_actions", "owners_with_overdue_actions"], item, figure)
        else:
            item, figure = shown[name]
        parts.append(stored.select(F.lit(name).alias("section"), F.expr(item).alias("item"), F.expr(figure).cast("bigint").alias("figure")))
    return reduce(DataFrame.unionByName, parts)


# --- governance ------------------------------------------------------------------------------

CUTOFF = datetime(1998, 1, 1)
_EXPIRED = f"(select run_id from ledger where completed_at < timestamp '1998-01-01' and run_id <> {_LATEST})"
_query("retention_plan", " union all ".join(f"""
    select {step} as step, '{name}' as table_name, run_id, count(*) as rows from
        (select {key} as run_id from {source}) where run_id in {_EXPIRED} group by run_id"""
    for step, name, source, key in (
        (1, "data_quality_results", "findings", "run_id"), (2, "stg_actions", "run_facts", "run_id"),
        (3, "raw_actions", "items", "run_id"), (4, "executive_summaries", "drafts", "source_run_id"),
        (5, "ingestion_runs", "ledger", "run_id"))),
    td.SQL_RUN_FACTS, td.SQL_DIRTY.replace(td.SQL_LEDGER + ", ", ""), _FINDINGS, td.SQL_DRAFTS)(
    lambda s, d: governance.retention_plan(td.ledger(s, d), {
        "data_quality_results": _counts(s, d), "stg_actions": td.run_facts(s, d),
        "raw_actions": td.raw_rows(s, d), "executive_summaries": td.drafts(s, d)}, CUTOFF))
_query("masked_detail", f"""
    select * replace (case when owner = '{OWNER}' then owner else sha256('{SALT}' || owner) end as owner,
                      null::varchar as action_name)
    from (select {_DETAIL} from facts where is_overdue)""", td.SQL_FACTS)(
    lambda s, d: governance.masked(metrics.overdue_rows(td.facts(s, d)), "ROLE-04", SALT, OWNER))
_query("tokenized_owner", f"""
    select sha256('{SALT}' || owner) as owner, count(*) as total_actions from facts group by 1""", td.SQL_FACTS)(
    lambda s, d: governance.tokenized_owners(td.facts(s, d), SALT).groupBy("owner").agg(
        F.count(F.lit(1)).alias("total_actions")))
_query("row_scope", f"""
    select {_DETAIL} from facts where is_overdue and owner in (
        select 'Owner-' || lpad((c_custkey % 97)::varchar, 3, '0') from customer where c_nationkey = 3)""",
       td.SQL_FACTS)(
    lambda s, d: governance.row_scope(
        metrics.overdue_rows(td.facts(s, d)), td.entitlements(s, d), "nation-3").select(*metrics.DETAIL_COLUMNS))
_SCOPED = "owner in (select 'Owner-' || lpad((c_custkey % 97)::varchar, 3, '0') from customer where c_nationkey = 3)"
for _role, _owner, _name, _rows in (
    ("ROLE-01", f"sha256('{SALT}' || owner)", "null::varchar", "true"), ("ROLE-02", f"sha256('{SALT}' || owner)", "null::varchar", "project_name = '2-HIGH'"),
    ("ROLE-03", "owner", "action_name", "true"), ("ROLE-04", "owner", "null::varchar", _SCOPED), ("ROLE-06", "owner", "action_name", "true"),
):
    _query(f"bound_{_role[-2:]}", f"""
        select project_name, {_owner} as owner, count({_name}) as names, count(*) as total_actions from facts where {_rows} group by 1, 2""", td.SQL_FACTS)(
        lambda s, d, role=_role: governance.bound(
            td.facts(s, d), "stg_actions", "nation-3", role, SALT,
            td.entitlements(s, d).withColumn("project_name", F.when(F.col("actor") == "nation-3", "2-HIGH").otherwise("5-LOW")),
        ).groupBy("project_name", "owner").agg(F.count("action_name").alias("names"), F.count(F.lit(1)).alias("total_actions")))
_query("masked_findings", "select run_id, check_name, severity_class, null::varchar as record_key, null::varchar as message, position from findings",
       td.SQL_DIRTY, _FINDINGS)(lambda s, d: governance.masked_findings(_findings(s, d), "ROLE-03"))
_query("erasure_report", f"""
    select *, rows_before - subject_rows as rows_after from (
        select 'stg_actions' as table_name, run_id, count(*) as rows_before,
               count(*) filter (owner = '{OWNER}') as subject_rows from run_facts group by 2
        union all select 'raw_actions', run_id, count(*), count(*) filter (owner = '{OWNER}') from items group by 2
        union all select 'data_quality_results', run_id, count(*),
               count(*) filter (record_key = '{OWNER}' or contains(message, '{OWNER}')) from findings group by 2
        union all select 'executive_summaries', source_run_id, count(*),
               count(*) filter (contains(summary_text, '{OWNER}')) from drafts group by 2)
    where subject_rows > 0""",
       td.SQL_RUN_FACTS, td.SQL_DIRTY.replace(td.SQL_LEDGER + ", ", ""), _FINDINGS, td.SQL_DRAFTS)(
    lambda s, d: governance.erasure_report(
        OWNER, td.raw_rows(s, d), td.run_facts(s, d), _findings(s, d), td.drafts(s, d)))
_query("audit_rollup", """
    select event_type, dataset, count(*) as events, count(distinct actor_id) as actors,
           cast(sum(row_count) as bigint) as rows_returned from audit group by 1, 2""", td.SQL_AUDIT)(
    lambda s, d: governance.audit_rollup(td.audit_log(s, d)))

# --- evaluation of drafts --------------------------------------------------------------------


def _context_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers a draft may use: the counts of its run and of the run's projects."""
    facts = td.run_facts(spark, sf)
    counts = F.array(*[F.col(c).cast("string") for c in metrics.ADDITIVE])
    wide = metrics.by(facts, ["run_id"]).select("run_id", counts.alias("n")).unionByName(
        metrics.by(facts, ["run_id", "project_name"]).select("run_id", counts.alias("n")))
    return wide.select(F.col("run_id").alias("source_run_id"), F.explode("n").alias("number"))


_UNNEST = "unnest([" + ", ".join(f"{c}::varchar" for c in metrics.ADDITIVE) + "]) as number"
_query("eval_grounding", f"""
    select distinct summary_id, source_run_id, number from (
        select summary_id, source_run_id, unnest(list_transform(
            regexp_extract_all(summary_text, '[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?'),
            lambda n: replace(n, ',', ''))) as number from drafts) d
    where not exists (select 1 from known k where k.run_id = d.source_run_id and k.number = d.number)""",
       td.SQL_RUN_FACTS, td.SQL_DRAFTS, f"""
    known as (select run_id, {_UNNEST} from (select run_id, {_COUNTS} from run_facts group by 1)
        union all select run_id, {_UNNEST} from
            (select run_id, project_name, {_COUNTS} from run_facts group by 1, 2))""")(
    lambda s, d: evaluation.ungrounded_numbers(td.drafts(s, d), _context_numbers(s, d)))
_query("eval_terms", """
    select summary_id, term from drafts, (values ('severity'), ('impact'), ('priority'), ('SLA'),
        ('consequence'), ('criticality')) t(term)
    where contains(lower(summary_text), lower(term))""", td.SQL_DRAFTS)(
    lambda s, d: evaluation.forbidden_terms(td.drafts(s, d)))
_query("eval_structure", """
    select *, has_label and sections_present = 5 as complete from (select summary_id,
        contains(substring(summary_text, 1, 200), 'ร่าง')
            or contains(lower(substring(summary_text, 1, 200)), 'draft') as has_label,
        cast(contains(summary_text, '(1)')::int + contains(summary_text, '(2)')::int
             + contains(summary_text, '(3)')::int + contains(summary_text, '(4)')::int
             + contains(summary_text, '(5)')::int as integer) as sections_present from drafts)""", td.SQL_DRAFTS)(
    lambda s, d: evaluation.structure(td.drafts(s, d)))
_query("eval_scope", """
    select summary_id, project_filter, project_name
    from drafts, (select distinct project_name from items)
    where project_filter is not null and project_name <> project_filter and regexp_matches(summary_text,
        '(^|[^\\p{L}\\p{N}])' || regexp_escape(project_name) || '($|[^\\p{L}\\p{N}])')""",
       td.SQL_ITEMS, td.SQL_DRAFTS)(
    lambda s, d: evaluation.out_of_scope_projects(td.drafts(s, d), td.items(s, d)))
_query("eval_privacy", """
    select summary_id, regexp_matches(summary_text,
        '(sk-[A-Za-z0-9_-]{16,}|OPENAI_API_KEY|Bearer\\s+[A-Za-z0-9._-]{16,})') as has_secret
    from drafts""", td.SQL_DRAFTS)(lambda s, d: evaluation.privacy(td.drafts(s, d)))
_query("draft_drift", """
    select provider, model_name, prompt_version, drafts, first_created_at,
        coalesce(lag(provider) over w <> provider, false) as provider_changed,
        coalesce(lag(model_name) over w <> model_name, false) as model_name_changed,
        coalesce(lag(prompt_version) over w <> prompt_version, false) as prompt_version_changed
    from (select provider, model_name, prompt_version, count(*) as drafts,
                 min(created_at) as first_created_at, arg_min(summary_id, (created_at, summary_id)) as first_id
          from drafts group by 1, 2, 3) window w as (order by first_created_at, first_id)""", td.SQL_DRAFTS)(
    lambda s, d: evaluation.draft_versions(td.drafts(s, d)))

# --- files and loading -----------------------------------------------------------------------

_QUOTED_NAME = "case when k % 17 = 0 then 'Order \"' || k || '\", first' || chr(13) || chr(10) || 'second' else f_name end"
_FILE_ROWS = """
    file_rows as (select file_no,
        cast(row_number() over (partition by file_no order by ord) as integer) as source_row_number,
        nullif(f_id, '') as action_id, nullif(f_project, '') as project_name, nullif(f_name, '') as action_name,
        case when (file_no % 35) % 7 = 4 then null else nullif(f_owner, '') end as owner,
        nullif(f_due, '') as due_date_raw, nullif(f_status, '') as status,
        cast(case when blank then 0 else header_count + has_spill::int end as integer) as field_count,
        header_count, (file_no % 35) % 7 <> 4 as header_ok
    from (select *, cast(case when (file_no % 35) % 7 = 4 then 5 when (file_no % 35) % 5 = 2 then 7 else 6 end
                         as integer) as header_count
          from (select file_no, k * 2 + 1 as ord, f_id, f_project, f_name, f_owner, f_due, f_status,
                       has_spill, false as blank from fields
                union all select file_no, k * 2 + 2, null, null, null, null, null, null, false, true
                from fields where blank_after)))"""
_ROW_COLUMNS = "file_no, source_row_number, " + ", ".join(schemas.TEXT_COLUMNS) + ", field_count, header_count, header_ok"
_query("src_rows", f"select {_ROW_COLUMNS} from file_rows", td.SQL_LINES, _FILE_ROWS)(
    lambda s, d: src.data_rows(td.file_records(s, d)).select(*_ROW_COLUMNS.split(", ")))
_query("src_header", """
    select file_no, cast(unnest(range(len(names))) as integer) as position, unnest(names) as column_name
    from (select file_no, string_split(trim(line, chr(13)), ',') as names from lines where ord = -1)""",
       td.SQL_LINES)(lambda s, d: src.header_columns(td.file_records(s, d), "file_no"))


_query("file_fingerprint", """
    select file_no, cast(strlen(content) as bigint) as length, sha256(content) as source_hash from files""",
       td.SQL_FILES)(
    lambda s, d: src.fingerprints(td.files(s, d)).select(td.file_number().alias("file_no"), "length", "source_hash"))
SIZE_CAP = 72_000


@_query("file_admission", f"""
    select file_no, case when strlen(content) > {SIZE_CAP} then 'too_large' else 'ok' end as admission,
           case when strlen(content) > {SIZE_CAP} then null else sha256(content) end as source_hash,
           cast(case when strlen(content) > {SIZE_CAP} then 0 else n end as integer) as source_row_count
    from files join (select file_no, count(*) as n from lines where ord >= 0 group by 1) using (file_no)""",
        td.SQL_FILES)
def _admission(spark: SparkSession, sf: str) -> DataFrame:
    files = td.files(spark, sf)
    summary = src.file_summary(files, src.split_records(files, SIZE_CAP), SIZE_CAP)
    return summary.select("file_no", "admission", "source_hash", "source_row_count")


_FILE_GATE = f"""
    file_gate as (select file_no, count(*) as source_row_count, bool_and(header_ok) as header_ok,
        count(*) filter (header_ok and coalesce(bad, false)) as invalid_row_count
        from (select *, ({_BAD}) or (not {_blank_sql('action_id')}
              and count(*) over (partition by file_no, action_id) > 1) as bad from file_rows) group by 1)"""
_LOADED = """
    select sha256(content) as source_hash,
           case when header_ok and invalid_row_count = 0 then 'succeeded' else 'failed' end as status,
           cast(source_row_count as integer) as source_row_count,
           cast(case when header_ok then source_row_count - invalid_row_count end as integer) as valid_row_count,
           cast(case when header_ok then invalid_row_count end as integer) as invalid_row_count
    from file_gate join files using (file_no)"""


def _loaded(spark: SparkSession, sf: str) -> Warehouse:
    wh = Warehouse(spark, fresh_folder(spark, "warehouse"))
    ingest.ingest(wh, td.write_files(spark, sf), td.REFERENCE_DATE)
    return wh


_LEDGER_COLUMNS = ("source_hash", "status", "source_row_count", "valid_row_count", "invalid_row_count")
@_query("orphan_folders", """
    select 'stg_actions' as table_name, run_id, status
    from (select distinct case when action_id like '%77' then 1000 + run_id % 5 else run_id end as run_id from run_facts)
    left join ledger using (run_id) where status is null or status in ('failed', 'running')""", td.SQL_RUN_FACTS)
def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    """A store in which loads were killed, failed, or lost their ledger entries."""
    return _broken_store(spark, sf).orphans(datetime(2100, 1, 1))


@_query("ri_01_stored", """
    select distinct run_id from (select case when action_id like '%77' then 1000 + run_id % 5 else run_id end as run_id from run_facts)
    where run_id not in (select run_id from ledger where status = 'succeeded')""", td.SQL_RUN_FACTS)
def _stored_without_success(spark: SparkSession, sf: str) -> DataFrame:
    wh = _broken_store(spark, sf)
    return integrity.facts_without_success(wh.read("stg_actions"), wh.runs())


@_query("latest_stored_facts", f"select action_id, due_date from run_facts where action_id not like '%77' and run_id = {_LATEST}", td.SQL_RUN_FACTS)
def _latest_stored(spark: SparkSession, sf: str) -> DataFrame:
    return _broken_store(spark, sf).latest_facts().select("action_id", "due_date")


def _broken_store(spark: SparkSession, sf: str) -> Warehouse:
    wh = Warehouse(spark, fresh_folder(spark, "broken"))
    wh.append("run_events", td.run_events(spark, sf))
    lost = F.when(F.col("action_id").endswith("77"), 1000 + F.col("run_id") % 5).otherwise(F.col("run_id"))
    wh.append("stg_actions", td.run_facts(spark, sf).withColumns({"run_id": lost, "loaded_at": F.expr("timestamp_ntz '2001-08-02 10:00:00'")}))
    return wh


_query("ingest_ledger", _LOADED, td.SQL_FILES, _FILE_ROWS, _FILE_GATE)(
    lambda s, d: _loaded(s, d).runs().select(*_LEDGER_COLUMNS))


@_query("ingest_findings", f"""
    select sha256(content) as source_hash, check_name, count(*) as findings from files join (
        select file_no, 'DQ-01' as check_name from file_rows group by file_no having not bool_and(header_ok)
        union all select file_no, 'DQ-01' from (select distinct file_no from file_rows)
            where (file_no % 35) % 5 = 2 and (file_no % 35) % 7 <> 4
        {' '.join(f"union all select file_no, '{c}' from file_rows where header_ok and ({t[0]})"
                  for c, t in _ROW_TESTS.items())}
        union all select distinct file_no, 'DQ-09' from file_rows where header_ok and status = 'Done')
    using (file_no) group by 1, 2""", td.SQL_FILES, _FILE_ROWS)
def _ingest_findings(spark: SparkSession, sf: str) -> DataFrame:
    wh = _loaded(spark, sf)
    counted = wh.findings().groupBy("run_id", "check_name").agg(F.count(F.lit(1)).alias("findings"))
    return counted.join(wh.runs().select("run_id", "source_hash"), "run_id").drop("run_id")


_query("ingest_facts", f"""
    select source_hash, {_COUNTS}, {_OWNERS}, {_RATE} from (
        select source_hash, owner, status = 'done' as is_completed, status <> 'done' as is_open,
               status <> 'done' and due_date_raw::date < date '1998-08-02' as is_overdue
        from file_rows join loaded using (file_no)) group by 1""",
       td.SQL_FILES, _FILE_ROWS, _FILE_GATE,
       "loaded as (select file_no, sha256(content) as source_hash from file_gate join files using (file_no)"
       " where header_ok and invalid_row_count = 0)")(lambda s, d: _ingest_facts(s, d))


def _ingest_facts(spark: SparkSession, sf: str) -> DataFrame:
    wh = _loaded(spark, sf)
    keyed = wh.facts().join(wh.runs().select("run_id", "source_hash"), "run_id")
    return metrics.by(keyed, ["source_hash"], owners=True)


@_query("stream_ingest", _LOADED, td.SQL_FILES, _FILE_ROWS, _FILE_GATE)
def _stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The same files through the incremental file-drop stream."""
    from snapledger.streaming import file_drop

    wh = Warehouse(spark, fresh_folder(spark, "warehouse"))
    landing = td.write_files(spark, sf)
    query = file_drop.start(wh, landing, fresh_folder(spark, "stream"), td.REFERENCE_DATE, 100)
    query.awaitTermination()
    return wh.runs().select(*_LEDGER_COLUMNS)
