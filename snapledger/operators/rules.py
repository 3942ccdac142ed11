"""Data-quality rules over text snapshots of any number of runs at once.

Every rule yields (run_id, check_name, record_key, severity_class, message, position). Row rules
share one pass over the rows; rules about groups fold their keys before any row moves, so one key
or one run may hold most of the input. Messages never carry owner or action_name values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapledger.functions.text import has_control, is_blank, is_real_iso_date
from snapledger.operators import packs
from snapledger.operators.packs import BLOCKING, FINDING_COLUMNS, INVESTIGATION, MAX_ROWS_SHOWN, WARNING, Pack, RowRule, SetRule
from snapledger.schemas import ACTION_STATUSES, SEVERITIES, SOURCE_COLUMNS, TEXT_COLUMNS

# Bits of a finding's id: run, check, position inside the run.
RUN_BITS, CHECK_BITS, POSITION_BITS = 26, 5, 32
HEADER_STEP = 1 << 30  # header findings of one kind stay below the next kind's first position


def _at_row(text: str, tail: str = "") -> Callable[[Column], Column]:
    return lambda row: F.concat(F.lit(f"{text} at source row "), row.cast("string"), F.lit(tail))


def _blank_rule(name: str, column: str) -> RowRule:
    return RowRule(name, BLOCKING, lambda: is_blank(column), _at_row(f"{column} is empty"))


# Rule names, severities and message texts.
ROW_RULES: tuple[RowRule, ...] = (
    _blank_rule("DQ-02", "action_id"),
    _blank_rule("DQ-04", "project_name"),
    _blank_rule("DQ-05", "action_name"),
    _blank_rule("DQ-06", "owner"),
    RowRule(
        "DQ-07", BLOCKING, lambda: ~is_real_iso_date("due_date_raw"),
        _at_row("due_date is empty or not a real ISO YYYY-MM-DD date"),
    ),
    _blank_rule("DQ-08", "status"),
    RowRule(
        "DQ-11", BLOCKING, lambda: F.col("field_count") != F.col("header_count"),
        _at_row("record has a different number of fields than the header"),
    ),
    RowRule(
        "DQ-12", WARNING, lambda: has_control(*TEXT_COLUMNS),
        _at_row("control character (e.g. NUL) in a field", "; kept as-is"),
    ),
)

REPEATED_ID = SetRule(
    "DQ-03", BLOCKING, "action_id", where=lambda: ~is_blank("action_id"), fails=lambda g: g["n"] > 1, shows_rows=True,
    message=lambda g: F.concat(F.lit("action_id is duplicated "), g["n"].cast("string"), F.lit(" times (source rows "), g["rows"], F.lit(")")),
)
UNKNOWN_STATUS = SetRule(
    "DQ-09", INVESTIGATION, "status", where=lambda: ~is_blank("status") & ~F.col("status").isin(*ACTION_STATUSES), fails=lambda g: F.lit(True),
    message=lambda g: F.lit("status value is not in enum action_status; kept as-is and counted as open"),
)
SET_RULES: tuple[SetRule, ...] = (REPEATED_ID, UNKNOWN_STATUS)
STANDARD = Pack(ROW_RULES, SET_RULES)

# Order of the checks inside a run's findings.
CHECK_ORDER = (
    "DQ-01", "DQ-02", "DQ-03", "DQ-04", "DQ-05", "DQ-06", "DQ-07", "DQ-08", "DQ-09", "DQ-10",
    "DQ-11", "DQ-12", "RI-05",
)

# Which quality dimension a rule measures.
DIMENSIONS = {
    "completeness": ("DQ-01", "DQ-02", "DQ-04", "DQ-05", "DQ-06", "DQ-08"),
    "validity": ("DQ-07", "DQ-09"),
    "uniqueness": ("DQ-03", "RI-05"),
    "consistency": ("DQ-10", "RI-01", "RI-02", "RI-03", "RI-04"),
}


def _finding(
    check: Column | str, key: Column, severity: Column | str, message: Column, position: Column
) -> list[Column]:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return [
        F.col("run_id"),
        lit(check).alias("check_name"),
        key.cast("string").alias("record_key"),
        lit(severity).alias("severity_class"),
        message.alias("message"),
        position.cast("bigint").alias("position"),
    ]


# --- header ----------------------------------------------------------------------------------


def header_lists(headers: DataFrame) -> DataFrame:
    """(run_id, names) from a header relation (run_id, position, column_name).

    A group is the header of one file, so its size is that of one record.
    """
    placed = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    return headers.groupBy("run_id").agg(placed.alias("placed")).select(
        "run_id", F.col("placed.column_name").alias("names")
    )


def _required() -> Column:
    return F.array(*map(F.lit, SOURCE_COLUMNS))


def _repeated(names: Column) -> Column:
    """Names that occur more than once, each once."""
    return F.filter(
        F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1
    )


def _header_hits(
    names: Column, severity: str, before: str, after: str, offset: int
) -> Column:
    """One (record_key, severity_class, message, position) per offending name."""
    return F.transform(names, lambda name, place: F.struct(
        name.alias("record_key"), F.lit(severity).alias("severity_class"),
        F.concat(F.lit(before), name, F.lit(after)).alias("message"),
        (F.lit(offset) + place).cast("bigint").alias("position"),
    ))


def _missing() -> Column:
    return _header_hits(
        F.array_except(_required(), F.col("names")), BLOCKING,
        "required column '", "' is missing from the header", 0,
    )


def _extra() -> Column:
    return _header_hits(
        F.filter("names", lambda n: ~n.isin(*SOURCE_COLUMNS)), WARNING,
        "unexpected extra column '", "' (not loaded)", HEADER_STEP,
    )


def _twice() -> Column:
    return _header_hits(
        _repeated(F.col("names")), BLOCKING, "column '", "' appears more than once in the header", 2 * HEADER_STEP,
    )


def _spread(lists: DataFrame, *hits: Column) -> DataFrame:
    found = lists.select("run_id", F.inline(F.concat(*hits)))
    return found.withColumn("check_name", F.lit("DQ-01")).select(*FINDING_COLUMNS)


def missing_columns(lists: DataFrame) -> DataFrame:
    """Required columns that a run's header lacks; `lists` is (run_id, names)."""
    return _spread(lists, _missing())


def extra_columns(lists: DataFrame) -> DataFrame:
    return _spread(lists, _extra())


def repeated_columns(lists: DataFrame) -> DataFrame:
    return _spread(lists, _twice())


def header_findings(lists: DataFrame) -> DataFrame:
    """All DQ-01 findings in one pass over the headers."""
    return _spread(lists, _missing(), _extra(), _twice())


def header_counts(lists: DataFrame) -> DataFrame:
    """(run_id, check_name, severity_class, findings) of DQ-01."""
    sizes = [("blocking", F.size(_missing()) + F.size(_twice())), ("warning", F.size(_extra()))]
    each = F.array(*[F.struct(F.lit("DQ-01").alias("check_name"), F.lit(s).alias("severity_class"), n.cast("bigint").alias("findings")) for s, n in sizes])
    return lists.select("run_id", F.inline(each)).where("findings > 0")


def header_status(lists: DataFrame) -> DataFrame:
    """(run_id, header_count, header_ok): row rules make sense only for usable headers."""
    names = F.col("names")
    return lists.select("run_id", F.size(names).alias("header_count"), _usable(names).alias("header_ok"))


def _usable(names: Column) -> Column:
    return (F.size(F.array_except(_required(), names)) == 0) & (F.size(F.array_distinct(names)) == F.size(names))


def usable_rows(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of runs with a usable header, with the header's size joined on.

    The right side has one row per run; its size decides the join, no hint is given.
    """
    good = header_status(lists).where("header_ok").select("run_id", "header_count")
    return rows.drop("header_count").join(good, "run_id")


# --- rows ------------------------------------------------------------------------------------


def failed_checks(rules: Sequence[RowRule]) -> Column:
    """Per rule (check_name, severity_class, message) when the row fails it, else NULL."""
    row = F.col("source_row_number")
    hits = [
        F.when(
            r.fails(),
            F.struct(
                F.lit(r.name).alias("check_name"),
                F.lit(r.severity).alias("severity_class"),
                r.message(row).alias("message"),
            ),
        )
        for r in rules
    ]
    return F.array(*hits)


def row_findings(rows: DataFrame, rules: Sequence[RowRule] = ROW_RULES) -> DataFrame:
    """One finding per failed rule and row, from a single pass without a shuffle.

    NULLs are dropped after the explode: compacting the array first would leave generated code.
    """
    hits = rows.select(
        "run_id", "source_row_number", F.explode(failed_checks(rules)).alias("hit")
    ).where(F.col("hit").isNotNull())
    row = F.col("source_row_number")
    return hits.select(
        *_finding(F.col("hit.check_name"), row, F.col("hit.severity_class"), F.col("hit.message"), row)
    )


def duplicate_members(rows: DataFrame) -> DataFrame:
    """(run_id, action_id, source_row_number, n): every row of an id that its run uses more than once.

    Counting folds each id before the shuffle, so the repeated ids are few; the rows meet them in a join whose hot ids
    Spark can split.
    """
    ids = rows.where(~is_blank("action_id")).select("run_id", "action_id", "source_row_number")
    repeated = ids.groupBy("run_id", "action_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ids.join(repeated, ["run_id", "action_id"])


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """(run_id, action_id, n, first_rows): repeated ids with their first MAX_ROWS_SHOWN row numbers."""
    return packs.failing_groups(rows, REPEATED_ID).select("run_id", F.col("key").alias("action_id"), "n", "first_rows")


def duplicate_findings(rows: DataFrame) -> DataFrame:
    return packs.findings(rows, Pack(set_rules=(REPEATED_ID,)))


def unknown_statuses(rows: DataFrame) -> DataFrame:
    """One finding per status value outside the enumeration; the value is kept and counted open."""
    return packs.findings(rows, Pack(set_rules=(UNKNOWN_STATUS,)))


def all_findings(rows: DataFrame, lists: DataFrame, pack: Pack = STANDARD) -> DataFrame:
    """Findings of every rule; `rows` are rows of runs with a usable header. Either input is read once."""
    return header_findings(lists).unionByName(packs.findings(rows, pack))


def finding_counts(rows: DataFrame, lists: DataFrame, pack: Pack = STANDARD) -> DataFrame:
    """(run_id, check_name, severity_class, findings) of every rule, without building a finding's message."""
    return header_counts(lists).unionByName(packs.counts_of(packs.totals(rows, pack), pack))


def counted(findings: DataFrame) -> DataFrame:
    """(run_id, check_name, severity_class, findings) of findings, stored ones say; counts stay as they are."""
    if "findings" in findings.columns:
        return findings
    return findings.groupBy("run_id", "check_name", "severity_class").agg(F.count(F.lit(1)).alias("findings"))


def by_severity(findings: DataFrame, names: Sequence[str] = SEVERITIES) -> DataFrame:
    """One row per run with its findings of each severity, as columns of these names; takes findings or counts."""
    sums = [F.sum(F.when(F.col("severity_class") == s, F.col("findings")).otherwise(0)).cast("bigint").alias(n) for s, n in zip(SEVERITIES, names)]
    return counted(findings).groupBy("run_id").agg(*sums)


def findings_of_check(rows: DataFrame, check: str) -> DataFrame:
    """Findings of one row rule."""
    return row_findings(rows, [r for r in ROW_RULES if r.name == check])


def _split(summed: DataFrame, key: str, *more: Column) -> DataFrame:
    """Valid and invalid rows of `totals` that carry header_ok; both NULL where the header is unusable."""
    invalid = F.when(F.col("header_ok"), F.col("invalid_row_count"))
    return summed.select(key, "source_row_count", (F.col("source_row_count") - invalid).alias("valid_row_count"), invalid.alias("invalid_row_count"), *more)


def validation_counts(rows: DataFrame, pack: Pack = STANDARD) -> DataFrame:
    """(run_id, source_row_count, valid_row_count, invalid_row_count) of runs with a usable header."""
    return _split(packs.totals(rows, pack).withColumn("header_ok", F.lit(True)), "run_id")


def file_counts(records: DataFrame, pack: Pack = STANDARD) -> DataFrame:
    """Counts of every file that has rows, straight from split records, and `noted`: the findings of its rows."""
    rows = records.where(F.col("source_row_number") > 0)
    noted = sum((F.col(f"c{i}") for i in range(len(pack.rules))), F.lit(0).cast("bigint"))
    return _split(packs.totals(rows, pack, ("file_no", "header_ok")), "file_no", noted.alias("noted"))


def gate(rows: DataFrame, lists: DataFrame, pack: Pack = STANDARD) -> DataFrame:
    """One row per run: counts (NULL when the header is unusable) and whether it may load.

    Every blocking finding about rows makes a row invalid, so the counts decide without the findings. Rows that
    carry the state of their header (header_ok, header_count) need no join with the lists.
    """
    return _judged(rows, lists, pack).select(
        "run_id", "header_ok", "source_row_count", "valid_row_count", "invalid_row_count", "accepted")


def preview(rows: DataFrame, lists: DataFrame, pack: Pack = STANDARD) -> DataFrame:
    """The gate and the number of findings of each severity, from one pass over the rows and one over the headers."""
    names = list(SEVERITIES)
    own = {s: F.coalesce(c, F.lit(0).cast("bigint")) for s, c in packs.severities_of(pack).items()}
    header = {"blocking": F.size(_missing()) + F.size(_twice()), "warning": F.size(_extra())}
    both = _judged(rows, lists, pack).withColumns({s: (own[s] + header.get(s, F.lit(0))).cast("bigint") for s in names})
    return both.select("run_id", "header_ok", "source_row_count", "valid_row_count", "invalid_row_count", "accepted", *names)


def _judged(rows: DataFrame, lists: DataFrame, pack: Pack) -> DataFrame:
    if not {"header_ok", "header_count"} <= set(rows.columns):
        rows = rows.drop("header_count").join(header_status(lists), "run_id")
    status = lists.join(packs.totals(rows, pack).withColumnRenamed("invalid_row_count", "bad"), "run_id", "left")
    usable = _usable(F.col("names"))
    bad = F.when(usable, F.col("bad"))
    return status.withColumns({
        "header_ok": usable, "source_row_count": F.coalesce("source_row_count", F.lit(0).cast("bigint")),
        "valid_row_count": F.col("source_row_count") - bad, "invalid_row_count": bad,
        "accepted": usable & (F.coalesce(bad, F.lit(0)) == 0),
    })


# --- identities and reports ------------------------------------------------------------------


def with_result_ids(findings: DataFrame, rules: Pack | Sequence[RowRule | SetRule] = STANDARD) -> DataFrame:
    """Unique ids that grow with run, check and position.

    They are computed from the finding itself, so no global numbering is needed and a retried task gives the same ids.
    Checks of a rule pack are numbered behind the known ones. A run, check or position that its bits cannot hold is an
    error, never an id that another finding has.
    """
    own = rules.rules if isinstance(rules, Pack) else rules
    order = [*CHECK_ORDER, *(r.name for r in own if r.name not in CHECK_ORDER)]
    if len(set(order)) != len(order) or len(order) >= 1 << CHECK_BITS:
        raise ValueError("checks need different names, and there is room for 31")
    check = F.array_position(F.array(*map(F.lit, order)), F.col("check_name"))
    packed = (
        F.shiftleft(F.col("run_id"), CHECK_BITS + POSITION_BITS) + F.shiftleft(check, POSITION_BITS) + F.col("position")
    )
    fits = (
        F.col("run_id").between(0, (1 << RUN_BITS) - 1) & (check > 0)
        & F.col("position").between(0, (1 << POSITION_BITS) - 1)
    )
    unfit = F.raise_error(F.concat_ws(" ", F.lit("no id for finding"), "run_id", "check_name", "position")).cast("bigint")
    return findings.withColumn("quality_result_id", F.when(fits, packed).otherwise(unfit))


def severity_counts(findings: DataFrame) -> DataFrame:
    return counted(findings).groupBy("run_id", "severity_class").agg(F.sum("findings").alias("findings"))


def findings_matrix(findings: DataFrame) -> DataFrame:
    summed = counted(findings).groupBy("check_name", "severity_class").agg(F.sum("findings").alias("findings"))
    return summed.orderBy("check_name", "severity_class")


def drift_report(findings: DataFrame) -> DataFrame:
    """Findings per run and kind of upstream drift."""
    check, severity = F.col("check_name"), F.col("severity_class")
    kind = (
        F.when((check == "DQ-01") & (severity == BLOCKING), "column_lost")
        .when((check == "DQ-01") & (severity == WARNING), "column_added")
        .when(check == "DQ-07", "date_format_changed")
        .when(check == "DQ-09", "new_status")
    )
    kinds = counted(findings).withColumn("drift", kind).where(F.col("drift").isNotNull())
    return kinds.groupBy("run_id", "drift").agg(F.sum("findings").alias("findings"))


def dimension_counts(findings: DataFrame) -> DataFrame:
    """Findings per run and quality dimension; counts only, never a score."""
    dimension = F.lit(None).cast("string")
    for name, checks in DIMENSIONS.items():
        dimension = F.when(F.col("check_name").isin(*checks), F.lit(name)).otherwise(dimension)
    named = counted(findings).withColumn("dimension", dimension).where(F.col("dimension").isNotNull())
    return named.groupBy("run_id", "dimension").agg(F.sum("findings").alias("findings"))
