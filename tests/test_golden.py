"""The hand-made snapshot: expected figures of metrics, reports and empty states."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import GOLDEN, golden_rows
from snapledger.operators import integrity, metrics, reports, staging
from snapledger.operators import runs as ledger
from snapledger.schemas import ALL_PROJECTS
from snapledger.sources.warehouse import Warehouse


# Open items by due date: Q-22 (10 Jan, ola), N-11 (27 Feb, mina), S-31 (5 Mar, ola), N-13 (9 Mar, mina),
# N-12 (10 Mar, ravi), Q-21 (2 Apr, ravi). Late means due before the reference date.
@pytest.mark.parametrize(
    ("day", "late", "longest", "owners"),
    [("2030-12-01", 0, 0, 0), ("2031-03-09", 3, 58, 2), ("2031-03-10", 4, 59, 2), ("2031-03-11", 5, 60, 3), ("2031-05-01", 6, 111, 3)],
)
def test_lateness_follows_the_reference_date(spark, day, late, longest, owners):
    raw = spark.createDataFrame(golden_rows(), "action_id string, project_name string, action_name string, owner string, due_date_raw string, status string")
    facts = staging.with_flags(staging.parse_due_date(raw), date.fromisoformat(day))
    total = metrics.portfolio(facts).first()
    assert total.overdue_actions == late and total.open_not_overdue_actions == 6 - late
    assert total.owners_with_overdue_actions == owners and metrics.max_days_overdue(facts).first()[0] == longest


def test_whole_portfolio_and_each_project(golden):
    facts = golden.latest_facts()
    total = metrics.portfolio(facts).first().asDict()
    assert total.pop("completion_rate") == pytest.approx(3 / 9)
    assert list(total.values()) == [9, 3, 6, 4, 2, 2]
    per = {r[0]: list(r)[1:] for r in metrics.by_project(facts).collect()}
    assert list(per) == ["Harbour", "Mill", "Quarry"]  # by name
    assert per == {"Harbour": [4, 1, 3, 2, 1, 0.25], "Mill": [3, 1, 2, 1, 1, pytest.approx(1 / 3)], "Quarry": [2, 1, 1, 1, 0, 0.5]}
    assert {p: metrics.portfolio(facts, p).first().owners_with_overdue_actions for p in per} == {"Harbour": 1, "Mill": 1, "Quarry": 1}


def test_late_items_and_their_owners(golden):
    facts = golden.latest_facts()
    listed = {r.action_id: r.days_overdue for r in metrics.overdue_detail(facts).collect()}
    assert list(listed.items()) == [("Q-22", 59), ("N-11", 11), ("S-31", 5), ("N-13", 1)]
    assert [r.asDict() for r in metrics.by_owner(facts).collect()] == [
        {"owner": "mina", "overdue_actions": 2}, {"owner": "ola", "overdue_actions": 2}]
    assert [r[0] for r in metrics.overdue_detail(facts, "Harbour").collect()] == ["N-11", "N-13"]
    assert [r[0] for r in metrics.overdue_detail(facts, owner="ola").collect()] == ["Q-22", "S-31"]
    assert [metrics.top_owners(facts, n).count() for n in (-2, 0, 1, 5)] == [0, 0, 1, 2]


# Names that would matter if a project name ever became part of SQL text or of a pattern.
ODD_NAMES = ["Mill' or true --", "Mi%", "Mi_l", "(Mill)", "mill", " Mill", "Mill\n", 'Mill"', "Mill\\", "${Mill}", "\u212a", ""]


@pytest.mark.parametrize("name", ODD_NAMES)
def test_a_scope_is_a_value(golden, name):
    facts = golden.latest_facts()
    assert metrics.portfolio(facts, name).first().total_actions == 0 == metrics.portfolio(facts, name).first().completion_rate
    assert metrics.by_project(facts, name).isEmpty() and metrics.overdue_detail(facts, name).isEmpty()


def test_scope_names(golden):
    facts = golden.latest_facts()
    assert metrics.portfolio(facts, ALL_PROJECTS).first() == metrics.portfolio(facts, None).first()
    assert metrics.scope_name("Mill") == "Mill" and metrics.scope_name(None) is None
    for odd in (7, b"Mill", ["Mill"]):
        with pytest.raises(TypeError):
            metrics.scope_name(odd)


def test_no_warehouse_is_an_empty_state(spark, tmp_path):
    empty = Warehouse(spark, str(tmp_path / "none"))
    assert empty.latest_run_id() is None
    assert metrics.portfolio(empty.latest_facts()).first().total_actions == 0
    assert metrics.by_project(empty.facts()).isEmpty()
    assert ledger.run_info(empty.runs()).isEmpty()
    summary = reports.quality_summary(empty.runs(), empty.findings()).first()
    assert summary.run_id is None and summary.latest_attempt_run_id is None
    assert reports.context_document(empty.facts(), empty.runs()).isEmpty()


def test_run_info_and_integrity(golden):
    info = ledger.run_info(golden.runs()).first()
    assert (info.run_id, info.reference_date, info.status, info.source_row_count) == (
        1, "2031-03-10", "succeeded", 9)
    assert info.source_file == "golden.csv"
    runs, raw, facts = golden.runs(), golden.read("raw_actions"), golden.read("stg_actions")
    assert integrity.count_mismatches(runs, raw, facts).isEmpty()
    assert integrity.facts_without_success(facts, runs).isEmpty()
    assert integrity.facts_without_raw(facts, raw).isEmpty()
    assert integrity.repeated_fact_keys(facts).isEmpty()
    assert integrity.rollup_mismatches(facts).isEmpty()
    assert golden.config().first().config_value == "2031-03-10"
    assert facts.where("is_open = is_completed or (is_overdue and not is_open)").isEmpty()
    assert facts.where("is_overdue <> (days_overdue > 0)").isEmpty()


def test_context_document(golden):
    doc = reports.context_document(golden.latest_facts(), golden.runs(), 3)
    payload = json.loads(reports.context_json(doc).first().payload)
    assert sorted(payload) == list(payload)
    assert [payload[k] for k in ("project_filter", "top_n", "overdue_total")] == [None, 3, 4]
    assert [set(r) for r in payload["top_overdue_actions"]] == [set(reports.CONTEXT_FIELDS)] * 3
    assert [r["action_id"] for r in payload["top_overdue_actions"]] == ["Q-22", "N-11", "S-31"]
    assert [p["project_name"] for p in payload["projects"]] == sorted({line.split("|")[1] for line in GOLDEN.strip().splitlines()})
    mill = reports.context_document(golden.latest_facts(), golden.runs(), project="Mill").first()
    assert mill.project_filter == "Mill" and [p.project_name for p in mill.projects] == ["Mill"]


@pytest.mark.parametrize(("wanted", "shown"), [(4, 4), ("25", 25), (" 007 ", 7), ("+5", 10), ("1e3", 10), ("٣", 10), ("", 10), (-1, 10), (0, 10), (None, 10), (2.5, 10)])
def test_rows_shown(wanted, shown):
    assert reports.rows_shown(wanted) == shown


def test_sanitised_text(spark):
    from snapledger.functions.text import sanitize, with_draft_label

    cases = {"one\x02two\tthree\r": "one two three", "\u2028 spaced out\u3000": "spaced out", "é" * 450: "é" * 200, "\x9b": "", None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in rows.select(sanitize("t")).collect()] == list(cases.values())
    notes = {"First DRAFT of it": "First DRAFT of it", "ฉบับร่าง 2": "ฉบับร่าง 2", "final": "[ร่าง (DRAFT)]\nfinal", "x" * 200 + "draft": "[ร่าง (DRAFT)]\n" + "x" * 200 + "draft"}
    rows = spark.createDataFrame([(t,) for t in notes], "t string")
    assert [r[0] for r in rows.select(with_draft_label("t")).collect()] == list(notes.values())


def test_kpis_of_an_empty_scope(golden):
    facts = golden.latest_facts()
    row = reports.kpi_row(metrics.portfolio(facts, "nope")).first()
    assert row.completion_rate == "-" and row.total_actions == "0"
    state = reports.scope_state(F.lit(1), metrics.portfolio(facts, "nope")).first()
    assert state.state == "no_data"
    state = reports.scope_state(F.lit(None), metrics.portfolio(facts)).first()
    assert state.state == "no_run"
