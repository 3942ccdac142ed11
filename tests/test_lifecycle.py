"""Runs: idempotency, versioning, rejection, rollback, visibility, purge, drafts, stream."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import HEADER, REF, golden_rows, write_csv
from snapledger import schemas
from snapledger.operators import governance, ingest as loading, integrity, metrics, reports
from snapledger.operators import runs as ledger
from snapledger.sources.folders import fresh_folder
from snapledger.streaming import file_drop


def load(wh, path, ref=REF, **kw):
    (result,) = loading.ingest(wh, path, ref, **kw)
    return result


def bad_file(path):
    """One row, the fourth, has a day that no month has."""
    rows = golden_rows()
    rows[3][HEADER.index("due_date")] = "2031-06-31"
    return write_csv(path, rows)


def test_repeat_rename_and_new_date(wh, tmp_path):
    path = write_csv(tmp_path / "a.csv", golden_rows())
    first = load(wh, path)
    again, renamed = load(wh, path), load(wh, write_csv(tmp_path / "b.csv", golden_rows()))
    assert (again.outcome, again.run_id) == (renamed.outcome, renamed.run_id) == ("noop", first.run_id)
    later = load(wh, path, date(2031, 5, 1))
    assert (later.outcome, later.run_id) == ("succeeded", 2)
    overdue = {r.run_id: r.overdue_actions for r in metrics.by(wh.facts(), ["run_id"]).collect()}
    assert overdue == {1: 4, 2: 6}
    older = load(wh, path, date(2030, 12, 1))
    assert wh.latest_run_id() == older.run_id == 3
    assert metrics.portfolio(wh.latest_facts()).first().overdue_actions == 0
    assert metrics.portfolio(wh.facts_at(1)).first().overdue_actions == 4


def test_rejected_files_never_show(wh, tmp_path):
    good = load(wh, write_csv(tmp_path / "g.csv", golden_rows()))
    path = bad_file(tmp_path / "b.csv")
    one, two = load(wh, path), load(wh, path)
    assert one.outcome == two.outcome == "failed" and one.run_id != two.run_id
    assert wh.latest_run_id() == good.run_id
    states = {r.run_id: (r.status, r.completed_at >= r.started_at) for r in wh.runs().collect()}
    assert states == {1: ("succeeded", True), 2: ("failed", True), 3: ("failed", True)}
    summary = reports.quality_summary(wh.runs(), wh.findings()).first()
    assert (summary.run_id, summary.latest_attempt_run_id, summary.latest_attempt_status) == (1, 3, "failed")
    assert wh.findings().select("quality_result_id").distinct().count() == wh.findings().count() == 2


def test_one_batch_of_many_files(wh, tmp_path):
    folder = tmp_path / "batch"
    folder.mkdir()
    write_csv(folder / "good.csv", golden_rows())
    write_csv(folder / "twin.csv", golden_rows())
    write_csv(folder / "half.csv", golden_rows()[:6])
    bad_file(folder / "bad.csv")
    bad_file(folder / "bad_twin.csv")
    (folder / "empty.csv").write_bytes(b"")
    got = {r.source_file: r for r in loading.ingest(wh, str(folder), REF)}
    assert {n: got[n].outcome for n in ("half.csv", "bad.csv", "bad_twin.csv", "empty.csv")} == {
        "half.csv": "succeeded", "bad.csv": "failed", "bad_twin.csv": "failed", "empty.csv": "error"}
    assert {got["good.csv"].outcome, got["twin.csv"].outcome} == {"succeeded", "noop"}
    assert got["good.csv"].run_id == got["twin.csv"].run_id
    totals = {r.run_id: r.total_actions for r in metrics.by(wh.facts(), ["run_id"]).collect()}
    assert totals == {got["good.csv"].run_id: 9, got["half.csv"].run_id: 6}
    assert wh.runs().count() == 4


class Broken(Exception):
    """Raised by a fact stage that meets a certain item."""


def stumbling(item):
    def stage(target, rows, day):
        loading.build_facts(target, rows, day)
        if not rows.where(F.col("action_id") == item).isEmpty():
            raise Broken(f"near {item}")
    return stage


def test_a_raising_stage_takes_its_rows_back(wh, tmp_path):
    path = write_csv(tmp_path / "w.csv", golden_rows())
    result = load(wh, path, on_facts=stumbling("S-31"))
    assert result.outcome == "failed" and "Broken" in result.message and "S-31" not in result.message
    assert all(wh.read(t).isEmpty() for t in ("raw_actions", "stg_actions")) and wh.latest_run_id() is None
    (noted,) = wh.findings().collect()
    assert noted.check_name == "DQ-10" and noted.severity_class == "blocking" and noted.record_key == str(result.run_id)
    assert "Broken" in noted.message and "S-31" not in noted.message
    assert load(wh, path).outcome == "succeeded"


def test_only_the_file_that_raises_fails(wh, tmp_path):
    rows, folder = golden_rows(), tmp_path / "three"
    folder.mkdir()
    for name, part in (("a", rows[:3]), ("b", rows[3:6]), ("c", rows[6:])):
        write_csv(folder / f"{name}.csv", part)
    got = {r.source_file: r.outcome for r in loading.ingest(wh, str(folder), REF, on_facts=stumbling("Q-22"))}
    assert got == {"a.csv": "succeeded", "b.csv": "failed", "c.csv": "succeeded"}
    assert {r.action_id for r in wh.facts().collect()} == {r[0] for r in rows[:3] + rows[6:]}
    assert wh.read("raw_actions").count() == wh.read("stg_actions").count() == 6


def test_a_stage_that_loses_or_changes_rows_is_caught(wh, tmp_path):
    def every_other(target, rows, day):
        loading.build_facts(target, rows.where("source_row_number % 2 = 0"), day)

    result = load(wh, write_csv(tmp_path / "h.csv", golden_rows()), on_facts=every_other)
    assert result.outcome == "failed" and "DQ-10" in result.message and wh.read("stg_actions").isEmpty()


def test_a_stage_that_repeats_a_key_is_caught(wh, tmp_path):
    """As many rows as before, all sums as before, but one item twice and another one gone."""
    def one_twice(target, rows, day):
        twin = F.when(F.col("action_id") == "N-13", F.lit("N-12")).otherwise(F.col("action_id"))
        loading.build_facts(target, rows.withColumn("action_id", twin), day)

    result = load(wh, write_csv(tmp_path / "t.csv", golden_rows()), on_facts=one_twice)
    assert result.outcome == "failed" and "RI-05" in result.message
    assert wh.read("stg_actions").isEmpty() and wh.read("raw_actions").isEmpty() and wh.latest_facts().isEmpty()
    assert [(r.check_name, r.severity_class) for r in wh.findings().collect()] == [("RI-05", "blocking")]


def test_a_killed_load_is_swept(wh, tmp_path, monkeypatch):
    load(wh, write_csv(tmp_path / "a.csv", golden_rows()))
    path = write_csv(tmp_path / "b.csv", golden_rows()[:5])
    with monkeypatch.context() as m:  # the process dies after its rows were written
        m.setattr(loading, "reconcile", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            loading.ingest(wh, path, REF)
    wh.append("stg_actions", wh.read("stg_actions").where("run_id = 1").withColumn("run_id", F.lit(77).cast("bigint")))
    later = datetime.now() + timedelta(days=2)
    assert wh.facts().count() == 9 and wh.read("stg_actions").count() == 9 + 5 + 9
    assert [r.run_id for r in integrity.facts_without_success(wh.read("stg_actions"), wh.runs()).orderBy("run_id").collect()] == [2, 77]
    assert {(r.table_name, r.run_id) for r in wh.orphans(datetime(2000, 1, 1)).collect()} == {("stg_actions", 77)}
    gone = {(r["table_name"], r["run_id"], r["status"]) for r in wh.sweep(later)}
    assert gone == {("raw_actions", 2, "running"), ("stg_actions", 2, "running"), ("stg_actions", 77, None)}
    assert wh.sweep(later) == [] and wh.read("stg_actions").count() == 9
    assert {r.run_id: r.status for r in wh.runs().collect()} == {1: "succeeded", 2: "failed"}
    assert load(wh, path).outcome == "succeeded"


def test_small_files_are_put_together(wh, tmp_path):
    for k in range(3):
        load(wh, write_csv(tmp_path / f"{k}.csv", golden_rows()[: 3 + k]))
    before, config = sorted(wh.runs().collect()), sorted(wh.config().collect())
    assert wh.compact("run_events") >= 6 and wh.compact("app_config") >= 3
    assert sorted(wh.runs().collect()) == before and sorted(wh.config().collect()) == config
    assert wh.compact("run_events") == 1 and len(wh.read("run_events").inputFiles()) == 1
    with pytest.raises(ValueError, match="kept by run"):
        wh.compact("stg_actions")


def test_nothing_is_left_behind(wh, tmp_path):
    import pathlib

    shared = pathlib.Path(wh.spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "snapledger"
    before = set(shared.glob("*")) if shared.exists() else set()
    load(wh, write_csv(tmp_path / "l.csv", golden_rows()))
    texts = wh.spark.createDataFrame(
        [("a text", 1, datetime(2031, 3, 11), REF, None)] * 3,
        "summary_text string, source_run_id long, created_at timestamp_ntz, reference_date date, project_filter string")
    wh.save_drafts(reports.draft_rows(texts, "p", "m", "v"))
    assert set(shared.glob("*")) == before


def test_running_and_orphan_runs_are_invisible(wh, tmp_path):
    load(wh, write_csv(tmp_path / "a.csv", golden_rows()))
    state = wh.read("run_events").limit(1).withColumns({
        "run_id": F.lit(9).cast("bigint"), "event_seq": F.lit(0), "status": F.lit("running"),
        "completed_at": F.lit(None).cast("timestamp_ntz")})
    wh.append("run_events", state)
    wh.append("stg_actions", wh.read("stg_actions").withColumn("run_id", F.lit(9).cast("bigint")))
    assert wh.latest_run_id() == 1 and wh.facts().count() == 9 and wh.facts_at(9).isEmpty()
    assert [r.run_id for r in integrity.facts_without_success(wh.read("stg_actions"), wh.runs()).collect()] == [9]


@pytest.mark.parametrize("text", ["31-03-10", "2031/03/10", "2031-3-10", "2031-02-29", "2031-00-10", "2031-W10-1", "2031-069", "+2031-03-10", "2031-03-10 ", "2031-03-10T08", "soon", "", "２０３１-03-10"])
def test_reference_dates_are_spelt_one_way(text):
    with pytest.raises(ValueError):
        loading.parse_reference_date(text)


def test_reference_date_is_read():
    assert loading.parse_reference_date("2028-02-29") == date(2028, 2, 29)


def test_reference_date_is_required(wh, tmp_path):
    with pytest.raises(TypeError):
        loading.ingest(wh, str(tmp_path), "2031-03-10")


def test_preview_writes_nothing(wh, tmp_path):
    findings, counts = loading.preview(wh, bad_file(tmp_path / "b.csv"))
    assert [(r.check_name, r.record_key) for r in findings.collect()] == [("DQ-07", "4")]
    assert counts.first().invalid_row_count == 1
    assert not wh.exists("run_events")


def test_purge_keeps_the_latest_success(wh, tmp_path):
    for n in (4, 5, 6):
        load(wh, write_csv(tmp_path / f"{n}.csv", golden_rows()[:n]))
    drafts = wh.spark.createDataFrame(
        [("text", 1, datetime(2031, 3, 16), date(2031, 3, 15), None)],
        "summary_text string, source_run_id long, created_at timestamp_ntz, reference_date date,"
        " project_filter string")
    wh.save_drafts(reports.draft_rows(drafts, "p", "m", "v1"))
    tables = {n: wh.read(n) for n in ("data_quality_results", "stg_actions", "raw_actions", "executive_summaries")}
    plan = governance.retention_plan(wh.runs(), tables, datetime.now() + timedelta(days=2))
    listed = sorted((r.step, r.table_name, r.run_id, r.rows) for r in plan.collect())
    assert listed == [
        (2, "stg_actions", 1, 4), (2, "stg_actions", 2, 5), (3, "raw_actions", 1, 4), (3, "raw_actions", 2, 5),
        (4, "executive_summaries", 1, 1), (5, "ingestion_runs", 1, 1), (5, "ingestion_runs", 2, 1)]
    wh.purge(plan)
    assert [r.run_id for r in wh.runs().collect()] == [3] and wh.latest_run_id() == 3
    assert wh.read("stg_actions").count() == wh.read("raw_actions").count() == 6
    assert wh.summaries().isEmpty()
    assert load(wh, write_csv(tmp_path / "n.csv", golden_rows()[:7])).run_id == 4


def test_a_purge_that_was_stopped_goes_on(wh, tmp_path, monkeypatch):
    for n in (4, 5, 6):
        load(wh, write_csv(tmp_path / f"{n}.csv", golden_rows()[:n]))
    tables = {n: wh.read(n) for n in ("data_quality_results", "stg_actions", "raw_actions")}
    plan = governance.retention_plan(wh.runs(), tables, datetime.now() + timedelta(days=2))
    whole = wh.drop_run

    def broken(name, run_id):
        if name == "raw_actions":
            raise OSError("storage went away")
        whole(name, run_id)

    with monkeypatch.context() as m:
        m.setattr(wh, "drop_run", broken)
        with pytest.raises(OSError):
            wh.purge(plan)
    assert wh.read("stg_actions").count() == 6 and wh.read("raw_actions").count() == 15
    left = sorted((r.step, r.table_name, r.run_id, r.rows) for r in wh.pending_purges().collect())
    assert left == [(3, "raw_actions", 1, 4), (3, "raw_actions", 2, 5), (5, "ingestion_runs", 1, 1), (5, "ingestion_runs", 2, 1)]
    assert wh.resume_purges() == 4 and wh.resume_purges() == 0
    assert wh.read("raw_actions").count() == 6 and [r.run_id for r in wh.runs().collect()] == [3]


def test_answers_are_bound_to_an_identity_and_logged(golden, wh, tmp_path):
    from snapledger.sources.governed import GovernedReader

    load(wh, write_csv(tmp_path / "a.csv", golden_rows()))
    keys = wh.spark.createDataFrame([("a", "mina", "Harbour"), ("b", "ola", "Mill")], "actor string, owner string, project_name string")

    def read(actor, role, dataset="stg_actions", build=lambda rows: rows, **kw):
        return GovernedReader(wh, actor, role, "salt", keys).answer(dataset, "Q-TEST", build, lambda df: df.collect(), **kw)

    assert {(r.owner, r.action_name) for r in read("a", "ROLE-04")} == {("mina", None)}
    assert {r.owner for r in read("b", "ROLE-04", "raw_actions")} == {"ola"} and read("c", "ROLE-04") == []
    assert {r.project_name for r in read("b", "ROLE-02")} == {"Mill"} and not any(r.owner in ("mina", "ola", "ravi") for r in read("b", "ROLE-02"))
    assert len(read("x", "ROLE-03")) == 9 and {r.action_name for r in read("x", "ROLE-05")} == {None}
    assert read("a", "ROLE-04", build=lambda rows: rows.where("owner = 'ola'")) == []  # no filter opens another scope
    assert read("a", "ROLE-04", "data_quality_results") == [] == read("a", "ROLE-04", "executive_summaries")
    assert [r.total_actions for r in read("x", "ROLE-03", build=metrics.portfolio, run_id=1)] == [9] and read("x", "ROLE-06", run_id=9) == []
    with pytest.raises(ValueError, match="unknown role"):
        read("a", "ROLE-99")
    with pytest.raises(ValueError, match="unknown dataset"):
        read("a", "ROLE-06", "audit_log")
    with pytest.raises(ZeroDivisionError):
        GovernedReader(wh, "a", "ROLE-06", "salt", keys).answer("stg_actions", "Q", lambda rows: rows, lambda df: 1 / 0)
    log = wh.read("audit_log").orderBy("event_time").collect()
    assert [(e.actor_id, e.role_id, e.dataset, e.row_count) for e in log[:3]] == [("a", "ROLE-04", "stg_actions", 3), ("b", "ROLE-04", "raw_actions", 3), ("c", "ROLE-04", "stg_actions", 0)]
    assert len(log) == 12 and len({e.audit_id for e in log}) == 12 and log[10].run_id == 1 and log[10].row_count == 1
    (rolled,) = governance.audit_rollup(wh.read("audit_log").where("dataset = 'raw_actions'")).collect()
    assert tuple(rolled) == ("query", "raw_actions", 1, 1, 3)


def test_erasing_an_owner(wh, tmp_path):
    load(wh, write_csv(tmp_path / "a.csv", golden_rows()))
    load(wh, write_csv(tmp_path / "one.csv", golden_rows()[:1]))
    report = governance.erasure_report(
        "mina", wh.read("raw_actions"), wh.read("stg_actions"), wh.findings(), wh.summaries())
    got = sorted((r.table_name, r.run_id, r.rows_before, r.subject_rows, r.rows_after) for r in report.collect())
    assert got == [("raw_actions", 1, 9, 3, 6), ("raw_actions", 2, 1, 1, 0),
                   ("stg_actions", 1, 9, 3, 6), ("stg_actions", 2, 1, 1, 0)]
    drafts = wh.spark.createDataFrame(
        [("mina is late", 1, datetime(2031, 3, 16), REF, None), ("nobody is named", 1, datetime(2031, 3, 17), REF, None)],
        "summary_text string, source_run_id long, created_at timestamp_ntz, reference_date date, project_filter string")
    wh.save_drafts(reports.draft_rows(drafts, "p", "m", "v"))
    noted = wh.findings().count()
    record = wh.erase_owner("mina")
    assert {(r["table_name"], r["run_id"]): (r["rows_before"], r["rows_after"]) for r in record} == {
        ("raw_actions", 1): (9, 6), ("raw_actions", 2): (1, 0), ("stg_actions", 1): (9, 6), ("stg_actions", 2): (1, 0),
        ("executive_summaries", 1): (2, 1)}
    assert "mina" not in str(record) and wh.findings().count() == noted
    assert [r.summary_text.split("\n")[-1] for r in wh.summaries().collect()] == ["nobody is named"]
    for name in ("raw_actions", "stg_actions"):
        left = wh.read(name)
        assert left.where("owner = 'mina'").isEmpty() and left.count() == 6


def test_findings_that_name_a_person_are_erased(wh):
    rows = [(1, 1, "DQ-03", "mina", "warning", "x"), (2, 1, "DQ-03", "k", "warning", "about mina"), (3, 1, "DQ-03", None, "warning", "other")]
    found = wh.spark.createDataFrame(rows, "quality_result_id long, run_id long, check_name string, record_key string, severity_class string, message string")
    wh.append("data_quality_results", found.withColumn("created_at", F.lit(datetime(2031, 3, 1)).cast("timestamp_ntz")))
    wh.erase_owner("mina")
    assert [r.quality_result_id for r in wh.findings().collect()] == [3]


def test_roles_see_findings_and_rows_of_their_scope(golden):
    facts = golden.latest_facts()
    keys = golden.spark.createDataFrame([("a", "mina"), ("b", "ola"), ("b", "ola")], "actor string, owner string")
    seen = {a: {r.owner for r in governance.row_scope(facts, keys, a).collect()} for a in ("a", "b", "c")}
    assert seen == {"a": {"mina"}, "b": {"ola"}, "c": set()}
    assert governance.row_scope(governance.row_scope(facts, keys, "a"), keys, "b").isEmpty()
    found = golden.spark.createDataFrame([("DQ-02", "7", "row 7")], "check_name string, record_key string, message string")
    assert [tuple(governance.masked_findings(found, r).first()) for r in ("ROLE-06", "ROLE-03", "ROLE-01")] == [
        ("DQ-02", "7", "row 7"), ("DQ-02", None, None), ("DQ-02", None, None)]


def test_drafts_are_held_against_the_context_that_was_sent(golden):
    from snapledger.operators import evaluation

    doc = reports.context_document(golden.latest_facts(), golden.runs(), 2)
    sent = reports.context_json(doc).select(F.lit(1).cast("long").alias("source_run_id"), "payload")
    text = "On 2031-03-10, 4 of 9 items are late, by up to 59 days; 33.3% are done; 77 are not there."
    drafts = golden.spark.createDataFrame([(5, 1, text)], "summary_id long, source_run_id long, summary_text string")
    assert [r.number for r in evaluation.ungrounded_numbers(drafts, evaluation.context_numbers(sent)).collect()] == ["77"]
    assert evaluation.unexpected_fields(sent).isEmpty()
    assert {r.field for r in evaluation.unexpected_fields(sent, allowed=("owner", "due_date")).collect()} == set(reports.CONTEXT_FIELDS) - {"owner", "due_date"}


def test_drafts_and_history(wh):
    texts = wh.spark.createDataFrame(
        [("A draft", 1, datetime(2031, 3, 16, h), date(2031, 3, 15), p) for h, p in enumerate([None, "Mill", None])]
        + [("  ", 1, datetime(2031, 3, 17), date(2031, 3, 15), None)],
        "summary_text string, source_run_id long, created_at timestamp_ntz, reference_date date,"
        " project_filter string")
    wh.save_drafts(reports.draft_rows(texts, "p", "m", "v1"))
    latest = {r.project_filter: r.summary_id for r in reports.latest_summaries(wh.summaries()).collect()}
    assert latest == {None: 3, "Mill": 2}
    assert reports.latest_summary(wh.summaries()).first().summary_id == 3
    assert reports.latest_summary(wh.summaries(), "Mill").first().summary_id == 2
    assert reports.latest_summary(wh.summaries(), "Mi").isEmpty()
    assert [r.summary_id for r in reports.summary_history(wh.summaries(), 2).collect()] == [3, 2]
    wh.save_drafts(reports.draft_rows(texts.limit(1), "p", "m", "v1"))
    assert [r.summary_id for r in wh.summaries().orderBy("summary_id").collect()] == [1, 2, 3, 4]


def test_contract_errors(wh, golden):
    with pytest.raises(schemas.ContractError):
        wh.append("stg_actions", golden.read("stg_actions").drop("owner"))
    bad = golden.runs().withColumn("status", F.lit("odd"))
    rows = schemas.contract_violations(bad, schemas.INGESTION_RUNS, schemas.CHECKS["ingestion_runs"]).collect()
    assert [(r.column_name, r.violations) for r in rows if r.violations] == [("status", 1)]


FAULTY = [
    {"action_id": "cast(null as string)"}, {"owner": "cast(null as string)"}, {"due_date": "cast(null as date)"},
    {"is_open": "true", "is_completed": "true"}, {"days_overdue": "-5"}, {"is_overdue": "not is_overdue"},
]


@pytest.mark.parametrize("fault", FAULTY)
def test_rows_against_the_contract_are_not_written(wh, golden, fault):
    rows = golden.read("stg_actions")
    broken = rows.withColumns({c: F.expr(f"if(action_id = 'Q-21', {v}, {c})") for c, v in fault.items()})
    with pytest.raises(Exception, match="stg_actions: "):
        wh.append("stg_actions", broken)
    assert wh.read("stg_actions").isEmpty()


def test_unknown_run_states_are_not_written(wh, golden):
    with pytest.raises(Exception, match="status is outside its value list"):
        wh.append("run_events", golden.read("run_events").withColumn("status", F.lit("banana")))
    assert wh.runs().isEmpty()


def test_config_ties_have_one_winner(spark):
    at = datetime(2031, 3, 1)
    rows = [("k", v, at) for v in ("b", "c", "a")]
    for order in (rows, rows[::-1]):
        got = ledger.latest_config(spark.createDataFrame(order, "config_key string, config_value string, updated_at timestamp_ntz"))
        assert [tuple(r) for r in got.collect()] == [("k", "c", at)]


def test_stream_picks_up_new_files_once(spark, wh, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    write_csv(landing / "a.csv", golden_rows())
    bad_file(landing / "b.csv")
    state = fresh_folder(spark, "stream")
    file_drop.start(wh, str(landing), state, REF).awaitTermination()
    assert sorted(r.status for r in wh.runs().collect()) == ["failed", "succeeded"]
    write_csv(landing / "c.csv", golden_rows()[:3])
    write_csv(landing / "d.csv", golden_rows())
    file_drop.start(wh, str(landing), state, REF).awaitTermination()
    assert sorted(r.status for r in wh.runs().collect()) == ["failed", "succeeded", "succeeded"]
    file_drop.start(wh, str(landing), fresh_folder(spark, "stream"), REF).awaitTermination()
    assert ledger.succeeded(wh.runs()).count() == 2


def test_restated_facts_are_kept_beside_the_old(wh, tmp_path, monkeypatch):
    load(wh, write_csv(tmp_path / "a.csv", golden_rows()))
    load(wh, write_csv(tmp_path / "b.csv", golden_rows()[:6]))
    before = sorted(wh.facts().collect())
    with monkeypatch.context() as m:
        m.setattr(integrity, "restatement_problems", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            wh.restate("inclusive", True, [1])
    assert wh.read("restated_actions").count() == 9
    assert {r.definition_version for r in wh.fact_versions().collect()} == {"original"}  # never ended, so not seen
    assert wh.drop_unfinished_restatements() == [(1, "inclusive")] and wh.read("restated_actions").isEmpty()
    assert wh.restate("inclusive", True, [1]) == [1] and wh.restate("inclusive", True, [1]) == []
    assert sorted(wh.facts().collect()) == before
    rows = metrics.by(wh.fact_versions(), ["run_id", "definition_version"]).collect()
    late = {(r.run_id, r.definition_version): r.overdue_actions for r in rows}
    due = sum(1 for r in before if r.run_id == 1 and r.is_open and r.due_date == REF)
    assert due and late[1, "inclusive"] == late[1, "original"] + due and set(late) == {(1, "original"), (1, "inclusive"), (2, "original")}
    mixed = wh.facts_as("inclusive")
    assert {(r.run_id, r.definition_version) for r in mixed.collect()} == {(1, "inclusive"), (2, "original")} and mixed.count() == 15
    assert wh.facts_as("original").count() == wh.facts_as("other").count() == 15
    assert wh.restate("inclusive", True) == [2] and wh.restate("2", False) == [1, 2]
    again = metrics.by(wh.facts_as("2"), ["run_id"]).collect()
    assert {r.run_id: r.overdue_actions for r in again} == {r: late[r, "original"] for r in (1, 2)}  # the same definition, the same facts
    wh.erase_owner("mina")
    assert wh.read("restated_actions").where("owner = 'mina'").isEmpty() and wh.facts_as("2").count() == wh.facts().count()
    wh.drop_run("stg_actions", 1)
    assert {r.run_id for r in wh.read("restated_actions").collect()} == {2}
    for bad in ("original", "", "../x", "a b"):
        with pytest.raises(ValueError, match="version name"):
            wh.restate(bad, True)


def test_a_restatement_with_other_actions_is_refused(wh, tmp_path):
    load(wh, write_csv(tmp_path / "a.csv", golden_rows()))
    load(wh, write_csv(tmp_path / "b.csv", golden_rows()[:6]))
    wh.append("raw_actions", wh.read_runs("raw_actions", [1]).limit(1))
    with pytest.raises(ValueError, match=r"\[1\]"):
        wh.restate("inclusive", True)
    assert {r.run_id for r in wh.read("restated_actions").collect()} == {2} == {r.run_id for r in wh.read("restatements").collect()}


def test_names_are_found_by_their_rarest_part(spark):
    from snapledger.operators import evaluation

    names = [f"Harbour {i}" for i in range(10_000)] + ["Harbour", "North Harbour East", "Mill", "++", "Q\\E (x)", "C#", "a b c"]
    texts = [f"Harbour {7 * i} and Harbour: late. (North Harbour East) mill" for i in range(60)]
    texts += ["Milling ++ is Q\\E (x)!", "C# 12, C", "", "Harbour-5 b c", "North Harbour\nEast", "a b; b c", "Mill"]
    rows = [(i, "Quay", t) for i, t in enumerate(texts)] + [(900, "Mill", "Mill"), (901, None, "Mill"), (902, "Quay", None)]
    drafts = spark.createDataFrame(rows, "summary_id long, project_filter string, summary_text string")
    projects = spark.createDataFrame([(n,) for n in names + ["", None]], "project_name string")
    got = evaluation.out_of_scope_projects(drafts, projects)

    def mentioned(name, text):
        sides = [(text[:i], text[i + len(name):]) for i in range(len(text)) if text.startswith(name, i)]
        return any(not (a and a[-1].isalnum()) and not (b and b[0].isalnum()) for a, b in sides)

    want = {(i, n) for i, f, t in rows if f and t for n in names if n != f and n in t and mentioned(n, t)}
    assert sorted((r.summary_id, r.project_name) for r in got.collect()) == sorted(want)
    assert evaluation.name_candidates(drafts.where("project_filter is not null"), projects).count() <= 2 * len(want)
