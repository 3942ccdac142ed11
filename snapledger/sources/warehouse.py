"""Parquet tables of one warehouse folder, partitioned by run, with empty-state reads.

The folder must be on storage that all executors share.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger import schemas
from snapledger.functions.time import ntz
from snapledger.operators import governance, integrity, runs as ledger, staging
from snapledger.sources.folders import fresh_folder, listed_in_bulk, path_texts
from snapledger.sources.local import small_table
from snapledger.sources.numbering import number_rows

# Tables kept in one folder per run, and the column that names the run. The ledger is not: it has
# a few rows per run, and readers want all of them.
PARTITION = {
    "raw_actions": "run_id",
    "stg_actions": "run_id",
    "restated_actions": "run_id",
    "data_quality_results": "run_id",
    "executive_summaries": "source_run_id",
}

MANY_RUNS = 100

# Further partition columns below the run.
BELOW_RUN = {"restated_actions": ("definition_version",)}


class Warehouse:
    """Reads and appends the declared tables under `root`. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """The table, or an empty one with the declared columns when nothing was written yet."""
        schema = schemas.TABLES[name]
        try:
            with listed_in_bulk(self.spark):
                df = self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return df.select(*schema.names)

    def read_runs(self, name: str, run_ids: list[int]) -> DataFrame:
        """Rows of some runs, read from their own folders; one listing tells which of them exist."""
        schema, key = schemas.TABLES[name], PARTITION[name]
        there = self.folders(name)
        if len(run_ids) > MANY_RUNS and 2 * len(run_ids) > len(there):
            # Most of the table: naming its folder and the runs costs less than naming each run's folder.
            table = self.read(name).where(F.col(key).between(min(run_ids), max(run_ids)))
            return table.join(small_table(self.spark, [{key: i} for i in run_ids], f"{key} long"), key, "left_semi")
        folders = [f"{self.path(name)}/{key}={i}" for i in run_ids if f"{key}={i}" in there]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.path(name))
        with listed_in_bulk(self.spark):
            return reader.parquet(*folders).select(*schema.names)

    def folders(self, name: str) -> set[str]:
        """Names of the run folders of a table."""
        target = self._fs_path(self.path(name))
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return set()
        paths = self.spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(target))
        return {p.rsplit("/", 1)[-1] for p in path_texts(self.spark, paths)}

    def exists(self, relative: str) -> bool:
        target = self._fs_path(f"{self.root}/{relative}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _fs_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows; a row against the table's declaration stops the write, and nothing of it becomes visible."""
        out = schemas.enforced(df, name).write.mode("append")
        if name in PARTITION:
            out = out.partitionBy(PARTITION[name], *BELOW_RUN.get(name, ()))
        out.parquet(self.path(name))

    def runs(self) -> DataFrame:
        """Current state of every run that was not purged."""
        return ledger.run_state(self.read("run_events")).where(F.col("status") != schemas.PURGED)

    def latest_run_id(self) -> int | None:
        return ledger.latest_run(self.runs()).first()[0]

    def facts(self) -> DataFrame:
        """Facts of successful runs only."""
        return ledger.visible(self.read("stg_actions"), self.runs())

    def latest_facts(self) -> DataFrame:
        """Facts of the latest successful run; empty when there is none.

        One plan: the run is a scalar subquery among the scan's partition filters, so only its folder is read, and
        the run is chosen when the result is computed.
        """
        return ledger.of_latest_run(self.read("stg_actions"), self.runs())

    def facts_at(self, run_ids: int | list[int]) -> DataFrame:
        """Facts of given successful runs, for readers pinned to them."""
        ids = [run_ids] if isinstance(run_ids, int) else run_ids
        return ledger.visible(self.read_runs("stg_actions", ids), self.runs())

    def findings(self) -> DataFrame:
        return self.read("data_quality_results")

    def summaries(self) -> DataFrame:
        return self.read("executive_summaries")

    def config(self) -> DataFrame:
        return ledger.latest_config(self.read("app_config"))

    # --- drafts and configuration -----------------------------------------------------------

    def set_config(self, key: str, value: str, at: datetime) -> None:
        row = {"config_key": key, "config_value": value, "updated_at": at}
        self.append("app_config", small_table(self.spark, [row], schemas.APP_CONFIG))

    def save_drafts(self, drafts: DataFrame) -> None:
        """Append prepared drafts (see reports.draft_rows) with the next summary ids."""
        top = self.summaries().agg(F.max("summary_id")).first()[0] or 0
        unique = [c for c in drafts.columns if c not in ("created_at", "source_run_id")]
        keyed, staged = number_rows(drafts, ["created_at", "source_run_id", *unique], top, "summary_id")
        try:
            self.append("executive_summaries", keyed)
        finally:
            self.remove(staged)

    # --- restatements ------------------------------------------------------------------------

    def restate(self, version: str, inclusive: bool, run_ids: list[int] | None = None) -> list[int]:
        """Keep facts of successful runs under another definition beside the old ones; gives the runs it did.

        Rows come from the runs' raw rows and never change the old facts. A run is done once per version: its folder is
        written, shown to hold the same actions as the old facts, and only then marked, so a stopped restatement stays
        unseen and can be repeated. Where a run's actions differ, its folder goes, the other runs are kept, and it raises.
        """
        if version == staging.ORIGINAL or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", version):
            raise ValueError(f"not a version name: {version!r}")
        done = self.read("restatements").where(F.col("definition_version") == F.lit(version))
        todo = ledger.succeeded(self.runs()).join(done, "run_id", "left_anti")
        if run_ids is not None:
            todo = todo.where(F.col("run_id").isin(run_ids))
        ids = sorted(r.run_id for r in todo.select("run_id").toLocalIterator())  # a row per run
        if not ids:
            return []
        facts = staging.restate(self.read_runs("raw_actions", ids), todo, version, inclusive)
        self._replace("restated_actions", schemas.enforced(facts, "restated_actions"))
        written = self.read_runs("restated_actions", ids).where(F.col("definition_version") == F.lit(version))
        bad = {r.run_id for r in integrity.restatement_problems(self.read_runs("stg_actions", ids), written).toLocalIterator()}
        for run in bad:
            self.remove(f"{self.path('restated_actions')}/run_id={run}/definition_version={version}")
        good = [i for i in ids if i not in bad]
        if good:
            now = datetime.now(UTC).replace(tzinfo=None)
            sizes = written.where(F.col("run_id").isin(good)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
            marks = small_table(self.spark, [{"run_id": i} for i in good], "run_id long").join(sizes, "run_id", "left").select(
                "run_id", F.lit(version).alias("definition_version"), F.coalesce("n", F.lit(0)).alias("fact_rows"), ntz(now).alias("restated_at"))
            self.append("restatements", marks.coalesce(1))
        if bad:
            raise ValueError(f"restated facts are not those of the runs: {sorted(bad)}")
        return good

    def fact_versions(self) -> DataFrame:
        """Facts of successful runs, loaded and restated ones side by side, told apart by `definition_version`."""
        restated = ledger.visible(self.read("restated_actions"), self.runs())
        return staging.with_versions(self.facts(), restated, self.read("restatements"))

    def facts_as(self, version: str) -> DataFrame:
        """Facts of successful runs, each run once: under a version where it has it, else as loaded."""
        restated = ledger.visible(self.read("restated_actions"), self.runs())
        return staging.as_version(self.facts(), restated, self.read("restatements"), version)

    def drop_unfinished_restatements(self) -> list[tuple[int, str]]:
        """Delete folders of restatements that were stopped before they were marked."""
        root, marks = self._fs_path(self.path("restated_actions")), self.read("restatements")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        listed = [path.getPath() for path in fs.globStatus(self._fs_path(f"{self.path('restated_actions')}/run_id=*/definition_version=*"))]
        there = {(int(p.getParent().getName().partition("=")[2]), p.getName().partition("=")[2]) for p in listed}
        marked = {(r.run_id, r.definition_version) for r in marks.select("run_id", "definition_version").toLocalIterator()}  # a row per run and version
        for run, version in sorted(there - marked):
            self.remove(f"{self.path('restated_actions')}/run_id={run}/definition_version={version}")
        return sorted(there - marked)

    # --- leftovers ---------------------------------------------------------------------------

    def orphans(self, started_before: datetime) -> DataFrame:
        """(table_name, run_id, status): rows' folders that no reader sees and no load will finish.

        These are folders of runs that the ledger does not know (status NULL) or has purged, and raw rows and facts of
        runs that failed, or that are still running though they started before the given time.
        """
        listed = [
            {"table_name": name, "run_id": int(run)}
            for name in PARTITION for run in (folder.partition("=")[2] for folder in self.folders(name)) if run.isdigit()
        ]
        there = small_table(self.spark, listed, "table_name string, run_id long")
        known = ledger.run_state(self.read("run_events")).select("run_id", "status", "started_at")
        loaded = F.col("table_name").isin("raw_actions", "stg_actions", "restated_actions")
        left = F.col("status").isNull() | (F.col("status") == schemas.PURGED) | loaded & (
            (F.col("status") == "failed") | (F.col("status") == "running") & (F.col("started_at") < ntz(started_before)))
        return there.join(known, "run_id", "left").where(left).select("table_name", "run_id", "status")

    def sweep(self, started_before: datetime) -> list[dict]:
        """Delete the orphans and mark the runs that never ended as failed; gives what was deleted.

        It may be stopped and repeated: what is gone is not listed again, and a run is marked last.
        """
        gone = [r.asDict() for r in self.orphans(started_before).orderBy("run_id", "table_name").toLocalIterator()]
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(lambda r: self.drop_run(r["table_name"], r["run_id"]), gone))
        state = self._last_events()
        stuck = state.where((F.col("status") == "running") & (F.col("started_at") < ntz(started_before)))
        self._mark(stuck, "failed", completed_at=F.greatest("started_at", ntz(started_before)))
        return gone

    def compact(self, name: str) -> int:
        """Put the small files of the ledger or the configuration into one; gives how many there were.

        The new file is written beside the old ones before these go. Readers fold repeated events and entries, so
        they see the same at any moment, also where it stops half way.
        """
        if name in PARTITION:
            raise ValueError(f"{name} is kept by run")
        if not self.exists(name):
            return 0
        target = self._fs_path(self.path(name))
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(target) if s.isFile() and s.getPath().getName().startswith("part-")]
        if len(old) > 1:
            self.append(name, self.read(name).distinct().coalesce(1))
            for path in old:
                fs.delete(path, False)
        return len(old)

    def _last_events(self) -> DataFrame:
        events = self.read("run_events")
        return events.groupBy("run_id").agg(F.max_by(F.struct(*events.columns), "event_seq").alias("s")).select("s.*")

    def _mark(self, events: DataFrame, status: str, **more: Column) -> None:
        """Append a further event for runs, given by their last ones."""
        marks = events.withColumns({"event_seq": F.col("event_seq") + 1, "status": F.lit(status)} | more)
        self.append("run_events", marks.coalesce(1))

    # --- removal ----------------------------------------------------------------------------

    def remove(self, folder: str) -> None:
        """Delete a folder this engine wrote."""
        target = self._fs_path(folder)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def drop_run(self, name: str, run_id: int) -> None:
        """Delete one run's rows of a table; restated facts go before the facts they stand for."""
        if name == "stg_actions":
            self.drop_run("restated_actions", run_id)
        self.remove(f"{self.path(name)}/{PARTITION[name]}={run_id}")

    def purge(self, plan: DataFrame) -> None:
        """Carry out a retention plan in its step order; the plan has one row per run and table.

        The plan is stored before anything goes. Where a purge is stopped, `resume_purges` or the next purge ends it.
        """
        self._record(plan.select(
            "step", "table_name", "run_id", "rows", F.lit(uuid.uuid4().hex).alias("purge_id"), F.lit("planned").alias("state")))
        self.resume_purges()

    def pending_purges(self) -> DataFrame:
        """Stored steps that were planned and are not done; never one of the latest successful run."""
        steps = self.read("purge_steps")
        keys = ["purge_id", "step", "table_name", "run_id"]
        state = steps.groupBy(*keys).agg(F.max("rows").alias("rows"), F.bool_or(F.col("state") == "done").alias("done"))
        keep = F.coalesce(ledger.latest_run(self.runs()).scalar(), F.lit(-1).cast("bigint"))
        return state.where(~F.col("done") & (F.col("run_id") != keep)).select(*keys, "rows")

    def resume_purges(self) -> int:
        """End purges that were stopped; gives the number of steps. Each step can be repeated, and is marked when done."""
        total = 0
        for step, name in enumerate(governance.PURGE_ORDER, start=1):
            todo = self.pending_purges().where(F.col("step") == step)
            rows = [r.asDict() for r in todo.toLocalIterator()]  # a row per run
            if not rows:
                continue
            done = small_table(self.spark, rows, "purge_id string, step int, table_name string, run_id long, rows long")
            if name == "ingestion_runs":
                left = self._last_events().where(F.col("status") != schemas.PURGED)
                self._mark(left.join(done.select("run_id"), "run_id", "left_semi"), schemas.PURGED)
            else:
                with ThreadPoolExecutor(8) as pool:
                    list(pool.map(lambda r: self.drop_run(r["table_name"], r["run_id"]), rows))
            self._record(done.withColumn("state", F.lit("done")))
            total += len(rows)
        return total

    def _record(self, steps: DataFrame) -> None:
        now = datetime.now(UTC).replace(tzinfo=None)
        self.append("purge_steps", steps.withColumn("at", ntz(now)).coalesce(1))

    def erase_owner(self, owner: str) -> list[dict]:
        """Remove every row about an owner from all tables, rewriting only the runs it is in.

        Gives the erasure record: table_name, run_id, rows_before, subject_rows, rows_after; it names no person. Tables
        go in this order: facts, restated facts, raw rows, findings, summaries.
        """
        self.drop_unfinished_restatements()
        record = governance.erasure_report(
            owner, self.read("raw_actions"), self.read("stg_actions"), self.findings(), self.summaries(),
            self.read("restated_actions"))
        rows = [r.asDict() for r in record.orderBy("table_name", "run_id").toLocalIterator()]  # a row per table and run
        for name, hit in governance.subject_rows(owner).items():
            hurt = [r for r in rows if r["table_name"] == name]
            if hurt:
                self._rewrite(name, [r["run_id"] for r in hurt if r["rows_after"]], ~hit)
                for r in hurt:
                    if not r["rows_after"]:
                        self.drop_run(name, r["run_id"])
        return rows

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Write the folders that rows fall in anew; other folders stay as they are."""
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(PARTITION[name], *BELOW_RUN.get(name, ())).parquet(self.path(name))

    def _rewrite(self, name: str, run_ids: list[int], keep: Column) -> None:
        """Replace some runs' rows by those to keep; they are staged first, as a table can't be read while it is replaced."""
        if not run_ids:
            return
        levels, schema = (PARTITION[name], *BELOW_RUN.get(name, ())), schemas.TABLES[name]
        staged = fresh_folder(self.spark, f"erase-{name}")
        try:
            self.read_runs(name, run_ids).where(keep).write.partitionBy(*levels).parquet(staged)
            kept = self.spark.read.schema(schema).parquet(staged).select(*schema.names)
            self._replace(name, kept)
        finally:
            self.remove(staged)
