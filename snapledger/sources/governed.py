"""Reads bound to an identity: scope, masks and an access event for every answer, which a caller can't leave out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import TypeVar

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from snapledger import schemas
from snapledger.operators import governance, runs as ledger
from snapledger.sources.local import small_table
from snapledger.sources.warehouse import Warehouse

T = TypeVar("T")
DATASETS = ("stg_actions", "raw_actions", "data_quality_results", "executive_summaries")


class GovernedReader:
    """What one actor may read of a warehouse.

    It gives out no table, only answers: a query gets the rows of the actor's scope with masked columns, its result is
    delivered, and an event with the number of delivered rows is appended to the audit log. Only rows of successful
    runs are read. `entitlements` has actor and the columns that limit roles (owner, project_name).
    """

    def __init__(self, wh: Warehouse, actor: str, role: str, salt: str, entitlements: DataFrame):
        if role not in governance.ROLES:
            raise ValueError(f"unknown role: {role}")
        self._wh, self._actor, self._role, self._salt, self._entitlements = wh, actor, role, salt, entitlements

    def answer(
        self, dataset: str, query_ref: str, build: Callable[[DataFrame], DataFrame], deliver: Callable[[DataFrame], T],
        run_id: int | None = None, event_type: str = "query",
    ) -> T:
        """`deliver(build(rows))`, where rows are those of the latest successful run, or of a given one.

        The rows are counted while they are delivered (`observe`), in the same job; `deliver` has to take the whole
        result, by collecting or writing it. Nothing is logged about a delivery that raises.
        """
        if dataset not in DATASETS:
            raise ValueError(f"unknown dataset: {dataset}")
        if event_type not in schemas.AUDIT_EVENTS:
            raise ValueError(f"unknown event: {event_type}")
        result = build(self._rows(dataset, run_id))
        seen = Observation(f"answer-{uuid.uuid4().hex}")
        out = deliver(result.observe(seen, F.count(F.lit(1)).alias("row_count")))
        self._wh.append("audit_log", small_table(self._wh.spark, [{
            "audit_id": uuid.uuid4().int >> 65, "event_time": datetime.now(UTC).replace(tzinfo=None), "actor_id": self._actor,
            "role_id": self._role, "event_type": event_type, "dataset": dataset, "run_id": run_id, "query_ref": query_ref,
            "columns_accessed": ", ".join(result.columns), "row_count": seen.get["row_count"],
        }], schemas.AUDIT_LOG))
        return out

    def _rows(self, dataset: str, run_id: int | None) -> DataFrame:
        key = "source_run_id" if dataset == "executive_summaries" else "run_id"
        if run_id is None:
            rows = ledger.of_latest_run(self._wh.read(dataset), self._wh.runs(), key)
        else:
            good = ledger.succeeded(self._wh.runs()).select(F.col("run_id").alias(key))
            rows = self._wh.read_runs(dataset, [run_id]).join(good, key, "left_semi")
        return governance.bound(rows, dataset, self._actor, self._role, self._salt, self._entitlements)
