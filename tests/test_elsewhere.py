"""Loads work from any working folder: tasks need no copy of the package on their path."""

import os
import pathlib
import subprocess
import sys

from conftest import golden_rows, write_csv

REPO = str(pathlib.Path(__file__).resolve().parent.parent)
SCRIPT = """
import sys
from datetime import date

sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession

from snapledger.operators.ingest import ingest
from snapledger.sources.warehouse import Warehouse

spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {shared!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate())
(result,) = ingest(Warehouse(spark, {shared!r} + "/warehouse"), {path!r}, date(2031, 3, 10))
print("OUTCOME", result.outcome, result.source_row_count)
"""


def test_a_load_from_another_folder(tmp_path):
    away = tmp_path / "away"
    away.mkdir()
    script = SCRIPT.format(repo=REPO, shared=str(tmp_path / "shared"), path=write_csv(tmp_path / "g.csv", golden_rows()))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", script], cwd=away, env=env, capture_output=True, text=True, timeout=300)
    assert "OUTCOME succeeded 9" in run.stdout, run.stderr[-2000:]
