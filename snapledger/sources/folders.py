"""The shared folder for everything the engine writes between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import SparkSession


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_listing = Lock()


@contextmanager
def listed_in_bulk(spark: SparkSession) -> Iterator[None]:
    """Tables opened inside are listed by a few tasks for each core, many folders in each; else each folder is a task."""
    with _listing:
        before = spark.conf.get(_LISTING_TASKS)
        spark.conf.set(_LISTING_TASKS, min(int(before), 4 * spark.sparkContext.defaultParallelism))
        try:
            yield
        finally:
            spark.conf.set(_LISTING_TASKS, before)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only where driver and tasks are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="snapledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/snapledger/{name}-{uuid.uuid4().hex}"


def path_texts(spark: SparkSession, paths) -> list[str]:
    """Paths of a JVM array. They come as one text, since a call for each takes far longer than listing them."""
    text = spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(paths).mkString("\0")
    return text.split("\0") if text else []
