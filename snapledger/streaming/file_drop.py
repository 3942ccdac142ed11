"""Incremental file-drop ingestion with Structured Streaming.

The stream only finds new files, and notes those of a micro-batch beside its checkpoint before the batch is done. When it
has ended, all noted files go through the batch loader together, so its jobs run once for thousands of files, not once for
each micro-batch. The notes go when the load is through: after a stop at any place, the next start loads what is left. The
loader's content hash decides about repeats, so a replayed batch or a lost checkpoint loads nothing twice.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from snapledger.operators.ingest import ingest
from snapledger.sources.warehouse import Warehouse

BINARY_FILE = StructType(
    [
        StructField("path", StringType()),
        StructField("modificationTime", TimestampType()),
        StructField("length", LongType()),
        StructField("content", BinaryType()),
    ]
)


# Files of one load; the driver holds a small row for each.
FILES_PER_LOAD = 10_000


class FileDrop:
    """The running stream, and the load that follows it. Other questions go to the stream."""

    def __init__(self, wh: Warehouse, query: StreamingQuery, notes: str, reference_date: date):
        self.wh, self.query, self.notes, self.reference_date = wh, query, notes, reference_date

    def __getattr__(self, name: str):
        return getattr(self.query, name)

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        """Wait until all that is new was found and loaded; as of a stream, with a time limit for finding it."""
        ended = self.query.awaitTermination(timeout) if timeout else self.query.awaitTermination()
        if ended is not False:
            self._load()
        return ended

    def _load(self) -> None:
        spark = self.wh.spark
        try:
            noted = spark.read.schema("path string").option("recursiveFileLookup", "true").parquet(self.notes)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        paths = sorted({r["path"] for r in noted.toLocalIterator()})  # names only; contents are read by the loader's tasks
        for first in range(0, len(paths), FILES_PER_LOAD):
            # The stream's listing passes over hidden files, so none is among these.
            ingest(self.wh, paths[first : first + FILES_PER_LOAD], self.reference_date, look_for_hidden=False)
        self.wh.remove(self.notes)


def start(
    wh: Warehouse, landing: str, checkpoint: str, reference_date: date, files_per_batch: int = 100
) -> FileDrop:
    """Find what is new under `landing`, then stop; `awaitTermination` loads it. Run again to pick up later files."""
    notes = f"{checkpoint}/arrivals"

    def note(batch: DataFrame, batch_id: int) -> None:
        batch.select("path").coalesce(1).write.mode("overwrite").parquet(f"{notes}/{batch_id}")

    files = (
        wh.spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        .load(landing)
    )
    query = (
        files.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    return FileDrop(wh, query, notes, reference_date)
