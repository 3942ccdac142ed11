"""Consecutive ids for tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapledger.sources.folders import fresh_folder


def number_rows(df: DataFrame, order: list[str], start: int, name: str) -> tuple[DataFrame, str]:
    """Add ids start+1, start+2, ... in the given order, without sorting in one task.

    Rows are range-partitioned and sorted, and written once with their partition and place, so
    that a repeated task cannot place them differently. Only the partition sizes, one row per
    partition, are summed up in order. Gives the rows and the folder they are read from, which the
    caller removes after use. Columns that tell rows apart belong into `order`, so that equal
    leading values are dealt out to several tasks and ids don't depend on arrival.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_part": F.spark_partition_id(), "_place": place}
    )
    folder = fresh_folder(df.sparkSession, "numbered")
    placed.write.parquet(folder)
    stored = df.sparkSession.read.schema(placed.schema).parquet(folder)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0).cast("bigint")).alias("_before"))
    numbered = stored.join(offsets, "_part")
    return numbered.withColumn(
        name, F.col("_before") + F.col("_place") + F.lit(start + 1).cast("bigint")
    ).drop("_part", "_place", "_before"), folder
