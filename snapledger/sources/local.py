"""Small control data (one row per file or run) as DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: list[dict], schema: StructType | str) -> DataFrame:
    """Driver rows as a local relation, whose known size lets Spark choose the join itself."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    named = [{f.name: r.get(f.name) for f in fields} for r in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(fields)), fields)


def with_lookup(df: DataFrame, key: str, values: dict, name: str, key_type: str) -> DataFrame:
    """Rows whose key is in `values`, with its whole-number value as column `name`.

    A join with a local relation, whose known size lets Spark choose how.
    """
    rows = [{key: k, name: v} for k, v in values.items()]
    return df.join(small_table(df.sparkSession, rows, f"{key} {key_type}, {name} long"), key)
