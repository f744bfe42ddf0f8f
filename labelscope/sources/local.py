"""Small driver-side tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows as a local relation: its size is known, so joins with it can be planned by it."""
    names = [part.split()[0] for part in schema.split(",")]
    columns = zip(*rows) if rows else [[] for _ in names]
    arrays = [pa.array(list(c)) for c in columns]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=names), schema)
