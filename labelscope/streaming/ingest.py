"""Incremental parsing of newly arriving answers.

Parsing, labelling and filtering keep no state, so the batch operators run
unchanged on a stream. Row ids must come with the data: a stream has no row order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from labelscope.operators.labels import normalize_labels
from labelscope.operators.parsing import parse_annotations, with_provider


def stream_raw(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Raw answers landed as Parquet in a folder, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def labelled_sentences(raw: DataFrame) -> DataFrame:
    """One row per annotation with provider and codes; for batch and stream alike."""
    return normalize_labels(with_provider(parse_annotations(raw)))


def land_sentences(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = labelled_sentences,
) -> StreamingQuery:
    """Appends the sentences of all waiting answers to a Parquet table, exactly once, then ends."""
    rows = transform(raw)
    return (
        rows.drop("text")
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
