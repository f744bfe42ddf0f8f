"""Reading annotation tables: CSV scan, header and type clean-up, checks."""

from __future__ import annotations

import re
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labelscope.functions.text import null_if_na

# Types of the known columns of a raw annotation table; all others stay text.
RAW_TYPES = {"page_number": "bigint"}


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def validate_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """The table itself, or ``ValueError`` naming every required column it lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def harden_schema(df: DataFrame, columns: Iterable[str] = ("filename", "model")) -> DataFrame:
    """Cast the group keys to string; a missing key stays NULL."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


def read_csv_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A headered CSV with quoted multi-line fields, all columns as text, NA tokens as NULL."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    df = normalize_columns(df)
    return df.select([null_if_na(F.col(f"`{c}`")).alias(c) for c in df.columns])


def _typed(value: Column, kind: str) -> Column:
    """The text as the given type, NULL if it is none; whole numbers may be written ``3.0``."""
    if kind == "string":
        return value
    if kind == "bigint":
        return F.coalesce(value.try_cast(kind), value.try_cast("double").try_cast(kind))
    return value.try_cast(kind)


def read_annotations(
    spark: SparkSession, path: str | list[str], types: dict[str, str] = RAW_TYPES
) -> DataFrame:
    """Raw answers from CSV with a dense ``row_id``: files by path, rows as they stand in the file.

    A multi-line file is read by one task, so the task-wise id grows along the file; the rows of
    the files before it, counted and summed up, are added. One rule for any number of
    files: the table of files has a row for each, and never reaches the driver. The input is
    scanned once for the counts and once for the rows. Land the result as Parquet before
    using it at size: a multi-line CSV cannot be split, and stored ids stay as they are.
    """
    scan = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    names = [c.strip().lower() for c in scan.columns]
    columns = [
        _typed(null_if_na(F.col(f"`{raw}`")), types.get(name, "string")).alias(name)
        for raw, name in zip(scan.columns, names)
    ]
    place = [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")]
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        scan.select(*place).groupBy("_file").agg(F.count("*").alias("_rows"), F.min("_line").alias("_first"))
        .select("_file", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    rows = scan.select(*columns, *place).join(files, "_file")
    return rows.withColumn("row_id", F.col("_line") + F.col("_shift")).drop("_file", "_line", "_shift")


def read_first_available(
    spark: SparkSession, candidates: Iterable[tuple[str, str | None]]
) -> tuple[DataFrame | None, str]:
    """The first ``(tag, uri)`` that can be read, and its tag; ``(None, "missing")`` if none can.

    Whatever keeps a source from being opened (no such path, an empty folder, a file system that is not
    there or fails) only sends the search on to the next. So does a source that opens but holds nothing: one
    of 0 bytes, one without a header that names a column, or one whose first block cannot be read, such as a compressed file that was
    cut off. A header alone is a table without rows. Later blocks are not probed. A URI may name any file system the
    cluster knows. The tag and the base name of the file travel along as ``source_tag`` and ``source_file``.
    """
    for tag, uri in candidates:
        if uri is None:
            continue
        try:
            df = spark.read.csv(uri, header=True, multiLine=True, quote='"', escape='"')
            # columns without a name in the header are called _c0, _c1, ...
            if all(re.fullmatch(r"\s*(_c\d+)?\s*", c) for c in df.columns):
                continue
            df.head(1)
        except (PySparkException, Py4JJavaError):
            continue
        cleaned = df.select(
            *[null_if_na(F.col(f"`{c}`")).alias(c.strip().lower()) for c in df.columns],
            F.lit(tag).alias("source_tag"),
            F.col("_metadata.file_name").alias("source_file"),
        )
        return cleaned, tag
    return None, "missing"


def preview(df: DataFrame, rows: int = 5, order: str = "row_id") -> DataFrame:
    """The first rows of a table (top-k by row number, no full sort)."""
    return df.orderBy(order).limit(rows)


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("records"))
