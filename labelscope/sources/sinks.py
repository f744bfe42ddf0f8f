"""Writers for exported tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headered CSV; quotes inside a field are doubled, so any CSV reader gets the text back."""
    df.write.mode(mode).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue='""',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, NULLs included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def records_document(df: DataFrame, order: str) -> DataFrame:
    """A dense label summary as one JSON array. Only for tables with one row per label."""
    entry = F.struct(*[F.col(c) for c in df.columns if c != order])
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e"))))
    return df.agg(F.to_json(F.transform(rows, lambda r: r["e"])).alias("document"))


def write_label_summaries(summaries: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each summary (see ``label_summary``) as ``<path>/<name>_summary`` in JSON records."""
    for name, df in summaries.items():
        write_json_records(df, f"{path}/{name}_summary", mode)


def write_lines(df: DataFrame, path: str, column: str = "line", mode: str = "errorifexists") -> None:
    """A text document, one line per row in the order of the frame."""
    df.select(column).write.mode(mode).text(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file as it is, in any file system the cluster knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
