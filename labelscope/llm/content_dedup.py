"""Exact duplicates by sorting content.

Normalised texts are dealt by range of (first characters, digest, id), with splitters that Spark
samples; each task sorts its range by the whole normalised text, so equal texts lie side by side, and compares each text
whole with its neighbour. A run of equal texts is settled where it lies: its first row has the largest id and stays. The id is part of the
range, so a text with any number of copies spreads over as many tasks as it needs; only the first and the last run of a task may go on in
another one. Those meet by digest, as one narrow row for each, two for a task at most, and go back to
their rows by a broadcast of that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelscope.llm.shared import bloom, in_bloom, written

#: Characters of a text that are a splitter's first part: what is sampled for splitters stays small however long the texts.
PREFIX = 32
#: Rows that a task hands on together.
ROWS = 10_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _sorted(docs: DataFrame) -> DataFrame:
    """``id, digest, norm`` in order of content, the largest id first among equals."""
    norm = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), norm.alias("norm"))
    rows = rows.withColumns({"digest": F.sha2(F.col("norm").cast("binary"), 256), "prefix": F.substring("norm", 1, PREFIX)})
    last = F.col("id").desc_nulls_last()
    dealt = rows.repartitionByRange(F.col("prefix"), F.col("digest"), last)
    return dealt.sortWithinPartitions("norm", last).select("id", "digest", "norm")


def sorted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, keep_id, group_size, kept`` as each task's runs have them, with ``task, edge``: the run may go on in another task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        last, digest, ids, edge = None, "", [], True
        out: list[tuple] = []

        def settled(edge: bool) -> None:
            out.extend((i, digest, ids[0], len(ids), n == 0, edge) for n, i in enumerate(ids))

        def handed() -> pa.RecordBatch:
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            columns.append(pa.array(np.full(len(out), task, dtype=np.int32)))
            out.clear()
            return pa.RecordBatch.from_arrays(columns, [*names, "task"])

        for batch in batches:
            for i, its, value in zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), batch.column("norm"), strict=True):
                value = value.as_buffer().to_pybytes()
                if value != last:
                    if last is not None:
                        settled(edge)
                        edge = False
                    last, digest, ids = value, its, []
                ids.append(i)
            if len(out) > ROWS:
                yield handed()
        if last is not None:
            settled(True)
        if out:
            yield handed()

    names = ["doc_id", "text_sha256", "keep_id", "group_size", "kept", "edge"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    schema = "doc_id long, text_sha256 string, keep_id long, group_size long, kept boolean, edge boolean, task int"
    return written(_sorted(docs).mapInArrow(run, schema), "runs")


def content_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): which row of its text stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest id stays; of rows alike in id too, one. Rows without an id come last and have a null
    ``keep_id`` only if no equal row has an id. An empty table gives no rows; other columns are not read. Very long texts are
    compared whole, two at a time.
    """
    rows = sorted_runs(docs)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    # of a text in several tasks: a row for each task
    edges = rows.filter("edge AND kept").groupBy("text_sha256").agg(
        F.max("keep_id").alias("best"), F.sum("group_size").alias("size"), F.min("task").alias("first")
    )
    across = rows.filter("edge").join(F.broadcast(edges), "text_sha256").select(
        "doc_id", F.col("best").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("kept") & (F.col("task") == F.col("first"))).alias("kept"), "text_sha256",
    )
    return rows.filter("NOT edge").select(*columns).unionByName(across)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay by the rules of ``content_dedup``: of null and empty texts one, too.

    Rows that go are named by id and digest. Only rows that may be among them, by a filter of fixed size, are
    shuffled to the table that names them, by a key that no text shares with its copies; all others pass through the scan.
    """
    rows = written(content_dedup(docs), "copies")
    named = [F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")]
    goes = rows.filter("NOT kept").select(*named).groupBy("id", "digest").count().select("id", "digest")
    stays = rows.filter("kept AND group_size > 1").select(*named, F.lit(True).alias("stays"))
    same = [F.col("g.id").eqNullSafe(F.col("s.id")), F.col("g.digest") == F.col("s.digest")]
    # rows alike in id and text: one of them stays
    gone = written(
        goes.alias("g").join(stays.alias("s"), same, "left").select("g.id", "g.digest", F.coalesce("stays", F.lit(False)).alias("one_stays")), "gone"
    )
    words = bloom(gone.select(F.xxhash64("id", "digest").alias("key")), "key")

    @F.pandas_udf("boolean")
    def may_go(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(words, keys.to_numpy().view(np.uint64)))

    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    marked = docs.select(row).withColumns({"id": F.col("row.doc_id").cast("long"), "digest": digest(F.col("row.text"))})
    marked = marked.withColumn("maybe", may_go(F.xxhash64("id", "digest")))
    alone = marked.filter("NOT maybe").select("row")
    found = marked.filter("maybe").alias("g").join(
        gone.alias("s"), same, "left"
    ).select("row", F.col("g.id").alias("id"), F.col("g.digest").alias("digest"), "one_stays")
    others = found.filter("one_stays IS NULL").select("row")
    ones = found.filter("one_stays").dropDuplicates(["id", "digest"]).select("row")
    return alone.unionByName(others).unionByName(ones).select("row.*")
