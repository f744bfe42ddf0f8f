"""Mixing of sources to target weights, by weighted sampling without replacement.

Every document draws an exponential key, divided by its quality weight: the documents
of smallest key are such a sample of any size. Sources take whole epochs first; the rest of a
target takes documents in order of key while their sizes, summed up, stay within it.
All of it is Spark SQL; keys are derived from ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelscope.llm.shared import written

#: Slices of the keys of a source: no window holds more than one slice.
SLICES = 4096
#: Sources up to which their table is broadcast to the documents; one row each, some hundred bytes.
MOST_BROADCAST = 50_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: 1 for words of six characters on average, less the farther from it."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.coalesce(1 / (1 + F.abs(mean - 6) / 6), F.lit(1.0))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an MD5 of seed and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / F.greatest(weight, F.lit(1e-6))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in order of their names, null last, get the weights in turn. The targets share ``share`` of
    all sizes by weight; none is above ``most`` times its source, and what that leaves is shared
    again by weight. In order of size over weight, the sources held at their bound are a
    prefix, so running sums give the level in one step. Runs on one row for each source.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    every = F.array(*(F.lit(float(w)) for w in weights))
    weighted = sizes.withColumn("weight", F.element_at(every, (turn + 1).cast("int"))).withColumn(
        "bound", (F.col("source_size") * most).cast("double"))
    up = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighted.withColumn("level", level).withColumn("rank", F.row_number().over(up))
    free = F.col("bound") > F.col("level") * F.col("weight")
    # the level of the first source below its bound is that of all after it
    final = F.min(F.when(free, F.struct("rank", "level"))).over(Window.partitionBy())["level"]
    return levelled.withColumn("final", final).select(
        "source", "source_size",
        F.when(F.col("final").isNull(), F.col("bound")).otherwise(F.least("bound", F.col("final") * F.col("weight"))).alias("target"),
    )


def measured(docs: DataFrame, seed: int, quality: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as a struct, with their size, key and slice of keys.

    ``quality`` is the weight of a document, by default one of its text; a null, a NaN or one below a millionth counts as a millionth.
    """
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    given = F.lit(None).cast("double") if quality is None else F.nanvl(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = docs.select(row, given.alias("quality")).withColumn("size", word_count(F.col("row.text")))
    weight = text_quality(F.col("row.text"), F.col("size")) if quality is None else F.col("quality")
    key = exponential_key(F.col("row.doc_id"), weight, seed)
    return sized.withColumn("key", key).withColumn("slice", F.floor(F.col("key") / (1 + F.col("key")) * SLICES).cast("int"))


def mixing_plan(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """One row for each source: target, whole epochs, and the last key of the fractional selection.

    ``rows`` has doc_id, source, size, key, slice. The selection ends in the first slice of keys whose running
    size passes what the epochs leave of the target; only that slice is sorted. The
    document at the end is taken if at least half of it fits.
    """
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    planned = written(
        targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets"
    )
    up = Window.partitionBy("source").orderBy("slice")
    through = slices.withColumn("through", F.sum("slice_size").over(up))
    named = planned.select(F.col("source").alias("name"), "rest")
    ends = (
        through.join(named, F.col("source").eqNullSafe(F.col("name")))
        .filter("through > rest").groupBy("source")
        .agg(F.min(F.struct("slice", (F.col("through") - F.col("slice_size")).alias("before"), "rest")).alias("end"))
        .select(F.col("source").alias("name"), F.col("end.slice").alias("end_slice"), "end.before", "end.rest")
    )
    last = rows.join(ends, F.col("source").eqNullSafe(F.col("name")) & (F.col("slice") == F.col("end_slice")))
    running = Window.partitionBy("source").orderBy("key", "doc_id")
    chosen = (
        last.withColumn("middle", F.col("before") + F.sum("size").over(running) - F.col("size") / 2)
        .filter("middle <= rest").groupBy("source").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))).alias("last"))
        .select(F.col("source").alias("other"), "last")
    )
    joined = planned.join(ends.select("name", "end_slice"), F.col("source").eqNullSafe(F.col("name")), "left")
    return written(
        joined.join(chosen, F.col("source").eqNullSafe(F.col("other")), "left").select(
            F.col("source").alias("of_source"), "source_size", "target", "epochs", "end_slice", "last"), "mixing-plan"
    )


def _taken(rows: DataFrame, plan: DataFrame, source: Column, doc_id: Column) -> DataFrame:
    """``rows`` with the columns of their source's plan and ``taken``."""
    if plan.count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    own = F.struct(F.col("key"), F.coalesce(doc_id, F.lit(-(2**63))).alias("id"))
    within = (
        F.col("end_slice").isNull() | (F.col("slice") < F.col("end_slice"))
        | ((F.col("slice") == F.col("end_slice")) & F.coalesce(own <= F.col("last"), F.lit(False)))
    )
    taken = F.col("size") * (F.col("epochs") + F.when((F.col("source_size") > 0) & within & (F.col("epochs") * F.col("source_size") < F.col("target")), 1).otherwise(0))
    return rows.join(plan, source.eqNullSafe(F.col("of_source"))).withColumn("taken", taken)


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 42, quality: str | None = None
) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``, ``source``): its size in words and how many the mix takes.

    ``taken`` is the size times the epochs of the source, once more for documents of the fractional
    selection. Null texts have size 0 and are never taken; null sources are one source, the
    last. Rows alike in id share a key and are taken or left together. An empty table gives no rows;
    other columns are not read. ``quality`` names a column of weights, such as a trained score; a document of twice the weight is twice as
    likely to come first. By default the weight is one of the text alone.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), "text", "source", *([F.col(quality).alias("weight")] if quality else []))
    rows = written(
        measured(narrow, seed, F.col("weight") if quality else None)
        .select("row.doc_id", "row.source", "size", "key", "slice"), "measured"
    )
    plan = mixing_plan(rows, weights, share, most)
    return _taken(rows, plan, F.col("source"), F.col("doc_id")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: int = 42, quality: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and, last, ``taken`` (over a column of that name)."""
    rows = measured(docs, seed, docs[quality] if quality else None)
    narrow = written(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.source", "size", "key", "slice"), "measured")
    plan = mixing_plan(narrow, weights, share, most)
    mixed = _taken(rows, plan, F.col("row.source"), F.col("row.doc_id").cast("long")).filter("taken > 0")
    return mixed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "taken"), "taken")
