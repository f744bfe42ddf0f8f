"""Rarest tones and exact balanced samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelscope.operators.flows import LABELS, flow_counts


def minimum_tone_distribution(
    df: DataFrame, labels: Sequence[str] = LABELS, with_ranking: bool = False
) -> DataFrame:
    """For each (aspect, sentiment) the least frequent tone that occurs, its count and the group size.

    Ties go to the first tone by name. The rows are aggregated to label triples
    before anything else, so what is ranked is a handful of tones per group.
    ``with_ranking`` adds tones and counts by falling frequency as two texts.
    """
    aspect, sentiment, tone = labels
    counts = flow_counts(df, labels)
    pair = F.struct(F.col("count"), F.col(tone).alias("tone"))
    columns = [
        F.min(pair).alias("_least"),
        F.sum("count").alias("group_count"),
    ]
    if with_ranking:
        falling = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col(tone).alias("tone"))))
        columns.append(falling.alias("_ranking"))
    out = counts.groupBy(F.col(aspect).alias("aspect_category"), F.col(sentiment).alias("sentiment")).agg(*columns)
    shown = [
        F.col("_least.tone").alias("minimum_tone"),
        F.col("_least.count").alias("minimum_amount"),
        F.col("group_count"),
    ]
    if with_ranking:
        shown += [
            F.concat_ws(", ", F.transform("_ranking", lambda r: r["tone"])).alias("descending_order"),
            F.concat_ws(", ", F.transform("_ranking", lambda r: (-r["n"]).cast("string"))).alias(
                "data_distribution"
            ),
        ]
    return out.select("aspect_category", "sentiment", *shown).orderBy("aspect_category", "sentiment")


def combined_minimum_tone(tones: DataFrame) -> DataFrame:
    """Sum of the minimum amounts per tone."""
    return tones.groupBy("minimum_tone").agg(F.sum("minimum_amount").alias("minimum_amount"))


def minimum_tone_flow(tones: DataFrame) -> DataFrame:
    """Sum of the minimum amounts per (aspect, sentiment, tone): the link weights of its flow graph."""
    keys = ("aspect_category", "sentiment", "minimum_tone")
    return tones.groupBy(*keys).agg(F.sum("minimum_amount").alias("count"))


def minimum_tone_matrix(tones: DataFrame, sentiments: Sequence[str]) -> DataFrame:
    """Aspect by sentiment table of the minimum amounts, 0 where a pair is absent."""
    return (
        tones.groupBy("aspect_category")
        .pivot("sentiment", list(sentiments))
        .agg(F.sum("minimum_amount"))
        .na.fill(0, list(sentiments))
    )


def balanced_sample(
    df: DataFrame,
    targets: DataFrame,
    n: int,
    seed: int = 42,
    labels: Sequence[str] = LABELS,
    row_id: str = "row_id",
    draw: Callable[..., Column] = F.xxhash64,
    small_targets: bool = False,
) -> DataFrame:
    """Exactly ``n`` rows of every target group, drawn by hash order; same seed, same rows.

    ``targets`` holds (aspect_category, sentiment, minimum_tone). Groups of at least
    ``n`` rows are drawn without replacement, smaller ones with. The output has the
    input columns and ``target_aspect``, ``target_sentiment``, ``target_tone``.

    A group may hold a large share of all rows, so it is never sorted as a whole.
    Each row falls into a level by the size of its hash, every level half as likely
    as the one before; counts per level (64 at most per group) tell which levels are
    needed to have ``n`` rows. Only those, about 2n rows, are ranked. The exchange
    of the level counts is reused, so the table is read once for them and once for the rows.

    Targets are joined plainly, and Spark broadcasts them where it knows them to be small.
    ``small_targets`` states that they come from two closed label sets, and asks for it.
    """
    group = ["target_aspect", "target_sentiment", "target_tone"]
    hint = F.broadcast if small_targets else (lambda frame: frame)
    keys = targets.select(
        F.col("aspect_category").alias(group[0]),
        F.col("sentiment").alias(group[1]),
        F.col("minimum_tone").alias(group[2]),
    ).distinct()
    matches = [F.col(c) == F.col(g) for c, g in zip(labels, group)]
    start = F.lit(seed).cast("long")
    place = F.shiftrightunsigned(draw(start, F.col(row_id)), 1)
    level = F.lit(63) - F.floor(F.log2(F.col("_place") + F.lit(1.0)))
    rows = df.withColumn("_place", place).withColumn("_row_level", level.cast("int"))

    levels = (
        rows.join(hint(keys), matches)
        .groupBy(*group, F.col("_row_level").alias("_level"))
        .agg(F.count("*").alias("_rows"))
    )
    higher = Window.partitionBy(*group).orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        levels.withColumn("_size", F.sum("_rows").over(Window.partitionBy(*group)))
        .withColumn("_higher", F.coalesce(F.sum("_rows").over(higher), F.lit(0)))
        .filter(F.col("_higher") < n)
        .select(*group, "_level", "_size")
    )
    by_place = Window.partitionBy(*group).orderBy("_place", row_id)
    ranked = rows.join(hint(needed), [*matches, F.col("_row_level") == F.col("_level")]).withColumn(
        "_rank", F.row_number().over(by_place)
    )
    # Draw k of a large group is the row of rank k; a small group is drawn from again and again.
    again = F.pmod(draw(start, *group, F.col("_draw")), F.col("_size")) + 1
    picked = F.when(F.col("_size") >= n, F.col("_draw")).otherwise(again)
    draws = (
        levels.groupBy(*group)
        .agg(F.sum("_rows").alias("_size"))
        .withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
        .select(*group, picked.cast("int").alias("_rank"))
    )
    return draws.join(ranked, [*group, "_rank"]).select(*df.columns, *group)
