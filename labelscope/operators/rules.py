"""Wildcard rules over label triples: which rows match, and the first n of each."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from labelscope.operators.flows import LABELS, flow_counts
from labelscope.operators.ranking import SLICE, SLICE_ROWS, earlier_rows, slice_of
from labelscope.sources.local import local_table

ANY = "(Any)"


class Rule(NamedTuple):
    aspect: str = ANY
    sentiment: str = ANY
    tone: str = ANY
    take_n: int = 10


def _matching_rules(rules: Sequence[Rule], labels: Sequence[str]) -> Column:
    """Array of ``(rule_id, take_n)`` of the rules a row meets; the rules are literals of the plan."""
    hits = []
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for column, wanted in zip(labels, rule[:3]):
            if wanted != ANY:
                test = test & (F.col(column) == wanted)
        entry = F.struct(F.lit(i + 1).alias("rule_id"), F.lit(rule.take_n).cast("long").alias("take_n"))
        hits.append(F.when(test, entry))
    return F.array_compact(F.array(*hits))


def _rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return local_table(
        spark,
        [(i + 1, *r) for i, r in enumerate(rules)],
        "rule_id int, aspect string, sentiment string, tone string, asked long",
    )


def rule_summary(df: DataFrame, rules: Sequence[Rule], labels: Sequence[str] = LABELS) -> DataFrame:
    """Each rule with its number of matches and the rows to take, held between 1 and the matches.

    Rules are compared with the counted label triples, not with the rows. Rules
    without a match stay, with a count of 0.
    """
    found = flow_counts(df, labels).select("count", F.inline(_matching_rules(rules, labels)))
    matches = found.groupBy("rule_id").agg(F.sum("count").alias("_matches"))
    count = F.coalesce("_matches", F.lit(0))
    take = F.least("asked", F.greatest(F.lit(1), count))
    return (
        _rule_table(df.sparkSession, rules)
        .join(matches, "rule_id", "left")
        .select("rule_id", "aspect", "sentiment", "tone", count.alias("count"), take.alias("take_n"))
        .orderBy("rule_id")
    )


def match_rules(
    df: DataFrame,
    rules: Sequence[Rule],
    labels: Sequence[str] = LABELS,
    row_id: str = "row_id",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The first ``take_n`` rows of every rule in row order, with ``rule_id`` and ``match_no``.

    An open rule matches the whole table. So the rows of each rule are first counted
    per slice of row ids; the slice in which it reaches ``take_n`` bounds the rows that
    are looked at again. These bounds are one row per rule, hence the broadcast. The
    counts also tell where the numbering of each slice starts, so no window ever holds
    more than one slice. Their exchange is reused: two reads of the table in all.
    """
    hits = _matching_rules(rules, labels)
    sliced = df.withColumn(SLICE, slice_of(row_id, slice_rows))
    per_slice = (
        sliced.groupBy(*labels, SLICE)
        .agg(F.count("*").alias("_n"))
        .select(SLICE, "_n", F.inline(hits))
        .groupBy("rule_id", "take_n", SLICE)
        .agg(F.sum("_n").alias("_rows"))
    )
    starts = (
        earlier_rows(per_slice, ["rule_id"], "_rows", "_before")
        .filter("_before < take_n")
        .select("rule_id", SLICE, "_before")
    )
    last = F.broadcast(starts.groupBy("rule_id").agg(F.max(SLICE).alias("_last")))
    matched = sliced.select("*", F.inline(hits)).join(last, "rule_id").filter(F.col(SLICE) <= F.col("_last"))
    inside = Window.partitionBy("rule_id", SLICE).orderBy(row_id)
    numbered = (
        matched.withColumn("_inside", F.row_number().over(inside))
        .join(starts, ["rule_id", SLICE])
        .withColumn("match_no", F.col("_before") + F.col("_inside"))
    )
    return numbered.filter("match_no <= take_n").select("rule_id", "match_no", *df.columns)
