"""Counts, shares and cross-tabs of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelscope.defaults import NOT_IN_ONTOLOGY
from labelscope.sources.local import local_table
from labelscope.sources.ontologies import Ontology


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), column)


def top_values(
    df: DataFrame, column: str, n: int = 10, fill: str | None = None, weight: str | None = None
) -> DataFrame:
    """The ``n`` most frequent values with their rank.

    ``fill`` stands in for NULL; ``weight`` names a column that already holds counts.
    """
    if fill is not None:
        df = df.withColumn(column, F.coalesce(F.col(column), F.lit(fill)))
    total = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(total.alias("count"))
    order = (F.desc("count"), F.asc(column))
    # The limit comes first (a top-k per partition), so the rank only ever sees n rows.
    return counts.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def label_distribution(df: DataFrame, column: str, ontology: Ontology) -> DataFrame:
    """Count of every code of the ontology in its fixed order, 0 where there is none."""
    order = local_table(
        df.sparkSession,
        [(code, i, label) for i, (code, label) in enumerate(ontology.labels.items())],
        f"{column} string, ord int, label string",
    )
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return (
        order.join(counts, column, "left")
        .select(column, F.coalesce("count", F.lit(0)).alias("count"), "label", "ord")
        .orderBy("ord")
    )


def label_summary(df: DataFrame, column: str, name: str, ontology: Ontology) -> DataFrame:
    """The export form of a dense distribution: ``(<name>, count, label)`` in ontology order."""
    return label_distribution(df, column, ontology).select(F.col(column).alias(name), "count", "label")


def crosstab_long(
    df: DataFrame, first: tuple[str, str, Ontology], second: tuple[str, str, Ontology]
) -> DataFrame:
    """Rows per pair of codes with both labels; each side is (code column, label column, ontology)."""
    (a, a_label, a_onto), (b, b_label, b_onto) = first, second
    return (
        df.groupBy(a, b)
        .agg(F.count("*").alias("count"))
        .withColumn(a_label, a_onto.label_of(F.col(a)))
        .withColumn(b_label, b_onto.label_of(F.col(b)))
    )


def crosstab_wide(
    df: DataFrame, index: str, index_ontology: Ontology, columns: str, ontology: Ontology, values: str = "sentence"
) -> DataFrame:
    """Non-null ``values`` per code and label, one column per label.

    All codes of the index are rows in ontology order; a code without any value is
    a row of NULLs, a missing pair inside a present row is 0.
    """
    codes_of: dict[str, list[str]] = {}
    for code, name in ontology.labels.items():
        codes_of.setdefault(name, []).append(code)
    filled = df.filter(F.col(values).isNotNull())
    counts = filled.groupBy(index).agg(
        *[F.count_if(F.col(columns).isin(*codes)).alias(name) for name, codes in codes_of.items()]
    )
    codes = [(code, i) for i, code in enumerate(index_ontology.order)]
    order = local_table(df.sparkSession, codes, f"{index} string, ord int")
    return order.join(counts, index, "left").orderBy("ord")


def category_table(df: DataFrame, column: str, ontology: Ontology | None = None) -> DataFrame:
    """Count, percentage of all rows (two decimals) and label of every category.

    The total is an aggregate of its own, one row that is joined back.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    share = F.round(F.col("count") / F.col("_total") * 100, 2)
    shares = counts.crossJoin(F.broadcast(total)).select(column, "count", share.alias("percentage"))
    label: Column = (
        F.lit(NOT_IN_ONTOLOGY)
        if ontology is None
        else ontology.label_of(F.col(column), F.lit(NOT_IN_ONTOLOGY))
    )
    return shares.withColumn("label", label)


def token_counts(df: DataFrame, column: str = "sentence", columns: Sequence[str] = ()) -> DataFrame:
    """Word frequencies of a text column, per group if ``columns`` are given.

    Words are runs of letters, marks, digits and connectors of any alphabet.
    """
    words = F.explode(F.split(F.lower(F.col(column)), r"(?U)\W+")).alias("token")
    tokens = df.select(*columns, words).filter("token <> ''")
    return tokens.groupBy(*columns, "token").agg(F.count("*").alias("count"))
