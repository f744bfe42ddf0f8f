"""Aspects -> keyword clusters.

Counting operators count distinct aspects first and match keywords once per
distinct aspect. The row-level form matches inside the projection: that costs CPU
per row, but no shuffle on a skewed text column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelscope.defaults import CLUSTERS, UNCLUSTERED
from labelscope.functions.text import keyword_cluster
from labelscope.operators.distributions import top_values

# Cluster names that ask for a review of the taxonomy.
REVIEW_LABELS = (UNCLUSTERED, "Undefined")


def cluster_aspects(
    df: DataFrame,
    column: str = "aspect",
    clusters: dict[str, list[str]] = CLUSTERS,
    name: str = "aspect_cluster",
    casefold_keywords: bool = False,
) -> DataFrame:
    """Adds the cluster of each row; all ``Unclustered`` if the table has no such column.

    The aspect is lower-cased in a projection of its own, once for all clusters.
    """
    if column not in df.columns:
        return df.withColumn(name, F.lit(UNCLUSTERED))
    lowered = df.withColumn("_lowered", F.lower(F.col(column)))
    return lowered.withColumn(name, keyword_cluster(F.col("_lowered"), clusters, casefold_keywords)).drop("_lowered")


def _clustered_counts(df: DataFrame, column: str, clusters: dict[str, list[str]]) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    return cluster_aspects(counts, column, clusters)


def top_clusters(
    df: DataFrame, n: int = 10, column: str = "aspect", clusters: dict[str, list[str]] = CLUSTERS
) -> DataFrame:
    """The ``n`` largest clusters with their rank."""
    return top_values(_clustered_counts(df, column, clusters), "aspect_cluster", n, weight="count")


def aspect_cluster_mapping(
    df: DataFrame,
    column: str = "aspect",
    clusters: dict[str, list[str]] = CLUSTERS,
    distinct: bool = False,
) -> DataFrame:
    """Each aspect beside its cluster, with its frequency, most frequent first.

    ``distinct`` gives the bare pairs in alphabetical order.
    """
    pairs = _clustered_counts(df.filter(F.col(column).isNotNull()), column, clusters)
    if distinct:
        return pairs.drop("count").orderBy("aspect_cluster", column)
    return pairs.orderBy(F.desc("count"), column)


def unclustered_report(
    df: DataFrame, column: str = "aspect", clusters: dict[str, list[str]] = CLUSTERS
) -> DataFrame:
    """Aspects without a cluster by falling frequency, each with its ``aspect (count)`` line.

    The review text is these lines in this order; ``write_lines`` stores it without
    ever holding it in one place.
    """
    counts = _clustered_counts(df.filter(F.col(column).isNotNull()), column, clusters)
    open_ones = counts.filter(F.col("aspect_cluster").isin(*REVIEW_LABELS))
    line = F.format_string("%s (%d)", column, "count")
    return open_ones.select(column, "count", line.alias("line")).orderBy(F.desc("count"), column)


def cluster_coverage(
    df: DataFrame, column: str = "aspect", clusters: dict[str, list[str]] = CLUSTERS
) -> DataFrame:
    """Rows in total, with and without a cluster, and the clustered share in percent."""
    counts = _clustered_counts(df, column, clusters)
    is_open = F.col("aspect_cluster").isin(*REVIEW_LABELS)
    totals = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(is_open, F.col("count"))), F.lit(0)).alias("unclustered"),
    )
    clustered = F.col("total") - F.col("unclustered")
    share = F.try_divide(clustered * 100, F.col("total"))
    return totals.select(
        "total", clustered.alias("clustered"), "unclustered", F.coalesce(share, F.lit(0.0)).alias("coverage")
    )
