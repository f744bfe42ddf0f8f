"""Per-document label profiles and statistics over documents."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

from labelscope.sources.ontologies import SENTIMENTS, TONES, Ontology


def profile_columns(sentiments: Ontology = SENTIMENTS, tones: Ontology = TONES) -> list[str]:
    return [f"sent_{c}" for c in sentiments.order] + [f"tone_{c}" for c in tones.order]


def document_profile(
    df: DataFrame,
    key: str = "filename",
    sentiment: str = "sentiment_norm",
    tone: str = "tone_norm",
    sentiments: Ontology = SENTIMENTS,
    tones: Ontology = TONES,
) -> DataFrame:
    """Rows per document and code, one column per sentiment and tone.

    Both halves count the same documents, so one conditional aggregate takes the
    place of two pivots and an outer join; its map side leaves one row per document.
    """
    counts = [F.count_if(F.col(sentiment) == c).alias(f"sent_{c}") for c in sentiments.order]
    counts += [F.count_if(F.col(tone) == c).alias(f"tone_{c}") for c in tones.order]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*counts)


def composition(profile: DataFrame, prefix: str, name: str) -> DataFrame:
    """Column totals of a profile as rows: ``prefix`` is ``sent_`` or ``tone_``."""
    columns = [c for c in profile.columns if c.startswith(prefix)]
    totals = profile.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c[len(prefix):]) for c in columns])
    return totals.unpivot([], [c[len(prefix):] for c in columns], name, "count")


def profile_stats(profile: DataFrame, columns: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Mean and sample standard deviation of each profile column over the documents."""
    columns = columns or profile_columns()
    stats = profile.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.round(f"{c}_mean", digits).alias("mean"),
                F.round(f"{c}_std", digits).alias("std"),
            )
            for c in columns
        ]
    )
    return stats.select(F.inline(rows))


def profile_correlation(profile: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of profile columns; NULL where a column is constant.

    One aggregate of centred sums over the documents; the pairs are columns of a
    single row that are unfolded afterwards.
    """
    columns = columns or profile_columns()
    sums = [f"stddev_samp(`{c}`) AS s_{i}" for i, c in enumerate(columns)]
    cells = []
    for (i, a), (j, b) in product(enumerate(columns), repeat=2):
        if i <= j:
            sums.append(f"covar_samp(`{a}`, `{b}`) AS c_{i}_{j}")
        shared = f"c_{min(i, j)}_{max(i, j)}"
        cells.append(f"struct('{a}' AS first, '{b}' AS second, try_divide({shared}, s_{i} * s_{j}) AS corr)")
    return profile.agg(*map(F.expr, sums)).selectExpr(f"inline(array({', '.join(cells)}))")
