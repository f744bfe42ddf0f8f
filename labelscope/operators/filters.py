"""Row filters. All are plain predicates, so Catalyst pushes them into the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelscope.defaults import OTHER

ALL = "(All)"

# Stands for "every value is selected": rows with NULL drop out, as they match no value.
ANY_VALUE = object()

# The columns that can be filtered by value lists.
FILTER_COLUMNS = [
    "aspect_category", "sentiment", "tone", "materiality", "stakeholder",
    "value_chain_stage", "time_horizon",
]


def _is_in(df: DataFrame, column: str, values: Sequence) -> Column:
    """Membership with the values cast to the type of the column, not the other way round."""
    kind = df.schema[column].dataType
    return F.col(column).isin(*[F.lit(v).try_cast(kind) for v in values])


def apply_filters(
    df: DataFrame,
    selections: dict[str, Sequence | object],
    confidence: tuple[float, float] | None = None,
) -> DataFrame:
    """Value lists per column and an inclusive confidence range.

    An empty list or an unknown column switches that filter off.
    """
    for column, values in selections.items():
        if column not in df.columns:
            continue
        if values is ANY_VALUE:
            df = df.filter(F.col(column).isNotNull())
        elif values:
            df = df.filter(_is_in(df, column, values))
    if confidence is not None and "confidence" in df.columns:
        df = df.filter(F.col("confidence").between(*confidence))
    return df


def drill_down(df: DataFrame, **equal) -> DataFrame:
    """Rows with exactly these values, e.g. ``filename=..., page_number=...``."""
    for column, value in equal.items():
        df = df.filter(F.col(column) == F.lit(value).try_cast(df.schema[column].dataType))
    return df


def waterfall_filter(df: DataFrame, **choices: str) -> DataFrame:
    """Like ``drill_down``; ``(All)`` leaves a column open."""
    return drill_down(df, **{c: v for c, v in choices.items() if v != ALL})


def filter_tone_table(
    df: DataFrame,
    aspects: Sequence[str],
    sentiments: Sequence[str],
    tones: Sequence[str],
) -> DataFrame:
    """Rows of the rarest-tone table whose three labels are all selected; an empty list selects nothing."""
    chosen = {"aspect_category": aspects, "sentiment": sentiments, "minimum_tone": tones}
    tests = [F.col(c).isin(*v) if v else F.lit(False) for c, v in chosen.items()]
    return df.filter(reduce(Column.__and__, tests))


def flag_categories(
    df: DataFrame, column: str, fallback: Sequence[str] = (OTHER,), below: float = 1.0
) -> DataFrame:
    """Fallback codes and categories under ``below`` percent of a category table."""
    return df.filter(F.col(column).isin(*fallback) | (F.col("percentage") < below))


def filter_options(df: DataFrame, columns: Sequence[str] = FILTER_COLUMNS) -> DataFrame:
    """Distinct non-null values of the columns as rows ``(column, value)``, in order."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
            if c in df.columns
        ]
    )
    return (
        df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct().orderBy("column", "value")
    )


def confidence_bounds(df: DataFrame, column: str = "confidence") -> DataFrame:
    return df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))
