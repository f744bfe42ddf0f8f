"""The three ways through the operators, end to end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from labelscope.operators.balance import balanced_sample, minimum_tone_distribution
from labelscope.operators.evaluation import (
    TARGETS,
    align_by_sentence,
    alignment_coverage,
    classification_metrics,
    error_rows,
)
from labelscope.operators.labels import normalize_labels
from labelscope.operators.parsing import parse_annotations, with_provider
from labelscope.sources.tables import validate_columns


def annotate(raw: DataFrame) -> DataFrame:
    """Raw answers -> sentence table with provider. No shuffle."""
    return with_provider(parse_annotations(validate_columns(raw, ["filename", "page_number", "model", "text"])))


def rarest_tones(flat: DataFrame) -> DataFrame:
    """Flat labels -> for each aspect and sentiment the tone to collect more of."""
    return minimum_tone_distribution(normalize_labels(validate_columns(flat, TARGETS)))


def balanced_dataset(flat: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Flat labels with row ids -> ``n`` rows for every rarest tone."""
    labelled = normalize_labels(validate_columns(flat, [*TARGETS, "row_id"]))
    return balanced_sample(labelled, minimum_tone_distribution(labelled), n, seed)


class Evaluation(NamedTuple):
    aligned: DataFrame
    coverage: DataFrame
    metrics: DataFrame
    errors: dict[str, DataFrame]


def evaluate(truth: DataFrame, predicted: DataFrame) -> Evaluation:
    """Alignment, coverage, metrics and error rows of predictions.

    ``aligned`` feeds all the others; persist it if more than one of them is read.
    """
    for df in (truth, predicted):
        validate_columns(df, ["sentence", *TARGETS])
    aligned = align_by_sentence(truth, predicted)
    return Evaluation(
        aligned=aligned,
        coverage=alignment_coverage(truth, predicted),
        metrics=classification_metrics(aligned),
        errors={t: error_rows(aligned, t) for t in TARGETS},
    )
