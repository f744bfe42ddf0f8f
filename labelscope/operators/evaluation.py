"""Ground truth against predictions: alignment, errors and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelscope.defaults import INVALID_LABELS
from labelscope.functions.text import strip
from labelscope.operators.ranking import SLICE_ROWS, occurrence_number

TARGETS = ("aspect_category", "sentiment", "tone")


def find_missing(
    output: DataFrame, exported: DataFrame, keys: Sequence[str] = ("filename", "page_number")
) -> DataFrame:
    """Rows of ``output`` whose keys do not occur in ``exported``; NULL keys equal each other.

    Only the distinct keys of the right side take part, so a key that is frequent
    there costs nothing; a frequent key on the left is split by AQE.
    """
    known = exported.select(*[F.col(k).alias(f"_known_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]
    return output.join(known, same, "left_anti")


def align_by_sentence(
    truth: DataFrame,
    predicted: DataFrame,
    sentence: str = "sentence",
    row_id: str = "row_id",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Pairs the k-th occurrence of a sentence on both sides: min(count, count) rows per sentence.

    Columns on both sides get ``_gt`` and ``_pred``. Rows without a sentence are left out;
    ``row_id`` names a row. Occurrences are numbered and paired as (digest, row id) alone, a digest of
    128 bits standing for the sentence; each side's rows are then fetched once by their ids, and the
    sentences compared. A sentence that fills a third of the table is numbered in slices,
    and (digest, occurrence) is unique on both sides.
    """
    shared = [c for c in truth.columns if c in predicted.columns and c != sentence]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        keys = df.filter(F.col(sentence).isNotNull()).select(digest_of(sentence).alias("_digest"), F.col(row_id).alias(name))
        return occurrence_number(keys, ["_digest"], name, name="_occurrence", slice_rows=slice_rows)

    def rows(df: DataFrame, suffix: str, text: str) -> DataFrame:
        named = df.withColumn(f"_id{suffix}", F.col(row_id))
        return named.withColumnsRenamed({c: f"{c}{suffix}" for c in shared} | {sentence: text})

    pairs = numbered(truth, "_id_gt").join(numbered(predicted, "_id_pred"), ["_digest", "_occurrence"])
    left, right = rows(truth, "_gt", sentence), rows(predicted, "_pred", "_other")
    found = pairs.select("_id_gt", "_id_pred").join(left, "_id_gt").join(right, "_id_pred")
    return found.filter(F.col(sentence) == F.col("_other")).drop("_id_gt", "_id_pred", "_other")


def digest_of(column: str) -> Column:
    """128 bits that stand for a text in exchanges."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def alignment_coverage(truth: DataFrame, predicted: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Aligned rows and their share of either side in percent, from sentence counts alone."""
    gt = truth.groupBy(digest_of(sentence).alias("_digest")).agg(F.count("*").alias("n_gt"))
    pred = predicted.groupBy(digest_of(sentence).alias("_digest")).agg(F.count("*").alias("n_pred"))
    both = gt.join(pred, "_digest", "full")
    # least() would ignore a NULL, so sentences of one side only are left to the 0
    paired = F.when(F.col("n_gt").isNotNull() & F.col("n_pred").isNotNull(), F.least("n_gt", "n_pred"))
    totals = both.agg(
        F.coalesce(F.sum(paired), F.lit(0)).alias("aligned"),
        F.coalesce(F.sum("n_gt"), F.lit(0)).alias("gt_rows"),
        F.coalesce(F.sum("n_pred"), F.lit(0)).alias("pred_rows"),
    )
    return totals.select(
        "aligned",
        "gt_rows",
        "pred_rows",
        F.try_divide(F.col("aligned") * 100, F.col("gt_rows")).alias("coverage_gt"),
        F.try_divide(F.col("aligned") * 100, F.col("pred_rows")).alias("coverage_pred"),
    )


def differs(truth: Column, predicted: Column) -> Column:
    """Inequality in which a NULL on either side, or on both, is a difference."""
    return ~F.coalesce(truth == predicted, F.lit(False))


def error_rows(aligned: DataFrame, target: str, sentence: str = "sentence") -> DataFrame:
    gt, pred = F.col(f"{target}_gt"), F.col(f"{target}_pred")
    return aligned.filter(differs(gt, pred)).select(sentence, gt.alias("actual"), pred.alias("predicted"))


def confidence_errors(aligned: DataFrame, target: str) -> DataFrame:
    """Confidence of the prediction beside the error flag; both sides must have a confidence."""
    if "confidence_pred" not in aligned.columns:
        raise ValueError("confidence must be a column of both sides")
    flag = differs(F.col(f"{target}_gt"), F.col(f"{target}_pred"))
    return aligned.select("confidence_pred", flag.alias("is_error"))


def _clean(label: Column) -> tuple[Column, Column]:
    text = strip(label)
    valid = ~F.coalesce(F.lower(text).isin(INVALID_LABELS), F.lit(True))
    return text, valid


def clean_label_pairs(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Label pairs as trimmed text without those where either side is no label."""
    (t, t_ok), (p, p_ok) = _clean(F.col(truth)), _clean(F.col(predicted))
    return df.filter(t_ok & p_ok).select(t.alias("y_true"), p.alias("y_pred"))


def classification_metrics(
    aligned: DataFrame, targets: Sequence[str] = TARGETS, average: str = "weighted"
) -> DataFrame:
    """Accuracy, precision, recall, F1 and dropped rows of every target.

    One pass counts (target, truth, prediction) for all targets; the metrics come
    from these confusion counts. ``average`` is weighted, macro or micro, a zero
    denominator counts as 0.
    """
    pairs = []
    for target in targets:
        (t, t_ok), (p, p_ok) = _clean(F.col(f"{target}_gt")), _clean(F.col(f"{target}_pred"))
        valid = t_ok & p_ok
        pairs.append(
            F.struct(
                F.lit(target).alias("target"),
                F.when(valid, t).alias("y_true"),
                F.when(valid, p).alias("y_pred"),
            )
        )
    confusion = (
        aligned.select(F.inline(F.array(*pairs)))
        .groupBy("target", "y_true", "y_pred")
        .agg(F.count("*").alias("n"))
    )
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    valid, zero = F.col("y_true").isNotNull(), F.lit(0).cast("long")
    dropped = F.when(valid, zero).otherwise(F.col("n"))
    as_truth = F.struct(
        F.col("y_true").alias("label"), F.when(valid, F.col("n")).otherwise(0).alias("n_true"),
        zero.alias("n_pred"), hit.alias("tp"), dropped.alias("dropped"),
    )
    as_prediction = F.struct(
        F.col("y_pred").alias("label"), zero.alias("n_true"),
        F.when(valid, F.col("n")).otherwise(0).alias("n_pred"), zero.alias("tp"), zero.alias("dropped"),
    )
    per_label = (
        confusion.select("target", F.inline(F.array(as_truth, as_prediction)))
        .groupBy("target", "label")
        .agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp", "dropped")])
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    scores = per_label.withColumns(
        {
            "p": ratio(F.col("tp"), F.col("n_pred")),
            "r": ratio(F.col("tp"), F.col("n_true")),
            "f": ratio(F.col("tp") * 2, F.col("n_true") + F.col("n_pred")),
        }
    )
    rows, hits = F.sum("n_true"), F.sum("tp")
    accuracy = ratio(hits, rows)
    if average == "micro":
        precision = recall = f1 = accuracy
    elif average == "macro":
        precision, recall, f1 = (ratio(F.sum(F.when(F.col("label").isNotNull(), F.col(c))), F.count("label")) for c in "prf")
    elif average == "weighted":
        precision, recall, f1 = (ratio(F.sum(F.col(c) * F.col("n_true")), rows) for c in "prf")
    else:
        raise ValueError(f"unknown average: {average}")
    return scores.groupBy("target").agg(
        accuracy.alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.sum("dropped").alias("dropped_rows"),
    )
