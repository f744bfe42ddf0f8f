"""Batch scoring of texts by models the caller supplies.

The only operators that need Python workers: texts go over in Arrow batches, one
column wide, and only raw scores come back. Decoding is native.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelscope.defaults import SENTIMENT_CLASSES, TONE_CLASSES
from labelscope.functions.scores import best_class, softmax
from labelscope.functions.text import present

# texts -> (sentiment logits per text, tone logits per text)
TwoHeadScorer = Callable[[list[str]], tuple[list[list[float]], list[list[float]]]]
# texts -> one list of (label, score) per text
Classifier = Callable[[list[str]], list[list[tuple[str, float]]]]

#: Scorers that a Python worker, which serves many tasks, keeps loaded; characters of text in a call of one.
MOST_LOADED, CALL_CHARS = 4, 1 << 20

# Loaded scorers of this Python worker by plan and model id, the least recently used first.
_LOADED: OrderedDict[tuple[str, str], Any] = OrderedDict()


def _once(plan: str, model_id: str, load: Callable[[], Any], most: int = MOST_LOADED) -> Any:
    """What ``load`` gives, called once per worker as long as it stays among the ``most`` used last; a failure is kept too, as its text.

    Scorers of another plan go first: a plan that has ended never asks again, one that goes on loads again.
    """
    key = (plan, model_id)
    if key not in _LOADED:
        while _LOADED and len(_LOADED) >= most:
            others = [k for k in _LOADED if k[0] != plan]
            del _LOADED[others[0] if others else next(iter(_LOADED))]
        try:
            _LOADED[key] = load()
        except Exception as error:
            _LOADED[key] = str(error)
    _LOADED.move_to_end(key)
    return _LOADED[key]


def _calls(texts: list[str], chars: int = CALL_CHARS) -> Iterator[list[str]]:
    """The texts in turn, in runs of about so many characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


LOAD_ERROR = "LOAD_ERROR"
INFER_ERROR = "INFER_ERROR"


def decode_scores(logits: Column, classes: Sequence[str]) -> tuple[Column, Column]:
    """Probabilities and the name of the most probable class."""
    scores = softmax(logits)
    return scores, best_class(scores, list(classes))


def score_texts(
    df: DataFrame,
    load: Callable[[], TwoHeadScorer],
    text: str = "text",
    sentiment_classes: Sequence[str] = SENTIMENT_CLASSES,
    tone_classes: Sequence[str] = TONE_CLASSES,
) -> DataFrame:
    """Adds ``sentiment``, ``tone``, ``sentiment_scores`` and ``tone_scores``.

    ``load`` is called once per Python worker and returns the scorer, which gets texts in runs of bounded length.
    """
    plan = uuid.uuid4().hex

    @F.pandas_udf("sentiment array<double>, tone array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = _once(plan, "", load)
        if isinstance(score, str):
            raise RuntimeError(score)
        for batch in batches:
            sentiment, tone = [], []
            for texts in _calls(batch.fillna("").tolist()):
                for heads, found in zip((sentiment, tone), score(texts)):
                    heads.extend(found)
            yield pd.DataFrame({"sentiment": sentiment, "tone": tone})

    scored = df.withColumn("_logits", logits(F.col(text)))
    for head, classes in (("sentiment", sentiment_classes), ("tone", tone_classes)):
        scores, _ = decode_scores(F.col(f"_logits.{head}"), classes)
        scored = scored.withColumn(f"{head}_scores", scores)
        scored = scored.withColumn(head, best_class(F.col(f"{head}_scores"), list(classes)))
    return scored.drop("_logits")


def _classify(classifier: Classifier, texts: list[str]) -> list[tuple[list, str | None]]:
    """Result or error of each text; a failed batch is halved until the texts that fail stand alone.

    With ``b`` bad texts among ``n`` that makes some ``2 b log n`` calls in place of ``n``.
    """
    try:
        found = classifier(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [(labels, None) for labels in found]
    except Exception as error:
        if len(texts) == 1:
            return [([], str(error))]
        half = len(texts) // 2
        return _classify(classifier, texts[:half]) + _classify(classifier, texts[half:])


def score_models(
    df: DataFrame,
    models: Sequence[tuple[str, str]],
    load: Callable[[str], Classifier],
    text: str = "text",
) -> DataFrame:
    """All labels and scores every model gives to every text.

    ``models`` are (name, id) pairs, ``load`` turns an id into a classifier, once per
    Python worker. The output has the input columns and ``model_name, model_id, label, score,
    error``. A model that cannot be loaded, or a text it fails on, gives an error row
    and never a failed task. Each text travels to Python once, whatever the number
    of models. A worker keeps the models of its plan loaded, and few of other plans.
    """
    plan = uuid.uuid4().hex

    @F.pandas_udf(
        "array<struct<model_name string, model_id string, label string, score double, error string>>"
    )
    def results(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows: list[list[tuple]] = [[] for _ in texts]
            for name, model_id in models:
                classifier = _once(plan, model_id, lambda: load(model_id), max(len(models), MOST_LOADED))
                if isinstance(classifier, str):
                    for row in rows:
                        row.append((name, model_id, LOAD_ERROR, None, classifier))
                    continue
                outcomes = (result for run in _calls(texts) for result in _classify(classifier, run))
                for row, (found, error) in zip(rows, outcomes):
                    if error is not None:
                        row.append((name, model_id, INFER_ERROR, None, error))
                    row.extend((name, model_id, label, float(score), None) for label, score in found)
            fields = ("model_name", "model_id", "label", "score", "error")
            yield pd.Series([[dict(zip(fields, r)) for r in row] for row in rows])

    return df.withColumn("_results", results(F.col(text))).select(*df.columns, F.inline("_results"))


def top_prediction_per_model(
    df: DataFrame, keys: Sequence[str] = ("model_id",), score: str = "score"
) -> DataFrame:
    """The best scored row per key; on a tie the first label by name.

    An aggregate with map-side combining, not a window: a model may own any number of rows.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col("label").alias("l")))
    found = df.filter(present(score)).groupBy(*keys).agg(best.alias("_best"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])
