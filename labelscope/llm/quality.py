"""Quality of texts by positive-unlabelled learning.

A linear model on bytes, words and lines of a text is fitted to trusted positives and
unlabelled texts by the non-negative unbiased risk ``prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives))``. The labels say which positives are trusted and, by their share, the class prior; labels of
low quality enter only the two numbers that turn the fitted value into a probability. Mean and scale of the features and the risk of the unlabelled
side cover all documents that are not held out: features are computed once, kept as a table, and every step of the fit
adds up risk, gradient and curvature over its rows, task by task. With the logistic loss this risk is
convex, so a few Newton steps find its minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelscope.llm.shared import held_out, mix, small_batches, written
from labelscope.llm.text import NOT_SPACE, chunks, words_of

#: Bound of the labelled sample: so many trusted positives, and so many texts of low quality, at most (in expectation).
MOST_TRAINED = 20_000
#: Tasks that add up what the tasks of a pass have found; steps of a fit; weight of the squared weights.
ADDERS, STEPS, DECAY = 16, 10, 0.02
#: Score from which a text passes.
THRESHOLD = 0.3

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_LETTER[128:] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, dtype=np.int64)
_SIGN[33:127] = 1
_SIGN = _SIGN * (1 - _LETTER) * (1 - _DIGIT)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many different values each owner has."""
    named = values ^ mix(owner.astype(np.uint64) + np.uint64(1))
    return np.bincount(owner[np.unique(named, return_index=True)[1]], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text: shares of bytes, shapes of words, lines and repeats; zeros for an empty one."""
    found = [_chunk_features(data, offsets) for _, _, data, offsets in chunks(texts)]
    return np.concatenate(found) if found else np.zeros((0, WIDTH), dtype=np.float32)


def _chunk_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    ascii_bytes = np.minimum(data, 128).astype(np.int64)
    counts = np.bincount(doc * 129 + ascii_bytes, minlength=n * 129).reshape(n, 129)
    shares = np.sqrt(_ratio(counts, size[:, None]))

    words = words_of(data, offsets, NOT_SPACE)
    total, owner = words.counts(), words.doc()
    length = words.end - words.start

    def in_words(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        return sums[words.end] - sums[words.start]

    def per_doc(values: np.ndarray) -> np.ndarray:
        return _ratio(np.bincount(owner, weights=values, minlength=n), total)

    upper, letters, digits, signs = (in_words(kind) for kind in (_UPPER, _LETTER, _DIGIT, _SIGN))
    mean = per_doc(length)
    hashes = words.hashes()
    inside = owner[1:] == owner[:-1]  # no pair reaches into the next text
    pairs = (hashes[:-1] ^ mix(hashes[1:]))[inside] if len(hashes) > 1 else hashes[:0]
    pair_owner = owner[:-1][inside]
    is_line = np.ones(256, dtype=bool)
    is_line[10] = False
    lines = words_of(data, offsets, is_line)
    line_owner, line_total = lines.doc(), lines.counts()
    line_length = lines.end - lines.start
    columns = [
        np.log1p(size), np.log1p(total), mean, np.sqrt(np.maximum(per_doc(length**2) - mean**2, 0)),
        per_doc((upper >= 2) & (upper == letters)), per_doc(letters == 0), per_doc(signs >= 2), per_doc(digits > 0),
        per_doc(_ratio(signs, length)), per_doc((upper > 0) & (upper < letters)), per_doc(length >= 15), per_doc(length == 1),
        _ratio(_distinct(hashes, owner, n), total), _ratio(_distinct(pairs, pair_owner, n), total),
        np.log1p(line_total), _ratio(np.bincount(line_owner, weights=line_length, minlength=n), line_total) ** 0.5,
        _ratio(_distinct(lines.hashes(), line_owner, n), line_total),
        _ratio(np.bincount(line_owner, weights=data[lines.end - 1] == ord("."), minlength=n), line_total),
    ]
    return np.concatenate([shares, np.stack(columns, axis=1)], axis=1).astype(np.float32)


WIDTH = 129 + 18


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def value(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.value(x), -30, 30)))


#: ``sums(f)`` adds up the vectors that ``f`` gives for matrices of features, over all rows.
Sums = Callable[[Callable[[np.ndarray], np.ndarray]], np.ndarray]


def table_sums(rows: DataFrame) -> Sums:
    """Sums over a table with the features of a row as ``x``; the driver gets ``ADDERS`` vectors a pass."""

    def sums(f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch):
                    own = f(matrix(batch.column("x")))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for value in batch.column("total"):
                    own = np.frombuffer(value.as_buffer(), np.float64)
                    total = own.copy() if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        own = rows.select("x").mapInArrow(added, "total binary").withColumn("task", F.spark_partition_id())
        # in order of the tasks, so that reruns add in one order
        dealt = own.repartition(ADDERS, "task").sortWithinPartitions("task").select("total").mapInArrow(added_up, "total binary")
        found = sorted(bytes(r.total) for r in dealt.collect())
        return np.sum([np.frombuffer(x, np.float64) for x in found], axis=0) if found else np.zeros(0)

    return sums


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.float32).reshape(len(column), -1).astype(np.float64)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and a last column of ones."""
    return np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_non_negative(positive: np.ndarray, sums: Sums, prior: float, steps: int = STEPS, decay: float = DECAY) -> Model:
    """A linear model of least non-negative unbiased risk with logistic loss, by Newton steps.

    ``sums`` covers the unlabelled rows. A step is halved until it neither raises the risk nor takes the estimated risk on
    negatives below zero, where a loss cannot be; at that edge the fit ends.
    """
    width = positive.shape[1]
    counted = sums(lambda x: np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)])
    theta = np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    if not len(positive) or not len(counted):
        return Model(np.zeros(width), np.ones(width), theta[:-1], float(theta[-1]))
    n = counted[0]
    mean = counted[1 : width + 1] / n
    scale = np.sqrt(np.maximum(counted[width + 1 :] / n - mean**2, 0)) + 1e-3
    trusted = _scaled(positive.astype(np.float64), mean, scale)
    pull = prior * trusted.mean(axis=0)
    ridge = np.r_[np.full(width, decay), 1e-9]
    held, change = None, np.zeros_like(theta)  # the last accepted (risk, theta), and the step from there
    for _ in range(steps):

        def risk_of(x: np.ndarray, theta: np.ndarray = theta) -> np.ndarray:
            x = _scaled(x, mean, scale)
            z = x @ theta
            p = _sigmoid(z)
            return np.concatenate([[np.logaddexp(0, z).sum()], x.T @ p, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        found = sums(risk_of) / n
        risk = found[0] - pull @ theta + ridge @ theta**2 / 2
        negative = found[0] - prior * np.logaddexp(0, trusted @ theta).mean()
        if held is not None and (negative < 0 or risk > held[0]):
            change = change / 2
            if np.abs(change).max() < 1e-2:
                break
            theta = held[1] + change
            continue
        gradient = found[1 : width + 2] - pull + ridge * theta
        step = np.linalg.solve(found[width + 2 :].reshape(width + 1, -1) + np.diag(ridge + 1e-9), gradient)
        held, change = (risk, theta), -step
        if gradient @ step < 1e-6:
            break
        theta = theta - step
    theta = held[1]
    return Model(mean, scale, theta[:-1], float(theta[-1]))


def calibrated(model: Model, positive: np.ndarray, negative: np.ndarray, prior: float) -> Model:
    """The model with slope and shift of its value fitted to labelled rows, weighted to the class prior."""
    if not len(positive) or not len(negative):
        return model
    z = np.concatenate([model.value(positive), model.value(negative)])
    y = np.r_[np.ones(len(positive)), np.zeros(len(negative))]
    weight = np.r_[np.full(len(positive), prior / len(positive)), np.full(len(negative), (1 - prior) / len(negative))]
    x = np.stack([z, np.ones(len(z))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-4 * (theta - [1, 0])
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        theta -= step / max(1.0, np.abs(step).max())
    return Model(model.mean, model.scale, model.weights * theta[0], model.bias * theta[0] + theta[1])


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows whose hashed key is small enough for ``most`` of them to be expected; all, if there are fewer."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 32)) < int((1 << 32) * most / total))


def features_table(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of each row of ``docs``: the features of its text as bytes of floats, in a table of the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "x"]
            )

    small_batches(docs.sparkSession)
    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x binary"), "features")


def _rows_of(table: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of a bounded set of ids, in an order of their own so that reruns agree."""
    rows = table.join(F.broadcast(ids), "doc_id", "left_semi").toPandas().sort_values(["doc_id", "x"])
    return np.stack([np.frombuffer(x, np.float32) for x in rows["x"]]) if len(rows) else np.zeros((0, WIDTH), np.float32)


def train_quality(table: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> Model:
    """Fitted to at most ``most`` trusted positives and to all rows of ``table`` (see ``features_table``) that are not held out, and
    calibrated with at most ``most`` texts of low quality among these.

    Of a document labelled more than once the lowest label counts; null labels count as none.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), "quality").dropna().filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    share = known.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = 0.5 if share is None else min(max(share, 0.02), 0.98)
    positive = sampled(known.filter("quality = 1").select("doc_id"), F.col("doc_id"), most)
    negative = sampled(known.filter("quality <> 1").select("doc_id"), F.col("doc_id"), most)
    trusted = _rows_of(table, positive)
    unlabelled = table.filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    model = fit_non_negative(trusted, table_sums(unlabelled), prior)
    return calibrated(model, trusted, _rows_of(table, negative), prior)


def score_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id``, ``text``); ``labels`` has doc_id and quality.

    The score reads the text only; null and empty texts get the score of a text without bytes.
    Rows without an id are scored and not held out. Without positives every score is the prior. Repeated rows are
    scored alike; other columns are not read. Very long texts are read whole, at some hundred bytes of memory for each of their own.
    """
    table = features_table(docs)
    model = train_quality(table, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(matrix(batch.column("x"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that pass the classifier; null and empty texts go or stay by the score of a text without bytes."""
    model = train_quality(features_table(docs), labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
