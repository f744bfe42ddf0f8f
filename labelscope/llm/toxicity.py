"""Toxicity categories by a classifier chain.

Categories are predicted one after another. Each one's model is a logistic regression on
the words of a text and on the probabilities of the categories before it; in
training these come from models that have not seen the row (out of fold). A model looks at every word whose share of rows differs between the
classes by more than chance explains; their number grows with the vocabulary, and weights are sparse.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from labelscope.llm.quality import sampled
from labelscope.llm.shared import held_out, small_batches
from labelscope.llm.text import ALPHANUMERIC, chunks, words_of

#: Bound of the training sample: so many labelled rows at most (in expectation).
MOST_TRAINED = 20_000
#: Hash space of words, chi-squared value (one degree, a chance of 0.01) from which a model looks at a word, folds.
SPACE, TELLING, FOLDS = 1 << 22, 6.635, 4
#: Toxic rows that a language needs to have a link of its own; texts of others are left to the last link.
LEAST_ROWS = 2 * FOLDS


def word_ids(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row, hashed word) of the distinct words of each text, chunk by chunk."""
    for row, end, data, offsets in chunks(texts):
        words = words_of(data, offsets, ALPHANUMERIC)
        value = (words.hashes() & np.uint64(SPACE - 1)).astype(np.int64)
        pairs = np.unique(words.doc() * SPACE + value)
        yield end - row, pairs // SPACE, pairs % SPACE


@dataclass
class Link:
    """One category's model: words it looks at, weights of words and earlier categories, bias."""

    words: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def probability(self, rows: int, row: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        known = len(self.words)
        value = before @ self.weights[known:] + self.bias
        if known:
            row, at = seen_words(row, word, self.words)
            value = value + np.bincount(row, weights=self.weights[at], minlength=rows)
        return _sigmoid(value)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(row: np.ndarray, at: np.ndarray, width: int, y: np.ndarray, least: float = TELLING) -> np.ndarray:
    """Which of the words, places below ``width``, are in a share of rows that differs between the classes, by a chi-squared score."""
    positive = np.bincount(at, weights=y[row], minlength=width)
    total = np.bincount(at, minlength=width)
    share = y.mean() if len(y) else 0.0
    expected = total * share
    return (positive - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9) >= least


def seen_words(row: np.ndarray, word: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``words``) of the words that are among them."""
    if not len(words):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    hit = words[at] == word
    return row[hit], at[hit]


def fit_logistic(
    rows: int, row: np.ndarray, at: np.ndarray, width: int, before: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 8, turns: int = 12
) -> tuple[np.ndarray, float]:
    """Weights of words and of earlier categories, and bias, by Newton steps solved by conjugate gradients; the bias is not penalised.

    ``row, at`` are the words of rows as places below ``width``.
    """
    dense = np.concatenate([before, np.ones((rows, 1))], axis=1)
    theta = np.zeros(width + dense.shape[1])
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    theta[-1] = np.log(share / (1 - share))
    ridge = np.full(len(theta), penalty)
    ridge[-1] = 1e-6

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v[at], minlength=rows) + dense @ v[width:]

    def back(u: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(at, weights=u[row], minlength=width), dense.T @ u]

    for _ in range(rounds):
        p = _sigmoid(forward(theta))
        gradient = back(p - y) + ridge * theta
        weight = np.maximum(p * (1 - p), 1e-6)
        scale = np.r_[np.bincount(at, weights=weight[row], minlength=width), (dense**2 * weight[:, None]).sum(axis=0)] + ridge
        step, rest = np.zeros_like(theta), gradient.copy()
        ahead = rest / scale
        way, size = ahead.copy(), rest @ ahead
        for _ in range(turns):
            if size < 1e-10:
                break
            bent = back(weight * forward(way)) + ridge * way
            length = size / (way @ bent)
            step += length * way
            rest -= length * bent
            ahead = rest / scale
            size, last = rest @ ahead, size
            way = ahead + size / last * way
        theta -= step
        if np.abs(step).max() < 1e-3:
            break
    return theta[:-1], float(theta[-1])


def fit_chain(rows: int, row: np.ndarray, word: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple[list[Link], np.ndarray]:
    """(links, out-of-fold probabilities) for the columns of ``labels`` in turn."""
    before = np.zeros((rows, 0))
    links = []
    known, at_word = np.unique(word, return_inverse=True)
    for category in range(labels.shape[1]):
        y = labels[:, category].astype(np.float64)

        def fit(inside: np.ndarray, y=y, before=before) -> Link:
            at, used = np.flatnonzero(inside), inside[row]
            its, words = (np.cumsum(inside) - 1)[row[used]], at_word[used]
            told = telling(its, words, len(known), y[at])
            kept = told[words]
            place = (np.cumsum(told) - 1)[words[kept]]
            return Link(known[told], *fit_logistic(len(at), its[kept], place, int(told.sum()), before[at], y[at]))

        own = np.zeros(rows)
        for fold in range(FOLDS):
            outside = folds == fold
            if outside.any() and (~outside).any():
                used = outside[row]
                own[outside] = fit(~outside).probability(
                    int(outside.sum()), (np.cumsum(outside) - 1)[row[used]], word[used], before[outside]
                )
        links.append(fit(np.ones(rows, dtype=bool)))
        before = np.concatenate([before, own[:, None]], axis=1)
    return links, before


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which predicting 1 has the best F1."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    at = int(np.argmax(f1))
    low = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float((p[order[at]] + low) / 2)


@dataclass
class Chain:
    groups: list[str]
    links: list[Link]
    threshold: float

    def scores(self, rows: int, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        before = np.zeros((rows, 0))
        for link in self.links:
            before = np.concatenate([before, link.probability(rows, row, word, before)[:, None]], axis=1)
        return before


def train_toxicity(docs: DataFrame, labels: DataFrame, groups: Sequence[str] | None = None, most: int = MOST_TRAINED) -> Chain:
    """Fitted to at most ``most`` labelled rows that are not held out.

    The categories are ``toxic`` texts of each of ``groups``, by default the languages of at least ``LEAST_ROWS`` toxic rows in order, then
    toxic ones of any. Of a document labelled more than once the highest label counts; null labels count as none.
    """
    small_batches(docs.sparkSession)
    known = sampled(
        labels.select(F.col("doc_id").cast("long"), "toxic").dropna().filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")), F.col("doc_id"), most,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, row, word in word_ids(batch.column("text")):
                bounds = np.searchsorted(row, np.arange(rows + 1))
                values = [word[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), part.column("toxic"), pa.array(values, pa.binary())],
                    ["doc_id", "lang", "toxic", "words"],
                )
                at += rows

    texts = docs.select(F.col("doc_id").cast("long"), "lang", "text").join(F.broadcast(known), "doc_id")
    seen = texts.select("doc_id", "lang", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(
        run, "doc_id long, lang string, toxic int, words binary"
    ).toPandas().sort_values(["doc_id", "words"]).reset_index(drop=True)
    if not len(seen):
        groups = list(groups or [])
        return Chain(groups, [Link(np.zeros(0, dtype=np.int64), np.zeros(i), 0.0) for i in range(len(groups) + 1)], 1.0)
    found = [np.frombuffer(x, np.int32) for x in seen["words"]]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    word = np.concatenate(found).astype(np.int64)
    toxic = (seen["toxic"] == 1).to_numpy()
    if groups is None:
        counts = seen["lang"][toxic].value_counts()
        groups = sorted(counts.index[counts >= LEAST_ROWS])
    columns = [toxic & (seen["lang"] == group).to_numpy() for group in groups] + [toxic]
    folds = np.random.default_rng(3).permutation(len(seen)) % FOLDS
    links, out_of_fold = fit_chain(len(seen), row, word, np.stack(columns, axis=1), folds)
    return Chain(list(groups), links, best_threshold(out_of_fold[:, -1], toxic))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, groups: Sequence[str] | None = None, most: int = MOST_TRAINED
) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``, and ``lang`` for training): probabilities of the chain.

    ``p_<group>`` for each group (see ``train_toxicity``), then ``score`` and ``predicted`` for toxic texts of any. Scores read
    the text only; null and empty texts have no words. Without labels every probability is a half and nothing is
    predicted. Rows without an id are scored and not held out. Repeated rows are scored alike; other columns are not read.
    Very long texts are read whole, at some tens of bytes of memory for each of their own.
    """
    chain = train_toxicity(docs, labels, groups, most)
    names = [f"p_{group}" for group in chain.groups] + ["score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows, row, word in word_ids(batch.column("text")):
                scores = chain.scores(rows, row, word)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, rows), *(pa.array(x) for x in scores.T), pa.array((scores[:, -1] >= chain.threshold).astype(np.int32))],
                    ["doc_id", *names, "predicted"],
                )
                at += rows

    fields = [StructField("doc_id", LongType()), *(StructField(name, DoubleType()) for name in names), StructField("predicted", IntegerType())]
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, StructType(fields))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *(F.col(f"`{name}`") for name in names), "predicted")
