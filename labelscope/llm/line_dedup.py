"""Repeated passages by overlapping windows of lines.

Every run of three consecutive lines is hashed. A window found more than once keeps its first
occurrence, by document id and place; the lines that later ones cover, merged, are removed.
On request, passages that fill fewer lines are found too: one or two lines of many words, and whole short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelscope.llm.text import NOT_SPACE, Words, chunks, window_hashes

#: Lines in a window; words that a passage of fewer lines must exceed.
WINDOW, PASSAGE = 3, 50


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The lines of each text, empty ones too: what stands between line feeds. A text has one line at least."""
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    before = np.searchsorted(feeds, offsets)
    return Words(data, start, end, before + np.arange(len(offsets)), offsets)


def words_before(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words, runs of bytes that are no white space, begin before each byte."""
    begins = NOT_SPACE[data]
    begins[1:] &= ~begins[:-1]
    border = offsets[:-1][offsets[:-1] < len(data)]
    begins[border] = NOT_SPACE[data[border]]
    return np.concatenate([[0], np.cumsum(begins)])


def line_windows(docs: DataFrame, window: int, passage: int | None = None) -> DataFrame:
    """``high, low, id, copy, at``: a 128-bit hash of each window that is not blank, and where it begins.

    With ``passage`` there are also windows of fewer lines, of more than so many words or of a whole text,
    and ``at`` is ``line * window + lines - 1``.
    """
    sizes = [window] if passage is None else range(1, window + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                lines = lines_of(data, offsets)
                owner = lines.doc()
                ink = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
                words = ink if passage is None else words_before(data, offsets)
                hashes = [lines.hashes(kind) for kind in (0, 1)]
                found = []
                for size in sizes:
                    n = max(0, len(owner) - size + 1)
                    last = size - 1
                    start, stop = lines.start[:n], lines.end[last : last + n]
                    taken = (owner[:n] == owner[last : last + n]) & (ink[stop] > ink[start])
                    if size < window:
                        taken &= (words[stop] - words[start] > passage) | (lines.counts()[owner[:n]] == size)
                    at = np.flatnonzero(taken)
                    place = at - lines.first[owner[at]]
                    found.append((
                        *(window_hashes(x, size)[at].view(np.int64) for x in hashes), owner[at],
                        place.astype(np.int32) if passage is None else place * window + size - 1,
                    ))
                high, low, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
                ids, copies = (batch.column(c).slice(row, end - row).take(pa.array(doc)) for c in ("id", "copy"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high), pa.array(low), ids, copies, pa.array(place)], ["high", "low", "id", "copy", "at"]
                )

    kind = "int" if passage is None else "long"
    return docs.select("id", "copy", "text").mapInArrow(run, f"high long, low long, id long, copy long, at {kind}")


def dedup_lines(docs: DataFrame, window: int = WINDOW, passage: int | None = None) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with ``n_lines``, ``n_removed`` and the ``cleaned`` text of each row.

    Lines are compared as they stand. Without ``passage`` a text of fewer lines than a window keeps all, and so do
    repeats of fewer lines. With it, runs of fewer lines that hold more than ``passage`` words are compared in the same
    way, in texts of any length, and a text of fewer lines than a window is compared whole with others of its number of
    lines. A null or empty text keeps all (null stays null, and has one line like an empty text). Windows of white space alone are not compared. Occurrences
    are ordered by id, ids of null last, then by a hash of the row; rows alike in id and text count as one and are
    cleaned alike. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumns({
        "copy": F.xxhash64("doc_id", "text"), "id": F.coalesce("doc_id", F.lit(2**63 - 1)),
    })
    windows = line_windows(rows, window, passage)
    place = F.struct("id", "copy", "at")
    repeated = windows.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    covered = (
        windows.join(repeated, ["high", "low"]).filter(place > F.col("first"))
        .groupBy("id", "copy").agg(F.sort_array(F.collect_set("at")).alias("covered"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, cleaned = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                keep = np.ones(len(lines), dtype=bool)
                for at in starts or ():
                    at, last = (at, window - 1) if passage is None else divmod(at, window)
                    keep[at : at + last + 1] = False
                total.append(len(lines))
                gone.append(int((~keep).sum()))
                cleaned.append("\n".join(line for line, kept in zip(lines, keep, strict=True) if kept) if starts else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cleaned, pa.string())],
                ["doc_id", "n_lines", "n_removed", "cleaned"],
            )

    return rows.join(covered, ["id", "copy"], "left").select("doc_id", "text", "covered").mapInArrow(
        run, "doc_id long, n_lines long, n_removed long, cleaned string"
    )
