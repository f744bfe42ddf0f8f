"""Benchmark decontamination: windows of benchmark words looked up in every document.

The windows of the benchmark, cut into blocks of a fixed size, are broadcast as a hash set,
one block after another for a benchmark beyond the bound. A scan rolls a hash over the words
of each document, looks it up, and compares the bytes of every hit with those of the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelscope.llm.shared import Scratch, small_batches
from labelscope.llm.text import ALPHANUMERIC, Words, chunks, window_hashes, words_of

#: Bytes of window text in one broadcast set. A larger benchmark is scanned for in several passes.
MOST_BYTES = 32 << 20
#: Bits of the table that is asked before the sorted hashes.
TABLE_BITS = 22

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """``n, window, items``: the distinct windows of the items, their length in words and the items that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column("text")):
                words = words_of(data, offsets, ALPHANUMERIC)
                ids = batch.column("item_id").slice(row, end - row).to_pylist()
                found = []
                for i, name in enumerate(ids):
                    first, last = int(words.first[i]), int(words.first[i + 1])
                    n = min(size, last - first)
                    for at in range(first, last - n + 1) if n else ():
                        found.append((n, _joined(words, at, n), name))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string()))],
                    ["n", "window", "item"],
                )

    rows = benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "n int, window string, item string")
    return rows.groupBy("n", "window").agg(F.collect_set("item").alias("items"))


def _joined(words: Words, at: int, n: int) -> str:
    """Words ``at`` to ``at + n`` with a blank between them."""
    return b" ".join(
        words.data[words.start[i] : words.end[i]].tobytes() for i in range(at, at + n)
    ).decode("utf-8", "surrogateescape")


class WindowSet:
    """Windows by length and hash."""

    def __init__(self, rows: list[tuple[int, str, list[str]]]) -> None:
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[str], list[list[str]]]] = {}
        for n in {row[0] for row in rows}:
            texts = [(window, items) for length, window, items in rows if length == n]
            data = pa.array([window for window, _ in texts], pa.large_string())
            hashes = []
            for _, _, chunk, offsets in chunks(data):
                words = words_of(chunk, offsets, ALPHANUMERIC)
                hashes.append(window_hashes(words.hashes(), n)[words.first[:-1]])
            hashes = np.concatenate(hashes)
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << TABLE_BITS, dtype=bool)
            table[hashes & np.uint64(len(table) - 1)] = True
            self.by_length[n] = hashes[order], table, [texts[i][0] for i in order], [texts[i][1] for i in order]

    def hits(self, words: Words) -> Iterator[tuple[int, int, int, list[str]]]:
        """(text, first word, number of words, items) of every verified occurrence."""
        own = words.hashes()
        doc = words.doc()
        for n, (hashes, table, texts, items) in self.by_length.items():
            windows = window_hashes(own, n)
            if not len(windows):
                continue
            at = np.flatnonzero(table[windows & np.uint64(len(table) - 1)] & (doc[: len(windows)] == doc[n - 1 :]))
            low = np.searchsorted(hashes, windows[at], side="left")
            high = np.searchsorted(hashes, windows[at], side="right")
            for place, i, j in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                text = _joined(words, place, n)
                for k in range(i, j):
                    if texts[k] == text:
                        yield int(doc[place]), place, n, items[k]


def _scan(found: WindowSet, texts: pa.Array) -> Iterator[tuple[int, Words, np.ndarray, list[set[str]]]]:
    """(first row, words, which words are hit, items of each row) for each chunk."""
    for row, end, data, offsets in chunks(texts):
        words = words_of(data, offsets, ALPHANUMERIC)
        hit = np.zeros(len(words.start), dtype=bool)
        items: list[set[str]] = [set() for _ in range(end - row)]
        for doc, at, n, names in found.hits(words):
            hit[at : at + n] = True
            items[doc].update(names)
        yield row, words, hit, items


def window_blocks(benchmark: DataFrame, size: int, most_bytes: int) -> Iterator[list[tuple[int, str, list[str]]]]:
    """The windows in blocks of no more than ``most_bytes`` bytes of window text and item names; the driver holds one at a time."""
    block, room = [], most_bytes
    for row in benchmark_windows(benchmark, size).toLocalIterator():
        cost = len(row["window"]) + 8 * 16 + sum(map(len, row["items"]))
        if cost > room and block:
            yield block
            block, room = [], most_bytes
        block.append((row["n"], row["window"], list(row["items"])))
        room -= cost
    yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): its words, hit words and items found.

    Words are runs of ASCII letters and digits and of everything beyond ASCII, with A-Z
    lower-cased. A window is ``size`` words in a row of an item; an item of fewer words, but not none, is one window.
    A null or empty text has no words; null item ids mark words as hit but count as no item.
    ``items_sha256`` is of the sorted item ids, joined by commas. Repeated rows are judged one by one; an empty
    benchmark hits nothing. Other columns are not read. A benchmark beyond ``most_bytes`` costs one scan for each block of it.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = window_blocks(benchmark, size, most_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return source.mapInArrow(_counts(source, first, False), OUT)
    # beyond the bound: hit places of all passes met again by document
    places, passes = _places(source, chain((first, second), blocks))
    return places.groupBy("doc_id", "copy", "n_words").applyInArrow(_merged(passes), OUT)


def _places(source: DataFrame, blocks: Iterator[list]) -> tuple[DataFrame, int]:
    """(hit words and items of each row and block, number of blocks): one pass and one table for each block."""
    scratch, parts = Scratch(source.sparkSession), []
    keyed = source.withColumn("copy", F.xxhash64("text"))
    for block in blocks:
        schema = "doc_id long, copy long, n_words long, hit binary, items array<string>"
        parts.append(scratch.write(keyed.mapInArrow(_counts(source, block, True), schema), "places"))
    return reduce(DataFrame.unionByName, parts), len(parts)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _counts(source: DataFrame, windows: list, places: bool):
    """The scan with one broadcast block; with ``places``, hit words as bits in place of counts."""
    small_batches(source.sparkSession)
    shared = source.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = WindowSet(shared.value)
        for batch in batches:
            for row, words, hit, items in _scan(found, batch.column("text")):
                n = len(items)
                ids, total = batch.column("doc_id").slice(row, n), words.counts()
                if places:
                    bits = [np.packbits(hit[words.first[i] : words.first[i + 1]]).tobytes() for i in range(n)]
                    columns = [ids, batch.column("copy").slice(row, n), pa.array(total, pa.int64()), pa.array(bits, pa.binary()),
                               pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "n_words", "hit", "items"])
                else:
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    hits = sums[words.first[1:]] - sums[words.first[:-1]]
                    yield _rows(ids, total, hits, items)

    return run


def _rows(ids: pa.Array, total: np.ndarray, hits: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
         pa.array([_digest(x) for x in items]), pa.array(hits > 0)],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _merged(passes: int):
    """One document's passes: places are or-ed. Rows alike in id and text come out as often as they came in."""

    def merge(group: pa.Table) -> pa.Table:
        bits = None
        names: set[str] = set()
        for hit, items in zip(group.column("hit").to_pylist(), group.column("items").to_pylist(), strict=True):
            hit = np.frombuffer(hit, np.uint8)
            bits = hit if bits is None else bits | hit
            names.update(items)
        row = _rows(group.column("doc_id").combine_chunks().slice(0, 1), np.array([group.column("n_words")[0].as_py()]),
                    np.array([int(np.bitwise_count(bits).sum())]), [names])
        return pa.Table.from_batches([row] * (group.num_rows // passes))

    return merge


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark occurs, by the rules of ``decontaminate``.

    Null and empty texts stay, an empty benchmark removes nothing, repeated rows stay or go together, and texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    blocks = window_blocks(benchmark, size, most_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        source = docs.select(F.col("doc_id").cast("long"), "text")
        places, _ = _places(source, chain((first, second), blocks))
        dirty = places.filter(F.hex("hit").rlike("[1-9A-F]")).select(F.col("doc_id").alias("dirty"), "copy").distinct()
        same = docs["doc_id"].cast("long").eqNullSafe(dirty["dirty"]) & (F.xxhash64(docs["text"]) == dirty["copy"])
        return docs.join(dirty, same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value)
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for row, words, hit, items in _scan(windows, batch.column("text")):
                sums = np.concatenate([[0], np.cumsum(hit)])
                keep[row : row + len(items)] = sums[words.first[1:]] == sums[words.first[:-1]]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
