"""Spelling variants: words that differ by one letter, by a dictionary of pairs of trie nodes.

The distinct words make two tries, one read forward and one backward. Both are numbered in parallel: words are
dealt by range and sorted, a word gets new nodes beyond what it shares with the word
ahead, and the nodes that lie across the borders of ranges, found from the first and last word of
each, are numbered ahead of all others. A word is then a list of integers for each trie, and every
position gives two pairs (prefix node, suffix node): one that leaves out the letter there, and one that leaves out nothing.
Two words that differ in a letter share a pair that leaves it out; a word with one letter less is
whole where the longer one leaves it out. No pair needs a second look: equal nodes are equal prefixes
and suffixes. The words of one pair differ in one letter, so there are no more of them than letters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelscope.llm.shared import Scratch, written
from labelscope.llm.text import chunks, distinct_keys, words_of

#: Bytes of text that a task looks at together; runs of more bytes are summed one by one.
CHUNK, LONG_RUN = 1 << 20, 48
#: One run in so many loses a letter.
DELETED = 199

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc_of_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, going on from the sum of what stands ahead of it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    state = (ahead ^ np.uint32(0xFFFFFFFF))[order]
    at, left = start[order], size[order]
    long = int(np.searchsorted(-left, -LONG_RUN, side="left"))
    for i in range(long):
        run = data[at[i] : at[i] + left[i]].tobytes()
        state[i] = zlib.crc32(run, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    active = len(left)
    for step in range(LONG_RUN):
        active = int(np.searchsorted(-left, -step, side="left"))  # runs of more than ``step`` bytes
        if active <= long:
            break
        now = state[long:active]
        state[long:active] = _CRC[(now ^ data[at[long:active] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def word_counts(docs: DataFrame, letters: int, least: int) -> DataFrame:
    """``word, n`` of the words of ``letters`` letters or more that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, end, data, offsets in chunks(batch.column("text"), CHUNK):
                # letters beyond ASCII are two bytes, of which the first is C3
                lead = data == 0xC3
                wide = lead.copy()
                wide[1:] |= lead[:-1]
                words = words_of(np.where(wide, np.uint8(0x61), data), offsets, _LETTERS)
                low = np.where(wide, data, words.data)
                seconds = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
                length = words.end - words.start - (seconds[words.end] - seconds[words.start])
                ahead = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in ids[row:end]], dtype=np.uint32)
                named = np.array([i is not None for i in ids[row:end]], dtype=bool)
                doc = words.doc()
                crc = crc_of_runs(low, words.start, words.end, ahead[doc])
                cut = (crc % np.uint32(DELETED) == 0) & named[doc]
                text = low.tobytes()
                found: Counter[bytes] = Counter()
                for i in np.flatnonzero(cut & (length > letters)).tolist():
                    whole = text[words.start[i] : words.end[i]].decode()
                    at = int(crc[i]) % len(whole)
                    found[(whole[:at] + whole[at + 1 :]).encode()] += 1
                words.data = low
                plain = np.flatnonzero(~cut & (length >= letters))
                first, n = distinct_keys(words.hashes()[plain], words.hashes(1)[plain])
                first = plain[first]
                texts = [text[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
                texts += found.keys()
                counts = np.concatenate([n, np.fromiter(found.values(), dtype=np.int64, count=len(found))])
                for part in range(0, len(texts), 20_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(texts[part : part + 20_000], pa.binary()).cast(pa.string()), pa.array(counts[part : part + 20_000], pa.int64())],
                        ["word", "n"],
                    )

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def shared_letters(a: str, b: str) -> int:
    """How many letters two words begin with together."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first low letters are equal, the first high + 1 are not
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Borders:
    """Numbers of the nodes that words of two ranges share: of the first word of each range, and of its last one."""

    def __init__(self, ends: list[tuple[int, str, str]]) -> None:
        self.front: dict[int, list[int]] = {}
        self.tail: dict[int, tuple[str, list[int]]] = {}
        count, ahead = 0, ("", [])
        for i, (part, first, last) in enumerate(ends):
            shared = shared_letters(ends[i - 1][2], first) if i else 0
            known = min(shared_letters(ahead[0], first), len(ahead[1]), shared)
            nodes = ahead[1][:known] + [-(count + k) for k in range(1, shared - known + 1)]
            count += shared - known
            self.front[part] = nodes
            if i:
                self.tail[ends[i - 1][0]] = (ends[i - 1][2], nodes)
            ahead = (first, nodes)


def trie_nodes(words: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, key, nodes``: the trie nodes on the way along ``key``, the root first; ``words`` has ``id`` and ``key``, which is unique.

    Nodes are numbered by (range, place in the range); those that ranges share are negative.
    """
    ranged = words.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged, name)
    ends = ranged.groupBy("part").agg(F.min("key"), F.max("key")).collect()  # a row for each range
    borders = Borders(sorted((r[0], r[1], r[2]) for r in ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, nodes, count = None, "", [0], 0
        front: list[int] = []
        last, tail = "", []
        for batch in batches:
            out = []
            for its, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if its != part:
                    part, before, nodes, count = its, "", [0], 0
                    front = borders.front.get(part, [])
                    last, tail = borders.tail.get(part, ("", []))
                shared = shared_letters(before, key)
                nodes = nodes[: shared + 1]
                if not before and front:
                    nodes += front
                if tail and len(nodes) <= len(tail):
                    nodes += tail[len(nodes) - 1 : shared_letters(last, key)]
                fresh = len(key) + 1 - len(nodes)
                nodes = nodes + [(part << 40) + count + k for k in range(1, fresh + 1)]
                count += fresh
                before = key
                out.append(nodes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "nodes"])

    rows = ranged.select("part", "id", "key").repartition("part").sortWithinPartitions("part", "key")
    return rows.mapInArrow(run, "id long, nodes array<long>")


#: Kinds of a pair: the whole word; one letter left out; the same, and the letter is not the one ahead of it, so
#: that of equal letters in a row only the first counts as inserted.
_PAIRS = """
concat(
  transform(sequence(0, size), i -> named_struct('prefix', forward[i], 'suffix', backward[size - i], 'kind', 0)),
  transform(sequence(0, size - 1), i -> named_struct('prefix', forward[i], 'suffix', backward[size - i - 1], 'kind',
    if(i = 0 OR substring(word, i + 1, 1) <> substring(word, i, 1), 2, 1)))
)"""

#: Of each word of a pair, those near it: a whole word is near words with a letter more, the others are near each other too.
_NEAR = """
transform(
  transform(words, w -> named_struct('id', w.id, 'near', filter(words, x ->
    x.id <> w.id AND CASE WHEN w.kind = 0 THEN x.kind = 2 WHEN x.kind = 0 THEN w.kind = 2 ELSE true END))),
  y -> named_struct('id', y.id, 'n_near', size(y.near), 'best', array_min(transform(y.near, x -> named_struct('less', -x.n, 'id', x.id)))))
"""


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, n_near, best`` of the words that have near ones: how many, and (minus its count, id) of the best of them."""
    forward = trie_nodes(words.select("id", F.col("word").alias("key")), scratch, "forward").withColumnRenamed("nodes", "forward")
    backward = trie_nodes(words.select("id", F.reverse("word").alias("key")), scratch, "backward").withColumnRenamed("nodes", "backward")
    both = words.withColumn("size", F.length("word")).join(forward, "id").join(backward, "id")
    pairs = both.select("id", "n", F.explode(F.expr(_PAIRS)).alias("pair")).select("id", "n", "pair.*")
    groups = pairs.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("id", "n", "kind")).alias("words")).filter("size(words) > 1")
    found = groups.select(F.inline(F.expr(_NEAR))).filter("n_near > 0")
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` from ``id, form``: the end of each chain of forms, whose steps double every round."""
    chains = scratch.write(forms.select("id", F.col("form").alias("root")), "chains")
    while True:
        ahead = chains.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = scratch.write(chains.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "chains")
        chains = moved.select("id", "root")
        if moved.filter("went").isEmpty():
            return chains


def spelling_variants(docs: DataFrame, letters: int = 6, least: int = 5, factor: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of ``docs`` (``doc_id``, ``text``).

    Words are maximal runs of ``A-Z a-z`` and U+00C0 to U+00FF, A-Z lower-cased. A run whose crc32 of ``<doc_id>:<run>`` is divisible
    by 199 loses the letter at (crc32 modulo its length); in a row without an id none does. Words of ``letters`` letters
    and ``least`` occurrences count. Two are near if one inserted, deleted or replaced letter
    is all they differ by. The form of a word is its near word of the largest ``n``, of equal ones the first in code-point
    order, if that occurs at least ``factor`` times as often; the root is the end of the chain of forms.
    A null text has no words, an empty table gives no rows, repeated rows count each time. Very long texts are
    read whole; a very long word costs time and rows in proportion to its length. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.write(word_counts(docs, letters, least), "counted")
    sorted_words = counted.repartitionByRange("word").sortWithinPartitions("word")
    # ids in the order of the words
    words = scratch.write(sorted_words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = scratch.write(near_words(words, scratch), "near")
    formed = near.join(words.select("id", "n"), "id").filter(-F.col("best.less") >= factor * F.col("n")).select(
        "id", F.col("best.id").alias("form"), (-F.col("best.less")).alias("form_n")
    )
    forms = scratch.write(formed, "forms")
    ends = roots(forms, scratch)
    named = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    top = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    chosen = forms.join(ends, "id").join(named, "form").join(top, "root").select("id", "form_word", "root_word", "form_n")
    rows = words.join(near.select("id", "n_near"), "id", "left").join(chosen, "id", "left")
    result = written(rows.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    ), "variants")
    scratch.drop()
    return result
