"""Phrase collocations by Toivonen's sampling.

A sample of the documents proposes phrases: those that are frequent in it at a lowered bound,
level by level. One full pass then counts the proposed phrases and their negative border, that is
every phrase whose two parts without its last and without its first word are proposed (of single words:
all). A border phrase that proves frequent was missed by the sample: it joins the proposed ones, and a further pass
counts what that admits, until no such phrase is left. Then every phrase that was never counted has
an infrequent part, so none is lost, whatever the sample. A frequent phrase that was not counted holds a missed one,
so where few were missed, one pass counts all that hold one, of every length, and is the last.

Passes count names of phrases, 60 bits of a hash and the number of words; proposed ones travel as a Bloom filter sized by their
number. A false positive or two phrases of one name only add to what is counted. A last pass over the texts counts the found
phrases again by their words, so the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelscope.llm.shared import Scratch, bloom, in_bloom, mix, written
from labelscope.llm.text import Words, chunks, distinct_keys, words_of

LANG = "und"
#: Share of the documents that propose phrases.
SAMPLE = 0.25
#: The bound in the sample lies this many standard deviations below the expected count of a phrase that is just frequent.
LOWERED = 2.3
#: Missed phrases are few if the proposed ones are so many times as many.
FEW = 16
#: Bits of a filter for each key, and the most bits of one: a fuller filter admits more phrases to the count, never fewer.
KEY_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 23, 1 << 27
#: Names that a task holds ahead of adding them up; sums, and phrases, ahead of handing them on; bytes of text it looks at together.
MOST_HELD, MOST_SUMS, MOST_PHRASES, CHUNK = 1_000_000, 3_000_000, 200_000, 1 << 19
#: Words of more bytes are hashed by all bytes of their chunk.
LONG = 256
#: Where the number of words lies in the name of a phrase, and the most that it tells. Filters use lower bits only.
_SIZE_AT, _MOST_SIZE = 60, 15

#: Partitions of the documents that one task of the last pass reads at most.
SPLITS = 16

_ENDS = b".,;:!?\n\x0b\x0c\r"
_INSIDE = np.ones(256, dtype=bool)
_INSIDE[list(b" \t" + _ENDS)] = False
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(_ENDS)] = True

_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Two hashes: what a word's eight bytes, and what its length, are multiplied with.
_FACTORS = tuple((np.uint64(a), np.uint64(b)) for a, b in ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)))


def lang_name(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def word_hashes(words: Words, kind: int = 0) -> np.ndarray:
    """A 64-bit hash for each word, of eight of its bytes at a time; the two kinds are independent."""
    factor, of_length = _FACTORS[kind]
    length = words.end - words.start
    eights = np.concatenate([words.data, np.zeros(16 - len(words.data) % 8, dtype=np.uint8)]).view("<u8")
    hashes = length.astype(np.uint64) * of_length
    at, left, which = words.start, length, slice(None)
    for _ in range(0, LONG, 8):
        place, shift = at >> 3, (at.astype(np.uint64) & np.uint64(7)) << np.uint64(3)
        value = eights[place] >> shift | eights[place + 1] << (np.uint64(63) - shift) << np.uint64(1)
        hashes[which] = mix(hashes[which] ^ (value & _EIGHT[np.minimum(left, 8)]) * factor)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return hashes
        at, left = at[more] + 8, left[more] - 8
        which = more if isinstance(which, slice) else which[more]
    hashes[which] = words.hashes(kind)[which]
    return hashes


class Chunk:
    """Words of a run of texts, and which neighbours lie in one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        self.words: Words = words_of(data, offsets, _INSIDE)
        self.doc = self.words.doc()
        begins = np.zeros(len(self.words.start) + 1, dtype=bool)
        begins[self.words.first] = True
        begins[np.searchsorted(self.words.start, np.flatnonzero(_BREAK[data]))] = True
        self.begins = begins[:-1]
        self.lang = langs[self.doc]
        self.keys = mix(word_hashes(self.words) ^ self.lang)

    def checks(self) -> np.ndarray:
        """A second, independent name of each word."""
        return mix(word_hashes(self.words, 1) ^ self.lang)

    def pairs(self) -> np.ndarray:
        """Whether a word and the next one lie in one piece."""
        return ~self.begins[1:]


def names_at(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The names of the phrases of ``size`` words that begin at these places."""
    if size == 1:
        return keys[at]
    total = np.full(len(at), size, dtype=np.uint64)
    factor = 1
    for i in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += keys[at + i] * np.uint64(factor)
    return mix(total)


def admitted(chunk: Chunk, proposed: np.ndarray | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, names) of the phrases to count: all words, then phrases whose two parts are proposed."""
    n = len(chunk.keys)
    at, names = np.arange(n), chunk.keys
    yield 1, at, names
    joined = chunk.pairs()
    for size in range(2, longest + 1):
        if proposed is None or not len(at):
            return
        known = np.zeros(n + 1, dtype=bool)
        known[at[in_bloom(proposed, names)]] = True
        # the phrase lies in one piece if its parts do and they overlap; two words must be neighbours
        follows = known[:-1] & known[1:]
        if size == 2:
            follows[:-1] &= joined
        at = np.flatnonzero(follows)
        names = names_at(chunk.keys, at, size)
        yield size, at, names


def missed_by(chunk: Chunk, proposed: np.ndarray, before: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, names) of the phrases that ``proposed`` admits and ``before``, a part of it, does not."""
    n = len(chunk.keys)
    joined = chunk.pairs()
    at, names, old = np.arange(n), chunk.keys, np.ones(n, dtype=bool)
    for size in range(2, longest + 1):
        if not len(at):
            return
        known, was = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
        known[at[in_bloom(proposed, names)]] = True
        was[at[old][in_bloom(before, names[old])]] = True
        follows, followed = known[:-1] & known[1:], was[:-1] & was[1:]
        if size == 2:
            follows[:-1] &= joined
            followed[:-1] &= joined
        at = np.flatnonzero(follows)
        names, old = names_at(chunk.keys, at, size), followed[at]
        yield size, names[~old]


def around_missed(chunk: Chunk, proposed: np.ndarray, before: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, names) of the phrases around those of ``proposed`` that ``before`` lacks, but for those with an infrequent part.

    A part is taken for frequent if it is proposed or is such a phrase itself.
    """
    n = len(chunk.keys)
    joined = chunk.pairs()
    at, names, around = np.arange(n), chunk.keys, np.zeros(n, dtype=bool)
    for size in range(2, longest + 1):
        found = in_bloom(proposed, names)
        missed = around.copy()
        missed[found] |= ~in_bloom(before, names[found])
        known, holds = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
        known[at[found | around]] = True
        holds[at[missed]] = True
        follows = known[:-1] & known[1:]
        if size == 2:
            follows[:-1] &= joined
        at = np.flatnonzero(follows)
        if not len(at):
            return
        names, around = names_at(chunk.keys, at, size), holds[at] | holds[at + 1]
        yield size, names[around]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, list[str], np.ndarray]]:
    """(chunk, languages, the language of each text as a place in that list)."""
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        langs, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        named = np.array([lang_name(x) for x in langs], dtype=np.uint64)
        for row, end, data, offsets in chunks(batch.column("text"), CHUNK):
            yield Chunk(data, offsets, named[codes[row:end]]), langs, codes[row:end]


def _counts(docs: DataFrame, names_of: Callable[[Chunk], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """``name, n``: exact counts of the names that ``names_of`` gives of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sums: list[tuple[np.ndarray, np.ndarray]] = []

        def add_up() -> None:
            if held:
                sums.append(np.unique(np.concatenate(held), return_counts=True))
                held.clear()

        def counted() -> Iterator[pa.RecordBatch]:
            if sums:
                names, n = (np.concatenate(x) for x in zip(*sums, strict=True))
                several = len(sums) > 1
                sums.clear()
                if several:
                    order = np.argsort(names, kind="stable")  # merges sorted runs
                    names, n = names[order], n[order]
                    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
                    names, n = names[first], np.add.reduceat(n, first)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])

        total = 0
        for chunk, _, _ in _chunks(batches):
            for size, names in names_of(chunk):
                held.append(names & np.uint64((1 << _SIZE_AT) - 1) | np.uint64(min(size, _MOST_SIZE) << _SIZE_AT))
                total += len(names)
            if total >= MOST_HELD:
                add_up()
                total = 0
                if sum(len(names) for names, _ in sums) >= MOST_SUMS:
                    yield from counted()
        add_up()
        yield from counted()

    # each task has added up its own, so a sum ahead of the shuffle would find next to nothing
    counts = docs.select("text", "lang").mapInArrow(run, "name long, n long").repartition("name")
    return counts.groupBy("name").agg(F.sum("n").alias("n"))


def _count(docs: DataFrame, proposed: np.ndarray | None, before: np.ndarray | None, sizes: range, longest: int) -> DataFrame:
    """``name, n``: exact counts of the names that ``proposed`` admits and ``before`` did not, of these sizes."""

    def names_of(chunk: Chunk) -> Iterator[tuple[int, np.ndarray]]:
        if before is not None:
            yield from (x for x in missed_by(chunk, proposed, before, longest) if x[0] in sizes)
        else:
            yield from ((size, names) for size, _, names in admitted(chunk, proposed, longest) if size in sizes)

    return _counts(docs, names_of)


def _bits(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * count - 1).bit_length()))


def _proposals(docs: DataFrame, least: int, longest: int, sample: float, scratch: Scratch) -> DataFrame:
    """``name``: the phrases, of fewer than ``longest`` words, that are frequent in the sample, each with all its parts."""
    cut = int(sample * (1 << 20))
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1 << 20)) < cut)
    bound = max(1, int(sample * least - LOWERED * sqrt(sample * least)))
    found = scratch.write(_count(chosen, None, None, range(1, 2), 1).filter(F.col("n") >= bound).select("name"), "proposed")
    level = found
    for size in range(2, longest):
        words = bloom(found, "name", _bits(found.count()))
        level = scratch.write(_count(chosen, words, None, range(size, size + 1), size).filter(F.col("n") >= bound).select("name"), "proposed")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def frequent_names(docs: DataFrame, least: int, longest: int, sample: float, scratch: Scratch) -> DataFrame:
    """``name`` of every phrase of up to ``longest`` words that occurs ``least`` times in its language."""
    proposed = _proposals(docs, least, longest, sample, scratch)
    most = proposed.count()
    bits = _bits(most)
    before, words = None, bloom(proposed, "name", bits)
    passes = []
    while True:
        counted = _count(docs, words, before, range(1 if before is None else 2, longest + 1), longest)
        found = scratch.write(counted.filter(F.col("n") >= least).select("name"), "frequent")
        passes.append(found)
        now = words

        def new(names: Iterator, now: np.ndarray = now) -> Iterator:
            for batch in names:
                missed = ~in_bloom(now, batch.column("name").to_numpy().view(np.uint64))
                yield batch.filter(pa.array(missed))

        shorter = found.filter(F.shiftrightunsigned("name", _SIZE_AT) < longest)
        failures = scratch.write(shorter.mapInArrow(new, "name long"), "failures")
        missed = failures.count()
        if not missed:
            break
        before, words = words, words | bloom(failures, "name", bits)
        if missed * FEW <= most:
            counted = _counts(docs, lambda chunk, known=words, old=before: around_missed(chunk, known, old, longest))
            passes.append(scratch.write(counted.filter(F.col("n") >= least).select("name"), "frequent"))
            break
    frequent = passes[0]
    for found in passes[1:]:
        frequent = frequent.unionByName(found)
    return frequent.distinct()


def _in_large_tasks(docs: DataFrame) -> DataFrame:
    """Two tasks a core, or one for ``SPLITS`` partitions if that is more: a frequent phrase is then counted up in few places."""
    wanted = max(2 * docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // SPLITS)
    return docs.coalesce(wanted)


def _recount(docs: DataFrame, names: DataFrame, longest: int) -> DataFrame:
    """``lang, size, phrase, n``: counts by the words themselves of phrases whose name may be among ``names``; size 0 counts all words."""
    words = bloom(names, "name", _bits(names.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        rows: list[tuple[str, int, bytes]] = []
        none = np.zeros(0, dtype=np.uint64)
        # of the rows held: their two names, sorted by the first, the place of each among the rows, and the counts by that place
        one, two, row, held = none, none, none.astype(np.int64), none.astype(np.int64)

        def counted(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            given = [*((*x, n) for x, n in zip(rows, counts.tolist(), strict=True)), *((lang, 0, b"", n) for lang, n in totals.items())]
            rows.clear()
            totals.clear()
            for first in range(0, len(given), 10_000):
                lang, size, phrase, n = zip(*given[first : first + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array([p.decode() for p in phrase], pa.string()), pa.array(n, pa.int64())],
                    ["lang", "size", "phrase", "n"],
                )

        for chunk, langs, codes in _chunks(batches):
            for code, n in enumerate(np.bincount(codes, weights=chunk.words.counts(), minlength=len(langs))):
                if n:
                    totals[langs[code]] = totals.get(langs[code], 0) + int(n)
            data, checks = chunk.words.data.tobytes(), chunk.checks()
            start, end, doc = chunk.words.start, chunk.words.end, chunk.doc
            phrases = []
            for size, at, found in admitted(chunk, words, longest):
                known = in_bloom(words, found)
                at, found = at[known], found[known]
                phrases.append((np.full(len(at), size), at, found, names_at(checks, at, size)))
            sizes, at, found, second = map(np.concatenate, zip(*phrases, strict=True))
            first, n = distinct_keys(found, second)
            sizes, at, found, second = sizes[first], at[first], found[first], second[first]
            place = np.searchsorted(one, found)
            there = place < len(one)
            there[there] = (one[place[there]] == found[there]) & (two[place[there]] == second[there])
            held[row[place[there]]] += n[there]
            if not there.all():
                fresh = ~there
                added = np.arange(len(rows), len(rows) + np.count_nonzero(fresh))
                for size, i in zip(sizes[fresh].tolist(), at[fresh].tolist(), strict=True):
                    rows.append((langs[codes[doc[i]]], size, b" ".join([data[start[k] : end[k]] for k in range(i, i + size)])))
                held = np.concatenate([held, n[fresh]])
                one, two, row = np.concatenate([one, found[fresh]]), np.concatenate([two, second[fresh]]), np.concatenate([row, added])
                order = np.argsort(one, kind="stable")
                one, two, row = one[order], two[order], row[order]
            if len(rows) >= MOST_PHRASES:
                yield from counted(held)
                one, two, row, held = none, none, none.astype(np.int64), none.astype(np.int64)
        yield from counted(held)

    counts = _in_large_tasks(docs.select("text", "lang")).mapInArrow(run, "lang string, size int, phrase string, n long")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, sample: float = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, n)`` of all phrases that occur ``least`` times, and ``(lang, total)``, all words of each language.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; a null text is empty, a null language is ``und``. A-Z count as a-z.
    Texts are cut at ``. , ; : ! ?`` and line ends into pieces, those at blanks and tabs into words, and a
    phrase is a run of words of one piece; occurrences may overlap. Very long texts are read whole; each costs
    some hundred bytes of memory for each of its words. Rows that repeat count each time. ``sample`` is the
    share of documents that propose phrases, chosen by hash; it changes the time, not the result.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit(LANG)).alias("lang"))
    names = frequent_names(rows, least, longest, sample, scratch)
    counts = written(_recount(rows, names, longest).filter((F.col("size") == 0) | (F.col("n") >= least)), "phrases")
    scratch.drop()
    return counts.filter("size > 0"), counts.filter("size = 0").select("lang", F.col("n").alias("total"))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, sample: float = SAMPLE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of each language of ``docs``.

    Rules of texts and phrases are those of ``frequent_phrases``. A phrase of two words or more that occurs ``a >= least``
    times is cut after each of its words; ``l`` and ``r`` are the counts of the two parts, ``n`` all words of the language, and the score
    of a cut is the whole part of ``1000 a n / (l r)``, computed with 38 digits. The cut of the lowest score
    counts, of equal ones the first. A phrase inside a longer one that occurs as often is dropped. Order: score, then ``a``,
    falling, then the phrase by its bytes. An empty table, or one in which no phrase is
    frequent, gives no rows; columns other than ``doc_id``, ``text`` and ``lang`` are not read.
    """
    frequent, totals = frequent_phrases(docs, least, longest, sample)
    words = F.split("phrase", " ")
    phrases = frequent.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    # a longer phrase occurs as often as a part of it only if all phrases between the two do
    parts = phrases.filter("size > 2").select(
        "lang", "a",
        F.explode(F.array(*(
            F.array_join(F.slice(words, first, F.col("size") - 1), " ") for first in (1, 2)
        ))).alias("phrase"),
    )
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")

    cuts = kept.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"), words.alias("words"), "size",
    ).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("right"),
    )
    for end, name in (("left", "l"), ("right", "r")):
        counts = frequent.select("lang", F.col("phrase").alias(end), F.col("n").alias(name))
        cuts = cuts.join(counts, ["lang", end])
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(
        "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(total AS DECIMAL(17,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    ))
    lowest = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", F.col("total").alias("n"))).alias("lowest")
    ).select("lang", "phrase", "lowest.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return lowest.withColumn("rank", place.cast("long")).filter(F.col("rank") <= best).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
