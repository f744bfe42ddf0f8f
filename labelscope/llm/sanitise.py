"""Personal data and the terms that give it away.

Fixed patterns find personal data. For the rest the corpus decides. The context of a protected entity (one address,
number or card) in a text are the words around each of its occurrences there; contexts of several entities overlap. The
words of the distinct texts that are in no context are cut into blocks as large. The co-occurrence of a term with an
entity over all contexts and blocks gives how much of the entity's information content the term reveals, ``PMI(e, t) / IC(e)``.
Terms above the disclosure threshold are generalised, or removed where they all but name the entity.

A term counts only if chance would hardly bring it so often to *any* entity, whichever that is, and this for all terms of the corpus together: the
entity was not named beforehand, and every rare word stands near something. One meeting is no evidence. So an entity of one
text has no such terms, one of two or three has those that stand with it every time and are rare elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelscope.llm.shared import bloom, in_bloom, written
from labelscope.llm.text import ALPHANUMERIC, Words, chunks, words_of

# Fixed patterns of the base kinds, in their order. The possessive runs keep scans linear and match the same.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?P<domain>@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words in a block, half of them on each side of an entity; chance that any term of the corpus is found by accident, share of the entity's information
#: from which a term discloses it, and conditional probability from which it is removed.
BLOCK_WORDS, CHANCE, DISCLOSURE, REMOVAL = 50, 0.05, 0.9, 0.9
#: Counts that a task holds before it hands them on.
MOST_HELD = 1_000_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def personal_data(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by kind as listed, then start."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text) if m["domain"]]
    for m in IP.finditer(text):
        parts = [part.lstrip("0") for part in m.group().split(".")]
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in parts):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def entity_name(kind: str, value: str) -> int:
    """A 64-bit name of an address or number, however it is set."""
    value = value.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


class Points:
    """Code points and bytes of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts = (data & 0xC0) != 0x80
        self.before = np.concatenate([[0], np.cumsum(starts)])  # code points ahead of each byte
        self.at = np.append(np.flatnonzero(starts), len(data))  # the byte of each code point
        self.first = self.before[offsets]

    def bytes_of(self, text: int, spans: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.array([(start, end) for start, end, _ in spans], dtype=np.int64).reshape(-1, 2) + self.first[text]
        return self.at[ends[:, 0]], self.at[ends[:, 1]]


def outside_of(spans: list[tuple[int, int, str]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the pieces meet no span."""
    if not spans:
        return np.ones(len(start), dtype=bool)
    edges = np.array(sorted((a, b) for a, b, _ in spans), dtype=np.int64)
    reach = np.concatenate([[-1], np.maximum.accumulate(edges[:, 1])])
    return reach[np.searchsorted(edges[:, 0], end, side="left")] <= start


class Counts:
    """Counts by up to two 64-bit keys, added up before they are handed on."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.held += len(keys)
        if self.held > 2 * MOST_HELD:
            self._sum()

    def _sum(self) -> None:
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.lexsort(keys.T[::-1])
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
        self.keys, self.values = [keys[starts]], [np.add.reduceat(values, starts) if len(keys) else values]
        self.held = len(starts)

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.keys[0][:, 0]), pa.array(self.keys[0][:, 1]), pa.array(self.values[0])], ["entity", "term", "n"]
            )
        self.__init__()


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``text``: each text once, null as empty. Only texts that may have copies, by a filter over their hashes, are shuffled."""
    hashed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    words = bloom(hashed.groupBy("key").count().filter("count > 1"), "key")

    @F.pandas_udf("boolean")
    def may_have_copies(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(words, keys.to_numpy().view(np.uint64)))

    marked = hashed.withColumn("maybe", may_have_copies("key"))
    return marked.filter("NOT maybe").select("text").unionByName(marked.filter("maybe").select("text").distinct())


def co_occurrence(docs: DataFrame) -> DataFrame:
    """``entity, term, n``: contexts of the entity, one a distinct text, that hold the term; 0 stands for any, so (0, t), (e, 0) and (0, 0)
    are the margins: (0, t) and (0, 0) count all contexts and blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            texts = batch.column("text")
            for row, end, data, offsets in chunks(texts):
                words = words_of(data, offsets, ALPHANUMERIC)
                hashes, points = words.hashes(), Points(data, offsets)
                doc = words.doc()
                able, outside = np.ones(len(doc), dtype=bool), np.ones(len(doc), dtype=bool)
                contexts = []  # (text, entity, its words)
                for i in range(end - row):
                    text = texts[row + i].as_py() or ""
                    around: dict[int, list[np.ndarray]] = {}
                    first, last = words.first[i], words.first[i + 1]
                    spans = personal_data(text)
                    begins, ends = points.bytes_of(i, spans)
                    lows = first + np.searchsorted(words.end[first:last], begins, side="right")
                    highs = np.maximum(lows, first + np.searchsorted(words.start[first:last], ends))
                    for (start, stop, kind), low, high in zip(spans, lows.tolist(), highs.tolist(), strict=True):
                        able[low:high] = False
                        near = np.arange(max(first, low - BLOCK_WORDS // 2), min(last, high + BLOCK_WORDS // 2))
                        outside[near] = False
                        around.setdefault(entity_name(kind, text[start:stop]), []).append(near)
                    contexts += [(i, e, np.unique(np.concatenate(near))) for e, near in around.items()]
                rest = np.concatenate([[0], np.cumsum(outside)])
                per_doc = (np.diff(rest[words.first]) + BLOCK_WORDS - 1) // BLOCK_WORDS
                lone = np.ones(end - row, dtype=bool)
                lone[[i for i, _, _ in contexts]] = False
                base = np.concatenate([[0], np.cumsum(np.maximum(per_doc, lone))])
                at = np.flatnonzero(outside & able)
                places, found = [base[doc[at]] + (rest[at] - rest[words.first[doc[at]]]) // BLOCK_WORDS], [at]
                for k, (_, _, near) in enumerate(contexts):
                    found.append(near[able[near]])
                    places.append(np.full(len(found[-1]), base[-1] + k))
                held = np.array([(base[-1] + k, e) for k, (_, e, _) in enumerate(contexts)], dtype=np.int64).reshape(-1, 2)
                pair = np.stack([np.concatenate(places), hashes[np.concatenate(found)].view(np.int64)], axis=1)
                pair = np.unique(pair, axis=0) if len(pair) else pair
                terms, n = np.unique(pair[:, 1], return_counts=True)
                zero = np.zeros_like(terms)
                counts.add(np.stack([zero, terms], axis=1), n)
                counts.add(np.zeros((1, 2), np.int64), np.array([base[-1] + len(contexts)]))
                if contexts:
                    counts.add(np.stack([held[:, 1], np.zeros(len(held), np.int64)], axis=1), np.ones(len(held), np.int64))
                    low, high = np.searchsorted(pair[:, 0], held[:, 0]), np.searchsorted(pair[:, 0], held[:, 0], side="right")
                    both = np.concatenate([np.stack([np.full(b - a, e), pair[a:b, 1]], axis=1) for a, b, e in zip(low, high, held[:, 1], strict=True)])
                    counts.add(both, np.ones(len(both), np.int64))
                if counts.held > MOST_HELD:
                    yield from counts.taken()
        yield from counts.taken()

    return (
        distinct_texts(docs).mapInArrow(run, "entity long, term long, n long")
        .groupBy("entity", "term").agg(F.sum("n").alias("n"))
    )


def disclosing_terms(counts: DataFrame) -> DataFrame:
    """``term, removed``: terms that reveal an entity, and whether they all but name it.

    A term of ``n_term`` contexts and blocks meets some entity ``n`` times or more by chance with a probability of at most
    ``C(n_term, n) * sum over entities of (n_entity / total) ** n``, and the sum is at most the one of squares times the largest share to the
    power ``n - 2``. That must not exceed ``CHANCE`` over all terms of the corpus; ``n`` is at least 2.
    """
    pairs = counts.filter("entity <> 0 AND term <> 0 AND n > 1")
    terms = counts.filter("entity = 0 AND term <> 0").select("term", F.col("n").alias("n_term"))
    margins = (F.col("entity") != 0) & (F.col("term") == 0)
    entities = counts.filter(margins).select("entity", F.col("n").alias("n_entity"))
    totals = counts.filter("entity = 0 OR term = 0").agg(
        F.max(F.when((F.col("entity") == 0) & (F.col("term") == 0), F.col("n"))).alias("total"),
        F.sum(F.when(margins, F.col("n").cast("double") * F.col("n"))).alias("squares"),
        F.max(F.when(margins, F.col("n"))).alias("largest"),
        F.count_if((F.col("entity") == 0) & (F.col("term") != 0)).alias("all_terms"),
    )
    n, n_term, n_entity, total = F.col("n"), F.col("n_term"), F.col("n_entity"), F.col("total")
    given = n / n_term
    content = F.log(total / n_entity)
    pmi = F.log(n * total / (n_term * n_entity))
    orders = F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")))).otherwise(n * F.log(n) - n)  # at most log n!
    chance = n * F.log(n_term) - orders + F.log(F.col("squares") / total / total) + (n - 2) * F.log(F.col("largest") / total)
    return (
        pairs.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(totals))  # one row
        .filter((content > 0) & (pmi >= DISCLOSURE * content) & (chance <= F.log(CHANCE / F.col("all_terms"))))
        .groupBy("term").agg(F.max(given >= REMOVAL).alias("removed"))
    )


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _copy_key(doc_id: Column, text: Column) -> Column:
    """A 128-bit name of a row by its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")))


def _found(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, copy, n_<kind>, base`` of each row, and ``copy, terms``, the spans of the terms of those that hold any."""
    terms = written(disclosing_terms(written(co_occurrence(source), "co-occurrence")), "terms")
    words_in = bloom(terms, "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for row, end, data, offsets in chunks(texts):
                words, points = words_of(data, offsets, ALPHANUMERIC), Points(data, offsets)
                hashes = words.hashes()
                at = np.flatnonzero(in_bloom(words_in, hashes))
                start, stop = points.before[words.start[at]], points.before[words.end[at]]
                hashed = hashes.view(np.int64)[at]
                bounds = np.searchsorted(at, words.first)
                rows = []
                for i in range(end - row):
                    spans = personal_data(texts[row + i].as_py() or "")
                    kinds = [kind for _, _, kind in spans]
                    its = slice(bounds[i], bounds[i + 1])
                    a, b = start[its] - points.first[i], stop[its] - points.first[i]
                    free = outside_of(spans, a, b)
                    maybe = [{"term": t, "start": x, "end": y} for t, x, y in zip(hashed[its][free].tolist(), a[free].tolist(), b[free].tolist(), strict=True)]
                    rows.append((*(kinds.count(kind) for kind in KINDS), joined(spans), maybe))
                columns = list(zip(*rows, strict=True))
                part = batch.slice(row, end - row)
                kinds = [pa.int64()] * 4 + [pa.string(), MAYBE]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("copy"), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))],
                    ["doc_id", "copy", *(f"n_{kind}" for kind in KINDS), "base", "maybe"],
                )

    schema = (
        "doc_id long, copy binary, n_email long, n_ip long, n_card long, n_phone long, base string, "
        "maybe array<struct<term: long, start: long, end: long>>"
    )
    rows = written(source.withColumn("copy", _copy_key(F.col("doc_id"), F.col("text"))).mapInArrow(run, schema), "spans")
    spans = (
        rows.filter(F.size("maybe") > 0).select("copy", F.explode("maybe").alias("x")).select("copy", "x.term", "x.start", "x.end")
        .join(terms, "term")
        .groupBy("copy").agg(F.sort_array(F.collect_set(F.struct("removed", "start", "end"))).alias("terms"))
    )
    return rows.drop("maybe"), spans


def sanitise(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``): personal data and disclosing terms in its whole text.

    ``n_email, n_ip, n_card, n_phone`` count the base spans, ``base_sha256`` is of them, ``spans`` has all spans as
    ``kind:start:end`` in code points: the base kinds, then ``generalise`` and ``remove`` for terms. A null text is
    empty. Rows alike in id and text get the same spans; rows without an id are scanned like others; an empty table gives
    no rows; other columns are not read. Every word is examined as a term, short ones and numbers too. Time is in proportion to the
    length of a text and its spans; the spans of one text are a list of one row.
    """
    rows, spans = _found(docs.select(F.col("doc_id").cast("long"), "text"))
    text = F.array_join(
        F.transform("terms", lambda x: F.concat_ws(":", F.when(x["removed"], "remove").otherwise("generalise"), x["start"], x["end"])), ","
    )
    return rows.join(spans, "copy", "left").select(
        "doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), text).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


#: What stands for personal data and for generalised terms in a sanitised text.
CLASSES = {kind: f"[{kind}]" for kind in KINDS}
NUMBER, NAME, WORD = "[number]", "[name]", "[word]"


def general_class(term: str) -> str:
    """What a term is, by its shape: one with digits, one with a capital, any other."""
    if any(c.isdigit() for c in term):
        return NUMBER
    return NAME if term[:1].isupper() else WORD


def sanitised_text(text: str, terms: list[tuple[bool, int, int]]) -> str:
    """The text with its personal data and generalised terms replaced by classes, and removed terms cut with the blank ahead of them.

    Spans of personal data that overlap are replaced together by the class of the first.
    """
    edits = sorted((a, b, CLASSES[kind]) for a, b, kind in personal_data(text))
    edits += [(a, b, "" if removed else general_class(text[a:b])) for removed, a, b in terms]
    out, at = [], 0
    for start, end, put in sorted(edits, key=lambda x: x[:2]):
        if start < at:  # overlaps the span before
            at = max(at, end)
            continue
        kept = text[at:start]
        out.append(kept[:-1] if not put and kept.endswith(" ") else kept)
        out.append(put)
        at = end
    return "".join([*out, text[at:]])


def sanitised_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, and their texts without what ``sanitise`` finds in them.

    Null texts stay null. Only texts that may hold terms, by a filter over their names, are shuffled to the table of
    spans; all others are rewritten in the scan.
    """
    columns = docs.columns
    _, spans = _found(docs.select(F.col("doc_id").cast("long"), "text"))
    spans = written(spans, "terms-of-texts")
    words = bloom(spans.select(F.xxhash64("copy").alias("key")), "key")

    @F.pandas_udf("boolean")
    def may_hold_terms(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(words, keys.to_numpy().view(np.uint64)))

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else sanitised_text(t, [] if x is None else [tuple(y.values()) for y in x]) for t, x in zip(texts, terms, strict=True)], dtype=object
        )

    row = F.struct(*(docs[c] for c in columns)).alias("row")
    marked = docs.select(row).withColumn("copy", _copy_key(F.col("row.doc_id").cast("long"), F.col("row.text")))
    marked = marked.withColumn("maybe", may_hold_terms(F.xxhash64("copy")))
    kind = "array<struct<removed: boolean, start: bigint, end: bigint>>"
    bare = marked.filter("NOT maybe").select("row", F.lit(None).cast(kind).alias("terms"))
    held = marked.filter("maybe").join(spans, "copy", "left").select("row", F.col("terms").cast(kind).alias("terms"))
    both = bare.unionByName(held).withColumn("clean", rewritten("row.text", "terms"))
    return both.select(*(F.col("clean").alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in columns))


MAYBE = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
