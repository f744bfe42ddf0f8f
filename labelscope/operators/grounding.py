"""Checks that each annotated sentence really occurs in the text of its page.

The text of a page and its distinct sentences meet in one task as rows of their own: the text comes first and
is read once for all sentences (``functions.places``), so no row holds a sentence and a text. A page
with very many sentences is dealt in blocks, each with a copy of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from labelscope.functions.places import places, present as present_in, spliced
from labelscope.functions.text import present
from labelscope.operators.coverage import PAGE
from labelscope.operators.ranking import occurrence_number, order_columns, row_order

TEXTS = ("markdown_full", "cleaned_markdown")

# The markup around a highlighted sentence.
OPEN_TAG = "<span style='background-color:#fff59d; padding:2px; border-radius:4px; font-weight:500;'>"
CLOSE_TAG = "</span>"


def _first_rows(rows: DataFrame, source: DataFrame, page: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``columns`` of the first row of each page: its key from a narrow aggregate, the texts of that row alone by a join."""
    first = rows.groupBy(*page).agg(F.min(row_order(rows, order)).alias("_first"))
    keys = ["_first"] if len(order) == 1 else [f"_first.{c}" for c in order]
    named = first.select(*page, *[F.col(k).alias(c) for k, c in zip(keys, order)])
    found = source.select(*order, *columns)
    return named.join(found, list(order)).select(*page, *columns)


def page_texts(
    sentences: DataFrame,
    raw: DataFrame | None = None,
    page: Sequence[str] = PAGE,
    texts: Sequence[str] = TEXTS,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Texts of each page as its first row has them.

    The usual call is ``page_texts(raw)`` on the table of answers, whose ``row_id`` (or ``order``)
    names a row. To take the first row of *filtered* sentences, pass them together with ``raw`` (one
    row per answer): they only give the first row id of each page. Either way ids are
    aggregated without a text, and only the texts of those ids are asked for.
    """
    rows = sentences.filter(present(*page))
    if raw is not None:
        return _first_rows(rows, raw, page, texts, ["row_id"])
    return _first_rows(rows, sentences, page, texts, order_columns(sentences, order))


def first_page_text(
    sentences: DataFrame,
    text: str = "cleaned_markdown",
    page: Sequence[str] = PAGE,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """First non-null text of each page."""
    return _first_rows(sentences.filter(present(*page, text)), sentences, page, [text], order_columns(sentences, order))


#: Sentences of a page that one task compares with its text, or this share of all rows if that is more: so no more than
#: ``SHARES`` pages are dealt in blocks, and their table can be broadcast. Rows and bytes that a task gathers for one reading.
BLOCK, SHARES, GATHERED, GATHERED_BYTES = 50_000, 100_000, 20_000, 1 << 25


def _page_key(page: Sequence[str], *more: Column) -> Column:
    """The page as one text; rows without a page are spread over keys of their own, which no text has."""
    spread = F.concat(F.lit("~"), F.pmod(F.xxhash64(F.col("_row")), F.lit(4096)).cast("string"))
    return F.when(present(*page), F.to_json(F.struct(*page, *more))).otherwise(spread)


def _meet(
    df: DataFrame, pages: DataFrame, page: Sequence[str], texts: Sequence[str], counted: DataFrame | None, order: Sequence[str] = ()
) -> DataFrame:
    """``_key, _texts, _row``: of each page, or block of its sentences, the texts and then the rows of ``df``, in one task."""
    types = {f.name: f.dataType for f in df.schema.fields}
    texts_of = pages.filter(present(*page)).select(
        *[F.col(c).cast(types[c]).alias(c) for c in page], F.array(*[F.col(t).cast("string") for t in texts]).alias("_texts")
    )
    rows = df.select(*page, *order, F.struct(*df.columns).alias("_row"))
    blocks = F.lit(1)
    if counted is not None:
        counts = counted.filter(present(*page)).groupBy(*[F.col(c).cast(types[c]).alias(c) for c in page]).agg(F.count("*").alias("_rows"))
        share = counts.agg(F.greatest(F.sum("_rows") / SHARES, F.lit(float(BLOCK))).alias("_share"))  # one row
        hot = (
            counts.filter(F.col("_rows") > BLOCK).crossJoin(F.broadcast(share)).filter("_rows > _share")
            .select(*page, F.ceil(F.col("_rows") / F.col("_share")).cast("int").alias("_blocks"))
        )
        rows, texts_of = (side.join(F.broadcast(hot), list(page), "left") for side in (rows, texts_of))
        blocks = F.coalesce("_blocks", F.lit(1))
    block = F.pmod(F.xxhash64("_row.sentence"), blocks).cast("int").alias("_block")
    each = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block")
    rows = rows.withColumn("_block", block).select(
        _page_key(page, F.col("_block")).alias("_key"), F.lit(None).cast("array<string>").alias("_texts"), "_row", *order
    )
    first = [F.lit(None).cast(types[c]).alias(c) for c in order]
    texts_of = texts_of.select(*page, "_texts", each).select(
        F.to_json(F.struct(*page, "_block")).alias("_key"), "_texts",
        F.struct(*[F.col(c) if c in page else F.lit(None).cast(t).alias(c) for c, t in types.items()]).alias("_row"), *first,
    )
    dealt = texts_of.unionByName(rows).repartition("_key")
    return dealt.sortWithinPartitions("_key", F.col("_texts").isNull(), *order).select("_key", "_texts", "_row")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.StructScalar], list[list[bytes | None]], list[pa.Array], bool]]:
    """(page rows, their texts, gathered rows, whether the group ends) of each key; a large group comes in several parts."""
    key, heads, texts, gathered, count, size = None, [], [], [], 0, 0
    for batch in batches:
        keys = batch.column("_key")
        runs = keys.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero(runs[1:] != runs[:-1]) + 1
        is_text = batch.column("_texts").is_valid().to_numpy(zero_copy_only=False)
        for first, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(runs)].tolist(), strict=True):
            if first == end:
                continue
            if (own := keys[first].as_py()) != key:
                if key is not None:
                    yield heads, texts, gathered, True
                key, heads, texts, gathered, count, size = own, [], [], [], 0, 0
            n = int(is_text[first:end].sum())
            for i in range(first, first + n):
                heads.append(batch.column("_row")[i])
                texts.append([None if t is None else t.encode() for t in batch.column("_texts")[i].as_py()])
            if first + n < end:
                gathered.append(batch.column("_row").slice(first + n, end - first - n))
                count, size = count + len(gathered[-1]), size + gathered[-1].nbytes
            if count > GATHERED or size > GATHERED_BYTES:
                yield heads, texts, gathered, False
                gathered, count, size = [], 0, 0
    if key is not None:
        yield heads, texts, gathered, True


def _with_presence(
    df: DataFrame, pages: DataFrame, page: Sequence[str], texts: Sequence[str], counted: DataFrame, markup: bool = False
) -> DataFrame:
    """Adds ``_in_<text>`` for each page text, and ``_markup`` on request: the sentence may match what a highlighter puts in.

    A row without a page or a sentence, or of a page without texts, is in none; a page of several rows has all their texts.
    """
    flags = [f"_in_{t}" for t in texts] + ["_markup"] * markup
    columns = [*df.columns, *flags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sources, gathered, _ in _groups(batches):
            if not gathered:
                continue
            rows = pa.concat_arrays(gathered)
            said = rows.field("sentence").to_pylist()
            given = [i for i, s in enumerate(said) if s is not None]
            sentences = [said[i].encode() for i in given]
            found = np.zeros((len(flags), len(said)), dtype=bool)
            for own in sources:
                for at, text in enumerate(own):
                    found[at, given] |= present_in(text, sentences)
            if markup and sources:
                found[-1, given] = _may_meet_markup([t for own in sources for t in own if t is not None], sentences)
            yield pa.RecordBatch.from_arrays([*rows.flatten(), *(pa.array(f) for f in found)], columns)

    schema = StructType([*df.schema.fields, *(StructField(f, BooleanType()) for f in flags)])
    return _meet(df, pages, page, texts, counted).mapInArrow(run, schema)


def _any_of(texts: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in texts:
        found = found | F.col(f"_in_{t}")
    return found


def with_grounding(
    df: DataFrame, pages: DataFrame, page: Sequence[str] = PAGE, texts: Sequence[str] = TEXTS, counted: DataFrame | None = None
) -> DataFrame:
    """Adds ``grounded``: the sentence is a literal part of one of the page texts.

    ``counted`` may name a cheaper table with at least as many rows for each page, from which blocks are planned.
    """
    checked = _with_presence(df, pages, page, texts, df if counted is None else counted)
    return checked.select(*df.columns, _any_of(texts).alias("grounded"))


def sentence_index(
    df: DataFrame, page: Sequence[str] = PAGE, order: Sequence[str] | None = None
) -> DataFrame:
    """Distinct sentences of each page, numbered from 1 by first appearance."""
    order = list(order or [c for c in ("row_id", "pos") if c in df.columns])
    rows = df.filter(present(*page, "sentence"))
    firsts = rows.groupBy(*page, "sentence").agg(F.min(row_order(df, order)).alias("_first"))
    if len(order) == 1:
        firsts = firsts.withColumnRenamed("_first", order[0])
    else:
        firsts = firsts.select(*page, "sentence", "_first.*")
    numbered = occurrence_number(firsts, page, row_id=order[0], then_by=order[1:], name="_n")
    return numbered.select(*page, (F.col("_n") + 1).alias("index"), "sentence")


def sentence_presence(
    df: DataFrame, pages: DataFrame, page: Sequence[str] = PAGE, order: Sequence[str] | None = None
) -> DataFrame:
    """The sentence index of each page with one flag per page text and their disjunction."""
    flagged = _with_presence(sentence_index(df, page, order), pages, page, TEXTS, df)
    return flagged.select(
        *page,
        "index",
        "sentence",
        F.col("_in_markdown_full").alias("in_markdown_full"),
        F.col("_in_cleaned_markdown").alias("in_cleaned_markdown"),
        _any_of(TEXTS).alias("found_anywhere"),
    )


def sentence_audit(df: DataFrame, pages: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Every annotation row with its grounding flag; each distinct sentence of a page is tested once."""
    columns = [*page, "sentence", "aspect", "sentiment", "model"]
    rows = df.select(*[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    distinct = rows.select(*page, "sentence").filter(present(*page, "sentence")).distinct()
    flags = with_grounding(distinct, pages, page, counted=rows)
    flagged = rows.join(flags, [*page, "sentence"], "left")
    return flagged.select(*columns, F.coalesce("grounded", F.lit(False)).alias("grounded"))


def grounded_sentences(audit: DataFrame) -> DataFrame:
    return audit.filter("grounded").drop("grounded")


def ungrounded_sentences(audit: DataFrame) -> DataFrame:
    return audit.filter("NOT grounded").drop("grounded")


def grounding_scorecard(
    df: DataFrame,
    pages: DataFrame,
    page: Sequence[str] = PAGE,
    by_model: bool = False,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Distinct sentences, grounded and not grounded, per page, and per page and model.

    ``by_model`` gives the long per-model table; a list of ``models`` adds a pair of
    columns per model to the page table instead. Each distinct sentence of a page
    is tested once; it carries the set of its models from there on.
    """
    rows = df.filter(present(*page))
    distinct = rows.groupBy(*page, "sentence").agg(F.collect_set("model").alias("models"))
    flagged = with_grounding(distinct, pages, page, counted=rows)
    has_text = F.col("sentence").isNotNull()
    is_hit = (has_text & F.col("grounded")).cast("int")
    is_miss = (has_text & ~F.col("grounded")).cast("int")
    by_pair = flagged.select(
        *page, is_hit.alias("hit"), is_miss.alias("miss"), F.posexplode_outer("models").alias("at", "model")
    )
    # A sentence shared by several models counts for the page only once, at position 0.
    once = F.coalesce(F.col("at"), F.lit(0)) == 0
    per_model = by_pair.groupBy(*page, "model").agg(
        F.sum("hit").alias("grounded"),
        F.sum("miss").alias("not_grounded"),
        F.sum(F.when(once, F.col("hit")).otherwise(0)).alias("page_hit"),
        F.sum(F.when(once, F.col("miss")).otherwise(0)).alias("page_miss"),
    )
    if by_model:
        return per_model.filter("model IS NOT NULL").drop("page_hit", "page_miss")
    wide = []
    for m in models or []:
        for count in ("grounded", "not_grounded"):
            total = F.sum(F.when(F.col("model") == m, F.col(count)).otherwise(0))
            wide.append(total.alias(f"{m}_{count}"))
    return per_model.groupBy(*page).agg(
        F.count("model").alias("num_llms"),
        F.sum(F.col("page_hit") + F.col("page_miss")).alias("total_sentences"),
        F.sum("page_hit").alias("grounded"),
        F.sum("page_miss").alias("not_grounded"),
        *wide,
    )


_OPEN, _CLOSE = OPEN_TAG.encode(), CLOSE_TAG.encode()
_WHOLE_TAGS = re.compile(re.escape(_OPEN) + rb"\[\d+\] |" + re.escape(_CLOSE))
_AFTER_TAG = re.compile(rb"(?:\[?\d*\])? ")
_END_OF_TAG = re.compile(rb"([^<>]*>)(\[\d+\] )?")
_OPENED_LAST = re.compile(re.escape(_OPEN) + rb"\[?\d*\]?$")
_IN_NUMBER = re.compile(rb"\[?\d*\]? ?")


def _without_cut_tags(piece: bytes, first: bool, last: bool) -> bytes:
    """A piece between whole tags without the end of a tag it begins with, or the beginning of one it ends with."""
    if first and (tag := _END_OF_TAG.match(piece)) and (_OPEN.endswith(tag[1]) or _CLOSE.endswith(tag[1])):
        piece = piece[tag.end() :]
    elif first and (tag := _AFTER_TAG.match(piece)):
        piece = piece[tag.end() :]
    if last and (tag := _OPENED_LAST.search(piece)):
        piece = piece[: tag.start()]
    elif last and (tag := re.search(rb"<[^<>]*$", piece)) and (_OPEN.startswith(tag[0]) or _CLOSE.startswith(tag[0])):
        piece = piece[: tag.start()]
    return piece


def _beside_markup(sentence: bytes) -> list[bytes] | None:
    """What a match that reaches into markup must find in the text itself; None if no such match is possible.

    A sentence reaches into markup if it holds a tag, starts with the end or stops with the beginning of one, or lies inside one.
    """
    if not sentence:
        return None
    if sentence in _OPEN or sentence in _CLOSE or _IN_NUMBER.fullmatch(sentence):
        return []
    if b"<" not in sentence and b">" not in sentence and not _AFTER_TAG.match(sentence):
        return None  # as most are
    pieces = _WHOLE_TAGS.split(sentence)
    bare = [_without_cut_tags(p, i == 0, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    if len(pieces) == 1 and bare == pieces:
        return None
    return [p for p in bare if p]


def _may_meet_markup(texts: list[bytes], sentences: list[bytes]) -> np.ndarray:
    """Which sentences may match in one of the texts once markup has been put in, with that markup."""
    beside = {i: parts for i, s in enumerate(sentences) if (parts := _beside_markup(s)) is not None}
    asked = sorted({p for parts in beside.values() for p in parts})
    found = np.zeros(len(sentences), dtype=bool)
    for text in texts:
        held = {p for p, hit in zip(asked, present_in(text, asked), strict=True) if hit}
        for i, parts in beside.items():
            found[i] |= held.issuperset(parts)
    return found


def _marked(text: bytes | None, marks: list[tuple[int, bytes]]) -> bytes:
    """The text with every sentence wrapped, lower indices first, as repeated replacing gives it."""
    if text is None:
        return b""
    result, starts = spliced(text, marks, _OPEN, _CLOSE)
    if _reaches_into_markup(text, marks, starts):
        for index, sentence in sorted(marks):
            text = text.replace(sentence, _OPEN + b"[%d] " % index + sentence + _CLOSE)
        return text
    return result


def _reaches_into_markup(text: bytes, marks: list[tuple[int, bytes]], starts: list[tuple[int, int]]) -> bool:
    """Whether a sentence may match markup of one before it; words after the end of a tag must begin where one was put."""
    if not starts:
        return False
    lowest = min(index for _, index in starts)
    after: list[tuple[int, bytes]] = []
    for index, sentence in marks:
        parts = _beside_markup(sentence) if index > lowest else None
        if parts is None:
            continue
        if len(parts) != 1 or b"<" in sentence or b">" in sentence:
            if _IN_NUMBER.fullmatch(sentence) and len(re.findall(rb"\d", sentence)) > len(str(index)):
                continue  # no number put in is as long
            return True
        after.append((index, parts[0]))
    first_at: dict[int, int] = {}
    for place, index in starts:
        first_at[place] = min(index, first_at.get(place, index))
    for which, at in places(text, [rest for _, rest in after]):
        if any(p in first_at and first_at[p] < after[s][0] for s, p in zip(which.tolist(), at.tolist(), strict=True)):
            return True
    return False


def highlight_pages(
    df: DataFrame, pages: DataFrame, page: Sequence[str] = PAGE, order: Sequence[str] | None = None
) -> DataFrame:
    """Page texts with every sentence wrapped in markup, in the order of the sentence index.

    A sentence is put in wherever it stands, unless markup put in before lies inside. Only sentences that can be found are gathered,
    so the list of a page is bounded by what its text and the markup hold and not by how many sentences models
    made up for it. Their places are found in one reading and the text is built once; only a page with a sentence that may match the
    markup itself is rewritten sentence by sentence. Empty sentences are skipped. A missing text gives ''. Where a sentence lies inside
    a tag (``e``, ``1``), others may match the pieces that it leaves of the tag; such sentences are not looked for.
    """
    tested = _with_presence(sentence_index(df, page, order), pages, page, TEXTS, df, markup=True)
    found = tested.filter((_any_of(TEXTS) | F.col("_markup")) & (F.col("sentence") != "")).select(*page, "index", "sentence")
    names = [f"highlighted_{t}" for t in TEXTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[tuple[int, bytes]] = []
        for heads, texts, gathered, last in _groups(batches):
            for rows in gathered:
                marks += zip(rows.field("index").to_pylist(), (s.encode() for s in rows.field("sentence").to_pylist()), strict=True)
            if last and heads:
                kinds = [heads[0].type.field(c).type for c in page]
                columns = [pa.array([h[c].as_py() for h in heads], kind) for c, kind in zip(page, kinds, strict=True)]
                marked = [pa.array([_marked(own[i], marks).decode() for own in texts], pa.string()) for i in range(len(TEXTS))]
                yield pa.RecordBatch.from_arrays([*columns, *marked], [*page, *names])
            if last:
                marks = []

    types = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in page), *(f"{n} string" for n in names)])
    return _meet(found, pages, page, TEXTS, None).mapInArrow(run, schema)
