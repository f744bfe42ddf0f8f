"""Jaccard self-join of documents on word shingles, with PartEnum signatures.

Sizes are cut into bands so that two sets of the asked similarity lie in the same band or
in neighbouring ones. For a band with largest size r such sets differ in at most
``k = floor(2 r (100 - t) / (100 + t))`` shingles. The domain of shingles is hashed into
``n1 = floor(k / (k2 + 1)) + 1 + slack`` parts of ``n2`` sub-parts each, so in at least ``slack + 1`` parts
two such sets differ in ``k2`` shingles at most, and agree on some ``n2 - k2`` of the
sub-parts. What a set holds in such a choice of sub-parts is a signature. A set leaves
out the signatures that hold next to nothing. If they lie in no more than ``slack`` parts, a part is left where all
are stated. If they lie in more, the set is cut anew by another hash, and states what that gives as well: two sets that share no
other signature than ones that hold next to nothing hold the same there, so both do. What is still left after
some rounds is stated as it is. Sets so small that they may not differ at all have one signature, the whole set. Thus no link is lost.

What follows is exact: the smallest member of each signature is a centre, and each
member meets its centre; those of its members that links do not join already meet in blocks: the members of its largest
component stay in their block, the others visit every block. A parity sketch gives a lower bound of the difference and so
drops pairs safely; what is left is compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelscope.llm.components import components
from labelscope.llm.shared import Scratch, bloom, in_bloom, mix, written
from labelscope.llm.text import NOT_SPACE, chunks, shingle_sets, words_of

#: Members of a centre in a block of the second comparison.
BLOCK = 256
#: Sets that a task remembers as stated; beyond that it forgets, and may state some again.
MOST_SEEN = 500_000


def bands(percent: int, largest: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band, up to one that holds ``largest``."""
    low, found = 1, []
    while not found or found[-1][1] < largest:
        high = low * 100 // percent
        found.append((low, high))
        low = high + 1
    return found


#: Sub-parts of a part, and shingles that may differ in one: every choice of ``N2 - K2`` sub-parts is a signature.
N2, K2 = 3, 1
CHOICES = tuple(combinations(range(N2), N2 - K2))
#: How often a set is cut anew because too many of its signatures hold next to nothing.
ROUNDS = 6


def parts_of_band(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """(parts, slack, least): into how many parts to cut, and in how many to leave out signatures of fewer than ``least`` shingles."""
    needed = 2 * high * (100 - percent) // (100 + percent) // (K2 + 1) + 1
    for least in (3, 2, 1):
        for slack in range(needed // 3 + 1):
            parts = needed + slack
            mean = low / parts * (N2 - K2) / N2
            thin = np.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(least))
            few = parts * (1 - (1 - thin) ** len(CHOICES))
            if few + 2 * np.sqrt(few) <= slack:
                return parts, slack, least
    return needed, 0, 1


def differ_at_most(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles two sets of these sizes may not share."""
    return (100 - percent) * (a + b) // (100 + percent)


class Signatures:
    """Signatures of sets; tables of bands grow with the largest set seen."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.highs = np.zeros(0, dtype=np.int64)
        self.plans = np.zeros((0, 3), dtype=np.int64)
        self.whole = np.zeros(0, dtype=bool)  # bands of sets that are alike or not linked

    def _grow(self, largest: int) -> None:
        if len(self.highs) < 2 or self.highs[-2] < largest:
            found = bands(self.percent, 2 * largest + 2)
            self.highs = np.array([high for _, high in found], dtype=np.int64)
            self.plans = np.array([parts_of_band(*band, self.percent) for band in found], dtype=np.int64)
            self.whole = 2 * self.highs * (100 - self.percent) // (100 + self.percent) == 0

    def of(self, shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, set) of each part that a set states, for its own band and the next."""
        sizes = np.diff(first)
        if not len(shingles):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self._grow(int(sizes.max()))
        band = np.searchsorted(self.highs, sizes)
        out = []
        whole = np.flatnonzero(self.whole[band] & (sizes > 0))
        if len(whole):
            sums = np.zeros(len(shingles) + 1, dtype=np.uint64)
            np.cumsum(mix(shingles ^ np.uint64(0x7FB5D329728EA185)), out=sums[1:])
            alike = mix(sums[first[whole + 1]] - sums[first[whole]] + sizes[whole].astype(np.uint64))
            out.append((mix(alike ^ np.uint64(0x94D049BB133111EB)), whole))
        for next_band in (0, 1):
            tag = band + next_band
            open_ = np.flatnonzero(~self.whole[tag] & (sizes > 0))
            for turn in range(ROUNDS):
                if not len(open_):
                    break
                keep = np.zeros(len(sizes), dtype=bool)
                keep[open_] = True
                names, whose, again = self._cut(
                    shingles[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[open_])]), tag[open_], turn, turn == ROUNDS - 1
                )
                out.append((names, open_[whose]))
                open_ = open_[again]
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _cut(self, shingles: np.ndarray, first: np.ndarray, tag: np.ndarray, turn: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, set) by the hash of this turn, and the sets that need another; the last turn leaves nothing out."""
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        value = mix(shingles ^ np.uint64(0xA24BAED4963EE407))
        spread = mix(shingles + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(32)
        parts, slack, least = self.plans[tag].T
        base = np.concatenate([[0], np.cumsum(parts)])
        at = (spread * (parts * N2)[owner].astype(np.uint64)) >> np.uint64(32)
        slot = base[owner] * N2 + at.astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        held = np.bincount(slot, minlength=base[-1] * N2).reshape(-1, N2)
        total = np.zeros(base[-1] * N2, dtype=np.uint64)
        total[slot[starts]] = np.add.reduceat(value[order], starts)
        total = mix(total.reshape(-1, N2) + (np.arange(N2, dtype=np.uint64) << np.uint64(32)) + np.uint64(1))
        whose = np.repeat(np.arange(len(sizes)), parts)
        thin = np.stack([held[:, c].sum(axis=1) < least[whose] for c in CHOICES], axis=1)
        many_thin = np.bincount(whose, weights=thin.any(axis=1), minlength=len(sizes)) > slack
        stated = ~thin | (many_thin[whose][:, None] if last else False)
        part = (np.arange(base[-1]) - base[whose]).astype(np.uint64)
        name = (tag[whose].astype(np.uint64) << np.uint64(32)) + np.uint64(turn << 40 | turn << 24) + part
        out = []
        for i, choice in enumerate(CHOICES):
            chosen = mix(name * np.uint64(len(CHOICES)) + np.uint64(i + 1))
            for sub in choice:
                chosen = mix(chosen + total[:, sub])
            out.append((chosen[stated[:, i]], whose[stated[:, i]]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]), np.flatnonzero(many_thin)


def digests(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, 0 for an empty one."""
    sums = np.zeros(len(shingles) + 1, dtype=np.uint64)
    np.cumsum(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    total = mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    total[total == 0] = 1
    return np.where(np.diff(first) > 0, total, np.uint64(0))


def sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the shingles that fall on each of ``bits`` bits: two sketches differ in no more bits than the sets differ."""
    count = np.bincount((mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8))


def sketch_bits(size: int) -> int:
    """A power of two, at least two bits for each shingle."""
    return max(64, 1 << (2 * size - 1).bit_length())


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes from a longer one: halves are added, so the bound stays true."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    """(batch, first row, end row, shingles, first) for each chunk of texts."""
    for batch in batches:
        for row, end, data, offsets in chunks(batch.column("text")):
            yield batch, row, end, *shingle_sets(words_of(data, offsets, NOT_SPACE), size)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, node``: the size of each document's set and its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, end, shingles, first in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, end - row), pa.array(np.diff(first)), _longs(digests(shingles, first))],
                ["doc_id", "n_shingles", "node"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, node long")


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``signature, node``; a set that a task sees again states nothing more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = Signatures(percent), set()
        for _, _, _, shingles, first in _sets(batches, shingle):
            names = digests(shingles, first)
            new = np.zeros(len(names), dtype=bool)
            new[np.unique(names, return_index=True)[1]] = True
            new &= np.array([x not in seen for x in names.tolist()], dtype=bool) & (names != 0)
            if len(seen) > MOST_SEEN:
                seen = set()
            seen.update(names[new].tolist())
            sizes = np.diff(first)
            keep = np.repeat(new, sizes)
            found, owner = plan.of(shingles[keep], np.concatenate([[0], np.cumsum(sizes[new])]))
            yield pa.RecordBatch.from_arrays([_longs(found), _longs(names[new][owner])], ["signature", "node"])

    return docs.select("text").mapInArrow(run, "signature long, node long")


def _of_nodes(docs: DataFrame, shingle: int, nodes: DataFrame, value: Callable[[np.ndarray], bytes], scratch: Scratch, name: str) -> DataFrame:
    """``node, n_shingles, value`` for the sets of ``nodes``: a filter of fixed size thins the scan, a join decides."""
    words = bloom(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, shingles, first in _sets(batches, shingle):
            names = digests(shingles, first)
            _, one = np.unique(names, return_index=True)
            one = one[(names[one] != 0) & in_bloom(words, names[one])]
            yield pa.RecordBatch.from_arrays(
                [_longs(names[one]), pa.array(np.diff(first)[one]),
                 pa.array([value(shingles[first[i] : first[i + 1]]) for i in one], pa.binary())],
                ["node", "n_shingles", "value"],
            )

    found = docs.select("text").mapInArrow(run, "node long, n_shingles long, value binary")
    single = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.max("value").alias("value"))
    return scratch.write(single, name)


def _stars(rows: DataFrame) -> DataFrame:
    """``centre, node, more`` from ``signature, node``: each member of a signature with its smallest one.

    ``more`` says that some signature of the two has a third member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = centre = before = None  # of the row ahead: signature, its centre, node
        place = 0  # and its place among the distinct members
        for batch in batches:
            signature, node = (batch.column(i).to_numpy() for i in (0, 1))
            if last is not None:  # the row ahead once more, so that runs go on
                signature, node = np.r_[last, signature], np.r_[before, node]
            fresh = np.r_[True, (signature[1:] != signature[:-1]) | (node[1:] != node[:-1])]
            signature, node = signature[fresh], node[fresh]
            if not len(node):
                continue
            starts = np.r_[True, signature[1:] != signature[:-1]]
            run_of = np.cumsum(starts) - 1
            first = np.flatnonzero(starts)
            centres, places = node[first], np.arange(len(node)) - first[run_of]
            if last is not None:
                centres[0] = centre
                places[run_of == 0] += place
            centres = centres[run_of]
            later = np.r_[places[1:] >= 2, False]  # the next row is a third member or beyond
            more = (places >= 2) | ((places == 1) & later)
            last, before, centre, place = signature[-1], node[-1], centres[-1], places[-1]
            kept = places > 0
            edge = np.unique(np.stack([centres[kept], node[kept], more[kept]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1]), pa.array(edge[:, 2] == 1)], ["centre", "node", "more"])

    stars = (
        rows.repartition(F.col("signature")).sortWithinPartitions("signature", "node")
        .mapInArrow(run, "centre long, node long, more boolean")
    )
    return stars.groupBy("centre", "node").agg(F.max("more").alias("more"))


def _near(pairs: DataFrame, percent: int, exact: bool) -> DataFrame:
    """The pairs ``a, b`` whose values ``x, y`` may be (sketches) or are (sets) similar enough; ``n, m`` are the sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name) for name in ("x", "y", "n", "m")]
            kept = []
            for i, (x, y, n, m) in enumerate(zip(*columns, strict=True)):
                x, y, n, m = x.as_buffer(), y.as_buffer(), n.as_py(), m.as_py()
                allowed = (100 - percent) * (n + m) // (100 + percent)
                if abs(n - m) > allowed:
                    continue
                if exact:
                    shared = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                    differ = n + m - 2 * shared
                else:
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    size = min(len(x), len(y))
                    differ = int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())
                if differ <= allowed:
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return pairs.select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long")


def _with_both(pairs: DataFrame, values: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs`` with columns of both ends: ``{column: (name for a, name for b)}``."""
    for i, end in enumerate(("a", "b")):
        pairs = pairs.join(values.select(F.col("node").alias(end), *(F.col(c).alias(names[i]) for c, names in columns.items())), end)
    return pairs


def _exact_links(docs: DataFrame, shingle: int, percent: int, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of few ``pairs`` that are similar enough, by their whole sets."""
    nodes = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    sets = _of_nodes(docs, shingle, nodes, np.ndarray.tobytes, scratch, "sets")
    both = _with_both(pairs, sets, {"value": ("x", "y"), "n_shingles": ("n", "m")})
    return scratch.write(_near(both, percent, exact=True), "links")


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``a, b`` for members of a centre in different components whose sketches allow a link.

    ``members`` has centre, node, label, n_shingles, the sketch as value, the number of blocks and the centre's largest label. Each member is
    a resident of one block; those of other labels than the largest also visit all blocks. A task holds the residents of a block, and
    visitors pass by, so rows are the members and, for each block, the visitors.
    """
    row = ["node", "label", "n_shingles", F.col("value").alias("sketch"), (F.col("label") == F.col("largest")).alias("stays")]
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    residents = members.select("centre", own.alias("block"), F.lit(False).alias("visits"), *row)
    visitors = members.filter("label <> largest").select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), *row
    )

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n_shingles", "stays"))

    def compared(held: list, batch: pa.RecordBatch) -> np.ndarray:
        node, label, n, stays, sketches, at_size = held
        found = []
        for own, its, size, sketch_ in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "n_shingles", "sketch")), strict=True):
            allowed = differ_at_most(n, np.int64(size), percent)
            # two visitors meet in the block of the one with the smaller name
            near = np.flatnonzero((label != its) & (np.abs(n - size) <= allowed) & (stays | (node < own)))
            if not len(near):
                continue
            bits = np.frombuffer(sketch_, np.uint8)
            width = min(len(bits), min(len(sketches[i]) for i in near))
            if width not in at_size:
                at_size[width] = {}
            folds = at_size[width]
            for i in near:
                if i not in folds:
                    folds[i] = folded(sketches[i], width) if len(sketches[i]) >= width else None
            differ = np.bitwise_count(np.stack([folds[i] for i in near]) ^ folded(bits, width)).sum(axis=1, dtype=np.int64)
            found += [(min(own, x), max(own, x)) for x in node[near[differ <= allowed[near]]].tolist()]
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("centre", "block", "visits")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for first, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(keys)].tolist(), strict=True):
                if first == end:
                    continue
                part = batch.slice(first, end - first)
                if tuple(keys[first, :2]) != key:
                    key, gathered, held = tuple(keys[first, :2]), [], None
                if not keys[first, 2]:
                    gathered.append(part)
                    continue
                if held is None:
                    if not gathered:
                        continue
                    sketches = [np.frombuffer(x.as_buffer(), np.uint8) for p in gathered for x in p.column("sketch")]
                    held = [*(np.concatenate(x) for x in zip(*(columns(p) for p in gathered), strict=True)), sketches, {}]
                found = compared(held, part)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return (
        residents.unionByName(visitors).repartition(F.col("centre"), F.col("block")).sortWithinPartitions("centre", "block", "visits")
        .mapInArrow(run, "a long, b long").distinct()
    )


def ngram_jaccard(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Two documents link when ``100 * shared >= percent * all`` of their distinct shingles of
    ``shingle`` words; ``component_id`` is the smallest id that links reach. A text of
    fewer words is one shingle; a null text, or one without words, links with nothing and is its own
    component. Rows with the same text are linked, whether their ids differ or not. A row
    without an id has the smallest id of its component, null if there is none. An empty table gives no rows.
    Other columns are not read. Sets are named by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, shingle), "fingerprints")
    stars = scratch.write(_stars(signatures(docs, shingle, percent)), "stars")
    sizes = prints.filter("n_shingles > 0").select("node", "n_shingles").distinct()
    sized = _with_both(stars.select(F.col("centre").alias("a"), F.col("node").alias("b")), sizes, {"n_shingles": ("n", "m")})
    allowed = F.floor(F.lit(100 - percent) * (F.col("n") + F.col("m")) / (100 + percent))
    edges = scratch.write(sized.filter(F.abs(F.col("n") - F.col("m")) <= allowed).select("a", "b"), "edges")
    # members of a centre too far from it in size may still be near each other
    nodes = scratch.write(stars.select(F.explode(F.array("centre", "node")).alias("node")).distinct(), "nodes")
    sketches = _of_nodes(docs, shingle, nodes, lambda x: sketch(x, sketch_bits(len(x))).tobytes(), scratch, "sketches")
    close = _near(_with_both(edges, sketches, {"value": ("x", "y"), "n_shingles": ("n", "m")}), percent, exact=False)
    links = _exact_links(docs, shingle, percent, scratch.write(close, "pairs"), scratch)
    labels = components(links, scratch)

    # what a centre did not join: its other members among themselves
    labelled = stars.filter("more").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_centres = (
        labelled.groupBy("centre", "label").agg(F.count("*").alias("members"))
        .groupBy("centre").agg(
            F.sum("members").alias("members"), F.count("*").alias("labels"), F.max(F.struct("members", "label")).alias("most"),
        )
        .filter("labels > 1")
        .select("centre", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.col("most.label").alias("largest"))
    )
    members = labelled.join(open_centres, "centre").join(sketches, "node")
    more = _exact_links(docs, shingle, percent, scratch.write(_block_pairs(members, percent), "pairs"), scratch)
    raised = (
        more.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    upper = components(raised, scratch).select(F.col("node").alias("base"), F.col("label").alias("top"))

    rows = (
        prints.join(labels, "node", "left").withColumn("base", F.coalesce("label", "node"))
        .join(upper, "base", "left").withColumn("base", F.coalesce("top", "base"))
        .select("doc_id", "n_shingles", "base")
    )
    smallest = rows.filter("n_shingles > 0").groupBy("base").agg(F.min("doc_id").alias("least"))
    found = rows.join(smallest, "base", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")
    )
    result = written(found, "components")
    scratch.drop()
    return result


def group_heads(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that head their component or have no id.

    Rows that share an id are one document: they stay or go together. The ids that go are looked for by a filter of
    fixed size in the scan, so only rows that may go are shuffled to the join that decides.
    """
    found = ngram_jaccard(docs, shingle, percent)
    goes = found.filter("doc_id <> component_id").select("doc_id").distinct()
    stays = found.filter("doc_id = component_id").select("doc_id").distinct()
    gone = written(goes.join(stays, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("gone")), "gone")
    words = bloom(gone, "gone")

    @F.pandas_udf("boolean")
    def may_go(keys):
        import pandas as pd

        return pd.Series(in_bloom(words, keys.to_numpy().view(np.uint64)))

    marked = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).withColumns({
        "id": F.col("row.doc_id").cast("long"),
    }).withColumn("maybe", may_go(F.xxhash64("id")))
    stays = marked.filter("id IS NULL OR NOT maybe").select("row")
    decided = marked.filter("id IS NOT NULL AND maybe").join(gone.select("id"), "id", "left_anti").select("row")
    return stays.unionByName(decided).select("row.*")
