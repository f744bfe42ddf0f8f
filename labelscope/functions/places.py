"""Where many sentences stand in one text, found by one reading of the text for each doubling of length.

A few sentences are searched for one after the other instead, which is faster than naming runs. With more of them
every run of 1, 2, 4, ... bytes gets a 64-bit name; the names of runs of twice the length come from those of
their halves. A sentence is found by the names of its longest such beginning and end, which together cover it,
and each find is compared by bytes. Time grows with the text, the sentences and the finds, not with
sentences times text. UTF-8 bytes match where characters match.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of a text that are named together; a longer one is taken in overlapping windows.
WINDOW = 1 << 22
#: Pairs of place and sentence that are looked at together.
PAIRS = 1 << 20
#: So few sentences are searched for one by one, or as many as have this product with the bytes of the text. One with more
#: places than ``OFTEN`` is then found by names too.
FEW, TRIED, OFTEN = 200, 1 << 24, 64

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTES = _spread(np.arange(1, 257, dtype=np.uint64) * _ODD)


class Names:
    """Names of all runs of one text that are ``1 << level`` bytes long; levels may only rise."""

    def __init__(self, text: np.ndarray) -> None:
        self.level, self.names = 0, _BYTES[text]

    def at(self, level: int) -> np.ndarray:
        while self.level < level:
            half = 1 << self.level
            n = len(self.names) - half
            if n <= 0:
                self.names = self.names[:0]
            else:
                self.names = _spread(self.names[:n] * _ODD + self.names[half:])
            self.level += 1
        return self.names


def _bytes(parts: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.uint8)


def _are_few(text: bytes, sentences: Sequence[bytes]) -> bool:
    return len(sentences) <= FEW or len(sentences) * len(text) <= TRIED


def places(text: bytes, sentences: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sentence, place) of every occurrence of the non-empty sentences, overlapping ones too, in runs of no certain order."""
    if not _are_few(text, sentences):
        yield from _places_by_names(text, sentences)
        return
    often, counts, every = [], [], []
    for i, sentence in enumerate(sentences):
        found, at = [], text.find(sentence) if sentence else -1
        while at >= 0 and len(found) < OFTEN:
            found.append(at)
            at = text.find(sentence, at + 1)
        if at >= 0:
            often.append(i)
            found = []
        counts.append(len(found))
        every += found
    if every:
        yield np.repeat(np.arange(len(counts)), counts), np.array(every)
    if often:
        for which, place in _places_by_names(text, [sentences[i] for i in often]):
            yield np.array(often)[which], place


def _places_by_names(text: bytes, sentences: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(s) for s in sentences], dtype=np.int64)
    levels = np.where(sizes > 0, np.frexp(np.maximum(sizes, 1))[1] - 1, -1)
    longest = int(sizes.max(initial=0))
    for first in range(0, len(text), WINDOW):
        # a sentence that begins in this window ends in what is added to it
        window = text[first : first + WINDOW + longest - 1] if longest else b""
        named = Names(np.frombuffer(window, dtype=np.uint8))
        for level in np.unique(levels[(levels >= 0) & (sizes <= len(window))]).tolist():
            which = np.flatnonzero(levels == level)
            yield from _of_level(window, first, min(WINDOW, len(text) - first), named.at(level), sentences, which, sizes[which], level)


def _of_level(
    window: bytes, shift: int, inside: int, names: np.ndarray, sentences: Sequence[bytes], which: np.ndarray, sizes: np.ndarray, level: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    own = Names(_bytes([sentences[i] for i in which])).at(level)
    ends = np.cumsum(sizes)
    heads, tails = own[ends - sizes], own[ends - (1 << level)]
    order = np.argsort(heads, kind="stable")
    known, begins, counts = np.unique(heads[order], return_index=True, return_counts=True)
    at = np.searchsorted(known, names[:inside])
    at[at == len(known)] = 0
    hits = np.flatnonzero(known[at] == names[:inside]) if len(names) else np.zeros(0, dtype=np.int64)
    group = at[hits]
    total = np.cumsum(counts[group])
    first = 0
    while first < len(hits):  # as many places as make a bounded number of pairs
        end = max(first + 1, int(np.searchsorted(total, total[first] - counts[group[first]] + PAIRS, side="right")))
        some, of = hits[first:end], group[first:end]
        first = end
        n = counts[of]
        place = np.repeat(some, n)
        member = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[of], n)
        sentence = order[member]
        last = place + sizes[sentence] - (1 << level)
        fits = last < len(names)
        place, sentence, last = place[fits], sentence[fits], last[fits]
        same = names[last] == tails[sentence]
        place, sentence = place[same], which[sentence[same]]
        real = np.fromiter(
            (window.startswith(sentences[s], p) for s, p in zip(sentence.tolist(), place.tolist(), strict=True)), dtype=bool, count=len(place)
        )
        if real.any():
            yield sentence[real], place[real] + shift


def present(text: bytes | None, sentences: Sequence[bytes]) -> np.ndarray:
    """Which of the sentences occur in the text; the empty one occurs in every text, nothing in a missing one."""
    found = np.zeros(len(sentences), dtype=bool)
    if text is None:
        return found
    if _are_few(text, sentences):
        found[[i for i, s in enumerate(sentences) if s in text]] = True
        return found
    found[[i for i, s in enumerate(sentences) if not s]] = True
    for which, _ in places(text, sentences):
        found[which] = True
    return found


def spliced(text: bytes, marks: Sequence[tuple[int, bytes]], opening: bytes, closing: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The text with each found sentence wrapped, and where the wrapped ones begin, as (place, index).

    ``marks`` are (index, sentence); lower indices go first. A sentence is wrapped wherever no edge of one
    wrapped before lies inside it, from left to right without overlap: what repeated replacing gives as long as no
    sentence matches what has been put in. A wrapped text opens with ``opening`` and ``[index] ``.
    """
    marks = sorted(marks)
    found: list[list[np.ndarray]] = [[] for _ in marks]
    for which, place in places(text, [s for _, s in marks]):
        order = np.argsort(which, kind="stable")
        which, place = which[order], place[order]
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        for s, part in zip(which[starts].tolist(), np.split(place, starts[1:]), strict=True):
            found[s].append(part)
    edges = bytearray(len(text) + 1)
    opens: dict[int, list[int]] = {}
    closes: dict[int, int] = {}
    for (index, sentence), parts in zip(marks, found, strict=True):
        taken, free = [], 0
        for place in np.sort(np.concatenate(parts)).tolist() if parts else ():
            end = place + len(sentence)
            if place >= free and edges.find(1, place + 1, end) < 0:
                taken.append(place)
                free = end
        for place in taken:
            end = place + len(sentence)
            edges[place] = edges[end] = 1
            opens.setdefault(place, []).append(index)
            closes[end] = closes.get(end, 0) + 1
    out, last = [], 0
    for place in sorted({*opens, *closes}):
        out.append(text[last:place])
        out.append(closing * closes.get(place, 0))
        out.extend(opening + b"[%d] " % index for index in opens.get(place, ()))
        last = place
    out.append(text[last:])
    return b"".join(out), [(place, index) for place, indices in opens.items() for index in indices]
