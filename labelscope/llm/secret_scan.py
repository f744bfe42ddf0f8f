"""Secrets in texts: fixed patterns, and windows of high entropy in candidate strings.

A candidate is a long run of characters of one class, inside one segment: what lies between equals signs and, in a path, between
slashes. A window slides over it; its Shannon entropy follows from counts that change by two characters a step. Windows above the
threshold of the class are merged into spans, unless an allow-list knows the segment or the word that holds them; a name or folder ahead
of a key does not hide the key.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelscope.llm.shared import small_batches

# Fixed patterns of the base kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(?P<name>password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}


@dataclass(frozen=True)
class CharacterClass:
    """Candidates: runs of ``characters`` of at least ``window``. ``bits`` is the least entropy of a window, ``needs`` what a window must hold,
    ``turns`` how often letters and digits must change places in it.
    """

    name: str
    characters: str
    window: int
    bits: float
    needs: tuple[str, ...]
    turns: int = 0


CLASSES = (
    CharacterClass("entropy_hex", "0-9a-fA-F", 24, 3.2, ("0-9", "a-fA-F")),
    CharacterClass("entropy_base32", "A-Z2-7", 24, 3.8, ("A-Z", "2-7")),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_-", 20, 3.8, ("A-Z", "a-z", "0-9")),
    CharacterClass("entropy_lower", "a-z0-9", 16, 3.4, ("a-z", "0-9"), 4),
    CharacterClass("entropy_upper", "A-Z0-9", 16, 3.4, ("A-Z", "0-9"), 4),
)
#: Segments that are no secrets: UUIDs, integrity hashes.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"sha(256|384|512)-.*",
)
#: Words that are no secrets if they hold one of these: documented examples and placeholders.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "redacted", "lorem")
#: Runs that are paths: their folders and their last name are segments.
PATH = re.compile(r"(/?[a-z0-9_.-]+/){2,}[A-Za-z0-9_.-]*")
#: Characters of a candidate from which counts are kept for all its windows at once, and of a piece of it.
LONG, PIECE = 200, 1 << 16


def entropy_windows(text: str, window: int, least: float) -> Iterator[int]:
    """Starts of the windows of ``text`` whose Shannon entropy, in bits a character, is at least ``least``.

    ``sum c log2 c`` over the counts is kept up to date: a step changes the counts of
    the character that leaves and of the one that comes.
    """
    log = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    most = (math.log2(window) - least) * window
    counts: dict[str, int] = {}
    total = 0.0
    for i, character in enumerate(text):
        c = counts.get(character, 0)
        total += log[c + 1] - log[c]
        counts[character] = c + 1
        if i >= window:
            old = text[i - window]
            c = counts[old]
            total += log[c - 1] - log[c]
            counts[old] = c - 1
        if i >= window - 1 and total <= most + 1e-9:
            yield i - window + 1


def _many_windows(text: str, window: int, least: float) -> np.ndarray:
    """``entropy_windows`` of a long text, with the counts of each character summed up along a piece of it."""
    log = np.array([0.0, *(c * math.log2(c) for c in range(1, window + 1))])
    most = (math.log2(window) - least) * window
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    found = []
    for first in range(0, len(codes) - window + 1, PIECE):
        known, at = np.unique(codes[first : first + PIECE + window - 1], return_inverse=True)
        total = np.zeros(len(at) - window + 1)
        for c in range(len(known)):
            ahead = np.concatenate([[0], np.cumsum(at == c)])
            total += log[ahead[window:] - ahead[:-window]]
        found.append(first + np.flatnonzero(total <= most + 1e-9))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _held(flags: list[bool], starts: list[int], window: int, least: int) -> list[int]:
    """The starts whose window holds at least so many of the flagged places."""
    ahead = [0, *accumulate(flags)]
    return [i for i in starts if ahead[min(i + window, len(flags))] - ahead[i] >= least]


def secret_windows(candidate: str, kind: CharacterClass, needs: Sequence[re.Pattern]) -> list[int]:
    """Starts of the windows of a candidate that pass all that the class asks."""
    if not all(need.search(candidate) for need in needs):
        return []
    long = len(candidate) >= LONG
    starts = (_many_windows if long else entropy_windows)(candidate, kind.window, kind.bits)
    starts = starts.tolist() if long else list(starts)
    for need in needs:
        if starts:
            starts = _held([bool(need.match(c)) for c in candidate], starts, kind.window, 1)
    if kind.turns and starts:
        turned = [_digit(a) != _digit(b) for a, b in zip(candidate, candidate[1:])]
        starts = _held(turned, starts, kind.window - 1, kind.turns)
    return starts


_SEGMENT, _PATH_SEGMENT, _WORD = re.compile("[^=]+"), re.compile("[^=/]+"), re.compile("[A-Za-z0-9]+")


class SecretScanner:
    def __init__(
        self, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED, placeholders: Sequence[str] = PLACEHOLDERS
    ) -> None:
        self.classes = [
            (c, re.compile(f"(?<![{c.characters}])[{c.characters}]{{{c.window},}}"), [re.compile(f"[{need}]") for need in c.needs])
            for c in classes
        ]
        self.allowed = re.compile("|".join(f"(?:{x})" for x in allowed)) if allowed else None
        self.placeholder = re.compile("(?i:" + "|".join(map(re.escape, placeholders)) + ")") if placeholders else None
        self.shortest = min((c.window for c in classes), default=1)
        self.longest = re.compile(f"[A-Za-z0-9+/_=-]{{{self.shortest},}}")

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for m in ASSIGN.finditer(text):
            if m.end("value") - m.start("value") >= LEAST["assign"]:
                found.append((m.start(), m.end(), "assign"))
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= LEAST[kind]]
        return found

    def segments(self, run: str) -> Iterator[tuple[int, str]]:
        """(place, segment) of what may hold a secret in a run; words with a placeholder are blanked."""
        for m in (_PATH_SEGMENT if PATH.fullmatch(run) else _SEGMENT).finditer(run):
            segment = m.group()
            if len(segment) < self.shortest or (self.allowed is not None and self.allowed.fullmatch(segment)):
                continue
            if self.placeholder is not None and self.placeholder.search(segment):
                segment = _WORD.sub(lambda w: " " * len(w[0]) if self.placeholder.search(w[0]) else w[0], segment)
            yield m.start(), segment

    def by_entropy(self, text: str) -> list[tuple[int, int, str]]:
        found = []
        for run in self.longest.finditer(text):
            for place, segment in self.segments(run.group()):
                for kind, pattern, needs in self.classes:
                    for m in pattern.finditer(segment):
                        base, last = run.start() + place + m.start(), None
                        for start in secret_windows(m.group(), kind, needs):
                            a, b = base + start, base + start + kind.window
                            if last is not None and a <= found[-1][1]:
                                found[-1] = (found[-1][0], b, kind.name)
                            else:
                                found.append((a, b, kind.name))
                            last = b
        return found

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base spans, spans by entropy), each by start, then by kind as listed."""
        text = text or ""
        order = {kind: i for i, kind in enumerate((*KINDS, *(c.name for c, _, _ in self.classes)))}
        key = lambda span: (span[0], order[span[2]], span[1])
        return sorted(self.base(text), key=key), sorted(self.by_entropy(text), key=key)

    def merged(self, text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        base, extra = self.scan(text)
        order = {kind: i for i, kind in enumerate((*KINDS, *(c.name for c, _, _ in self.classes)))}
        return base, sorted(base + extra, key=lambda span: (span[0], order[span[2]], span[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(
    docs: DataFrame, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED, placeholders: Sequence[str] = PLACEHOLDERS
) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``) with the secrets in its whole text.

    ``n_assign, n_access, n_hex`` count the base spans, ``base_sha256`` is of them, ``spans`` has all spans with those by
    entropy (``n_entropy``) as ``kind:start:end`` in code points. The allow-list drops spans by entropy
    only. A null text is empty and has no spans; repeated rows are scanned alike; no rows give none;
    other columns are not read. Very long texts and candidates are read whole, in time that grows with their length.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(classes, allowed, placeholders)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, spans = scanner.merged(text.as_py())
                kinds = [span[2] for span in base]
                rows.append((*(kinds.count(kind) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    )
