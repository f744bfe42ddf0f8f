"""Column expressions on plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from labelscope.defaults import NA_TOKENS, UNCLUSTERED, WHITE_SPACE


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character; plain ``trim`` removes blanks only."""
    return F.btrim(col.cast("string"), F.lit(WHITE_SPACE))


def fold(col: Column) -> Column:
    """The form in which labels and aliases are compared."""
    return F.lower(strip(col))


def null_if_na(col: Column, tokens: list[str] = NA_TOKENS) -> Column:
    return F.when(~col.isin(tokens), col)


def provider(model: Column) -> Column:
    """The part of ``provider/name`` before the first slash, or ``unknown``."""
    return F.when(F.contains(model, F.lit("/")), F.substring_index(model, "/", 1)).otherwise("unknown")


def present(*columns: str) -> Column:
    """None of the columns is NULL.

    Written out rather than left to ``dropna``: this form reaches the scan, and it
    vanishes for columns that cannot be NULL instead of computing them twice.
    """
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def contains_text(text: Column, sentence: Column) -> Column:
    """Literal substring test; a missing text or sentence is never a hit."""
    return F.coalesce(F.contains(text, sentence), F.lit(False))


def _quoted(letter: str) -> str:
    return letter if letter.isalnum() else f"\\x{{{ord(letter):x}}}"


def any_of(words: list[str]) -> str:
    """A pattern that finds any of the words literally, with common beginnings tried once.

    The look-ahead passes over all positions at which no word starts.
    """
    if not all(words):
        return ""  # the empty word is part of every text
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def branch(node: dict) -> str:
        if "" in node:
            return ""  # a word ends here; longer ones add nothing
        parts = [_quoted(letter) + branch(rest) for letter, rest in node.items()]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return f"(?=[{''.join(map(_quoted, tree))}]){branch(tree)}"


def keyword_cluster(
    lowered: Column, clusters: dict[str, list[str]], casefold_keywords: bool = False
) -> Column:
    """First cluster with a keyword inside the aspect, which must be lower-cased already.

    One compiled pattern tells whether any keyword occurs at all, then one per cluster
    which it is. A test per keyword would be slower by far: inside a lambda it runs
    uncompiled, and written out it makes a method too large for the JVM to compile.
    """
    if casefold_keywords:
        clusters = {cluster: [k.lower() for k in words] for cluster, words in clusters.items()}
    clusters = {cluster: words for cluster, words in clusters.items() if words}
    if not clusters:
        return F.lit(UNCLUSTERED)
    first, *others = clusters.items()
    chain = F.when(lowered.rlike(any_of(first[1])), first[0])
    for cluster, words in others:
        chain = chain.when(lowered.rlike(any_of(words)), cluster)
    known = lowered.rlike(any_of([k for words in clusters.values() for k in words]))
    return F.when(known, chain).otherwise(UNCLUSTERED)
