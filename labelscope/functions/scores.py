"""Column expressions on score arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def best_class(scores: Column, classes: list[str]) -> Column:
    """Class with the highest score, the first of them on a tie."""
    at = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.try_element_at(F.array(*map(F.lit, classes)), F.when(at > 0, at))
