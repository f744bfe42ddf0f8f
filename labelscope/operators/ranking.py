"""Row numbers inside groups that may hold a large share of all rows.

A plain ``row_number`` puts a whole group into one task. Row ids let us do
without: a group is cut into slices of consecutive ids, rows are numbered inside
their slice, and the counts of the earlier slices of the group are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from labelscope.session import shared_table
from labelscope.sources.local import local_table

# A slice holds at most this many different row ids.
SLICE_ROWS = 1 << 20

SLICE = "_slice"


def slice_of(row_id: str = "row_id", slice_rows: int = SLICE_ROWS) -> Column:
    return F.expr(f"`{row_id}` div {slice_rows}L").alias(SLICE)


def earlier_rows(slices: DataFrame, keys: Sequence[str], count: str, name: str) -> DataFrame:
    """Rows of the group in the slices before each slice; input is one row per (keys, slice)."""
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn(name, F.coalesce(F.sum(count).over(before), F.lit(0)))


def occurrence_number(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str = "row_id",
    then_by: Sequence[str] = (),
    name: str = "occurrence",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """0-based number of each row inside its group by ``row_id``; keys must not be NULL.

    Groups inside one slice need nothing but the window. Only groups that span
    slices have an offset, so the joined table stays small unless many groups are
    large, and the join key spreads a large group over its slices.
    """
    keys = list(keys)
    sliced = df.withColumn(SLICE, slice_of(row_id, slice_rows))
    inside = Window.partitionBy(*keys, SLICE).orderBy(row_id, *then_by)
    numbered = sliced.withColumn("_inside", F.row_number().over(inside) - 1)
    counts = sliced.groupBy(*keys, SLICE).agg(F.count("*").alias("_rows"))
    offsets = (
        earlier_rows(counts, keys, "_rows", "_before").filter("_before > 0").select(*keys, SLICE, "_before")
    )
    number = F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0))
    return (
        numbered.join(offsets, [*keys, SLICE], "left")
        .withColumn(name, number.cast("long"))
        .select(*df.columns, name)
    )


def order_columns(df: DataFrame, order: Sequence[str] | None = None) -> list[str]:
    """The columns that stand for the row order of the source table."""
    if order is None:
        order = [c for c in ("row_id", "pos") if c in df.columns]
    if not order:
        raise ValueError("the table has no row_id; pass the ordering columns")
    return list(order)


def row_order(df: DataFrame, order: Sequence[str] | None = None) -> Column:
    """The row order as one column, a struct if it has several."""
    order = order_columns(df, order)
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


#: Digits of the integer types.
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}


def packed_order(df: DataFrame, order: Sequence[str]) -> Column:
    """The row order as one number if its columns are integers of 38 digits together, else as a struct.

    A number is state of fixed width: its minimum is taken by a hash aggregate, that of a struct by sorting.
    Columns after the first must not be negative or NULL.
    """
    digits = [_DIGITS.get(type(df.schema[c].dataType)) for c in order]
    if None in digits or sum(digits) > 38:
        return row_order(df, order)
    packed = F.col(order[0]).cast("decimal(38,0)")
    for c, n in zip(order[1:], digits[1:], strict=True):
        packed = (packed * F.expr(f"CAST('{10**n}' AS DECIMAL(20,0))") + F.col(c).cast("decimal(19,0)")).cast("decimal(38,0)")
    return packed


def global_number(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """0-based number of each row in the order of the whole table, as a table of the shared folder; the order must be total.

    Rows are dealt by range, sorted there and numbered in their task; the number of a range is the count of all ranges
    before it. The driver sums up those counts, a number for each task of an exchange; no task sees all rows.
    """
    at = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.shiftright(at, 33).alias("_range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_inside")
    )
    stored = shared_table(ranged, "ranged")
    counts = sorted((r[0], r[1]) for r in stored.groupBy("_range").count().collect())
    ahead = [0, *accumulate(n for _, n in counts)]
    shifts = local_table(df.sparkSession, [(r, n) for (r, _), n in zip(counts, ahead)], "_range long, _ahead long")
    return stored.join(shifts, "_range").withColumn(name, F.col("_inside") + F.col("_ahead")).drop("_range", "_inside", "_ahead")
