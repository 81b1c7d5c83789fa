"""Row numbers and running sums inside groups of any size.

A window numbers a group in one task. Here rows are ordered by range partitions over (group, order), which cut a large
group into pieces; each row's place in its partition is written with it, and a table with one row for each piece has the
numbers and sums of the pieces before. A window meets that small table only, never the rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import stored

ROW, PART = "__row", "__part"


def in_order(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df with ROW, which ascends with (by, order), and PART, the number of the partition that held it; written to the shared folder."""
    keys = [*by, *order]
    placed = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(ROW, F.monotonically_increasing_id()))
    return placed.withColumn(PART, F.shiftright(ROW, 33))  # the upper bits of such an id are the partition's number


def _pieces(placed: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """A row for each (by, PART), so that no key of the join with it holds more than a partition did: its first ROW, and for each of `sums` the sum over the pieces before and over the group."""
    there = placed.groupBy(*by, PART).agg(F.min(ROW).alias("__first"), *[F.sum(c).alias(n) for n, c in sums.items()])
    group = W.partitionBy(*by)
    before = group.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    return there.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col(PART).alias("__of"), "__first", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums], *[F.sum(n).over(group).alias(f"{n}_all") for n in sums])


def _with_pieces(placed: DataFrame, pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    same = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)] + [F.col(PART) == F.col("__of")]
    return placed.join(pieces, reduce(lambda a, b: a & b, same))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "at", *, size: str | None = None) -> DataFrame:
    """df with `name`, the place of each row in its group from 0, and on request `size`, the group's number of rows.

    Null groups are groups. Give an order that tells all rows of a group apart: equal rows stay in one partition, and which of
    them comes first is open.
    """
    placed = in_order(df, by, order)
    pieces = _pieces(placed, by, {"__n": F.lit(1)})
    extra = {size: F.col("__n_all")} if size else {}
    return _with_pieces(placed, pieces, by).select(*df.columns, (F.col(ROW) - F.col("__first") + F.col("__n_before")).alias(name), *[c.alias(n) for n, c in extra.items()])


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: str, name: str = "before") -> DataFrame:
    """df with `name`, the sum of `value` over the rows before in the group (0 for the first; nulls count as 0)."""
    placed = in_order(df, by, order)
    pieces = _pieces(placed, by, {"__n": F.coalesce(F.col(value), F.lit(0))})
    piece = W.partitionBy(*by, PART).orderBy(ROW).rowsBetween(W.unboundedPreceding, -1)  # one partition's part of a group
    own = placed.withColumn("__own", F.coalesce(F.sum(value).over(piece), F.lit(0)))
    return _with_pieces(own, pieces, by).select(*df.columns, (F.col("__own") + F.col("__n_before")).alias(name))
