"""Numbers, ranks and running sums over a whole table without a single task.

Rows are dealt by ranges of the order and written once; what each range holds is counted by range, and the counts of
the ranges before it are carried to its rows. Only one row for each range (and group that it touches) is windowed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.store import Stages

#: Columns that this module adds to the table it writes.
PLACE, RANGE = "_place", "_range"


def _keys(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def in_ranges(df: DataFrame, order: Sequence[str | Column], stages: Stages, name: str) -> DataFrame:
    """``df`` written in ranges of ``order``, with ``_place`` (ascends in that order) and ``_range`` (its range).

    Rows that are equal in all of ``order`` are spread over ranges too, in any order among themselves.
    """
    tie = "_tie"
    kept = (
        df.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(*_keys(order), F.col(tie))
        .sortWithinPartitions(*_keys(order), F.col(tie))
        .drop(tie)
        .withColumn(PLACE, F.monotonically_increasing_id())
        .withColumn(RANGE, F.shiftright(PLACE, 33))
    )
    return stages.keep(kept, name)


def carried(ranged: DataFrame, groups: Sequence[str], stages: Stages, name: str, sums: Mapping[str, str] | None = None) -> DataFrame:
    """For each range and group: ``_first`` place, ``_before`` (rows of the group in earlier ranges), ``_size`` of the group.

    ``sums`` maps a column to the name under which its sum over earlier ranges is carried. One row a range and group.
    """
    sums = dict(sums or {})
    parts = ranged.groupBy(RANGE, *groups).agg(F.min(PLACE).alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select(
        RANGE, *groups, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(to) for c, to in sums.items()],
    )
    return stages.keep(out, name)


def numbered(df: DataFrame, order: Sequence[str | Column], stages: Stages, name: str, groups: Sequence[str] = (), to: str = "index", size: str | None = None) -> DataFrame:
    """``df`` with ``to``: 0, 1, ... in ``order`` within each group (groups lead the order; no nulls in them)."""
    ranged = in_ranges(df, [*groups, *order], stages, f"{name}-ranges")
    offsets = carried(ranged, groups, stages, f"{name}-offsets")
    out = ranged.join(offsets, [RANGE, *groups]).withColumn(to, (F.col(PLACE) - F.col("_first") + F.col("_before")).cast("long"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop(RANGE, PLACE, "_first", "_before", "_size")


def dense_ranks(df: DataFrame, keys: Sequence[str], stages: Stages, name: str, to: str = "rank") -> DataFrame:
    """``df`` with ``to``: 1, 2, ... by the order of ``keys`` (no nulls), equal keys alike."""
    named = numbered(df.select(*keys).distinct(), keys, stages, name, to=to).withColumn(to, F.col(to) + 1)
    return df.join(stages.keep(named, f"{name}-names"), list(keys))


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, str], stages: Stages, name: str, to: str | None = None) -> DataFrame:
    """``df`` with the sum of each column of ``sums`` over its row and all rows before it, and row numbers from 1 in ``to``."""
    ranged = in_ranges(df, order, stages, f"{name}-ranges")
    offsets = carried(ranged, [], stages, f"{name}-offsets", {c: f"_before_{c}" for c in sums})
    here = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(offsets, RANGE)
    out = out.select("*", *[(F.sum(c).over(here) + F.col(f"_before_{c}")).alias(new) for c, new in sums.items()])
    if to:
        out = out.withColumn(to, F.col(PLACE) - F.col("_first") + F.col("_before") + 1)
    return out.drop(RANGE, PLACE, "_first", "_before", "_size", *[f"_before_{c}" for c in sums])
