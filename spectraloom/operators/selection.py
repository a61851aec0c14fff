"""Selection of rows by position, key and mask."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.runtime import materialize


def select_rows(df: DataFrame, key: str = "id", *, positions: int | slice | Iterable[int] | None = None, keys: Iterable | DataFrame | None = None, mask: Column | None = None, position: str = "position") -> DataFrame:
    """Rows by position, then by key, then by mask, one after the other (repeats kept): ``df`` and ``ordinal`` 0, 1, 2.

    Positions count from 0 in the column ``position`` (see ``with_position``); a slice
    needs start and stop of 0 or more. A key that does not occur selects nothing.
    """
    parts = []
    if positions is not None:
        p = F.col(position)
        if isinstance(positions, slice):
            start, step = positions.start or 0, positions.step or 1
            if start < 0 or (positions.stop or 0) < 0 or step < 1:
                raise ValueError("a slice needs start and stop of 0 or more and a step of 1 or more")
            test = (p >= start) & ((p - start) % step == 0)
            test = test if positions.stop is None else test & (p < positions.stop)
        else:
            test = p.isin([positions] if isinstance(positions, int) else list(positions))
        parts.append((0, df.where(test)))
    if keys is not None:
        if isinstance(keys, DataFrame):
            parts.append((1, df.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")))
        else:
            parts.append((1, df.where(F.col(key).isin(list(keys)))))
    if mask is not None:
        parts.append((2, df.where(mask)))
    out = None
    for ordinal, part in parts:
        part = part.withColumn("ordinal", F.lit(ordinal))
        out = part if out is None else out.unionByName(part)
    return df.limit(0).withColumn("ordinal", F.lit(0)) if out is None else out


def with_position(df: DataFrame, order: str, position: str = "position") -> DataFrame:
    """Adds the 0-based place of each row in the order of a column, ties in any order.

    Rows are sorted in ranges and numbered within their range; the small table of range
    sizes gives each range its start, so nothing is numbered in a single task.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    # monotonically_increasing_id holds the partition in its upper bits and the place in it in the lower 33
    ranged = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), "positions")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__start") + place).alias(position))


def select_all(tables: Mapping[str, DataFrame], chosen: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """The rows of the chosen keys in every table of a container."""
    keys = chosen.select(key).distinct()
    return {name: t.join(keys, key, "left_semi") for name, t in tables.items()}
