"""Flattening nested lists to rows and building them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame, key: Sequence[str], column: str, *, levels: int = 1, value: str = "value", keep_empty: bool = False) -> DataFrame:
    """One row per innermost element: ``key..., pos_0, ..., value``; null and empty lists give no rows.

    With ``keep_empty`` a list without elements, null or empty, gives a row with null
    positions from its level on, by which ``restructure`` makes it an empty list again.
    """
    out = df.select(*key, F.col(column).alias("__v"))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    for level in range(levels):
        places = [f"pos_{i}" for i in range(level)]
        out = out.select(*key, *places, explode("__v").alias(f"pos_{level}", "__v"))
    return out.withColumnRenamed("__v", value)


def restructure(flat: DataFrame, key: Sequence[str], *, levels: int = 1, value: str = "value", lengths: str | None = None) -> DataFrame:
    """The reverse of ``flatten``: ``key..., value``; a null position stands for an empty list.

    With ``lengths``, a column of the expected length of each outermost list, a list of
    another length raises an error when the result is computed.
    """
    out = flat.withColumnRenamed(value, "__v")
    keep = [lengths] if lengths else []
    for level in range(levels - 1, -1, -1):
        places = [f"pos_{i}" for i in range(level)]
        place = F.col(f"pos_{level}")
        packed = F.sort_array(F.collect_list(F.when(place.isNotNull(), F.struct(place.alias("p"), F.col("__v").alias("v")))))
        out = out.groupBy(*key, *keep, *places).agg(F.transform(packed, lambda x: x["v"]).alias("__v"))
    if lengths:
        wrong = F.size("__v") != F.col(lengths)
        out = out.withColumn("__v", F.when(wrong, F.raise_error(F.lit("a list has another length than it should"))).otherwise(F.col("__v")))
    return out.select(*key, F.col("__v").alias(value))
