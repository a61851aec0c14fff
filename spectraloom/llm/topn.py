"""Top N items within every group, with heavy groups taken out of the ordinary window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spectraloom.runtime import col, materialize

#: No more than this many groups can be heavy, whatever the size of the table: some 30 MB of keys and bounds.
MAX_HEAVY_GROUPS = 1 << 20


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def top_n_per_group(
    df: DataFrame,
    group: str,
    item: str,
    score: str,
    n: int = 10,
    *,
    rank: str = "topk",
    heavy_rows: int = 2_000,
    score_ranges: int = 16,
    salts: int = 8,
) -> DataFrame:
    """The ``n`` best items of every group: columns ``group, item, rank, score``.

    Order: score descending, then item ascending; ranks start at 1 without gaps.
    An item scored more than once in a group counts once, with its highest score.
    Rows with a null group, a null item or a score that is null, NaN or infinite
    do not compete; a group without any other row does not appear. An empty table
    gives no rows. Other columns of ``df`` are ignored, whatever their names.

    Hot-cold split. One pass counts every group exactly (map-side combined). Groups
    of at least ``heavy_rows`` rows are heavy; from a table of ``heavy_rows`` times
    ``MAX_HEAVY_GROUPS`` rows on the limit rises with it, so that no more can be, which
    bounds the broadcast of their keys; a light group of a table of 10**12 rows still
    has under a million. Light groups are shuffled once by group and ranked by one window. Rows of
    heavy groups are spread by (group, score range, salt), sorted there, cut to the
    ``n`` best of each part, and the few winners are ranked again. Both ways are
    exact; the parts of a heavy group never meet in one task before the cut.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(col(group).alias("g"), col(item).alias("i"), col(score).cast("double").alias("s")).where(
        F.col("g").isNotNull() & F.col("i").isNotNull() & finite(F.col("s"))
    )
    limit = max(heavy_rows, -(-df.count() // MAX_HEAVY_GROUPS))
    heavy = (
        rows.groupBy("g")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("s").alias("lo"), F.max("s").alias("hi"))
        .where(F.col("rows") >= limit)
        .select("g", "lo", "hi")
    )
    heavy = materialize(heavy, "heavy-groups")  # counted once; the two ways read the few rows

    light = rows.join(F.broadcast(heavy.select("g")), "g", "left_anti").repartition("g")
    light = light.groupBy("g", "i").agg(F.max("s").alias("s"))
    light = light.withColumn("k", F.row_number().over(_ranked("g"))).where(F.col("k") <= n)

    hot = rows.join(F.broadcast(heavy.select("g")), "g", "left_semi").groupBy("g", "i").agg(F.max("s").alias("s"))
    hot = hot.join(F.broadcast(heavy), "g")
    width = F.col("hi") - F.col("lo")
    part = F.when(width > 0, F.least(F.lit(score_ranges - 1), F.floor((F.col("hi") - F.col("s")) / width * score_ranges))).otherwise(0)
    hot = hot.select("g", "i", "s", part.cast("int").alias("r"), F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int").alias("h"))
    hot = hot.withColumn("k", F.row_number().over(_ranked("g", "r", "h"))).where(F.col("k") <= n)
    hot = hot.select("g", "i", "s").withColumn("k", F.row_number().over(_ranked("g"))).where(F.col("k") <= n)

    both = light.select("g", "i", "k", "s").unionByName(hot.select("g", "i", "k", "s"))
    return both.select(F.col("g").alias(group), F.col("i").alias(item), F.col("k").cast("long").alias(rank), F.col("s").alias(score))


def _ranked(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc("s"), F.asc("i"))
