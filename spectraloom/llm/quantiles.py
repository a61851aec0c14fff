"""Percentiles of large numeric columns from mergeable quantile digests.

A value is quantized to one of 2**22 ordered leaves: zero, and for either sign 512 steps
an octave over all finite doubles, 2**-1074 to 2**1024. A leaf stands for the middle of
its step, so any value from 2**-1022 on is off by at most ``VALUE_ERROR`` of itself (and
a subnormal one, for which doubles have no such precision, by that or 2**-1074). A digest
holds counts of nodes of the binary tree over the leaves, a node being (level, index)
with leaves at level 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spectraloom.llm.topn import finite
from spectraloom.runtime import col

LEVELS = 22
STEPS = 512
LOWEST = -1074
HALF = 1 << (LEVELS - 1)
VALUE_ERROR = 2 ** (0.5 / STEPS) - 1


def leaf_of(x: Column) -> Column:
    """Leaf of a finite double, 1 to 2**22 - 1."""
    size = F.abs(x)
    step = F.greatest(F.lit(0), F.least(F.lit((1024 - LOWEST) * STEPS - 1), F.floor((F.log2(size) - LOWEST) * STEPS))).cast("int")
    return F.when(size == 0, F.lit(HALF)).when(x > 0, HALF + 1 + step).otherwise(HALF - 1 - step).cast("int")


def value_of(leaf: Column) -> Column:
    """The value a leaf stands for."""
    step = F.abs(leaf - HALF) - 1
    return F.when(leaf == HALF, F.lit(0.0)).otherwise(F.signum((leaf - HALF).cast("double")) * F.pow(F.lit(2.0), (step + 0.5) / STEPS + LOWEST))


def compress(digest: np.ndarray, index: np.ndarray, count: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Compress many digests at once, level by level from the leaves.

    ``digest, index, count`` are leaves sorted by digest and index; ``limit[d]`` is
    floor(n / k) of digest d. Two siblings whose counts together do not exceed the
    limit are added to their parent, so a node other than a leaf never holds more
    than the limit. Returns digest, level, index and count of the nodes left.
    """
    kept: list[tuple[np.ndarray, ...]] = []
    for level in range(LEVELS):
        if not len(index):
            break
        parent = index >> 1
        first = np.flatnonzero(np.r_[True, (parent[1:] != parent[:-1]) | (digest[1:] != digest[:-1])])
        total = np.add.reduceat(count, first)
        owner = digest[first]
        up = total <= limit[owner]
        stay = ~np.repeat(up, np.diff(np.r_[first, len(index)]))
        kept.append((digest[stay], np.full(int(stay.sum()), level), index[stay], count[stay]))
        digest, index, count = owner[up], parent[first][up], total[up]
    kept.append((digest, np.full(len(index), LEVELS), index, count))
    return tuple(np.concatenate(x) for x in zip(*kept))


def _compressor(keys: Sequence[str], k: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            start = _starts(t)
            rest = t.slice(int(start[-1]))  # the last digest may go on in the next batch
            if start[-1]:
                yield from squeeze(t.slice(0, int(start[-1])))
        if rest is not None and rest.num_rows:
            yield from squeeze(rest)

    def _starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for key in keys:
            code = t[key].combine_chunks().dictionary_encode(null_encoding="encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def squeeze(t: pa.Table) -> Iterator[pa.RecordBatch]:
        start = _starts(t)
        digest = np.repeat(np.arange(len(start)), np.diff(np.r_[start, t.num_rows]))
        leaf, count = t["leaf"].to_numpy().astype(np.int64), t["cnt"].to_numpy()
        first = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (digest[1:] != digest[:-1])])
        count = np.add.reduceat(count, first)
        n = np.bincount(digest[first], weights=count, minlength=len(start)).astype(np.int64)
        d, level, index, count = compress(digest[first], leaf[first], count, n // k)
        head = t.take(pa.array(start[d]))
        yield from pa.Table.from_arrays([*(head[x].combine_chunks() for x in keys), pa.array(level, pa.int32()), pa.array(index, pa.int32()), pa.array(count, pa.int64())], schema=schema).to_batches()

    return run


def quantile_digests(df: DataFrame, value: str, keys: Sequence[str], *, distinct_on: Sequence[str] | None = None, k: int = 2200) -> DataFrame:
    """A quantile digest for each combination of ``keys``: ``keys, level, node, cnt``.

    Rows whose value is null, NaN or infinite are left out; a null key is a key of its
    own. With ``distinct_on``, rows equal in those columns and the keys count once. Digests of
    the same keys may be added node by node, in any order, see ``merge_digests``.

    Any rank read from a digest of n values is off by at most floor(n / k) * 22 ranks;
    digests of fewer than k values are exact up to the quantization. Repeats are removed
    and leaves counted with map-side combine, so neither a row repeated very often nor
    one hot value gathers in a task; a task compresses many digests in one stream, of
    which a digest has no more than it has different leaves.
    """
    x = col(value).cast("double")
    named = [f"k{j}" for j in range(len(keys))]
    rows = df.where(finite(x))
    key = [col(c).alias(a) for c, a in zip(keys, named)]
    if distinct_on is not None:
        rows = rows.select(*key, leaf_of(x).alias("leaf"), *(col(c).alias(f"c{j}") for j, c in enumerate(distinct_on) if c not in keys)).distinct()
    else:
        rows = rows.select(*key, leaf_of(x).alias("leaf"))
    rows = rows.groupBy(*named, "leaf").agg(F.count(F.lit(1)).alias("cnt"))
    rows = rows.repartition(*named).sortWithinPartitions(*named, "leaf")
    out = rows.select(*named, F.lit(0).alias("level"), F.lit(0).alias("node"), F.lit(0).cast("long").alias("cnt")).schema
    done = rows.mapInArrow(_compressor(named, k, to_arrow_schema(out)), out)
    return done.select(*(F.col(a).alias(c) for c, a in zip(keys, named)), "level", "node", "cnt")


def merge_digests(digests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add digests that agree in ``keys``, node by node."""
    return digests.groupBy(*(col(c) for c in keys), "level", "node").agg(F.sum("cnt").alias("cnt"))


def percentiles(digests: DataFrame, keys: Sequence[str], part: Sequence[str], ranks: dict[str, float], *, k: int = 2200) -> DataFrame:
    """Percentiles of merged digests: ``keys, n, <names of ranks>, rank_error, value_error``.

    ``part`` names the further key columns (the day, say) over which digests are
    merged. A percentile q is the value of rank ceil(q * n). ``rank_error`` is the
    bound in ranks: 22 * floor(n / k), added up over the parts. ``value_error`` is the
    relative bound of the quantization.
    """
    each = digests.groupBy(*(col(c) for c in [*keys, *part])).agg(F.sum("cnt").alias("n"))
    size = each.groupBy(*(col(c) for c in keys)).agg(F.sum("n").alias("n"), F.sum(F.floor(F.col("n") / k) * LEVELS).cast("long").alias("rank_error"))
    nodes = merge_digests(digests, keys).withColumn("top", F.expr("shiftleft(node + 1, level) - 1"))
    run = Window.partitionBy(*(col(c) for c in keys)).orderBy("top", "level").rowsBetween(Window.unboundedPreceding, 0)
    # a digest of n values has about 3 * k nodes, and parts of one key are as many as there are days, so this window is bounded however large the data are
    nodes = nodes.withColumn("below", F.sum("cnt").over(run)).withColumn("n", F.sum("cnt").over(Window.partitionBy(*(col(c) for c in keys))))
    pick = [F.min(F.when(F.col("below") >= F.ceil(F.col("n") * F.lit(q)), F.col("top"))).alias(f"__{name}") for name, q in ranks.items()]
    found = nodes.groupBy(*(col(c) for c in keys)).agg(*pick)
    same = [col(c) for c in keys]
    joined = found.select(*same, *(F.col(f"__{r}") for r in ranks)).alias("f").join(size.alias("s"), [F.expr(f"f.`{c}` <=> s.`{c}`") for c in keys])
    return joined.select(
        *(F.expr(f"f.`{c}`").alias(c) for c in keys), F.col("s.n").alias("n"), *(value_of(F.col(f"__{r}")).alias(r) for r in ranks),
        F.col("s.rank_error").alias("rank_error"), F.lit(VALUE_ERROR).alias("value_error"),
    )
