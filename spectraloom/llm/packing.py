"""Filling containers of fixed capacity with documents."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.runtime import col


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container number of every item (sizes 1 to ``capacity``) and the number of containers.

    Items above a third of the capacity are matched greedily: from the largest down,
    each takes the largest other one that still fits beside it. The smaller items,
    from the largest down, go into the smallest gap that holds them, or open a
    container where there is none. Equal sizes are taken in the order given.
    """
    n = len(sizes)
    bins = np.full(n, -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    size = sizes.tolist()
    by_size: dict[int, list[int]] = {}
    large, small = [], []
    for i in order.tolist():
        (large if 3 * size[i] > capacity else small).append(i)
    have = 0  # bit s is set while an unmatched large item of size s is left
    for i in reversed(large):
        by_size.setdefault(size[i], []).append(i)
        have |= 1 << size[i]
    gaps: dict[int, list[int]] = {}
    gap_bits, count = 0, 0

    def open_gap(bin: int, gap: int) -> None:
        nonlocal gap_bits
        if gap:
            gaps.setdefault(gap, []).append(bin)
            gap_bits |= 1 << gap

    def take(s: int) -> int:
        nonlocal have
        i = by_size[s].pop()
        if not by_size[s]:
            have &= ~(1 << s)
        return i

    while have:
        s = have.bit_length() - 1
        bins[take(s)] = count
        gap = capacity - s
        fits = have & ((1 << (gap + 1)) - 1)
        if fits:
            s = fits.bit_length() - 1
            bins[take(s)] = count
            gap -= s
        open_gap(count, gap)
        count += 1
    for i in small:
        s = size[i]
        fits = gap_bits >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            bin = gaps[gap].pop()
            if not gaps[gap]:
                gap_bits &= ~(1 << gap)
        else:
            gap, bin = capacity, count
            count += 1
        bins[i] = bin
        open_gap(bin, gap - s)
    return bins, count


def fill_containers(df: DataFrame, id: str, size: str, capacities: Mapping[str, int], *, shard_rows: int = 50_000) -> DataFrame:
    """Containers of every kind: ``pack_kind, container_id, id, piece, tokens, unused``.

    An item of at most the capacity stays whole, with piece 0. A larger one is cut into
    full containers, pieces 0, 1, ..., and a rest that is packed like an item. A row is
    a piece; ``unused`` is what its container leaves free, and ``container_id`` is
    unique within the kind. Rows with a null id, or a size that is null or below 1, are
    left out; a repeated id is packed as often as it occurs. No kinds or no rows give an
    empty result. Other columns are ignored.

    Items are spread by a hash of their id over shards of about ``shard_rows``; each
    shard and kind is packed on its own, which costs a few unfilled containers a shard.
    """
    bad = [k for k, c in capacities.items() if c is None or c < 1]
    if bad:
        raise ValueError(f"capacities below 1: {bad}")
    shards = max(1, -(-df.count() // shard_rows))
    kinds = F.array(*(F.struct(F.lit(k).alias("pack_kind"), F.lit(int(c)).cast("long").alias("capacity")) for k, c in capacities.items()))
    rows = df.select(col(id).alias("id"), col(size).cast("long").alias("size")).where(F.col("id").isNotNull() & (F.col("size") >= 1))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"pack_kind string, container_id long, id {kind}, piece long, tokens long, unused long"
    if not capacities:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")
    rows = rows.select("id", "size", shard, F.explode(kinds).alias("k")).select("id", "size", "shard", "k.*")

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name, capacity, own = (k.as_py() for k in key)
        table = table.sort_by([("id", "ascending"), ("size", "ascending")])
        sizes = table["size"].to_numpy()
        full, rest = sizes // capacity, sizes % capacity
        item = np.flatnonzero(rest)
        bins, count = pack(rest[item], capacity)
        used = np.bincount(bins, weights=rest[item], minlength=count)
        whole = np.repeat(np.arange(len(sizes)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        source = np.r_[whole, item]
        return pa.table({
            "pack_kind": pa.array([name] * len(source), pa.string()),
            "container_id": pa.array((np.int64(own) << 32) + np.r_[count + np.arange(len(whole)), bins].astype(np.int64)),
            "id": table["id"].take(pa.array(source)).combine_chunks(),
            "piece": pa.array(np.r_[piece, full[item]].astype(np.int64)),
            "tokens": pa.array(np.r_[np.full(len(whole), capacity), rest[item]].astype(np.int64)),
            "unused": pa.array(np.r_[np.zeros(len(whole)), capacity - used[bins]].astype(np.int64)),
        })

    done = rows.groupBy("pack_kind", "capacity", "shard").applyInArrow(fill, schema)
    return done.withColumnRenamed("id", id)


def container_summary(pieces: DataFrame, id: str) -> DataFrame:
    """Per kind: containers, documents, tokens, unused tokens and the share of space that is used."""
    each = pieces.groupBy("pack_kind", "container_id").agg(F.sum("tokens").alias("tokens"), F.first("unused").alias("unused"))
    space = each.groupBy("pack_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("unused").alias("unused"))
    whole = pieces.where(F.col("piece") == 0).groupBy("pack_kind").agg(F.count(F.lit(1)).alias("documents"))
    return space.join(whole, "pack_kind").withColumn("used_share", F.round(F.col("tokens") / (F.col("tokens") + F.col("unused")), 6))
