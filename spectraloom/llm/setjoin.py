"""All pairs of set-valued records whose Jaccard similarity reaches a threshold."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.runtime import col, materialize


@dataclass(frozen=True)
class SetJoin:
    """Result of ``similar_sets``.

    ``members(set_id, id, right)``: the records, by set of equal records; ``set_id`` is
    the lowest id of the set and ``right`` marks records of the second table.
    ``pairs(set_a, set_b, overlap, size_a, size_b)``: similar pairs of different sets,
    each once, ``set_a`` < ``set_b``.
    """

    members: DataFrame
    pairs: DataFrame

    def id_pairs(self) -> DataFrame:
        """All pairs of different ids ``(id_a, id_b)``, id_a < id_b, at least one of the first table."""
        m = self.members
        a, b = m.select(F.col("set_id").alias("set_a"), F.col("id").alias("x"), F.col("right").alias("rx")), m.select(F.col("set_id").alias("set_b"), F.col("id").alias("y"), F.col("right").alias("ry"))
        across = self.pairs.select("set_a", "set_b").join(a, "set_a").join(b, "set_b").where(~(F.col("rx") & F.col("ry")) & (F.col("x") != F.col("y")))
        within = a.join(b.withColumnRenamed("set_b", "set_a"), "set_a").where(~(F.col("rx") & F.col("ry")) & (F.col("x") < F.col("y")))
        both = across.select("x", "y").unionByName(within.select("x", "y"))
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def links(self) -> DataFrame:
        """One row per record ``(id, right, set_id, copies, links)`` without listing the pairs.

        ``copies`` counts other records with the same set, ``links`` all other records
        similar to this one, copies included; two records of the second table are no link.
        """
        size = self.members.groupBy("set_id").agg(F.count(F.lit(1)).alias("all"), F.sum(F.when(F.col("right"), 0).otherwise(1)).alias("left"))
        both = self.pairs.select(F.col("set_a").alias("set_id"), F.col("set_b").alias("other")).unionByName(self.pairs.select(F.col("set_b").alias("set_id"), F.col("set_a").alias("other")))
        other = size.select(F.col("set_id").alias("other"), F.col("all").alias("o_all"), F.col("left").alias("o_left"))
        near = both.join(other, "other").groupBy("set_id").agg(F.sum("o_all").alias("n_all"), F.sum("o_left").alias("n_left"))
        m = self.members.join(size, "set_id").join(near, "set_id", "left")
        copies = F.when(F.col("right"), F.col("left")).otherwise(F.col("all") - 1)
        others = F.coalesce(F.when(F.col("right"), F.col("n_left")).otherwise(F.col("n_all")), F.lit(0))
        return m.select("id", "right", "set_id", copies.cast("long").alias("copies"), (copies + others).cast("long").alias("links"))


def similar_sets(
    left: DataFrame,
    id: str,
    tokens: str,
    right: DataFrame | None = None,
    *,
    threshold: float = 0.6,
    min_size: int = 1,
    max_small: int = 12,
    hot_rows: int = 50_000,
    bucket_rows: int = 100_000,
) -> SetJoin:
    """Similar pairs within ``left`` and, if given, between ``left`` and ``right``.

    Both tables have the columns ``id`` and ``tokens`` (an array); other columns are
    ignored. A set holds the distinct tokens that are not null. Rows with a null id, a
    null array or fewer than ``min_size`` distinct tokens take no part (an empty set is
    similar to nothing). Rows equal in id and set count once; ids are compared over both
    tables. Empty tables give no pairs. Pairs with Jaccard >= ``threshold``, bound
    included, are found exactly; nothing is sampled or capped.

    Size-aware overlap join. Equal sets are one set. Tokens are in order of rising
    frequency. A small set (at most ``max_small`` tokens) enumerates its threshold-sized
    subsets: of two small sets the larger, of m tokens, must share ceil(threshold * m)
    with the other, so both meet on an equal subset of that size. A large set, which
    would have too many (a set of 30 tokens has 86 million), scans the inverted lists of
    its first (size - o + 1) tokens, where o is the least overlap it can have with a set
    that is not larger; those lists hold its partners, small or large, by their first
    tokens. A token that is among more than ``hot_rows`` sets has no list of its own:
    where the first shared token is such a one, sets meet on the first two.

    Sets are sent to the buckets of their subsets, tokens and pairs of tokens, about
    ``bucket_rows`` rows each. A bucket that has more than four times as many, because
    very many sets share a signature, is divided by set, and its parts are compared part
    against part. Within a bucket sets meet in slices of bounded size, and are cut by size
    and by a 128-bit bitmap that bounds the overlap from above; what is left of all
    buckets is cut by the exact similarity. Tokens that are not whole numbers are
    compared by 64-bit hash.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")

    def records(df: DataFrame, is_right: bool) -> DataFrame:
        item = df.select(col(tokens).alias("t")).schema["t"].dataType.elementType
        whole = isinstance(item, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
        t = F.filter(col(tokens), lambda x: x.isNotNull())
        t = F.array_sort(F.array_distinct(t.cast("array<bigint>") if whole else F.transform(t, lambda x: F.xxhash64(x))))
        return df.select(col(id).alias("id"), F.lit(is_right).alias("right"), t.alias("t")).where(F.col("id").isNotNull() & (F.size("t") >= max(1, min_size)))

    recs = records(left, False)
    if right is not None:
        recs = recs.unionByName(records(right, True))
    recs = recs.select("id", "right", "t", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), F.reverse("t")).alias("h2"))
    sets = recs.groupBy("h1", "h2").agg(F.min("id").alias("set_id"), F.min("right").alias("only_right"), F.first("t").alias("t"))
    sets = materialize(sets, "sets")
    members = recs.select("id", "right", "h1", "h2").distinct().join(sets.select("h1", "h2", "set_id"), ["h1", "h2"]).select("set_id", "id", "right")
    plan = _Prefixes(threshold, max_small, hot_rows, max(12, -(-sets.count() * 12 // bucket_rows)))
    ordered = _by_rarity(sets, plan)
    kind = ordered.schema["set_id"].dataType.simpleString()
    rows = ordered.select(F.explode("buckets").alias("bucket"), "set_id", "size", "hot", "prefix", "b0", "b1")
    full = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("parts")).where(F.col("parts") > 4)
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(F.broadcast(materialize(full, "full-buckets")), "bucket", "left").withColumn("part", F.pmod(F.xxhash64("set_id"), parts).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, "part").alias("lo"), F.greatest(k, "part").alias("hi")))
    spread = rows.withColumn("c", F.explode(cell)).select("bucket", "c.lo", "c.hi", "part", "set_id", "size", "hot", "prefix", "b0", "b1")
    found = spread.groupBy("bucket", "lo", "hi").applyInArrow(_meeting(plan), f"set_id_p {kind}, set_id_i {kind}").distinct()

    side = lambda s: ordered.select(F.col("set_id").alias(f"set_id_{s}"), F.col("o").alias(f"o_{s}"))
    exact = found.join(side("p"), "set_id_p").join(side("i"), "set_id_i")
    a, b = F.col("set_id_p"), F.col("set_id_i")
    exact = exact.select("set_id_p", "set_id_i", F.size(F.array_intersect("o_p", "o_i")).alias("overlap"), F.size("o_p").alias("n_p"), F.size("o_i").alias("n_i"))
    exact = exact.where(F.col("overlap") / (F.col("n_p") + F.col("n_i") - F.col("overlap")) >= threshold)
    pairs = exact.select(
        F.least(a, b).alias("set_a"), F.greatest(a, b).alias("set_b"), "overlap",
        F.when(a < b, F.col("n_p")).otherwise(F.col("n_i")).alias("size_a"), F.when(a < b, F.col("n_i")).otherwise(F.col("n_p")).alias("size_b"),
    )
    return SetJoin(members, pairs)


@dataclass(frozen=True)
class _Prefixes:
    """Where sets of n tokens have to be looked for: lengths of prefixes, by role and kind of signature."""

    threshold: float
    max_small: int
    hot_rows: int
    buckets: int

    def larger(self, n: np.ndarray, subset: int) -> np.ndarray:
        """As the larger set of a pair, the overlap being at least threshold * n."""
        return np.minimum(n, n - np.ceil(n * self.threshold - 1e-9).astype(np.int64) + subset)

    def smaller(self, n: np.ndarray, subset: int) -> np.ndarray:
        """As the smaller one, or one of two equally large."""
        return np.minimum(n, n - np.ceil(n * (2 * self.threshold / (1 + self.threshold)) - 1e-9).astype(np.int64) + subset)

    def small(self, n: np.ndarray) -> np.ndarray:
        return n <= self.max_small

    def partner(self, n: np.ndarray) -> np.ndarray:
        """Sets that may be similar to a large one."""
        return n >= math.ceil((self.max_small + 1) * self.threshold - 1e-9)

    def shared(self, n: int) -> int:
        """Tokens that a set of n must share with one that is not larger."""
        return max(1, math.ceil(self.threshold * n - 1e-9))

    def subset_sizes(self, n: int) -> list[int]:
        """Of a small set as the smaller of two, its own size as the larger one first."""
        larger = range(n, min(self.max_small, math.floor(n / self.threshold + 1e-9)) + 1)
        return list(dict.fromkeys(c for m in larger if (c := self.shared(m)) <= n))

    def reach(self, n: np.ndarray, subset: int) -> np.ndarray:
        """Length of the prefix that holds the first (two) tokens shared: small sets are the smaller ones of such pairs."""
        return np.where(self.small(n), self.smaller(n, subset), self.larger(n, subset))

    def length(self, n: np.ndarray) -> np.ndarray:
        """Tokens of which the codes are needed: all of a small set."""
        return np.where(self.small(n), n, self.larger(n, 2))

    def subsets(self, n: np.ndarray, code: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signature, row and whether it is one of the row as the larger set, of all threshold-sized subsets of the small sets."""
        keys, rows, own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for size in range(1, self.max_small + 1):
            row = np.flatnonzero(n == size)
            for j, c in enumerate(self.subset_sizes(size)) if len(row) else []:
                chosen = np.array(list(itertools.combinations(range(size), c)))
                h = np.full((len(row), len(chosen)), c, np.int64)
                with np.errstate(over="ignore"):
                    for place in range(c):
                        h = (h ^ (h >> np.int64(31))) * np.int64(0x2545F4914F6CDD1D) + code[start[row][:, None] + chosen[None, :, place]]
                keys.append((h & np.int64((1 << 62) - 1)).ravel())
                rows.append(np.repeat(row, len(chosen)))
                own.append(np.full(h.size, j == 0))
        return tuple(np.concatenate(x) for x in (keys, rows, own))

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """Of a token's code, or of two codes in one number."""
        return ((key ^ (key >> 29)) * np.int64(0x2545F4914F6CDD1D) >> 17) % self.buckets


def _later(length: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places after each place: the number of the entry in ``row, at`` and the later place."""
    count = np.maximum(length[row] - at - 1, 0)
    entry = np.repeat(np.arange(len(row)), count)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + at[entry] + 1


def _by_rarity(sets: DataFrame, plan: _Prefixes, counters: int = 1 << 18) -> DataFrame:
    """Every set with its tokens in order of rising frequency, and where it has to be looked for.

    ``o`` are the tokens, ``prefix`` the 31-bit codes of the first ones, ``hot`` the
    first place of a token of more than ``hot_rows`` sets, ``buckets`` the buckets of
    the signatures, ``b0, b1`` a 128-bit bitmap in which every token sets one bit and
    ``size`` twice the number of tokens, plus 1 for a set of the second table only.

    Frequencies over all different sets are added up in a fixed number of counters by
    the token's hash, so what is sent to every task does not grow with the vocabulary.
    Any order that is the same for all sets is right; this one only has to be good.
    """
    place = F.pmod(F.xxhash64("tok"), F.lit(counters)).cast("int").alias("c")
    got = sets.select(F.explode("t").alias("tok")).groupBy(place).agg(F.count(F.lit(1)).alias("df")).toPandas()
    table = np.zeros(counters, np.int64)
    table[got["c"].to_numpy()] = got["df"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            lists, hashes = batch.column("t"), batch.column("h")
            tok, h = lists.flatten().to_numpy(zero_copy_only=False), hashes.flatten().to_numpy(zero_copy_only=False)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            df = frequency[h % counters]
            order = np.lexsort((tok, df, row))
            tok, h, df = tok[order], h[order], df[order]
            bit, code = (h // counters) % 128, (h // (counters * 128)) & 0x7FFFFFFF
            words = []
            for half in (0, 1):
                word = np.zeros(len(n), np.uint64)
                own = (bit // 64) == half
                np.bitwise_or.at(word, row[own], np.uint64(1) << (bit[own] % 64).astype(np.uint64))
                words.append(pa.array(word.view(np.int64)))
            start = np.cumsum(n) - n
            at = np.arange(len(tok)) - start[row]
            length = plan.length(n)
            kept = at < length[row]
            cold = np.bincount(row, weights=kept & (df <= plan.hot_rows), minlength=len(n)).astype(np.int64)
            one = np.flatnonzero((at < plan.reach(n, 1)[row]) & (plan.partner(n) | ~plan.small(n))[row])
            hot = one[at[one] >= cold[row[one]]]
            single = one[at[one] < cold[row[one]]]
            entry, later = _later(plan.reach(n, 2), row[hot], at[hot])
            both = (code[hot[entry]] << 32) | code[start[row[hot[entry]]] + later]
            keys, owner, _ = plan.subsets(n, code, start)
            where = np.unique(np.r_[row[single] * plan.buckets + plan.bucket(code[single]), row[hot[entry]] * plan.buckets + plan.bucket(both), owner * plan.buckets + plan.bucket(keys)])
            nested = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)
            size = n.astype(np.int32) * 2 + batch.column("only_right").to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("set_id"), pa.array(size), pa.array(cold.astype(np.int32)), nested(n, pa.array(tok)), nested(length, pa.array(code[kept].astype(np.int32))),
                nested(np.bincount(where // plan.buckets, minlength=len(n)), pa.array((where % plan.buckets).astype(np.int32))), *words,
            ], ["set_id", "size", "hot", "o", "prefix", "buckets", "b0", "b1"])

    kind = sets.schema["set_id"].dataType.simpleString()
    rows = sets.select("set_id", "only_right", "t", F.transform("t", lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 63) - 1))).alias("h"))
    return materialize(rows.mapInArrow(arrange, f"set_id {kind}, size int, hot int, o array<bigint>, prefix array<int>, buckets array<int>, b0 long, b1 long"), "ordered")


def _meeting(plan: _Prefixes):
    """Candidate pairs of a bucket: sets with an equal signature that size and bitmaps allow to be similar."""
    share = plan.threshold / (1 + plan.threshold)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, lo, hi = (k.as_py() for k in key)
        ids, part = table["set_id"].combine_chunks(), table["part"].to_numpy()
        size, hot = table["size"].to_numpy().astype(np.int64), table["hot"].to_numpy().astype(np.int64)
        n, right = size >> 1, (size & 1).astype(bool)
        b0, b1 = (table[c].to_numpy().view(np.uint64) for c in ("b0", "b1"))
        prefix = table["prefix"].combine_chunks()
        code = prefix.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        length = prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row, start = np.repeat(np.arange(len(n)), length), np.cumsum(length) - length
        at = np.arange(len(code)) - start[row]
        by_id = np.empty(len(ids), np.int64)
        by_id[np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(ids))
        out = [np.zeros(0, np.int64)]

        def meet(keys: np.ndarray, owner: np.ndarray, probe: np.ndarray, index: np.ndarray) -> None:
            """Pairs of a set that probes a key and another one under that key that is not larger."""
            order = np.argsort(keys, kind="stable")
            keys, owner, probe, index = keys[order], owner[order], probe[order], index[order]
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            count = np.diff(np.r_[edge, len(keys)])
            group = np.repeat(np.arange(len(edge)), count)
            source = np.flatnonzero(index & (count[group] > 1))
            work = np.cumsum(count[group[source]])
            for some in np.split(source, np.searchsorted(work, np.arange(2_000_000, work[-1], 2_000_000))) if len(source) else []:
                each = count[group[some]]
                i = owner[np.repeat(some, each)]
                other = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(edge[group[some]], each)
                p = owner[other]
                ok = probe[other] & ((n[i] < n[p]) | ((n[i] == n[p]) & (by_id[i] < by_id[p]))) & ~(right[i] & right[p]) & (n[i] >= np.ceil(n[p] * plan.threshold - 1e-9))
                if lo != hi:
                    ok &= part[i] != part[p]
                i, p = i[ok], p[ok]
                apart = np.bitwise_count(b0[i] ^ b0[p]).astype(np.int64) + np.bitwise_count(b1[i] ^ b1[p])
                ok = n[i] + n[p] - apart >= 2 * np.ceil((n[i] + n[p]) * share - 1e-9)
                out.append(np.unique(p[ok] * len(ids) + i[ok]))

        # threshold-sized subsets of small sets
        keys, owner, own = plan.subsets(n, code, start)
        here = plan.bucket(keys) == bucket
        meet(keys[here], owner[here], own[here], np.ones(int(here.sum()), bool))
        # inverted lists, which large sets scan: of tokens, and of pairs of tokens where the first is hot
        one = np.flatnonzero((at < plan.reach(n, 1)[row]) & (plan.partner(n) | ~plan.small(n))[row])
        large, listed = ~plan.small(n), plan.smaller(n, 1)
        single = one[(at[one] < hot[row[one]]) & (plan.bucket(code[one]) == bucket)]
        meet(code[single], row[single], large[row[single]], at[single] < listed[row[single]])
        first = one[at[one] >= hot[row[one]]]
        entry, later = _later(plan.reach(n, 2), row[first], at[first])
        first = first[entry]
        both = (code[first] << 32) | code[start[row[first]] + later]
        mine = plan.bucket(both) == bucket
        first, both, later = first[mine], both[mine], later[mine]
        meet(both, row[first], large[row[first]], (at[first] < listed[row[first]]) & (later < plan.smaller(n, 2)[row[first]]))
        pairs = np.unique(np.concatenate(out))
        return pa.table({"set_id_p": ids.take(pa.array(pairs // max(1, len(ids)))), "set_id_i": ids.take(pa.array(pairs % max(1, len(ids))))})

    return run


def peak_sets(df: DataFrame, id: str, mz: Column, intensity: Column, *, weakest: float = 0.01, per_unit: int = 10) -> DataFrame:
    """``(id, tokens)``: floor(m/z * per_unit) of the peaks that are not weak.

    A row with a null list, or lists of unequal length, is left out. A peak counts
    if m/z and intensity are neither null nor NaN and above 0, and its intensity is at
    least ``weakest`` times the highest one of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, x = batch.column("m"), batch.column("x")
            n = m.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(m) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            mzs, ints = (np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in (m, x))
            ok = (mzs > 0) & (ints > 0)
            row, mzs, ints = row[ok], mzs[ok], ints[ok]
            top = np.zeros(len(n))
            np.maximum.at(top, row, ints)
            ok = ints >= weakest * top[row]
            tok = np.clip(np.floor(mzs[ok] * per_unit), None, 2.0**62).astype(np.int64)
            row = row[ok]
            order = np.lexsort((tok, row))
            row, tok = row[order], tok[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (tok[1:] != tok[:-1])
            ends = np.r_[0, np.cumsum(np.bincount(row[new], minlength=len(n)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(tok[new]))], ["id", "tokens"])

    rows = df.select(col(id).alias("id"), mz.cast("array<double>").alias("m"), intensity.cast("array<double>").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    # null lists and lists of unequal length have no set
    return rows.where(F.size("m") == F.size("x")).where(F.col("m").isNotNull() & F.col("x").isNotNull()).mapInArrow(run, f"id {kind}, tokens array<bigint>")
