"""Joins of m/z values within a tolerance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spectraloom.functions.peaks import PPM_FLOOR, delta
from spectraloom.runtime import materialize, runs
from spectraloom.schema import require

#: Peaks of a block of queries, half those of a block of references; matches that a task makes at once.
BLOCK, AT_ONCE = 1 << 20, 1 << 18


def mz_join(
    qry: DataFrame,
    ref: DataFrame,
    tolerance: float = 3.0,
    unit: str = "ppm",
    *,
    rt_tolerance: float | None = None,
    on: Sequence[str] = (),
    candidates: DataFrame | None = None,
    carry: Sequence[str] = (),
    inclusive: bool = True,
    nested: bool = False,
) -> DataFrame:
    """Pairs of query and reference ions whose m/z agree: ``on..., qry_ids, ref_ids, carry..., delta``.

    ``qry`` and ``ref`` have ``id`` and ``mz``, optionally ``rt``, and the columns of
    ``on``, which must be equal (the groups of a queue). ``carry`` names columns of
    ``ref`` to keep, such as the adduct. A pair matches if its difference, in Da or in
    ppm of the reference, is at most ``tolerance`` (``inclusive=False``: below it). With
    ``rt_tolerance``, and ``rt`` on both sides, retention times must agree as well; a
    null or NaN time matches nothing. Null or NaN m/z match nothing, a negative
    tolerance gives no rows, tolerance 0 joins on equality.

    ``candidates(qry_ids, ref_ids)`` restricts each query to its listed references by
    equality joins; unknown ids are ignored and repeated ones count once. Otherwise the
    m/z axis is divided into buckets of the tolerance's width, linear for Da and
    logarithmic for ppm; each reference is put into its own and the two adjacent
    buckets, so every qualifying pair meets exactly once under an equality join and the
    exact test stays as a residual. ``nested=True`` tests all pairs instead.
    """
    require(qry, ["id", "mz", *on], "the query table")
    require(ref, ["id", "mz", *on, *carry], "the reference table")
    if unit not in ("ppm", "da"):
        raise ValueError(f"unit must be 'ppm' or 'da', not {unit!r}")
    timed = rt_tolerance is not None and "rt" in qry.columns and "rt" in ref.columns

    def side(df: DataFrame, s: str, extra: Sequence[str]) -> DataFrame:
        mz = F.col("mz").cast("double")
        cols = [F.col("id").alias(f"{s}_ids"), mz.alias(f"{s}_mz"), *(F.col(c).alias(f"{s}__{c}") for c in on), *(F.col(c) for c in extra)]
        if timed:
            cols.append(F.col("rt").cast("double").alias(f"{s}_rt"))
        return df.where(mz.isNotNull() & ~F.isnan(mz)).select(*cols)

    q, r = side(qry, "qry", ()), side(ref, "ref", carry)
    qm, rm = F.col("qry_mz"), F.col("ref_mz")
    d = delta(qm, rm, unit)
    test = d <= tolerance if inclusive else d < tolerance
    for c in on:
        test = test & (F.col(f"qry__{c}") == F.col(f"ref__{c}"))
    if timed:
        apart = F.abs(F.col("qry_rt") - F.col("ref_rt"))
        test = test & (apart <= rt_tolerance) & ~F.isnan(apart)
    if candidates is not None:
        listed = candidates.select("qry_ids", "ref_ids").distinct()
        hits = q.join(listed, "qry_ids").join(r, "ref_ids").where(test)
    elif nested or tolerance * 1e-6 >= 1 and unit == "ppm":
        hits = q.join(r, test)
    elif tolerance < 0:
        hits = q.join(r, F.lit(False))
    elif tolerance == 0:
        hits = q.join(r, test & (qm == rm))
    elif unit == "da":
        hits = _bucketed(q, r, F.floor(qm / _wider(tolerance)), F.floor(rm / _wider(tolerance)), test)
    else:
        t = tolerance * 1e-6
        width = _wider(-math.log1p(-t))
        above = rm > PPM_FLOOR
        hits = _bucketed(q.where(qm > 0), r.where(above), F.floor(F.ln(qm) / width), F.floor(F.ln(rm) / width), test)
        # at or below the floor of the denominator the tolerance is absolute, and tiny
        tiny = max(_wider(t * PPM_FLOOR), 1e-3)
        hits = hits.unionByName(_bucketed(q.where(qm <= 2e-6), r.where(~above), F.floor(qm / tiny), F.floor(rm / tiny), test))
    keep = [F.col(f"qry__{c}").alias(c) for c in on]
    return hits.select(*keep, "qry_ids", "ref_ids", *carry, d.alias("delta"))


def _wider(width: float) -> float:
    return width * (1 + 1e-6)


def _bucketed(q: DataFrame, r: DataFrame, qb: Column, rb: Column, test: Column) -> DataFrame:
    near = F.explode(F.array(rb - 1, rb, rb + 1)).alias("bucket")
    # sorted and merged: small files can hold many rows, which a broadcast would gather on the driver
    return q.withColumn("bucket", qb).hint("merge").join(r.select("*", near), "bucket").where(test)


def with_enough_hits(qry: DataFrame, ref: DataFrame, tolerance: float, unit: str = "ppm", threshold: int = 1, *, rt_tolerance: float | None = None, distinct_adducts: bool = False) -> DataFrame:
    """Rows of ``ref`` whose id has at least ``threshold`` hits, or different adducts among them, over all queries.

    Equal queries are joined once, with their number, and only counts leave the join; so
    ``mz_join`` of what is left gives the hits of ``co_occurrence`` without writing them.
    """
    at = ["mz", "rt"] if rt_tolerance is not None and "rt" in qry.columns and "rt" in ref.columns else ["mz"]
    alike = qry.groupBy(*at).agg(F.count(F.lit(1)).alias("id"))
    hits = mz_join(alike, ref, tolerance, unit, rt_tolerance=rt_tolerance, carry=["adducts"])
    count = F.count_distinct("adducts") if distinct_adducts else F.sum("qry_ids")
    enough = hits.groupBy("ref_ids").agg(count.alias("n")).where(F.col("n") >= threshold).select(F.col("ref_ids").alias("id"))
    return ref.join(enough, "id", "left_semi")


def join_several(qry: DataFrame, ref: DataFrame, tolerance: float, unit: str = "ppm", threshold: int = 2, *, carry: Sequence[str] = ()) -> DataFrame:
    """The hits of ``mz_join`` of every query and reference that have at least ``threshold`` of them: ``qry_ids, ref_ids, carry..., delta``.

    The rows of a reference id that one query could match are near each other, so they are
    put into one row a bucket first and meet the query together; a pair with too few is
    never a row. Queries whose id is repeated are counted over all their rows, by ``co_occurrence``.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    qry, ref = qry.where(F.col("id").isNotNull()), ref.where(F.col("id").isNotNull())
    counted = lambda q: co_occurrence(mz_join(q, ref, tolerance, unit, carry=carry), threshold, per_query=True)
    if threshold == 1 or tolerance <= 0 or unit == "ppm" and tolerance * 1e-6 >= 1:
        return counted(qry)
    require(ref, ["id", "mz", *carry], "the reference table")
    repeated = qry.groupBy("id").count().where(F.col("count") > 1).select("id")
    mz = F.col("mz").cast("double")
    if unit == "ppm":  # at or below the floor of the denominator all share a bucket
        bucket = F.floor(F.ln(F.greatest(mz, F.lit(PPM_FLOOR))) / _wider(-math.log1p(-tolerance * 1e-6)))
    else:
        bucket = F.floor(mz / _wider(tolerance))
    good = mz.isNotNull() & ~F.isnan(mz)
    q = qry.join(repeated, "id", "left_anti").where(good).select(F.col("id").alias("qry_ids"), mz.alias("qry_mz"), bucket.alias("bucket"))
    r = ref.where(good).select(F.col("id").alias("ref_ids"), F.struct(mz.alias("mz"), *carry).alias("row"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    r = r.groupBy("ref_ids", "bucket").agg(F.array_sort(F.collect_list("row")).alias("rows")).where(F.size("rows") >= threshold)
    # a query matches a row not below the threshold-th lowest, and one not above the threshold-th highest
    r = r.withColumns({"low": F.element_at("rows", -threshold)["mz"], "high": F.element_at("rows", threshold)["mz"]})
    m, loose = F.col("qry_mz"), tolerance * (1 + 1e-6)
    could = ((m <= F.col("low")) | (delta(m, F.col("low"), unit) <= loose)) & ((m >= F.col("high")) | (delta(m, F.col("high"), unit) <= loose))
    near = q.hint("merge").join(r, "bucket").where(could)
    found = near.select("qry_ids", "ref_ids", "qry_mz", F.filter("rows", lambda x: delta(m, x["mz"], unit) <= tolerance).alias("rows")).where(F.size("rows") >= threshold)
    each = found.select("qry_ids", "ref_ids", "qry_mz", F.explode("rows").alias("row"))
    hits = each.select("qry_ids", "ref_ids", *(F.col("row")[c].alias(c) for c in carry), delta(m, F.col("row")["mz"], unit).alias("delta"))
    return hits if repeated.isEmpty() else hits.unionByName(counted(qry.join(repeated, "id", "left_semi")))


def co_occurrence(hits: DataFrame, threshold: int, *, per_query: bool = False, distinct_adducts: bool = False, on: Sequence[str] = ()) -> DataFrame:
    """Hits whose reference has at least ``threshold`` hits, or different adducts among them.

    Counted over all queries (of a group ``on``), or per query and reference. Above a
    threshold of 1 the hits are written to the shared folder, so that the join that made
    them runs once for the count and the result.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    if threshold == 1:
        return hits
    hits = materialize(hits, "hits")
    keys = [*on, *(["qry_ids"] if per_query else []), "ref_ids"]
    count = F.count_distinct("adducts") if distinct_adducts else F.count(F.lit(1))
    enough = hits.groupBy(*keys).agg(count.alias("n")).where(F.col("n") >= threshold).select(*keys)
    return hits.join(enough, keys, "left_semi")


def peak_overlap(qry: DataFrame, ref: DataFrame, tolerance: float, unit: str = "ppm", *, candidates: DataFrame | None = None, inclusive: bool = False) -> DataFrame:
    """Matching reference peaks of every pair of spectra: ``qry_ids, ref_ids, n_peaks, ref_mzs``.

    Both tables hold ``id, mz``, a row a peak. A reference peak is listed once for each
    query peak that it matches, by rising m/z. The test is strict unless ``inclusive``.
    """
    if candidates is None:
        return _overlap(qry, ref, tolerance, unit, inclusive)
    r = ref.select("id", "mz", F.col("mz").alias("peak"))
    listed = candidates.select(F.col("qry_ids").alias("id"), "ref_ids").distinct()
    q = qry.select("id", "mz").join(listed, "id").select("id", "mz", F.col("ref_ids").alias("pair"))
    hits = mz_join(q, r.withColumn("pair", F.col("id")), tolerance, unit, on=["pair"], carry=["peak"], inclusive=inclusive)
    return hits.groupBy("qry_ids", "ref_ids").agg(F.count(F.lit(1)).alias("n_peaks"), F.sort_array(F.collect_list("peak")).alias("ref_mzs"))


def _overlap(qry: DataFrame, ref: DataFrame, tolerance: float, unit: str, inclusive: bool) -> DataFrame:
    """All pairs of spectra that share a peak. A task holds a block of references and passes the spectra of a block of queries by, so matches are neither shuffled nor gathered."""
    require(qry, ["id", "mz"], "the query table")
    require(ref, ["id", "mz"], "the reference table")
    if unit not in ("ppm", "da"):
        raise ValueError(f"unit must be 'ppm' or 'da', not {unit!r}")
    mz = F.col("mz").cast("double")
    n_q, n_r = qry.count(), ref.count()
    nq, nr = max(-(-n_q // BLOCK), min(8, 1 + n_q // 4096)), -(-n_r // (2 * BLOCK)) or 1
    kinds = [df.schema["id"].dataType for df in (qry, ref)]

    def side(df: DataFrame, is_qry: bool) -> DataFrame:
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        placed = df.where(mz.isNotNull() & ~F.isnan(mz)).select(block(nq if is_qry else nr).alias("own"), "id", mz.alias("mz"), every(nr if is_qry else nq).alias("other"))
        task = F.col("own") * nr + F.col("other") if is_qry else F.col("other") * nr + F.col("own")
        ids = [F.col("id").alias(name) if this == is_qry else F.lit(None).cast(kind).alias(name) for name, this, kind in (("q", True, kinds[0]), ("r", False, kinds[1]))]
        return placed.select(task.alias("task"), F.lit(is_qry).alias("is_qry"), *ids, "mz")

    schema = T.StructType([T.StructField("qry_ids", kinds[0]), T.StructField("ref_ids", kinds[1]), T.StructField("n_peaks", T.LongType()), T.StructField("ref_mzs", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block, left = None, [], None, None  # left: peaks of a query that may go on in the next batch
        for batch in batches:
            for piece in runs(pa.Table.from_batches([batch]), ["task", "is_qry"]):
                task = piece["task"][0].as_py()
                if task != now:
                    if left is not None:
                        yield from _matches(left, block, tolerance, unit, inclusive, arrow)
                    now, parts, block, left = task, [], None, None
                if not piece["is_qry"][0].as_py():
                    parts.append(piece)
                    continue
                if block is None:
                    block, parts = _peak_block(parts), []
                piece = piece if left is None else pa.concat_tables([left, piece])
                last = runs(piece.select(["q"]), ["q"], tables=False)[-1][0]
                if last:
                    yield from _matches(piece.slice(0, last), block, tolerance, unit, inclusive, arrow)
                left = piece.slice(last)
        if left is not None:
            yield from _matches(left, block, tolerance, unit, inclusive, arrow)

    rows = side(ref, False).unionByName(side(qry, True)).repartition(2 * nq * nr, "task").sortWithinPartitions("task", "is_qry", "q")
    return rows.mapInArrow(run, schema).withColumn("ref_mzs", F.col("ref_mzs").cast(T.ArrayType(ref.schema["mz"].dataType)))


def _peak_block(parts: list[pa.Table]) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """m/z of a block of references by rising value, and the number of each one's id among the last."""
    if not parts:
        return None
    table = pa.concat_tables(parts)
    mz, ids = table["mz"].to_numpy(), table["r"].combine_chunks().dictionary_encode("encode")
    order = np.argsort(mz, kind="stable")
    return mz[order], ids.indices.to_numpy().astype(np.int64)[order], ids.dictionary


def _matches(table: pa.Table, block: tuple[np.ndarray, np.ndarray, pa.Array] | None, tolerance: float, unit: str, inclusive: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Matching peaks of whole queries, sorted by id, against a block of references."""
    if block is None:
        return
    peaks, number, ids = block
    mz, t = table["mz"].to_numpy(), tolerance * 1e-6
    wide, near = 1e-9 * np.abs(mz), 1.01 * abs(tolerance if unit == "da" else t * PPM_FLOOR)  # the exact test follows
    if unit == "da":
        low, high = mz - near - wide, mz + near + wide
    else:
        up = mz / (1 - t) if t < 1 else np.full(len(mz), np.inf)
        low, high = np.where(mz > 0, mz / (1 + max(t, 0)), mz if t < 1 else -np.inf) - near - wide, np.where(mz > 0, up, mz if t < 1 else np.inf) + near + wide
    start, stop = np.searchsorted(peaks, low, "left"), np.searchsorted(peaks, high, "right")
    count = np.maximum(stop - start, 0)
    first = np.array([i for i, _ in runs(table.select(["q"]), ["q"], tables=False)])
    query = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(mz)]))
    lot = np.r_[0, np.cumsum(count)][first] // AT_ONCE  # queries with some million matches together
    edges = np.r_[first[np.flatnonzero(np.r_[True, lot[1:] != lot[:-1]])], len(mz)]
    for a, b in zip(edges[:-1], edges[1:]):
        n = count[a:b]
        own = np.repeat(np.arange(a, b), n)
        at = np.arange(len(own)) + np.repeat(start[a:b] - np.cumsum(n) + n, n)
        apart = np.abs(mz[own] - peaks[at])
        if unit == "ppm":
            apart = apart * (1e6 / np.maximum(peaks[at], PPM_FLOOR))
        ok = apart <= tolerance if inclusive else apart < tolerance
        own, at = own[ok], at[ok]
        if not len(own):
            continue
        pair = (query[own] - query[a]) * len(ids) + number[at]
        if (int(pair.max()) + 1) * len(peaks) < 1 << 62:
            pair, at = np.divmod(np.sort(pair * len(peaks) + at), len(peaks))
        else:
            order = np.lexsort((at, pair))
            pair, at = pair[order], at[order]
        begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        q, r = np.divmod(pair[begin], len(ids))
        ends = np.r_[begin, len(pair)]
        yield pa.RecordBatch.from_arrays([table["q"].take(pa.array(first[q + query[a]])).combine_chunks(), ids.take(pa.array(r)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(peaks[at]))], schema=arrow)
