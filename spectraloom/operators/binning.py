"""Pooling of peaks on a grid of m/z bins."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.schema import require

POOLS = ("sum", "max", "avg")


def n_bins(window: tuple[float, float, float]) -> int:
    low, high, size = window
    if not (size > 0 and high > low):
        raise ValueError("the window must be (low, high, size) with low < high and size > 0")
    return math.ceil((high - low) / size)


def bin_of(mz: Column, window: tuple[float, float, float]) -> Column:
    """Number of the half-open bin, or null outside the grid."""
    place = F.floor((mz - window[0]) / window[2])
    return F.when((place >= 0) & (place < n_bins(window)), place.cast("int"))


def bin_peaks(peaks: DataFrame, window: tuple[float, float, float] = (50.0, 1000.0, 1.0), pool: str = "sum", *, id: str | Sequence[str] = "spectrum_id") -> DataFrame:
    """Non-empty bins ``id, bin, value`` of a table with a row a peak (``id, mz, intensity``); ``id`` can be several columns.

    Peaks outside the window, and with a null or NaN m/z or intensity, are left out.
    """
    ids = [id] if isinstance(id, str) else list(id)
    require(peaks, [*ids, "mz", "intensity"], "the peak table")
    if pool not in POOLS:
        raise ValueError(f"pool must be one of {POOLS}, not {pool!r}")
    mz, value = F.col("mz").cast("double"), F.col("intensity").cast("double")
    rows = peaks.where(~F.isnan(mz) & ~F.isnan(value)).select(*ids, bin_of(mz, window).alias("bin"), value.alias("x"))
    return rows.where(F.col("bin").isNotNull()).groupBy(*ids, "bin").agg(getattr(F, pool)("x").alias("value"))


def densify(bins: DataFrame, window: tuple[float, float, float] = (50.0, 1000.0, 1.0), *, id: str = "spectrum_id") -> DataFrame:
    """``id, embedding``: one value a bin, 0 where there is none."""
    n = n_bins(window)
    filled = bins.groupBy(id).agg(F.collect_list(F.struct("bin", F.col("value").cast("double").alias("value"))).alias("m"))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            flat, out = lists.flatten(), np.zeros((len(lists), n))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            out[row, flat.field("bin").to_numpy(zero_copy_only=False)] = flat.field("value").to_numpy(zero_copy_only=False)
            ends = pa.array((np.arange(len(lists) + 1) * n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [id, "embedding"])

    return filled.mapInArrow(scatter, T.StructType([filled.schema[id], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))


def bin_spectra(spectra: DataFrame, window: tuple[float, float, float] = (50.0, 1000.0, 1.0), pool: str = "sum", *, id: str = "spectrum_id") -> DataFrame:
    """``id, embedding`` of spectra given as ``id, peaks``; spectra without a peak in the window are all zero."""
    require(spectra, [id, "peaks"], "the spectrum table")
    peaks = spectra.select(id, F.explode("peaks").alias("p")).select(id, F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    dense = densify(bin_peaks(peaks, window, pool, id=id), window, id=id)
    none = F.array_repeat(F.lit(0.0), n_bins(window))
    return spectra.select(id).join(dense, id, "left").select(id, F.coalesce("embedding", none).alias("embedding"))
