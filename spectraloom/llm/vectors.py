"""Vectors between Spark's arrays, Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.runtime import col


def select_vectors(df: DataFrame, id: str, embedding: str, dim: int) -> DataFrame:
    """``(id, v)`` of the valid vectors, each id once.

    A valid vector has ``dim`` components, none null, NaN or infinite, and not all zero;
    rows without one, or with a null id, are left out. Of several vectors under one id
    the lowest in order of components is taken. Repeats are removed before they are
    shuffled, so an id that is repeated very often gathers nowhere.
    """
    v = col(embedding).cast("array<float>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = df.select(col(id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    rows = rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def packed(df: DataFrame) -> DataFrame:
    """``(id, v)`` with the float32 vectors as bytes, which cost far less to copy between Spark and Python than arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), bytes_of(flat.reshape(batch.num_rows, -1))], ["id", "v"])

    return df.select("id", "v").mapInArrow(run, "id long, v binary")


def bytes_of(x: np.ndarray, keep: np.ndarray | None = None) -> pa.BinaryArray:
    """The rows of ``x``, in single precision, as bytes; null where ``keep`` is false."""
    keep = np.ones(len(x), bool) if keep is None else keep
    x = np.ascontiguousarray(x[keep], np.float32)
    ends = np.r_[0, np.cumsum(np.where(keep, 4 * (x.shape[1] if x.ndim == 2 else 0), 0))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keep), [pa.array(keep).buffers()[1], pa.py_buffer(ends), pa.py_buffer(x)])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The float32 vectors of a column of bytes or of lists that has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim), np.float32)
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.float32).reshape(-1, dim)
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim))


def unpack(table: pa.Table, dim: int, name: str = "v", *, order: bool = False) -> tuple[np.ndarray, ...]:
    """Ids and float32 vectors, ordered by id, so that results do not depend on the order of rows; with ``order`` also the places they had."""
    x = matrix(table[name], dim)
    ids = table["id"].to_numpy()
    at = np.argsort(ids, kind="stable")
    return (ids[at], x[at], at) if order else (ids[at], x[at])


def lists_of(x: np.ndarray, keep: np.ndarray | None = None) -> pa.ListArray:
    """The rows of ``x`` as lists, null where ``keep`` is false."""
    n, dim = x.shape
    keep = np.ones(n, bool) if keep is None else keep
    ends = np.r_[0, np.cumsum(np.where(keep, dim, 0))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x[keep]).ravel()), mask=pa.array(~keep))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, computed in double, kept in single precision."""
    wide = x.astype(np.float64)
    return (wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of matching rows in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
