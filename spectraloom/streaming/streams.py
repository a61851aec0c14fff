"""Searches of a stream of query ions or vectors against a static library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from spectraloom.operators.bandjoin import mz_join


def stream_mz_join(stream: DataFrame, ref: DataFrame, tolerance: float = 3.0, unit: str = "ppm", **options) -> DataFrame:
    """Hits of a stream of ions ``id, mz[, rt]``: a stateless join of stream and static table."""
    if not stream.isStreaming:
        raise TypeError("the query table is not a stream")
    return mz_join(stream, ref, tolerance, unit, **options)


def rank_batches(stream: DataFrame, search: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Runs a search that ranks, which a stream cannot do, on every micro-batch and hands the hits to ``sink(hits, batch_id)``.

    A batch can be repeated after a failure; a sink that keeps the last result of a
    batch id makes the whole exactly once.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: sink(search(batch), number))
