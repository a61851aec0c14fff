"""Column contracts of the tables the operators take and give."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PEAK = T.StructType([T.StructField("mz", T.DoubleType()), T.StructField("intensity", T.DoubleType())])
SPECTRA = T.StructType([T.StructField("spectrum_id", T.LongType()), T.StructField("peaks", T.ArrayType(PEAK))])
IONS = T.StructType([T.StructField("id", T.LongType()), T.StructField("mz", T.DoubleType()), T.StructField("rt", T.DoubleType())])
FRAGMENTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("adducts", T.StringType()), T.StructField("mz", T.DoubleType()), T.StructField("rt", T.DoubleType())])
EMBEDDINGS = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CANDIDATES = T.StructType([T.StructField("qry_ids", T.LongType()), T.StructField("ref_ids", T.LongType())])
LOSSES = T.StructType([T.StructField("loss_idx", T.LongType()), T.StructField("loss_type", T.LongType()), T.StructField("loss_da", T.DoubleType())])
PATTERN_EDGES = T.StructType([T.StructField("pattern_id", T.LongType()), T.StructField("u", T.IntegerType()), T.StructField("v", T.IntegerType()), T.StructField("loss_type", T.LongType())])
PATTERN_NODES = T.StructType([T.StructField("pattern_id", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("mz", T.DoubleType())])


def require(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """``df`` itself if it has all ``columns``; else a TypeError that names the missing ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TypeError(f"{what} lacks the columns {missing}; it has {df.columns}")
    return df
