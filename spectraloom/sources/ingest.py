"""Building contract tables from Python, pandas and wide tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom import schema as S
from spectraloom.functions.smiles import smiles_formula


def _same_length(what: str, *fields: Sequence | None) -> int:
    sizes = {len(f) for f in fields if f is not None}
    if len(sizes) > 1:
        raise ValueError(f"{what}: fields of different lengths {sorted(sizes)}")
    return sizes.pop() if sizes else 0


def ions(spark: SparkSession, mzs: Sequence[float], rts: Sequence[float] | None = None, ids: Sequence | None = None) -> DataFrame:
    """``id, mz``, and ``rt`` if times are given; ids default to 0, 1, ..., NaN times become null."""
    n = _same_length("ions", mzs, rts, ids)
    ids = list(range(n)) if ids is None else list(ids)
    clean = lambda x: None if x is None or x != x else float(x)
    rows = [(ids[i], clean(mzs[i]), None if rts is None else clean(rts[i])) for i in range(n)]
    key = T.StringType() if ids and isinstance(ids[0], str) else T.LongType()
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", key), *S.IONS.fields[1:]]))
    return df if rts is not None else df.drop("rt")


def fragments(spark: SparkSession, mzs: Sequence[Sequence[float]], adducts: Sequence[str], rts: Sequence[float] | None = None, ids: Sequence | None = None) -> DataFrame:
    """Long form ``id, adducts, mz``, and ``rt`` if times are given, of a matrix (reference x adduct)."""
    n = _same_length("fragments", mzs, rts, ids)
    if any(len(row) != len(adducts) for row in mzs):
        raise ValueError("every row needs one m/z per adduct")
    ids = list(range(n)) if ids is None else list(ids)
    rows = [(ids[i], a, float(m) if m is not None else None, None if rts is None else rts[i]) for i in range(n) for a, m in zip(adducts, mzs[i])]
    df = spark.createDataFrame(rows, S.FRAGMENTS)
    return df if rts is not None else df.drop("rt")


def unpivot_adducts(wide: DataFrame, id: str = "id", *, reserved: Sequence[str] = ("formula", "RT", "[M]")) -> DataFrame:
    """Long form of a table with one column per adduct; all columns but the id and the reserved ones are adducts."""
    adducts = [c for c in wide.columns if c != id and c not in reserved]
    rt = [F.col("`RT`").cast("double").alias("rt")] if "RT" in wide.columns else []
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("adducts"), F.col(f"`{a}`").cast("double").alias("mz")) for a in adducts)))
    return wide.select(F.col(f"`{id}`").alias("id"), *rt, pairs.alias("p")).select("id", "p.adducts", "p.mz", *(["rt"] if rt else []))


def candidates(spark: SparkSession, lists: dict) -> DataFrame:
    """``qry_ids, ref_ids`` of a mapping from query to a list of references."""
    return spark.createDataFrame([(q, r) for q, refs in lists.items() for r in refs], S.CANDIDATES)


def embeddings(spark: SparkSession, vectors: Sequence[Sequence[float]], ids: Sequence | None = None) -> DataFrame:
    """``id, embedding`` in single precision; all vectors must have the same length."""
    _same_length("embeddings", vectors, ids)
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors of different lengths")
    ids = list(range(len(vectors))) if ids is None else list(ids)
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], S.EMBEDDINGS)


def spectra(spark: SparkSession, mzs: Sequence[Sequence[float]], intensities: Sequence[Sequence[float]], ids: Sequence | None = None) -> DataFrame:
    """``spectrum_id, peaks``; the two lists of a spectrum must have the same length."""
    n = _same_length("spectra", mzs, intensities, ids)
    if any(len(m) != len(x) for m, x in zip(mzs, intensities)):
        raise ValueError("m/z and intensity lists of different lengths")
    ids = list(range(n)) if ids is None else list(ids)
    return spark.createDataFrame([(ids[i], [(float(a), float(b)) for a, b in zip(mzs[i], intensities[i])]) for i in range(n)], S.SPECTRA)


def molecules(df: DataFrame, *, inchi_to_smiles: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, smiles, inchi, formula`` of a table with an id and any of the others.

    A missing SMILES is taken from the InChI by the given function, if there is one; a
    missing formula from the formula layer of the InChI, or else from the SMILES.
    """
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    smiles = F.coalesce(have("smiles"), inchi_to_smiles(have("inchi"))) if inchi_to_smiles else have("smiles")
    layer = F.regexp_extract(have("inchi"), r"^InChI=1S?/([A-Za-z0-9]+)", 1)
    return df.select("id", smiles.alias("smiles"), have("inchi").alias("inchi"), F.coalesce(have("formula"), F.when(layer != "", layer), smiles_formula(smiles)).alias("formula"))


def explode_peaks(spectra: DataFrame, id: str = "spectrum_id") -> DataFrame:
    """One row per peak: ``id, peak, mz, intensity``."""
    return spectra.select(id, F.posexplode("peaks").alias("peak", "p")).select(id, "peak", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def nest_peaks(peaks: DataFrame, id: str = "spectrum_id") -> DataFrame:
    """The reverse, in order of ``peak``."""
    nested = peaks.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("peak", "mz", "intensity"))).alias("p"))
    return nested.select(id, F.transform("p", lambda x: F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity"))).alias("peaks"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold only nulls."""
    filled = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if filled[i]))
