"""A search in two stages: ions choose the candidates, vectors rank them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators import views
from spectraloom.operators.search import EmbeddingSearcher, FragmentSearcher, PrecursorSearcher
from spectraloom.sources.library import Library


def two_stage_search(
    qry_ions: DataFrame,
    ref_ions: DataFrame,
    qry_vectors: DataFrame,
    ref_vectors: DataFrame,
    *,
    first: PrecursorSearcher | FragmentSearcher,
    second: EmbeddingSearcher,
    molecules: DataFrame | None = None,
) -> DataFrame:
    """Hits of the second stage, with molecule columns and the adducts of the first stage where there are any.

    One lazy plan: band join, candidate join, ranking and enrichment. Ions without a
    vector can give no hit and are dropped before the band join, unless the first stage
    counts hits.
    """
    if getattr(first, "co_occurrence_threshold", 1) == 1:
        qry_ions = qry_ions.join(qry_vectors.select("id").distinct(), "id", "left_semi")
        ref_ions = ref_ions.join(ref_vectors.select("id").distinct(), "id", "left_semi")
    ions = first.run(qry_ions, ref_ions)
    ranked = second.run(qry_vectors, ref_vectors, ions.tag_refs()).table
    if molecules is None:
        return ranked
    return views.enrich(ranked, molecules, ions.table if "adducts" in ions.table.columns else None)


def search_library(
    library: Library,
    qry_ions: DataFrame,
    qry_vectors: DataFrame,
    *,
    by: str = "fragments",
    embedding: str = "embedding",
    adducts: str | Sequence[str] = "all_adducts",
    mz_tolerance: float = 3.0,
    unit: str = "ppm",
    rt_tolerance: float | None = 0.1,
    co_occurrence_threshold: int = 1,
    metric: str = "plain_cosine",
    top_k: int | None = 5,
    keep_unmatched: bool = False,
    decimals: int | None = None,
) -> DataFrame:
    """Two-stage search of a library: ``qry_ids, ref_ids, topk, scores``, SMILES and formula, and adducts.

    ``by='fragments'`` chooses candidates by the library's fragments of some adducts,
    ``by='precursors'`` by the m/z ``pi`` of its spectra; formula and SMILES are null
    where the library has none. With ``keep_unmatched`` a query without a hit has a row
    of nulls.
    """
    if by == "fragments":
        refs = library.fragment_mzs(adducts)
        first = FragmentSearcher(mz_tolerance, unit, rt_tolerance, co_occurrence_threshold)
    elif by == "precursors":
        spectra = library["spectra"]
        refs = spectra.select("id", F.col("pi").alias("mz"), *(["rt"] if "rt" in spectra.columns else []))
        first = PrecursorSearcher(mz_tolerance, unit, rt_tolerance)
    else:
        raise ValueError("by must be 'fragments' or 'precursors'")
    known = library.tables.get("molecules")
    have = known.columns if known is not None else []
    text = lambda c: (F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
    molecules = (known if known is not None else library.ids()).select("id", text("smiles"), text("formula"))
    hits = two_stage_search(qry_ions, refs, qry_vectors, library.embedding(embedding), first=first, second=EmbeddingSearcher(metric, top_k, decimals), molecules=molecules)
    if not keep_unmatched:
        return hits
    return qry_vectors.select(F.col("id").alias("qry_ids")).distinct().join(hits, "qry_ids", "left")
