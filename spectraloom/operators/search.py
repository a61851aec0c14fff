"""Tools and searchers: configured operators that take tables and give hit tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from spectraloom.functions.vectors import VectorMetric
from spectraloom.operators import similarity, views
from spectraloom.operators.bandjoin import co_occurrence, mz_join, with_enough_hits
from spectraloom.operators.binning import POOLS, bin_spectra, n_bins
from spectraloom.operators.patterns import search_patterns
from spectraloom.operators.similarity import SpectrumMetric
from spectraloom.schema import require


@dataclass(frozen=True)
class Hits:
    """A hit table with its usual views."""

    table: DataFrame

    def unique_qry_ids(self) -> DataFrame:
        return views.unique_ids(self.table, "qry_ids")

    def unique_ref_ids(self) -> DataFrame:
        return views.unique_ids(self.table, "ref_ids")

    def tag_refs(self) -> DataFrame:
        """Candidates for a next search."""
        return views.tag_refs(self.table, "topk" if "topk" in self.table.columns else None)


@dataclass(frozen=True)
class PrecursorSearcher:
    """Reference ions whose m/z, and retention time where both sides have one, agree with a query ion."""

    mz_tolerance: float = 3.0
    unit: str = "ppm"
    rt_tolerance: float | None = 0.1

    def run(self, qry: DataFrame, ref: DataFrame, candidates: DataFrame | None = None) -> Hits:
        return Hits(mz_join(qry, ref, self.mz_tolerance, self.unit, rt_tolerance=self.rt_tolerance, candidates=candidates))


@dataclass(frozen=True)
class FragmentSearcher:
    """The same over references in long form by adduct, keeping references with enough hits.

    Without candidates hits are counted over all queries, with them per query.
    """

    mz_tolerance: float = 3.0
    unit: str = "ppm"
    rt_tolerance: float | None = 0.1
    co_occurrence_threshold: int = 1
    distinct_adducts: bool = False

    def run(self, qry: DataFrame, ref: DataFrame, candidates: DataFrame | None = None) -> Hits:
        require(ref, ["id", "adducts", "mz"], "the fragment table")
        least = self.co_occurrence_threshold
        if candidates is None and least > 1:  # references are counted first, and only hits of those kept are made
            ref = with_enough_hits(qry, ref, self.mz_tolerance, self.unit, least, rt_tolerance=self.rt_tolerance, distinct_adducts=self.distinct_adducts)
            return Hits(mz_join(qry, ref, self.mz_tolerance, self.unit, rt_tolerance=self.rt_tolerance, carry=["adducts"]))
        hits = mz_join(qry, ref, self.mz_tolerance, self.unit, rt_tolerance=self.rt_tolerance, candidates=candidates, carry=["adducts"])
        return Hits(co_occurrence(hits, least, per_query=candidates is not None, distinct_adducts=self.distinct_adducts))


@dataclass(frozen=True)
class EmbeddingSearcher:
    """The ``top_k`` most similar references of each query vector, of its candidates if there are any."""

    metric: str | VectorMetric = "cosine"
    top_k: int | None = None
    decimals: int | None = None

    def run(self, qry: DataFrame, ref: DataFrame, candidates: DataFrame | None = None) -> Hits:
        if candidates is not None:
            return Hits(similarity.top_k_candidates(qry, ref, candidates, self.metric, self.top_k, decimals=self.decimals))
        return Hits(similarity.top_k(qry, ref, similarity.vector_scorer(self.metric), self.top_k, decimals=self.decimals))


@dataclass(frozen=True)
class EmbeddingSimilarity:
    """Scores of all pairs of query and reference vectors ``id, embedding``, within the groups ``on`` if there are any."""

    metric: str | VectorMetric = "cosine"
    decimals: int | None = None

    def run(self, qry: DataFrame, ref: DataFrame, on: Sequence[str] = ()) -> DataFrame:
        return similarity.all_pairs(qry, ref, similarity.vector_scorer(self.metric), on=on, decimals=self.decimals)


@dataclass(frozen=True)
class SpectrumSimilarity:
    """Scores of all pairs of spectra ``id, peaks`` by a spectrum metric: a registered one with ``options`` over its defaults, or the caller's own."""

    metric: str | SpectrumMetric = "spectral_entropy"
    options: Mapping[str, Any] = field(default_factory=dict)
    decimals: int | None = None

    def run(self, qry: DataFrame, ref: DataFrame, on: Sequence[str] = ()) -> DataFrame:
        return similarity.all_pairs(qry, ref, similarity.spectrum_scorer(self.metric, **self.options), value="peaks", on=on, decimals=self.decimals)


@dataclass(frozen=True)
class SpectrumSearcher:
    """The ``top_k`` most similar spectra by a spectrum metric, spectral entropy unless another is named.

    ``tolerance``, ``ppm`` and ``clean_spectra`` are those of spectral entropy; any
    metric takes its ``options``.
    """

    tolerance: float = 0.02
    ppm: float = -1.0
    clean_spectra: bool = True
    top_k: int | None = None
    decimals: int | None = None
    metric: str | SpectrumMetric = "spectral_entropy"
    options: Mapping[str, Any] = field(default_factory=dict)

    def run(self, qry: DataFrame, ref: DataFrame, on: Sequence[str] = ()) -> Hits:
        own = {"tolerance": self.tolerance, "ppm": self.ppm, "clean_spectra": self.clean_spectra} if self.metric == "spectral_entropy" else {}
        scorer = similarity.spectrum_scorer(self.metric, **{**own, **self.options})
        return Hits(similarity.top_k(qry, ref, scorer, self.top_k, value="peaks", on=on, decimals=self.decimals))


@dataclass(frozen=True)
class SpectrumBinning:
    window: tuple[float, float, float] = (50.0, 1000.0, 1.0)
    pool: str = "sum"

    def __post_init__(self) -> None:
        n_bins(self.window)
        if self.pool not in POOLS:
            raise ValueError(f"pool must be one of {POOLS}, not {self.pool!r}")

    def run(self, spectra: DataFrame) -> DataFrame:
        return bin_spectra(spectra, self.window, self.pool)


@dataclass(frozen=True)
class PatternSearch:
    """Patterns of neutral losses, as lists of edges (node, node, loss type) by number."""

    patterns: dict[int, list[tuple[int, int, int]]]
    loss_tolerance: float = 0.1
    mz_tolerance: float = 3.0
    unit: str = "ppm"
    node_mz: dict[int, dict[int, float]] = field(default_factory=dict)

    def run(self, peaks: DataFrame, losses: DataFrame) -> DataFrame:
        return search_patterns(peaks, losses, self.patterns, self.loss_tolerance, node_mz=self.node_mz, tolerance=self.mz_tolerance, unit=self.unit)
