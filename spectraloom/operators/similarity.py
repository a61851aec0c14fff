"""All-pairs similarity and top-k search of vectors and spectra.

Both sides are cut into blocks by a hash of the id; each pair of blocks (of a group) is
a task that scores its block of queries against its block of references at once, with
BLAS for vectors. Top-k search keeps the k best of every block pair and ranks those
again, so neither side is broadcast or gathered and only winners are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spectraloom.functions.entropy import clean, entropy_block, matched_sums
from spectraloom.functions.vectors import VectorMetric, metric
from spectraloom.runtime import materialize, runs
from spectraloom.schema import require

#: Scores that a task computes at once.
SLICE = 1 << 22

@dataclass(frozen=True)
class Scorer:
    """``score`` compares two columns of prepared values, giving a matrix; ``prepare`` makes those of a raw column, once a row, before rows are copied to blocks.

    ``prepare`` maps a column to arrays or structs of arrays of the type ``prepared``.
    """

    score: Callable[[pa.ChunkedArray, pa.ChunkedArray], np.ndarray]
    prepare: Callable[[pa.Array], pa.Array] | None = None
    prepared: str = ""

    def __call__(self, a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
        return self.score(a, b)


def vector_scorer(which: str | VectorMetric) -> Scorer:
    block = metric(which).block

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)

    return Scorer(lambda q, r: block(matrix(q), matrix(r)))


def binned_scorer(which: str | VectorMetric = "cosine", bins: int = 950) -> Scorer:
    """Vectors given by their non-empty bins, ``array<struct<bin, value>>``; they are dense only within a task, some at a time."""
    block = metric(which).block

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        flat = lists.flatten()
        out = np.zeros((len(lists), bins))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        out[row, flat.field("bin").to_numpy(zero_copy_only=False)] = flat.field("value").to_numpy(zero_copy_only=False)
        return out

    return Scorer(lambda q, r: block(matrix(q), matrix(r)))


Peaks = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class SpectrumMetric:
    """``prepare(mz, intensity)`` makes a spectrum ready, once; ``block`` compares all spectra of two lists."""

    name: str
    prepare: Callable[[np.ndarray, np.ndarray], Peaks]
    block: Callable[[list[Peaks], list[Peaks]], np.ndarray]


def entropy_metric(tolerance: float = 0.02, ppm: float = -1.0, clean_spectra: bool = True) -> SpectrumMetric:
    """Spectral entropy similarity; a ``ppm`` above 0 takes the place of the Da tolerance."""

    def prepare(mz: np.ndarray, x: np.ndarray) -> Peaks:
        gap = 2 * tolerance if ppm <= 0 else 2e-6 * ppm * float(np.nanmax(mz, initial=0.0))
        return clean(mz, x, gap if clean_spectra else 0.0, 0.01 if clean_spectra else 0.0)

    return SpectrumMetric("spectral_entropy", prepare, lambda q, r: entropy_block(q, r, ppm if ppm > 0 else tolerance, ppm > 0))


def peak_cosine_metric(tolerance: float = 0.02, power: float = 0.5) -> SpectrumMetric:
    """Cosine of intensities, raised to ``power``, of the peaks that agree within ``tolerance`` Da."""

    def prepare(mz: np.ndarray, x: np.ndarray) -> Peaks:
        ok = np.isfinite(mz) & np.isfinite(x) & (mz > 0) & (x > 0)
        order = np.argsort(mz[ok], kind="stable")
        w = x[ok][order] ** power
        return mz[ok][order], w / max(float(np.sqrt((w * w).sum())), 1e-300)

    return SpectrumMetric("peak_cosine", prepare, lambda q, r: np.clip(matched_sums(q, r, tolerance, False, lambda a, b: a * b), 0.0, 1.0))


#: Spectrum metrics by name; each takes its own options.
SPECTRUM_METRICS: dict[str, Callable[..., SpectrumMetric]] = {"spectral_entropy": entropy_metric, "peak_cosine": peak_cosine_metric}


def spectrum_metric(which: str | SpectrumMetric, **options) -> SpectrumMetric:
    """A registered metric with the caller's options over its defaults, or the caller's own."""
    if isinstance(which, SpectrumMetric):
        return which
    if which not in SPECTRUM_METRICS:
        raise ValueError(f"unknown spectrum metric {which!r}; known: {sorted(SPECTRUM_METRICS)}")
    return SPECTRUM_METRICS[which](**options)


def spectrum_scorer(which: str | SpectrumMetric = "spectral_entropy", **options) -> Scorer:
    """Peak lists compared by a spectrum metric; each is prepared once."""
    own = spectrum_metric(which, **options)

    def prepare(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        mz, x = (np.asarray(pc.struct_field(flat, f).to_numpy(zero_copy_only=False), np.float64) for f in ("mz", "intensity"))  # null peaks become NaN
        ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        done = [own.prepare(mz[i:j], x[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        at = pa.array(np.r_[0, np.cumsum([len(m) for m, _ in done])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0), *(d[k] for d in done)]))) for k in (0, 1)]
        return pa.StructArray.from_arrays(lists, ["mz", "p"])

    def spectra(column: pa.ChunkedArray) -> list[Peaks]:
        rows = column.combine_chunks()
        mz, p = rows.field("mz"), rows.field("p")
        ends = np.r_[0, np.cumsum(mz.value_lengths().to_numpy(zero_copy_only=False))]
        m, x = (c.flatten().to_numpy(zero_copy_only=False) for c in (mz, p))
        return [(m[i:j], x[i:j]) for i, j in zip(ends[:-1], ends[1:])]

    return Scorer(lambda q, r: own.block(spectra(q), spectra(r)), prepare, "struct<mz:array<double>,p:array<double>>")


def entropy_scorer(tolerance: float = 0.02, ppm: float = -1.0, clean_spectra: bool = True) -> Scorer:
    return spectrum_scorer("spectral_entropy", tolerance=tolerance, ppm=ppm, clean_spectra=clean_spectra)


def all_pairs(qry: DataFrame, ref: DataFrame, scorer: Scorer, *, value: str = "embedding", on: Sequence[str] = (), decimals: int | None = None, block_rows: int = 16_384) -> DataFrame:
    """Scores of all pairs (of a group): ``on..., qry_ids, ref_ids, scores``; null ids, values and groups have none."""
    return _blocks(qry, ref, scorer, value, on, None, decimals, block_rows)


def top_k(qry: DataFrame, ref: DataFrame, scorer: Scorer, k: int | None, *, value: str = "embedding", on: Sequence[str] = (), decimals: int | None = None, block_rows: int = 16_384) -> DataFrame:
    """The ``k`` best references of every query: ``on..., qry_ids, ref_ids, topk, scores``.

    Ranks start at 1; ties go to the lower reference id; scores that are NaN are no
    hits; ``k=None`` ranks all references. With ``decimals`` scores are rounded first,
    and then ranked.
    """
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    return rank(_blocks(qry, ref, scorer, value, on, k, decimals, block_rows), k, on)


def rank(scored: DataFrame, k: int | None, on: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy(*on, "qry_ids").orderBy(F.desc("scores"), "ref_ids")
    ranked = scored.where(~F.isnan("scores")).withColumn("topk", F.row_number().over(order))
    if k is not None:
        ranked = ranked.where(F.col("topk") <= k)
    return ranked.select(*on, "qry_ids", "ref_ids", F.col("topk").cast("long").alias("topk"), "scores")


def top_k_candidates(qry: DataFrame, ref: DataFrame, candidates: DataFrame, which: str | VectorMetric, k: int | None, *, decimals: int | None = None, block_rows: int = 2048) -> DataFrame:
    """As ``top_k``, each query meeting only its listed references; unknown ids are ignored, repeated pairs count once.

    Both sides are cut into blocks by a hash of the id; the listed pairs of a pair of
    blocks go to the task that holds both blocks, so a vector is sent once to each block
    that it has a candidate in, however many it has there, and norms are computed once.
    """
    block = metric(which).block
    nq, nr = (max(1, -(-df.count() // block_rows)) for df in (qry, ref))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    listed = candidates.select("qry_ids", "ref_ids").where(F.col("qry_ids").isNotNull() & F.col("ref_ids").isNotNull())
    # written once, as pairs and vectors both need it: candidates can come from a join
    listed = materialize(listed.select("qry_ids", "ref_ids", place("qry_ids", nq).alias("qb"), place("ref_ids", nr).alias("rb")), "candidates")

    kind = listed.schema["ref_ids"].dataType

    def sent(df: DataFrame, own: str, side: int) -> DataFrame:
        where = listed.select(F.col(own).alias("id"), "qb", "rb").distinct()
        vectors = df.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").alias("v"))
        return vectors.join(where, "id").select("qb", "rb", F.lit(side).alias("side"), F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "v")

    pairs = listed.select("qb", "rb", F.lit(2).alias("side"), F.col("qry_ids").alias("a"), F.col("ref_ids").alias("b"), F.array().cast(qry.schema["embedding"].dataType).alias("v"))  # Arrow is slow to write null lists
    rows = sent(qry, "qry_ids", 0).unionByName(sent(ref, "ref_ids", 1)).unionByName(pairs)
    schema = T.StructType([T.StructField("qry_ids", listed.schema["qry_ids"].dataType), T.StructField("ref_ids", listed.schema["ref_ids"].dataType), T.StructField("scores", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        q, r, p = (table.filter(pa.array(side == s)) for s in (0, 1, 2))
        if not q.num_rows or not r.num_rows or not p.num_rows:
            return arrow.empty_table()
        at = lambda ids, pool: pc.index_in(ids.combine_chunks(), value_set=pool.combine_chunks()).fill_null(-1).to_numpy()
        i, j = at(p["a"], q["a"]), at(p["b"], r["a"])
        ok = (i >= 0) & (j >= 0)
        i, j = i[ok], j[ok]
        x, y = (_matrix(t["v"]) for t in (q, r))
        i, j = np.divmod(np.unique(i.astype(np.int64) * len(y) + j), len(y))  # repeated pairs meet here
        out = np.empty(len(i))
        step = max(1, SLICE // len(y))
        for low in range(0, len(x), step):
            here = slice(*np.searchsorted(i, [low, low + step]))
            if here.stop > here.start:
                out[here] = block(x[low : low + step], y)[i[here] - low, j[here]]
        if decimals is not None:
            out = np.round(out, decimals) + 0.0
        if k is not None:  # only the best of a block are sent on
            ids = r["a"].take(pa.array(j))
            best = np.lexsort((pc.rank(ids).to_numpy(), -np.where(np.isnan(out), -np.inf, out), i))
            keep = best[np.arange(len(i)) - np.searchsorted(i, i[best]) < k]
            i, j, out = i[keep], j[keep], out[keep]
        return pa.Table.from_arrays([q["a"].take(pa.array(i)).cast(arrow.field(0).type), r["a"].take(pa.array(j)).cast(arrow.field(1).type), pa.array(out)], schema=arrow)

    return rank(rows.groupBy("qb", "rb").applyInArrow(lambda t: score(t), schema), k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _prepared(df: DataFrame, scorer: Scorer, value: str) -> DataFrame:
    if scorer.prepare is None:
        return df
    rest = [c for c in df.columns if c != value]
    out = T.StructType([*(df.schema[c] for c in rest), T.StructField(value, T._parse_datatype_string(scorer.prepared))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), scorer.prepare(batch.column(value))], names=[*rest, value])

    return df.select(*rest, value).mapInArrow(run, out)


def _blocks(qry: DataFrame, ref: DataFrame, scorer: Scorer, value: str, on: Sequence[str], k: int | None, decimals: int | None, block_rows: int) -> DataFrame:
    require(qry, ["id", value, *on], "the query table")
    require(ref, ["id", value, *on], "the reference table")

    def side(df: DataFrame, own: str, other: str, size: DataFrame) -> DataFrame:
        # new attributes on both sides, as both can be the same table
        rows = df.where(F.col("id").isNotNull() & F.col(value).isNotNull()).select(*(F.col(c).alias(c) for c in on), F.col("id").alias(f"id_{own}"), F.col(value).alias(f"v_{own}"))
        rows = _prepared(rows, scorer, f"v_{own}")
        rows = rows.join(size, list(on)) if on else rows.withColumns({"n_qb": F.lit(size[0]), "n_rb": F.lit(size[1])})
        rows = rows.withColumn(own, F.pmod(F.xxhash64(f"id_{own}"), f"n_{own}").cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_qb", "n_rb")

    if on:  # as many blocks as each group needs
        count = lambda df, name: df.groupBy(*(F.col(c).alias(c) for c in on)).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
        size = count(qry, "n_qb").join(count(ref, "n_rb"), list(on))
    else:
        size = [max(1, -(-df.count() // block_rows)) for df in (qry, ref)]
    q, r = side(qry, "qb", "rb", size), side(ref, "rb", "qb", size)
    schema = T.StructType([*(q.schema[c] for c in on), T.StructField("qry_ids", q.schema["id_qb"].dataType), T.StructField("ref_ids", r.schema["id_rb"].dataType), T.StructField("scores", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        # some million scores at a time; a search keeps k of each row
        step = max(1, SLICE // b.num_rows)
        return pa.concat_tables([part(a.slice(at, step), b) for at in range(0, a.num_rows, step)])

    def part(a: pa.Table, b: pa.Table) -> pa.Table:
        s = scorer(a["v_qb"], b["v_rb"])
        if decimals is not None:
            s = np.round(s, decimals) + 0.0
        if k is None or k >= s.shape[1]:
            i, j = np.indices(s.shape).reshape(2, -1)
        else:
            clear = np.where(np.isnan(s), -np.inf, s)
            ids = b["id_rb"].to_numpy()
            order = np.argsort(ids, kind="stable")
            best = order[np.argsort(-clear[:, order], axis=1, kind="stable")[:, :k]]
            i, j = np.repeat(np.arange(len(s)), k), best.ravel()
        groups = [a[c].take(pa.array(i)) for c in on]
        return pa.Table.from_arrays([*groups, a["id_qb"].take(pa.array(i)), b["id_rb"].take(pa.array(j)), pa.array(s[i, j])], schema=arrow)

    keys = [*on, "qb", "rb"]
    if k is None:
        return _streamed(q, r, keys, part, schema, None if on else 2 * size[0] * size[1])
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(score, schema)


def _streamed(q: DataFrame, r: DataFrame, keys: list[str], part: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, tasks: int | None) -> DataFrame:
    """``part`` of every pair of blocks: a task holds its block of references and passes the queries by, giving some scores at a time, so blocks can be large and copies few."""

    def side(df: DataFrame, is_qry: bool) -> DataFrame:
        ids = [F.col(f"id_{own}") if is_qry == this else F.lit(None).cast(schema[name].dataType).alias(f"id_{own}") for own, this, name in (("qb", True, "qry_ids"), ("rb", False, "ref_ids"))]
        return df.select(*keys, F.lit(is_qry).alias("is_qry"), *ids, F.col("v_qb" if is_qry else "v_rb").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            for piece in runs(pa.Table.from_batches([batch]), [*keys, "is_qry"]):
                key = tuple(piece[c][0].as_py() for c in keys)
                if key != now:
                    now, parts, block = key, [], None
                if not piece["is_qry"][0].as_py():
                    parts.append(piece.drop_columns(["id_qb"]).rename_columns({"v": "v_rb"}))
                elif parts or block is not None:
                    if block is None:
                        block, parts = pa.concat_tables(parts).combine_chunks(), []
                    own, step = piece.rename_columns({"v": "v_qb"}), max(1, (SLICE >> 2) // block.num_rows)
                    for at in range(0, own.num_rows, step):
                        yield from part(own.slice(at, step), block).combine_chunks().to_batches()

    rows = side(r, False).unionByName(side(q, True))
    rows = rows.repartition(*keys) if tasks is None else rows.repartition(tasks, *keys)
    return rows.sortWithinPartitions(*keys, "is_qry").mapInArrow(run, schema)
