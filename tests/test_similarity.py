import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions.entropy import clean, entropy_block
from spectraloom.functions.vectors import METRICS, metric
from spectraloom.operators import similarity, views
from spectraloom.operators.binning import bin_peaks, bin_spectra, densify, n_bins
from spectraloom.operators.search import EmbeddingSearcher, EmbeddingSimilarity, SpectrumBinning, SpectrumSearcher, SpectrumSimilarity
from spectraloom.sources.ingest import candidates, embeddings, explode_peaks, nest_peaks, spectra

#: Reference spectra and the scores expected of them.
MZ = [149.05970595, 277.15869171, 295.1692564, 313.17982108, 373.20095045, 433.22207982, 581.27450931]
REFS = [
    (MZ, [0.5, 0.3, 0.4, 0.6, 0.7, 0.8, 1.0]),
    (MZ, [0.2, 0.3, 0.7, 0.3, 0.5, 0.9, 1.0]),
    ([149.05970595, 237.15869171, 295.1692564, 303.17982108, 363.20095045, 423.22207982, 581.27450931], [0.2, 0.3, 0.7, 0.3, 0.5, 0.9, 1.0]),
    ([231.15869171, 290.1692564, 303.17982108, 363.20095045, 423.22207982], [0.3, 0.7, 0.3, 0.5, 1.0]),
]
TABLE = {
    "cosine": [1.0, 0.945134, 0.479516, 0.0],
    "dot": [2.99, 2.72, 1.38, 0.0],
    "tanimoto": [1.0, 0.894737, 0.315068, 0.0],
    "jaccard": [1.0, 1.0, 0.272727, 0.0],
    "pearson": [1.0, 0.944805, 0.476309, -0.005318],
}


@pytest.fixture(scope="module")
def tables(spark):
    q = spectra(spark, [MZ, MZ], [REFS[0][1]] * 2)
    r = spectra(spark, [m for m, _ in REFS], [x for _, x in REFS])
    return q, r


@pytest.mark.parametrize("name", TABLE)
def test_binned_metrics(tables, name):
    q, r = (bin_spectra(t).withColumnRenamed("spectrum_id", "id") for t in tables)
    got = {(x.qry_ids, x.ref_ids): x.scores for x in similarity.all_pairs(q, r, similarity.vector_scorer(name)).collect()}
    assert got == pytest.approx({(i, j): s for i in (0, 1) for j, s in enumerate(TABLE[name])}, abs=2e-6)
    pairs = q.select(F.col("embedding").alias("a")).limit(1).crossJoin(r.select("id", F.col("embedding").alias("b")))
    got = {x.id: x.s for x in pairs.select("id", metric(name).expr(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == pytest.approx(dict(enumerate(TABLE[name])), abs=2e-6)


def test_golden_matrices():
    a, b = np.array([[1, 0], [0.5, 0.5]]), np.array([[1, 0], [0, 1], [0.5, 0.5]])
    assert METRICS["cosine"].block(a, b) == pytest.approx(np.array([[1, 0, 0.7071], [0.7071, 0.7071, 1]]), abs=1e-4)
    assert METRICS["tanimoto"].block(a, b) == pytest.approx(np.array([[1, 0, 0.5], [0.5, 0.5, 1]]), abs=1e-4)
    with pytest.raises(ValueError):
        metric("no such")


def test_embedding_searcher(spark, rows):
    q = embeddings(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]], [1, 2, 3])
    r = embeddings(spark, [[1, 2, 3], [1.1, 2.1, 3.1], [4, 5, 6], [7, 8, 9], [7.1, 8.1, 9.1]], [1, 2, 3, 4, 5])
    hits = EmbeddingSearcher().run(q, r, candidates(spark, {1: [1, 2], 2: [3], 3: [4, 5]}))
    assert rows(hits.table, "qry_ids", "ref_ids", "topk") == [(1, 1, 1), (1, 2, 2), (2, 3, 1), (3, 4, 1), (3, 5, 2)]
    assert [x[0] for x in sorted(rows(hits.table, "scores"))] == pytest.approx([0.999859, 1, 1, 1, 1], abs=1e-5)
    assert EmbeddingSearcher().run(q, r, candidates(spark, {1: [77]})).table.count() == 0


def test_top_k_edges_and_blocks(spark, rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6)).round(1)
    x[5] = x[6]
    e = embeddings(spark, x.tolist())
    scorer = similarity.vector_scorer("cosine")
    want = similarity.top_k(e, e, scorer, 3, decimals=6)
    assert rows(similarity.top_k(e.repartition(7), e, scorer, 3, decimals=6, block_rows=9)) == rows(want)
    s = METRICS["cosine"].block(x.astype(np.float32).astype(float), x.astype(np.float32).astype(float)).round(6)
    brute = sorted((i, int(j), r + 1) for i in range(40) for r, j in enumerate(sorted(range(40), key=lambda j: (-s[i, j], j))[:3]))
    assert rows(want, "qry_ids", "ref_ids", "topk") == brute
    assert similarity.top_k(e, e.limit(2), scorer, 6).count() == 80
    assert similarity.top_k(e, e.limit(0), scorer, 3).count() == 0 and similarity.top_k(e.limit(0), e, scorer, 3).count() == 0
    assert similarity.top_k(e, e, scorer, None).count() == 1600
    with pytest.raises(ValueError):
        similarity.top_k(e, e, scorer, 0)


def test_views(spark, rows):
    hits = spark.createDataFrame([(1, 5, 1, 0.9), (1, 3, 2, 0.8), (2, 5, 1, 0.7)], "qry_ids long, ref_ids long, topk long, scores double")
    assert rows(views.padded(hits, 3)) == [(1, (5, 3, -1), (0.9, 0.8, float("-inf"))), (2, (5, -1, -1), (0.7, float("-inf"), float("-inf")))]
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    lists = views.as_lists(hits, q, "ref_ids", "scores")
    assert rows(lists) == [(1, (3, 5), (0.8, 0.9)), (2, (5,), (0.7,)), (3, None, None)]
    assert rows(views.from_lists(lists, "ref_ids", "scores")) == [(1, 0, 3, 0.8), (1, 1, 5, 0.9), (2, 0, 5, 0.7)]
    assert rows(views.tag_refs(hits, "topk")) == [(1, 3, 2), (1, 5, 1), (2, 5, 1)]
    mol = spark.createDataFrame([(5, "CC")], "id long, smiles string")
    frag = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 5, "a")], "qry_ids long, ref_ids long, adducts string")
    assert rows(views.enrich(hits, mol, frag), "qry_ids", "ref_ids", "smiles", "adducts") == [(1, 3, None, None), (1, 5, "CC", ("a", "b")), (2, 5, "CC", None)]


def test_entropy(tables, spark, rows):
    q, r = (t.withColumnRenamed("spectrum_id", "id") for t in tables)
    got = {(x.qry_ids, x.ref_ids): x.scores for x in similarity.all_pairs(q, r, similarity.entropy_scorer(), value="peaks").collect()}
    assert [got[0, j] for j in range(4)] == pytest.approx([1.0, 0.983708, 0.440510, 0.0], abs=2e-6)
    best = SpectrumSearcher(top_k=2).run(q, r).table
    assert rows(best, "qry_ids", "ref_ids", "topk") == [(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2)]


def test_entropy_toy_spectra():
    s = [([100, 200, 300], [1, 0.8, 0.5]), ([150, 250, 350], [0.9, 0.7, 0.6]), ([150, 200, 300], [0.9, 0.7, 0.6])]
    cleaned = [clean(np.array(m, float), np.array(x), 0.04) for m, x in s]
    got = entropy_block(cleaned, cleaned, 0.02)
    assert np.diag(got) == pytest.approx([1, 1, 1])
    assert [got[0, 1], got[0, 2], got[1, 2]] == pytest.approx([0.0, 0.620148, 0.372190], abs=2e-6)
    empty = clean(np.array([-1.0, np.nan]), np.array([1.0, 1.0]), 0.04)
    assert entropy_block([empty], cleaned, 0.02).tolist() == [[0, 0, 0]] and entropy_block([], cleaned, 0.02).shape == (0, 3)
    joined = clean(np.array([100.0, 100.01, 200.0]), np.array([1.0, 1.0, 2.0]), 0.04)
    assert joined[0].tolist() == pytest.approx([100.005, 200.0])


@pytest.mark.parametrize("pool,want", [("sum", [[1, 2, 0, 3, 0], [4, 0, 5, 0, 6]]), ("max", [[1, 2, 0, 3, 0], [4, 0, 5, 0, 6]]), ("avg", [[1, 2, 0, 3, 0], [4, 0, 5, 0, 6]])])
def test_binning(spark, pool, want):
    s = spectra(spark, [[50.2, 100.5, 200.8], [99.9, 150.3, 250.1, 300.2], []], [[1, 2, 3], [4, 5, 6, 7], []])
    got = {r.spectrum_id: r.embedding for r in SpectrumBinning((50.0, 300.0, 50.0), pool).run(s).collect()}
    assert got == {0: want[0], 1: want[1], 2: [0.0] * 5}


def test_binning_pools(spark, rows):
    p = spark.createDataFrame([(1, 10.0, 1.0), (1, 10.5, 3.0), (1, float("nan"), 1.0), (1, 99.0, 9.0), (1, None, 1.0)], "spectrum_id long, mz double, intensity double")
    for pool, want in (("sum", 4.0), ("max", 3.0), ("avg", 2.0)):
        bins = bin_peaks(p, (10.0, 12.0, 1.0), pool)
        assert rows(bins) == [(1, 0, want)]
        assert densify(bins, (10.0, 12.0, 1.0)).first().embedding == [want, 0.0]
    assert n_bins((0.0, 10.0, 3.0)) == 4
    with pytest.raises(ValueError):
        bin_peaks(p, pool="median")
    with pytest.raises(ValueError):
        n_bins((10.0, 5.0, 1.0))


def test_peaks_round_trip(spark, rows):
    s = spectra(spark, [[3.0, 1.0], [2.0]], [[1.0, 2.0], [5.0]])
    assert rows(nest_peaks(explode_peaks(s))) == rows(s)


def test_centroiding_ends_at_exact_distances():
    rng = np.random.default_rng(3)
    for _ in range(300):
        mz = np.sort(100 + 0.02 * rng.integers(0, 60, 40) + rng.choice([0, 1e-15, 0.04], 40))
        joined, p = clean(mz, rng.uniform(0.1, 1, 40), 0.04)
        assert (np.diff(joined) >= 0.04).all() and p.sum() == pytest.approx(1)


def test_spectrum_metrics(tables, rows):
    q, r = (t.withColumnRenamed("spectrum_id", "id") for t in tables)
    got = {(x.qry_ids, x.ref_ids): x.scores for x in SpectrumSimilarity("peak_cosine").run(q, r).collect()}
    assert got[0, 0] == pytest.approx(1) and got[0, 3] == 0 and 0 < got[0, 2] < got[0, 1] < 1
    assert rows(SpectrumSimilarity().run(q, r)) == rows(similarity.all_pairs(q, r, similarity.entropy_scorer(), value="peaks"))
    wide = SpectrumSimilarity("spectral_entropy", {"tolerance": 200.0, "clean_spectra": False}).run(q, r).collect()
    assert any(x.scores > 0 for x in wide if x.ref_ids == 3)  # the caller's options go over the defaults
    own = similarity.SpectrumMetric("peaks in common", lambda mz, x: (np.sort(mz), x), lambda a, b: np.array([[float(len(np.intersect1d(m, n))) for n, _ in b] for m, _ in a]))
    hits = SpectrumSearcher(metric=own, top_k=2).run(q, r).table
    assert rows(hits, "qry_ids", "ref_ids", "topk", "scores") == [(i, j, j + 1, 7.0) for i in (0, 1) for j in (0, 1)]
    with pytest.raises(ValueError):
        SpectrumSimilarity("no such").run(q, r)


def test_null_peaks_count_for_nothing(spark, rows):
    schema = "id long, peaks array<struct<mz:double,intensity:double>>"
    whole = spark.createDataFrame([(1, [(100.0, 1.0), (200.0, 0.5)]), (2, []), (3, None)], schema)
    holes = spark.createDataFrame([(1, [(100.0, 1.0), None, (None, 3.0), (200.0, 0.5), (300.0, None)])], schema)
    for metric in ("spectral_entropy", "peak_cosine"):
        assert rows(SpectrumSimilarity(metric).run(whole, holes)) == [(1, 1, 1.0), (2, 1, 0.0)]


def test_embedding_similarity_tool(spark, rows):
    a = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.5, 0.5], "y"), (None, [1.0, 1.0], "x"), (3, None, "x")], "id long, embedding array<double>, g string")
    assert rows(EmbeddingSimilarity("dot").run(a, a)) == [(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 0.5)]
    assert rows(EmbeddingSimilarity("dot").run(a, a, on=["g"])) == [("x", 1, 1, 1.0), ("y", 2, 2, 0.5)]


def test_blocks_follow_the_groups(spark, rows):
    """Groups of very unequal size are cut into as many blocks as each needs."""
    rng = np.random.default_rng(4)
    data = [(i, [float(c) for c in rng.normal(size=4)], 0 if i < 150 else i) for i in range(180)]
    e = spark.createDataFrame(data, "id long, embedding array<double>, g long")
    scorer = similarity.vector_scorer("cosine")
    assert rows(similarity.top_k(e, e, scorer, 3, on=["g"], decimals=6, block_rows=20)) == rows(similarity.top_k(e, e, scorer, 3, on=["g"], decimals=6))


def test_candidates_in_blocks(spark, rows):
    rng = np.random.default_rng(5)
    e = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=4)]) for i in range(60)], "id long, embedding array<double>")
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 70, (900, 2))]  # repeated pairs and unknown ids
    listed = spark.createDataFrame([*pairs, *pairs[:50], (None, 1), (1, None)], "qry_ids long, ref_ids long")
    got = similarity.top_k_candidates(e, e, listed, "cosine", 3, decimals=6, block_rows=7)
    x = np.array([r.embedding for r in e.orderBy("id").collect()])
    s = np.round(METRICS["cosine"].block(x, x), 6)
    want = sorted((a, b, k + 1, s[a, b]) for a in range(60) for k, b in enumerate(sorted({b for c, b in pairs if c == a and b < 60}, key=lambda b: (-s[a, b], b))[:3]))
    assert rows(got, "qry_ids", "ref_ids", "topk", "scores") == [pytest.approx(w) for w in want]
    everything = similarity.top_k_candidates(e, e, listed, "cosine", None).count()
    assert everything == len({p for p in pairs if max(p) < 60})


def test_all_pairs_hold_one_side(spark, rows):
    """All scores of a pair of blocks are never in one table, and few blocks copy few rows."""
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(300)], "id long, embedding array<double>")
    wide = v.withColumn("embedding", F.col("embedding").cast("array<float>"))
    scorer = similarity.vector_scorer("cosine")
    want = rows(similarity.all_pairs(v, v, scorer, decimals=6))
    assert len(want) == 90_000 and rows(similarity.all_pairs(v, wide, scorer, decimals=6, block_rows=70)) == want
    plan = similarity.all_pairs(v, v, scorer)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan
