import math
import random

import pytest

from spectraloom.operators.bandjoin import co_occurrence, join_several, mz_join, peak_overlap
from spectraloom.operators.search import FragmentSearcher, PrecursorSearcher
from spectraloom.sources.ingest import candidates, fragments, ions

#: Spectra whose hits are known.
QUERY = [149.05970595, 277.15869171, 295.1692564, 313.17982108, 373.20095045, 433.22207982, 581.27450931]
OTHER = [149.05970595, 237.15869171, 295.1692564, 303.17982108, 363.20095045, 423.22207982, 581.27450931]


def test_golden_hits(spark, rows):
    hits = mz_join(ions(spark, QUERY), ions(spark, OTHER), 5.0)
    assert rows(hits, "qry_ids", "ref_ids") == [(0, 0), (2, 2), (6, 6)]


def test_ppm_is_of_the_reference(spark, rows):
    hits = mz_join(ions(spark, [100, 200, 300]), ions(spark, [100.003, 199.995, 305]), 50.0)
    assert rows(hits) == [(0, 0, 29.9991), (1, 1, 25.000625)]


def test_groups(spark, rows):
    from pyspark.sql import functions as F

    q, r = ions(spark, QUERY), ions(spark, OTHER)
    two = lambda df: df.withColumn("group_id", F.explode(F.array(F.lit(1), F.lit(2))))
    assert rows(mz_join(two(q), two(r), 5.0, on=["group_id"]), "group_id", "qry_ids") == [(g, i) for g in (1, 2) for i in (0, 2, 6)]


@pytest.mark.parametrize("unit,tolerance", [("da", 0.5), ("da", 0.0), ("da", -1.0), ("ppm", 900.0), ("ppm", 0.0), ("ppm", 2e6)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_against_all_pairs(spark, rows, unit, tolerance, inclusive):
    rng = random.Random(3)
    values = lambda n: [rng.choice([0.0, -5.0, 1e-7, 3.0, float("nan"), None, rng.uniform(-50, 500), rng.uniform(100, 101)]) for _ in range(n)]
    q, r = values(120), values(120)
    times = [rng.choice([None, float("nan"), 1.0, 1.05, 2.0]) for _ in range(120)]

    def ok(a, b):
        d = abs(a - b) * (1e6 / max(b, 1e-6) if unit == "ppm" else 1)
        return d <= tolerance if inclusive else d < tolerance

    good = lambda x: x is not None and not math.isnan(x)
    want = sorted((i, j) for i, a in enumerate(q) for j, b in enumerate(r) if good(a) and good(b) and ok(a, b))
    clean = [x if x is not None else None for x in q], [x if x is not None else None for x in r]
    left = spark.createDataFrame(list(zip(range(120), clean[0], times)), "id long, mz double, rt double")
    right = spark.createDataFrame(list(zip(range(120), clean[1], times)), "id long, mz double, rt double")
    assert rows(mz_join(left, right, tolerance, unit, inclusive=inclusive), "qry_ids", "ref_ids") == want
    assert rows(mz_join(left, right, tolerance, unit, inclusive=inclusive, nested=True), "qry_ids", "ref_ids") == want
    timed = [(i, j) for i, j in want if good(times[i]) and good(times[j]) and abs(times[i] - times[j]) <= 0.1]
    assert rows(mz_join(left, right, tolerance, unit, inclusive=inclusive, rt_tolerance=0.1), "qry_ids", "ref_ids") == timed


def test_bad_input(spark):
    q = ions(spark, [1.0])
    with pytest.raises(ValueError):
        mz_join(q, q, 1.0, "amu")
    with pytest.raises(TypeError):
        mz_join(q.drop("mz"), q)


def test_plan_has_no_nested_loop(spark):
    q = ions(spark, QUERY)
    plan = mz_join(q, q, 5.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_precursor_searcher(spark, rows):
    q, r = ions(spark, [100, 200, 300], ids=[1, 2, 3]), ions(spark, [100, 200, 300, 200, 100], ids=[1, 2, 3, 4, 5])
    hits = PrecursorSearcher(10.0).run(q, r, candidates(spark, {1: [1, 2, 3, 99], 2: [2, 3, 4, 4], 3: [4, 5]}))
    assert rows(hits.table) == [(1, 1, 0.0), (2, 2, 0.0), (2, 4, 0.0)]
    assert rows(hits.tag_refs()) == [(1, 1, 1), (2, 2, 1), (2, 4, 2)]
    assert rows(hits.unique_qry_ids()) == [(1,), (2,)] and rows(hits.unique_ref_ids()) == [(1,), (2,), (4,)]


@pytest.fixture()
def adducts(spark):
    return fragments(spark, [[100, 101, 102], [199, 200, 201], [298, 299, 300], [100, 200, 300]], ["[M]+", "[M+H]+", "[M+2H]+"], ids=[1, 2, 3, 4])


def test_fragment_searcher(spark, rows, adducts):
    q = ions(spark, [100, 200, 300], ids=[1, 2, 3])
    found = FragmentSearcher(10.0).run(q, adducts, candidates(spark, {1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 3: [1, 2, 3]}))
    assert rows(found.table, "qry_ids", "ref_ids", "adducts") == [(1, 1, "[M]+"), (1, 4, "[M]+"), (2, 2, "[M+H]+"), (2, 4, "[M+H]+"), (3, 3, "[M+2H]+")]
    for distinct in (False, True):
        kept = FragmentSearcher(10.0, co_occurrence_threshold=2, distinct_adducts=distinct).run(q, adducts)
        assert rows(kept.table, "qry_ids", "ref_ids") == [(1, 4), (2, 4), (3, 4)]
    assert rows(FragmentSearcher(10.0, co_occurrence_threshold=4).run(q, adducts).table) == []
    with pytest.raises(ValueError):
        co_occurrence(found.table, 0)


def test_peak_overlap(spark, rows):
    q, r = ions(spark, [100.0, 200.0, 100.5], ids=[1, 1, 2]), ions(spark, [100.25, 100.0, 300.0], ids=[7, 7, 8])
    assert rows(peak_overlap(q, r, 0.5, "da")) == [(1, 7, 2, (100.0, 100.25)), (2, 7, 1, (100.25,))]
    assert rows(peak_overlap(q, r, 0.5, "da", inclusive=True), "qry_ids", "n_peaks") == [(1, 2), (2, 2)]
    assert rows(peak_overlap(q, r, 0.5, "da", candidates=candidates(spark, {2: [7, 8]})), "qry_ids", "ref_ids") == [(2, 7)]


@pytest.mark.parametrize("unit,tolerance", [("da", 0.5), ("ppm", 900.0), ("ppm", 2e6), ("da", 0.0)])
@pytest.mark.parametrize("repeated", [False, True])
def test_join_several_against_counts(spark, rows, unit, tolerance, repeated):
    rng = random.Random(5)
    value = lambda: rng.choice([0.0, -5.0, 1e-7, 1e-6, 2e-6, float("nan"), None, rng.uniform(-50, 500), rng.uniform(100, 101), rng.uniform(100, 101)])
    q = spark.createDataFrame([(rng.choice([i, None, 3 if repeated else i]), value()) for i in range(90)], "id long, mz double")
    r = spark.createDataFrame([(rng.choice([i // 4, i // 4, None]), f"a{i % 4}", value()) for i in range(240)], "id long, adducts string, mz double")
    for least in (2, 3):
        want = co_occurrence(mz_join(q, r, tolerance, unit, carry=["adducts"]), least, per_query=True)
        assert rows(join_several(q, r, tolerance, unit, least, carry=["adducts"])) == rows(want)


def test_hits_are_counted_without_being_written(spark, rows, adducts, monkeypatch):
    from spectraloom.operators import bandjoin

    monkeypatch.setattr(bandjoin, "materialize", None)
    q = ions(spark, [100, 200, 200, 300], ids=[1, 2, 5, 3])
    for distinct, want in ((False, [(2, 2), (5, 2)]), (True, [])):
        kept = FragmentSearcher(10.0, co_occurrence_threshold=2, distinct_adducts=distinct).run(q, adducts.where("id < 4"))
        assert rows(kept.table, "qry_ids", "ref_ids") == want
    join_several(q.where("id <> 5"), adducts, 6000.0, "ppm", 2, carry=["adducts"])


def test_band_join_is_not_broadcast(spark):
    q = ions(spark, QUERY)
    plan = mz_join(q, q, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("unit,tolerance", [("da", 0.5), ("da", 0.0), ("da", -1.0), ("ppm", 900.0), ("ppm", 0.0), ("ppm", 2e6)])
def test_peak_overlap_against_hits(spark, rows, unit, tolerance, monkeypatch):
    from pyspark.sql import functions as F

    from spectraloom.operators import bandjoin

    rng = random.Random(7)
    value = lambda: rng.choice([0.0, -5.0, 1e-7, 1e-6, 2e-6, float("nan"), None, rng.uniform(-50, 500), rng.uniform(100, 101)])
    q, r = (spark.createDataFrame([(rng.choice([None, *range(12)]), value()) for _ in range(150)], "id long, mz double") for _ in range(2))
    hits = mz_join(q, r.withColumn("peak", F.col("mz")), tolerance, unit, carry=["peak"], inclusive=True)
    want = rows(hits.groupBy("qry_ids", "ref_ids").agg(F.count("*").alias("n_peaks"), F.sort_array(F.collect_list("peak")).alias("ref_mzs")))
    for block, at_once in ((1 << 20, 1 << 20), (40, 16)):
        monkeypatch.setattr(bandjoin, "BLOCK", block)
        monkeypatch.setattr(bandjoin, "AT_ONCE", at_once)
        assert rows(peak_overlap(q, r, tolerance, unit, inclusive=True)) == want


def test_peak_overlap_shuffles_peaks_only(spark):
    q = ions(spark, QUERY)
    plan = peak_overlap(q, q, 0.5, "da")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
