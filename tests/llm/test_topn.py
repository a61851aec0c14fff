import random

import pytest

from spectraloom.llm.topn import top_n_per_group


def _brute(data, n):
    best = {}
    for g, i, s in data:
        if g is not None and i is not None and s is not None and abs(s) < float("inf"):
            best.setdefault(g, {})
            best[g][i] = max(best[g].get(i, s), s)
    return sorted((g, i, k + 1) for g, items in best.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n]))


@pytest.mark.parametrize("heavy", [5, 50, 10**6])
def test_against_brute_force(spark, rows, heavy):
    rng = random.Random(heavy)
    score = lambda: rng.choice([0.5, 0.5, 1.0, rng.random(), None, float("nan"), float("inf"), -float("inf"), -0.25])
    data = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([None, *range(60)]), score()) for _ in range(900)] + [(9, 1, 0.5)] * 300
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "qry long, ref long, s double, g string, k int")
    got = top_n_per_group(df, "qry", "ref", "s", 10, heavy_rows=heavy)
    assert rows(got, "qry", "ref", "topk") == _brute(data, 10)
    assert got.columns == ["qry", "ref", "topk", "s"]


def test_edges(spark):
    empty = spark.createDataFrame([], "g long, i string, s double")
    assert top_n_per_group(empty, "g", "i", "s").count() == 0
    one = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, None, 3.0), (None, "a", 3.0)], "`x.g` long, i string, s double")
    assert [tuple(r) for r in top_n_per_group(one, "x.g", "i", "s", 1).collect()] == [(1, "a", 1, 2.0)]
    with pytest.raises(ValueError):
        top_n_per_group(one, "x.g", "i", "s", 0)


def test_heavy_group_of_one_score(spark, rows):
    df = spark.range(3000).selectExpr("1 as g", "id as i", "0.5D as s")
    assert rows(top_n_per_group(df, "g", "i", "s", 3, heavy_rows=100), "i", "topk") == [(0, 1), (1, 2), (2, 3)]
