import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm.quantiles import LEVELS, VALUE_ERROR, compress, leaf_of, merge_digests, percentiles, quantile_digests, value_of

RANKS = {"p01": 0.01, "p50": 0.5, "p99": 0.99}


def test_leaves_keep_order_and_value(spark):
    values = sorted([0.0, -1e-9, 1e-9, 1e300, -1e300, 1.7976931348623157e308, 2.3e-308, 5e-324, *(random.Random(1).uniform(-50, 50) for _ in range(500)), *(10.0**k for k in range(-6, 11))])
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", leaf_of(F.col("v")).alias("leaf")).select("v", "leaf", value_of(F.col("leaf")).alias("back")).orderBy("v").collect()
    assert all(a.leaf <= b.leaf for a, b in zip(got, got[1:])) and all(0 < r.leaf < 2**22 for r in got)
    assert all(abs(r.back - r.v) <= 1.0001 * VALUE_ERROR * abs(r.v) for r in got if r.v == 0 or abs(r.v) >= 2.0**-1022)


@pytest.mark.parametrize("k", [20, 200, 10**6])
def test_compress_keeps_rank_bound(k):
    rng = np.random.default_rng(k)
    leaf = np.sort(rng.integers(0, 2**LEVELS, 5000))
    leaf, cnt = np.unique(leaf, return_counts=True)
    n = int(cnt.sum())
    d, level, index, count = compress(np.zeros(len(leaf), int), leaf, cnt, np.array([n // k]))
    assert count.sum() == n and len(count) <= len(leaf)
    top = ((index + 1) << level) - 1
    order = np.lexsort((level, top))
    below = np.cumsum(count[order])
    for q in (0.01, 0.25, 0.5, 0.9, 0.999):
        found = top[order][np.searchsorted(below, math.ceil(q * n))]
        rank = int(cnt[leaf <= found].sum())
        low = int(cnt[leaf < found].sum())
        assert low - LEVELS * (n // k) <= math.ceil(q * n) <= rank + LEVELS * (n // k)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        v = rng.choice([None, float("nan"), float("inf"), 0.0, rng.lognormvariate(0, 2), rng.gauss(0, 1), 0.75])
        rows.append((rng.choice([1, 1, 1, 2, None]), rng.randrange(3), i, v, "x"))
    rows += rng.choices(rows, k=800)  # repeated rows
    return rows


@pytest.mark.parametrize("k", [50, 2200])
def test_percentiles(spark, data, k):
    df = spark.createDataFrame(data, "g long, day int, i long, v double, level string")
    days = quantile_digests(df, "v", ["g", "day"], distinct_on=["g", "day", "i", "v"], k=k)
    got = {r.g: r for r in percentiles(days, ["g"], ["day"], RANKS, k=k).collect()}
    clean = {}
    for g, _, _, v, _ in {r for r in data if r[3] is not None and math.isfinite(r[3])}:
        clean.setdefault(g, []).append(v)
    assert set(got) == set(clean)
    for g, values in clean.items():
        values.sort()
        n, r = len(values), got[g]
        assert r.n == n and r.rank_error <= n * LEVELS / k
        for name, q in RANKS.items():
            # the value need not occur; its rank among the values is what is bounded
            rank, x = math.ceil(q * n), r[name]
            slack = abs(x) * VALUE_ERROR * 1.01 + 1e-7
            assert sum(v <= x + slack for v in values) >= rank - r.rank_error
            assert sum(v < x - slack for v in values) <= rank - 1 + r.rank_error


def test_merge_in_any_order(spark, rows, data):
    df = spark.createDataFrame(data, "g long, day int, i long, v double, level string")
    whole = merge_digests(quantile_digests(df, "v", ["g", "day"], k=10**9), ["g"])
    assert rows(whole) == rows(quantile_digests(df, "v", ["g"], k=10**9))


def test_empty_and_hot(spark, rows):
    empty = spark.createDataFrame([], "g long, day int, v double")
    assert percentiles(quantile_digests(empty, "v", ["g", "day"]), ["g"], ["day"], RANKS).count() == 0
    hot = spark.range(20000).selectExpr("1L as g", "1 as day", "id", "0.5D as v")
    r = percentiles(quantile_digests(hot, "v", ["g", "day"], distinct_on=["g", "id"]), ["g"], ["day"], RANKS).first()
    assert r.n == 20000 and r.p50 == pytest.approx(0.5, rel=VALUE_ERROR * 1.01)
