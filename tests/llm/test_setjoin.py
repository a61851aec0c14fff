import itertools
import random

import pytest
from pyspark.sql import functions as F

from spectraloom.llm.setjoin import peak_sets, similar_sets


def _families(rng, n, size, low, high):
    """Sets in families of similar ones, with some very common tokens and exact copies."""
    out = []
    while len(out) < n:
        base = [rng.randrange(size) for _ in range(rng.randint(low, high))] + [t for t in range(5) if rng.random() < 0.5]
        for _ in range(rng.randint(1, 4)):
            out.append([rng.randrange(size) if rng.random() < 0.12 else t for t in base])
            if rng.random() < 0.2:
                out.append(list(out[-1]))
    return [list(s) for s in out[:n]]


def _brute(a, b, threshold, least):
    sets = [(i, set(s), r) for r, side in ((False, a), (True, b)) for i, s in side if s is not None]
    sets = [(i, {t for t in s if t is not None}, r) for i, s, r in sets]
    sets = [(i, s, r) for i, s, r in sets if len(s) >= max(1, least)]
    return {(min(i, j), max(i, j)) for (i, s, r), (j, t, q) in itertools.combinations(sets, 2) if not (r and q) and i != j and len(s & t) / len(s | t) >= threshold}


@pytest.mark.parametrize("threshold,least,max_small,hot,bucket", [(0.6, 8, 12, 50_000, 100_000), (0.6, 8, 14, 50_000, 50), (0.6, 1, 6, 3, 100), (0.4, 1, 10, 5, 200), (0.9, 2, 20, 50_000, 100), (1.0, 1, 8, 2, 30), (0.6, 1, 12, 2, 3), (0.6, 1, 0, 10, 5), (0.3, 1, 9, 50_000, 2)])
def test_against_brute_force(spark, threshold, least, max_small, hot, bucket):
    rng = random.Random(int(threshold * 10) + max_small)
    every = _families(rng, 260, 400, 1, 24) + _families(rng, 30, 400, 60, 90)
    every = [[None, *s] if rng.random() < 0.1 else s for s in every] + [[], None, [None]]
    ids = rng.sample(range(1000), len(every))
    rows = list(zip(ids, every))
    a, b = rows[:200], rows[200:]
    frame = lambda r: spark.createDataFrame([(i, s, "x", 1) for i, s in r], "id long, tokens array<int>, t string, set_id int")
    found = similar_sets(frame(a + a[:20]), "id", "tokens", frame(b), threshold=threshold, min_size=least, max_small=max_small, hot_rows=hot, bucket_rows=bucket)
    want = _brute(a, b, threshold, least)
    assert {(r.id_a, r.id_b) for r in found.id_pairs().collect()} == want
    links = {r.id: r.links for r in found.links().collect()}
    assert links == {i: sum(i in p for p in want) for i in links}
    assert {x for p in want for x in p} <= set(links)


def test_strings_and_edges(spark, rows):
    df = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["b", "a"]), (3, ["a", "b", "c"]), (None, ["a", "b"]), (4, [])], "id long, tokens array<string>")
    assert rows(similar_sets(df, "id", "tokens", threshold=0.6).id_pairs()) == [(1, 2), (1, 3), (2, 3)]
    assert similar_sets(df.limit(0), "id", "tokens").id_pairs().count() == 0
    with pytest.raises(ValueError):
        similar_sets(df, "id", "tokens", threshold=0.0)


def test_many_copies(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 300, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))).alias("tokens"))
    found = similar_sets(df, "id", "tokens", threshold=0.7)
    assert found.pairs.count() == 1
    assert {(r.copies, r.links) for r in found.links().collect()} == {(299, 399), (99, 399)}


def test_peak_sets(spark, rows):
    nan = float("nan")
    data = [(1, [100.05, 100.06, 200.0, 300.0], [1.0, 0.5, 0.009, 0.01]), (2, [1.0], [1.0, 2.0]), (3, None, [1.0]), (4, [nan, -1.0, 5.0, 6.0, None], [1.0, 9.0, nan, 0.0, 4.0]), (5, [], []), (6, [9.99, 1e300], [5.0, float("inf")])]
    df = spark.createDataFrame(data, "id long, m array<double>, x array<double>")
    got = dict(rows(peak_sets(df, "id", F.col("m"), F.col("x"))))
    assert got == {1: (1000, 3000), 4: (), 5: (), 6: (2**62,)}
