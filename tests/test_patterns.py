import itertools
import random

import pytest

from spectraloom.operators.patterns import loss_edges, match_pattern, search_patterns
from spectraloom.operators.search import PatternSearch

#: A spectrum whose patterns are known.
MZ = [149.05970595, 277.15869171, 295.1692564, 313.17982108, 373.20095045, 433.22207982, 581.27450931]


@pytest.fixture(scope="module")
def peaks(spark):
    return spark.createDataFrame([(s, i, m) for s in (1, 2) for i, m in enumerate(MZ)], "spectrum_id long, peak int, mz double")


@pytest.fixture(scope="module")
def losses(spark):
    return spark.createDataFrame([(0, 0, 60.0)], "loss_idx long, loss_type long, loss_da double")


def test_golden(spark, rows, peaks, losses):
    assert rows(loss_edges(peaks, losses, 0.1)) == [(s, u, u + 1, 0) for s in (1, 2) for u in (3, 4)]
    chains = {n: [(i, i + 1, 0) for i in range(n + 1)] for n in range(3)}
    assert rows(PatternSearch(chains).run(peaks, losses)) == [(s, p) for s in (1, 2) for p in (0, 1)]


def test_node_mz(spark, rows, peaks, losses):
    edge = {5: [(0, 1, 0)]}
    hit = lambda mz, tol=3.0: rows(search_patterns(peaks, losses, edge, node_mz={5: {0: mz}}, tolerance=tol), "spectrum_id")
    assert hit(313.17982) == [(1,), (2,)] and hit(400.0) == [] and hit(400.0, 0.0) == [(1,), (2,)]


def test_last_loss_wins_and_loops(spark, rows):
    p = spark.createDataFrame([(1, 0, 100.0), (1, 1, 110.0)], "spectrum_id long, peak int, mz double")
    l = spark.createDataFrame([(0, 7, 10.0), (1, 8, 10.05), (2, 9, 0.0)], "loss_idx long, loss_type long, loss_da double")  # noqa: E741
    assert rows(loss_edges(p, l, 0.1)) == [(1, 0, 1, 8)]
    assert rows(loss_edges(p, l, 0.1, multi_edge=True)) == [(1, 0, 1, 7), (1, 0, 1, 8)]
    assert rows(loss_edges(p, l, 0.1, loops=True)) == [(1, 0, 0, 9), (1, 0, 1, 8), (1, 1, 1, 9)]
    assert rows(match_pattern(loss_edges(p, l, 0.1, loops=True), [(0, 0, 9), (0, 1, 8)])) == [(1,)]


@pytest.mark.parametrize("pattern", [[(0, 1, 0)], [(0, 1, 0), (1, 2, 1)], [(0, 1, 0), (2, 3, 0)], [(0, 1, 0), (1, 2, 0), (2, 0, 1)], [(0, 1, 0), (0, 2, 0), (0, 3, 1)]])
def test_against_brute_force(spark, rows, pattern):
    rng = random.Random(5)
    edges = {(s, u, v): rng.randint(0, 1) for s in range(30) for u, v in itertools.combinations(range(6), 2) if rng.random() < 0.25}
    table = spark.createDataFrame([(*k, t) for k, t in edges.items()], "spectrum_id long, u int, v int, loss_type long")
    nodes = sorted({x for a, b, _ in pattern for x in (a, b)})

    def has(s):
        return any(all(edges.get((s, *sorted((m[a], m[b])))) == t for a, b, t in pattern) for m in (dict(zip(nodes, c)) for c in itertools.permutations(range(6), len(nodes))))

    want = [(s,) for s in range(30) if has(s)]
    assert rows(match_pattern(table, pattern)) == want
    assert rows(match_pattern(table, pattern, max_joins=0)) == want


def test_backtracking_with_node_mz(spark, rows, peaks, losses):
    edges = loss_edges(peaks, losses, 0.1)
    hit = lambda mz: rows(match_pattern(edges, [(0, 1, 0), (1, 2, 0)], nodes=peaks, node_mz={1: mz}, max_joins=0))
    assert hit(373.20095) == [(1,), (2,)] and hit(313.17982) == []
    assert rows(match_pattern(edges, [(0, 1, 0)], nodes=peaks, lone_nodes=5, max_joins=0)) == [(1,), (2,)]
    assert rows(match_pattern(edges, [(0, 1, 0)], nodes=peaks, lone_nodes=6)) == []


def test_too_many_losses(spark, peaks, losses):
    with pytest.raises(ValueError):
        loss_edges(peaks, losses, 0.1, max_losses=0)
