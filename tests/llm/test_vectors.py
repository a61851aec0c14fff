import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import ann, queries
from spectraloom.llm.ann import build_index, nearest
from spectraloom.llm.clusters import _components, exact_neighbourhoods, similarity_clusters
from spectraloom.llm.hnsw import Hnsw
from spectraloom.llm.neighbours import communities, descend, neighbour_graph
from spectraloom.llm.vectors import bytes_of, matrix, packed, unit

DIRT = [None, [], [1.0] * 3, [0.0] * 8, [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 7 + [None]]
SCHEMA = "id long, embedding array<float>, v string, shard int"


def _frame(spark, ids, x, dirt=True):
    rows = [(int(i), [float(c) for c in v], "x", 1) for i, v in zip(ids, x)]
    rows += rows[:7]  # repeated rows
    if dirt:
        rows += [(9_000_000 + j, d, "x", 1) for j, d in enumerate(DIRT)] + [(None, [1.0] * 8, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def _mixed(rng, n, dim):
    """Isolated vectors and dense groups of very unequal size, of different lengths."""
    centres = rng.normal(size=(max(1, n // 20), dim))
    own = rng.integers(0, len(centres), n) ** 2 % len(centres)
    x = np.where(rng.random(n)[:, None] < 0.3, rng.normal(size=(n, dim)), centres[own] + 0.15 * rng.normal(size=(n, dim)))
    return (x * rng.uniform(0.1, 9, (n, 1))).astype(np.float32)


def test_vectors_as_bytes():
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    column = bytes_of(x)
    assert (matrix(column, 3) == x).all() and (matrix(column[1:3], 3) == x[1:3]).all() and matrix(column[:0], 3).shape == (0, 3)
    some = bytes_of(x, np.array([True, False, False, True]))
    assert some.null_count == 2 and (matrix(some.drop_null(), 3) == x[[0, 3]]).all()


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = unit(_mixed(rng, 6000, 16))
    q = unit(_mixed(rng, 300, 16))
    graph = Hnsw.build(x, rng.permutation(len(x)), fan=8, top=128, ef=64)
    assert len(graph.nodes) >= 3 and (graph.links[0] <= len(x)).all()
    got, sims = graph.search(q, 10)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want)]) >= 0.95
    assert (np.diff(sims, axis=1) <= 0).all()


def test_graph_edges():
    none = Hnsw.build(np.zeros((0, 4), np.float32), np.arange(0))
    assert (none.search(np.ones((2, 4), np.float32), 3)[0] == 0).all()
    large = unit(_mixed(np.random.default_rng(5), 3000, 16))  # neighbours of the lowest level by descent
    graph = Hnsw.build(large, np.random.default_rng(5).permutation(3000), exact=500)
    assert len(graph.nodes) >= 2
    want = np.argsort(-(large[:200] @ large.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(graph.search(large[:200], 10)[0].tolist(), want.tolist())]) >= 0.95
    one = Hnsw.build(np.eye(4, dtype=np.float32)[:2], np.arange(2))
    rows, sims = one.search(np.eye(4, dtype=np.float32)[:1], 3)
    assert rows[0].tolist() == [0, 1, 2] and sims[0, 2] == -np.inf
    same = np.tile(np.eye(4, dtype=np.float32)[:1], (3000, 1))
    rows, _ = Hnsw.build(same, np.arange(3000), top=100).search(same[:5], 10)
    assert (rows < 3000).all() and all(len(set(r)) == 10 for r in rows.tolist())


@pytest.mark.parametrize("exact", [False, True])
def test_nearest(spark, rows, exact):
    rng = np.random.default_rng(2)
    x, q = _mixed(rng, 900, 8), _mixed(rng, 60, 8)
    x[5] = 3 * x[6]  # equal directions
    ids = rng.permutation(5000)[:900]
    got = nearest(_frame(spark, range(60), q), _frame(spark, ids, x), "id", "embedding", 5, dim=8, exact=exact, block_rows=20, max_rows=300, min_shards=2)
    a, b = q.astype(float), x.astype(float)
    s = np.round(a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)), 6)
    want = {(i, int(ids[j]), r + 1) for i in range(60) for r, j in enumerate(sorted(range(900), key=lambda j: (-s[i, j], ids[j]))[:5])}
    found = set(rows(got, "qry_id", "ref_id", "rank"))
    assert found == want if exact else len({f[:2] for f in found} & {w[:2] for w in want}) >= 0.97 * len(want)
    assert len(found) == 300


def test_queries_visit_few_shards(spark, rows):
    """Near rows share a shard, a query visits the nearest leaves only, and a leaf of one direction is divided."""
    rng = np.random.default_rng(12)
    x, q = _mixed(rng, 1500, 8), _mixed(rng, 80, 8)
    x[:500] = x[0] + 1e-3 * rng.normal(size=(500, 8))  # a third of all rows in one place
    q[:20] = x[500:520] + 0.01 * rng.normal(size=(20, 8))
    full = _frame(spark, range(1500), x)
    index = build_index(full, "id", "embedding", dim=8, max_rows=40, min_shards=2)
    shards = [r.shard for r in index.rows.select("shard").distinct().collect()]
    assert len(index.parts) >= 30 and index.parts.max() >= 2 and len(shards) <= index.parts.sum()
    got = nearest(_frame(spark, range(80), q), full, "id", "embedding", 5, dim=8, max_rows=40, visits=8)
    a, b = q.astype(float), x.astype(float)
    s = np.round(a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)), 6)
    want = {(i, j) for i in range(80) for j in sorted(range(1500), key=lambda j: (-s[i, j], j))[:5]}
    found = {r[:2] for r in rows(got, "qry_id", "ref_id")}
    assert len(found) == 400 and len(found & want) >= 0.9 * len(want)


def test_nearest_edges(spark):
    x = np.eye(8, dtype=np.float32)
    full, empty = _frame(spark, range(8), x), spark.createDataFrame([], SCHEMA)
    assert nearest(empty, full, "id", "embedding", dim=8).count() == 0
    assert nearest(full, empty, "id", "embedding", dim=8).count() == 0
    assert nearest(full, full, "id", "embedding", 20, dim=8).count() == 64


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("scaled", [False, True])
def test_nearest_equal_directions(spark, rows, exact, scaled):
    rng = np.random.default_rng(8)
    x, q = _mixed(rng, 900, 8), _mixed(rng, 30, 8)
    hot = rng.normal(size=8)
    x[:400] = (hot * (rng.uniform(0.1, 9, (400, 1)) if scaled else 1)).astype(np.float32)  # one direction, of one or of many lengths
    q[:10] = hot + 0.1 * rng.normal(size=(10, 8))
    ids = rng.permutation(5000)[:900]
    got = nearest(_frame(spark, range(30), q), _frame(spark, ids, x), "id", "embedding", 5, dim=8, exact=exact, min_shards=2)
    a, b = q.astype(float), x.astype(float)
    s = np.round(a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)), 6)
    want = {(i, int(ids[j]), r + 1) for i in range(30) for r, j in enumerate(sorted(range(900), key=lambda j: (-s[i, j], ids[j]))[:5])}
    found = set(rows(got, "qry_id", "ref_id", "rank"))
    assert {f for f in found if f[0] < 10} == {w for w in want if w[0] < 10}
    assert len(found & want) >= (1 if exact else 0.97) * len(want)


def _embs(spark, folder, dim=64):
    rng = np.random.default_rng(6)
    for name, n in (("qry_embs", 100), ("ref_embs", 600)):
        x = _mixed(rng, n, dim)
        spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<float>").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_found_has_the_beam_of_nearest(spark, tmp_path, monkeypatch):
    used = []
    monkeypatch.setattr(ann, "nearest", lambda *a, **k: used.append(k) or nearest(*a, **k))
    folder = _embs(spark, tmp_path)
    for q in (queries.p2_found, queries.p2_nearest):
        q(spark, folder)
    assert used[0] == used[1] == {}  # the operator's own parameters
    queries.p2_recall(spark, folder)
    assert used[2:] == [{"exact": True}, used[0]]  # measured with what p2_found uses


def test_descent_recall():
    rng = np.random.default_rng(3)
    x = unit(_mixed(rng, 3000, 16))
    got, sims = descend(x, 10, 1, leaf=100, trees=2, rounds=12)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.tolist(), want.tolist())]) >= 0.9
    assert (got != np.arange(3000)[:, None]).all() and (np.diff(sims, axis=1) <= 0).all()


def test_communities():
    edges = [(a, b) for base in (0, 10, 20) for a in range(base, base + 10) for b in range(a + 1, base + 10)] + [(0, 10), (10, 20)]
    a, b = map(np.array, zip(*edges))
    label, degree = communities(32, a, b, np.ones(len(a)))
    assert [len(set(label[i : i + 10])) for i in (0, 10, 20)] == [1, 1, 1] and len(set(label)) == 5
    assert degree[:30].tolist() == [9.0] * 30 and degree[30:].tolist() == [0.0, 0.0]
    assert communities(3, np.zeros(0, int), np.zeros(0, int), np.zeros(0))[0].tolist() == [0, 1, 2]


def test_search_memory_does_not_grow_with_leaves(spark):
    """A batch of queries is sent to its nearest of very many leaves some rows at a time; a shard travels in small rows."""
    rng = np.random.default_rng(8)
    sample, x = unit(rng.normal(size=(8000, 8))), unit(rng.normal(size=(10_000, 8)))
    leaf = np.sort(np.r_[np.arange(4000), rng.integers(0, 4000, 4000)])
    tracemalloc.start()
    goes = ann._routes(x, sample, leaf, 64)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20  # 10,000 x 4,000 similarities alone are 160 MB
    tracemalloc.stop()
    near = np.maximum.reduceat(x[:50] @ sample.T, np.searchsorted(leaf, np.arange(4000)), axis=1)
    assert [set(g) for g in goes[:50].tolist()] == [set(np.argsort(-s)[:64].tolist()) for s in near]
    assert (ann._routes(x[:3], sample, leaf, 4000) == np.arange(4000)).all()

    v = _mixed(rng, 3000, 8)
    index = build_index(_frame(spark, range(3000), v), "id", "embedding", dim=8, min_shards=2)
    rows = index.rows.toArrow()
    assert max(len(d) for d in rows["data"].to_pylist()) <= 1 << 16 and rows.num_rows > 4
    parts = [ann._load(rows.filter(np.array(rows["shard"]) == shard)) for shard in set(rows["shard"].to_pylist())]
    assert sorted(np.concatenate([p["ids"] for p in parts]).tolist()) == list(range(3000))
    assert all((p["vectors"] == v[p["ids"]]).all() and len(p["links0"]) == len(p["first"]) for p in parts)


@pytest.mark.parametrize("cell,most", [(4, 30), (40, 100_000), (100_000, 50)])
def test_clusters(spark, cell, most):
    rng = np.random.default_rng(4)
    sizes = [150, 60, 20, 9, 5, 3, 2, 2, 2] + [1] * 60
    dim = 32
    centres = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    x, own = [], []
    for k, n in enumerate(sizes):
        c = centres[k] if k < 9 else unit(rng.normal(size=(1, dim)) + 0)[0]
        x.append(c + 0.03 * rng.normal(size=(n, dim)))
        own += [k] * n
    x, own = np.vstack(x).astype(np.float32), np.array(own)
    u = unit(x)
    close = u @ u.T >= 0.85
    ids = rng.permutation(10_000)[: len(x)]
    want = {int(ids[i]): int(ids[close[i]].min()) for i in range(len(x))}
    assert all(set(own[close[i]]) == {own[i]} for i in range(len(x)))  # the case the operator is exact in
    schema = _frame(spark, ids, x).schema
    df = spark.createDataFrame([(r[0], r[1] and (list(r[1]) + [1.0] * (dim - 8) if len(r[1]) == 8 else r[1]), r[2], r[3]) for r in _frame(spark, ids, x).collect()], schema)
    found = similarity_clusters(df, "id", "embedding", dim=dim, cell_rows=cell, most=most)
    got = {r.id: r.cluster_id for r in found.members.collect() if r.id < 10_000}
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    top = [r for r in found.typical(2).collect() if r["size"] == 150 and r["rank"] == 1]
    of = np.flatnonzero(own == 0)
    s = (x[of].astype(float) / np.linalg.norm(x[of].astype(float), axis=1, keepdims=True)) @ (x[of].astype(float) / np.linalg.norm(x[of].astype(float), axis=1, keepdims=True)).T
    degree = s.sum(1) - 1
    assert len(top) == 1 and top[0].id == int(ids[of[degree.argmax()]]) and top[0].degree == pytest.approx(degree.max(), abs=1e-5)
    parts = found.communities.collect()
    assert {r.id for r in parts} == {r.id for r in found.members.collect()}
    assert all(got[r.community_id] == got[r.id] for r in parts if r.id < 10_000)  # a community lies within a cluster
    exact = {r.id: (r.lowest, r["size"]) for r in exact_neighbourhoods(df, "id", "embedding", F.col("id") % 3 == 0, dim=dim, block_rows=50).collect() if r.id < 10_000}
    assert exact == {i: (c, sum(v == c for v in want.values())) for i, c in want.items() if i % 3 == 0}


def test_clusters_do_not_depend_on_the_size_of_tasks(spark):
    """Overlapping families, of which nearly every record reaches the threshold with some of other families: the division is the same whether all share a task or not."""
    rng = np.random.default_rng(12)
    x = np.vstack([c + 0.55 * rng.normal(size=(60, 8)) for c in 2 * rng.normal(size=(10, 8))]).astype(np.float32)
    df = _frame(spark, rng.permutation(5000)[:600] - 100, x)
    got = []
    for most in (20, 100_000):
        found = similarity_clusters(df, "id", "embedding", dim=8, most=most)
        got.append((sorted(map(tuple, found.members.collect())), sorted(map(tuple, found.communities.collect()))))
    assert len({r[0] for r in got[0][0]}) > 10 and got[0] == got[1]


def test_linked_rows_are_one_part(spark):
    rng = np.random.default_rng(13)
    chain, star = rng.permutation(400) - 50, 1000 + np.arange(300)
    pairs = [*zip(chain[:-1].tolist(), chain[1:].tolist()), *((1000, int(i)) for i in star[1:]), (7000, 7001), (7001, 7000)]
    got = {r.id: r.component for r in _components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {int(i): -50 for i in chain} | {int(i): 1000 for i in star} | {7000: 7000, 7001: 7000}
    # and a part's communities are those it has by itself
    a, b = np.triu_indices(40, 1)
    keep = rng.random(len(a)) < np.where((a < 20) == (b < 20), 0.5, 0.1)
    a, b, w = a[keep], b[keep], rng.uniform(0.5, 1, keep.sum())
    names = np.sort(rng.choice(1000, 40, replace=False))
    alone, _ = communities(40, a, b, w, total=99.0, names=names)
    m = 300
    both, _ = communities(m + 40, np.r_[np.arange(m - 1), a + m], np.r_[np.arange(1, m), b + m], np.r_[rng.uniform(0.5, 1, m - 1), w], total=99.0, names=np.r_[np.arange(m) - m, names])
    assert (np.unique(both[m:], return_inverse=True)[1] == np.unique(alone, return_inverse=True)[1]).all() and len(set(alone)) > 1


def test_graph_of_the_table(spark):
    """Cells of a few rows only seed the graph: descent over the table finds most neighbours, and clusters are found whole."""
    rng = np.random.default_rng(9)
    x = _mixed(rng, 2000, 32)
    u = unit(x)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<float>")
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = np.argsort(-s, axis=1)[:, :10]
    recall = []
    for rounds in (0, 6):
        graph = {r.id: r for r in neighbour_graph(packed(df), 2000, dim=32, cell_rows=20, rounds=rounds, stop=0.0).collect()}
        assert sorted(graph) == list(range(2000)) and all(len(set(r.near)) == len(r.near) <= 10 and i not in r.near for i, r in graph.items())
        assert all(abs(s[i, j] - w) < 1e-3 for i, r in graph.items() for j, w in zip(r.near, r.sim))
        recall.append(np.mean([len(set(graph[i].near) & set(want[i].tolist())) / 10 for i in range(2000)]))
    assert recall[1] > recall[0] and recall[1] >= 0.85
    centres = np.linalg.qr(rng.normal(size=(32, 32)))[0] + 0.05
    own = np.r_[np.zeros(1500, int), np.repeat(np.arange(1, 32), 3)]
    x = (centres[own] + 0.02 * rng.normal(size=(len(own), 32))).astype(np.float32)
    close = unit(x) @ unit(x).T >= 0.85
    assert (close == (own[:, None] == own)).all()
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<float>")
    found = similarity_clusters(df, "id", "embedding", dim=32, cell_rows=2, most=100)
    assert {r.id: r.cluster_id for r in found.members.collect()} == {i: int(close[i].argmax()) for i in range(len(x))}


def test_chains_are_not_clusters(spark):
    """Vectors on an arc, 20 degrees apart, of which only neighbours reach the threshold."""
    angle = np.deg2rad(20 * np.arange(18))
    x = np.c_[np.cos(angle), np.sin(angle), np.zeros((18, 6))]
    found = similarity_clusters(_frame(spark, range(18), x, dirt=False), "id", "embedding", dim=8)
    of = {r.id: r.cluster_id for r in found.members.collect()}
    assert all(x[i] @ x[j] >= 0.7 for i in of for j in of if of[i] == of[j])


def test_clusters_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similarity_clusters(empty, "id", "embedding", dim=8).members.count() == 0
    one = _frame(spark, [5], np.ones((1, 8), np.float32), dirt=False)
    assert [tuple(r) for r in similarity_clusters(one, "id", "embedding", dim=8).members.collect()] == [(5, 5, 0.0)]
    same = _frame(spark, range(300), np.tile(np.arange(1, 9, dtype=np.float32), (300, 1)))
    assert {r.cluster_id for r in similarity_clusters(same, "id", "embedding", dim=8, most=50).members.collect()} == {0}
