"""Nearest-neighbour graphs by neighbour descent, in a block and over a whole table, and modularity communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.vectors import bytes_of, matrix, unit, unpack
from spectraloom.runtime import materialize, release

GRAPH = "id long, near array<long>, sim array<float>, v binary"
MOST_PIVOTS = 1 << 16


def leaves(x: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows cut by random hyperplanes at the median until no part exceeds ``size``."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        a, b = x[rng.choice(rows)], x[rng.choice(rows)]
        side = x[rows] @ (a - b)
        order = np.argpartition(side, len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def _merge(ids: np.ndarray, sims: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best different ids of every row."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    same = np.zeros(ids.shape, bool)
    same[:, 1:] = ids[:, 1:] == ids[:, :-1]
    sims = np.where(same | (ids >= n), -np.inf, sims)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, n), sims


def descend(x: np.ndarray, k: int, seed: int, *, trees: int = 4, leaf: int = 512, fan: int = 8, rounds: int = 6, stop: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Approximate ``k`` nearest neighbours of every row: rows and cosines, best first.

    Starts from the neighbours within leaves of a few random hyperplane trees, then
    lets every row look at the neighbours of its neighbours, reverse ones included,
    until a round changes less than ``stop`` of all places. Missing ones are row n.
    """
    n, rng = len(x), np.random.default_rng(seed)
    ids, sims = np.full((n, k), n, np.int64), np.full((n, k), -np.inf, np.float32)
    for _ in range(trees if n > leaf else 1):
        for rows in leaves(x, leaf, rng):
            near, s = exact_neighbours(x[rows], k)
            ids[rows], sims[rows] = _merge(np.hstack([ids[rows], np.where(near < len(rows), rows[np.minimum(near, len(rows) - 1)], n)]), np.hstack([sims[rows], s]), k, n)
    if n <= leaf:
        return ids, sims
    for _ in range(rounds):
        both = np.hstack([ids, _reverse(ids, n, k)])
        both = np.vstack([both, np.full((1, both.shape[1]), n, np.int64)])
        changed = 0
        ways = np.stack([rng.permutation(both.shape[1])[:fan] for _ in range(2)])
        for at in range(0, n, 2048):
            own = np.arange(at, min(n, at + 2048))
            cand = both[both[own][:, ways[0]]][:, :, ways[1]].reshape(len(own), -1)
            cand.sort(axis=1)
            skip = (cand == n) | (cand == own[:, None])
            skip[:, 1:] |= cand[:, 1:] == cand[:, :-1]
            r, c = np.nonzero(~skip)
            s = np.full(cand.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", x[own[r]], x[cand[r, c]])
            low = sims[own, -1]
            better = s > low[:, None]
            width = int(better.sum(1).max())
            if not width:
                continue
            pick = np.argpartition(-np.where(better, s, -np.inf), min(width, s.shape[1]) - 1, axis=1)[:, :width]
            new_i, new_s = _merge(np.hstack([ids[own], np.where(np.take_along_axis(better, pick, 1), np.take_along_axis(cand, pick, 1), n)]), np.hstack([sims[own], np.take_along_axis(s, pick, 1)]), k, n)
            changed += int((new_s[:, -1] > low).sum()) + int((new_s.sum(1) > sims[own].sum(1)).sum())
            ids[own], sims[own] = new_i, new_s
        if changed <= stop * n * k:
            break
    return ids, sims


def exact_neighbours(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest other rows of every row of a small block, all compared; missing ones are row n."""
    n = len(x)
    ids, sims = np.full((n, k), n, np.int32), np.full((n, k), -np.inf, np.float32)
    c = min(k, n - 1)
    step = max(1, (1 << 22) // max(1, n))
    for at in range(0, n if c >= 1 else 0, step):
        s = x[at : at + step] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        near = np.argpartition(s, n - c, axis=1)[:, n - c :]
        ids[at : at + step, :c], sims[at : at + step, :c] = near, np.take_along_axis(s, near, 1)
    return ids, sims


def _reverse(ids: np.ndarray, n: int, most: int) -> np.ndarray:
    """Up to ``most`` rows that have each row as a neighbour."""
    src, dst = np.repeat(np.arange(n), ids.shape[1]), ids.ravel()
    ok = dst < n
    src, dst = src[ok], dst[ok]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    out = np.full((n, most), n, np.int64)
    keep = rank < most
    out[dst[keep], rank[keep]] = src[keep]
    return out


def neighbour_graph(points: DataFrame, n: int, *, dim: int, k: int = 10, cell_rows: int = 500, probes: int = 3, fan: int = 5, pool: int = 12, rounds: int = 2, stop: float = 0.001, seed: int = 7, max_cell: int = 1 << 16) -> DataFrame:
    """One graph over the table ``points(id, v)`` of ``n`` rows, the vectors as bytes (``packed``): ``id, near, sim, v``, the approximate ``k`` nearest of every row.

    Blocks only seed it: about ``n / cell_rows`` rows, at most 65,536, are pivots, every
    row goes to the cells of its ``probes`` nearest pivots, and a cell looks for the
    neighbours inside it, by neighbour descent of its own if it is large. A cell above
    ``max_cell`` rows is cut at random. Then rounds of neighbour descent over the whole
    table: a row sends itself to ``fan`` of its neighbours, and all that meet at one,
    at most ``pool`` of them, are compared; until a round changes less than ``stop`` of
    all places. Rows travel in half precision, so a similarity found in a round is
    right to about 0.0005.
    """
    sample = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n // max(1, min(MOST_PIVOTS, n // cell_rows))))) == 0)
    pivots = unit(unpack(sample.limit(4 * MOST_PIVOTS).select("id", "v").toArrow(), dim)[1])
    if len(pivots) < 2:
        pivots = np.zeros((1, dim), np.float32)
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    several = min(probes, len(pivots))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            out = np.empty((len(x), several), np.int32)
            step = max(1, (1 << 22) // len(p))
            for at in range(0, len(x), step):
                s = unit(x[at : at + step]) @ p.T
                best = np.argpartition(s, len(p) - several, axis=1)[:, len(p) - several :]
                order = np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable")
                out[at : at + step] = np.take_along_axis(best, order, 1)
            ends = pa.array((np.arange(len(x) + 1) * several).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["id", "v", "cells"])

    placed = materialize(points.select("id", "v").mapInArrow(cells, "id long, v binary, cells array<int>"), "cells")
    rows = placed.select("id", "v", F.posexplode("cells").alias("probe", "cell"))
    part = F.lit(0)
    if n * several > max_cell:
        counts = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / max_cell).cast("long").alias("parts"))
        rows = rows.join(F.broadcast(counts.where(F.col("parts") > 1)), "cell", "left")  # at most a row a pivot
        part = F.pmod(F.xxhash64("id", "cell"), F.coalesce("parts", F.lit(1).cast("long"))).cast("int")
    rows = rows.select("id", "v", "probe", "cell", part.alias("part"))

    def block(table: pa.Table) -> pa.Table:
        ids, x, order = unpack(table, dim, order=True)
        u = unit(x)
        near, sims = exact_neighbours(u, k) if len(ids) <= 4096 else descend(u, k, seed)
        return _graph_rows(ids, ids[np.minimum(near, len(ids) - 1)], sims, x, table["probe"].to_numpy()[order] == 0)

    seeds = rows.groupBy("cell", "part").applyInArrow(lambda t: block(t), GRAPH)
    parts = max(1, -(-n // 20_000))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int").alias("place")
    graph = seeds.select("*", place("id")).groupBy("place").applyInArrow(lambda t: _best(t, None, k, dim), GRAPH)
    graph = materialize(graph, "graph")
    release(placed)
    for number in range(rounds if n > k + 1 else 0):
        send = graph.select("id", "near", "sim", "v").mapInArrow(_messages(k, fan, dim, seed + number), "to long, u long, x binary, low float, h long")
        met = Window.partitionBy("to").orderBy("h", "u")  # cut on the map side too, so a row that is near to very many does not gather them
        pools = send.withColumn("place_in_pool", F.row_number().over(met)).where(F.col("place_in_pool") <= pool).select("to", "u", "x", "low")
        news = materialize(pools.mapInArrow(_meet(pool, dim), "id long, near long, sim float").distinct(), "updates")
        merged = graph.select("*", place("id")).groupBy("place").cogroup(news.select("*", place("id")).groupBy("place")).applyInArrow(lambda g, u: _best(g, u, k, dim), GRAPH)
        old, graph, found = graph, materialize(merged, "graph"), news.count()
        release(old, news)
        if found <= stop * n * k:
            break
    return graph


def _graph_rows(ids: np.ndarray, near: np.ndarray, sims: np.ndarray, x: np.ndarray, with_vector: np.ndarray) -> pa.Table:
    """Rows of a graph from arrays (rows, k), the missing places, of similarity -inf, left out."""
    have = np.isfinite(sims)
    ends = pa.array(np.r_[0, np.cumsum(have.sum(1))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(near[have], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(sims[have], pa.float32()))]
    return pa.Table.from_arrays([pa.array(ids), *lists, bytes_of(x, with_vector)], names=["id", "near", "sim", "v"])


def _best(table: pa.Table, more: pa.Table | None, k: int, dim: int) -> pa.Table:
    """The ``k`` best different neighbours of every id, from all its rows."""
    has = table["v"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    ids, x = unpack(table.filter(pa.array(has)), dim)
    near = table["near"].combine_chunks()
    owner = np.repeat(np.searchsorted(ids, table["id"].to_numpy()), near.value_lengths().to_numpy(zero_copy_only=False))
    to, s = near.flatten().to_numpy(zero_copy_only=False), table["sim"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if more is not None and more.num_rows:
        owner = np.r_[owner, np.searchsorted(ids, more["id"].to_numpy())]
        to, s = np.r_[to, more["near"].to_numpy()], np.r_[s, more["sim"].to_numpy()]
    order = np.lexsort((-s, to, owner))
    owner, to, s = owner[order], to[order], s[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (to[1:] != to[:-1])] if len(to) else np.zeros(0, bool)
    owner, to, s = owner[new], to[new], s[new]
    order = np.lexsort((to, -s, owner))
    owner, to, s = owner[order], to[order], s[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = rank < k
    out, sims = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf, np.float32)
    out[owner[keep], rank[keep]], sims[owner[keep], rank[keep]] = to[keep], s[keep]
    return _graph_rows(ids, out, sims, x, np.ones(len(ids), bool))


def _messages(k: int, fan: int, dim: int, seed: int):
    """Every row to itself and to ``fan`` of its neighbours, chosen by hash."""
    half = pa.binary(2 * dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            near = batch.column("near")
            count = near.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own, to = np.repeat(np.arange(len(ids)), count), near.flatten().to_numpy(zero_copy_only=False)
            s = batch.column("sim").flatten().to_numpy(zero_copy_only=False)
            low = np.full(len(ids), -np.inf, np.float32)
            full = count >= k
            low[full] = s[(np.cumsum(count) - 1)[full]]  # best first, so the last one is the worst
            order = np.lexsort((_mix(ids[own], to, seed), own))
            rank = np.arange(len(own)) - (np.cumsum(count) - count)[own]
            take = order[rank < fan]
            row, target = np.r_[np.arange(len(ids)), own[take]], np.r_[ids, to[take]]
            h = np.r_[np.full(len(ids), -1, np.int64), _mix(to[take], ids[own[take]], seed + 1)]
            x = unit(matrix(batch.column("v"), dim)).astype(np.float16)
            packed = pa.FixedSizeBinaryArray.from_buffers(half, len(row), [None, pa.py_buffer(np.ascontiguousarray(x[row]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(ids[row]), packed, pa.array(low[row]), pa.array(h)], ["to", "u", "x", "low", "h"])

    return run


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 0 or more of two numbers."""
    with np.errstate(over="ignore"):
        h = a * np.int64(0x5851F42D4C957F2D) + b * np.int64(0x14057B7EF767814F) + np.int64(seed)
        h = (h ^ (h >> np.int64(31))) * np.int64(0x2545F4914F6CDD1D)
        return (h ^ (h >> np.int64(29))) & np.int64((1 << 62) - 1)


def _meet(pool: int, dim: int):
    """Compares all that meet at a row; gives those that improve on the last neighbour of one of the two."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        to, u, low = table["to"].to_numpy(), table["u"].to_numpy(), table["low"].to_numpy()
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        size = np.diff(np.r_[first, len(to)])
        out = []
        for at in range(0, len(first), 4096):
            start, count = first[at : at + 4096], size[at : at + 4096]
            here = start[:, None] + np.minimum(np.arange(pool), count[:, None] - 1)
            v = x[here]
            s = v @ v.transpose(0, 2, 1)
            real = np.arange(pool) < count[:, None]
            i, j = here[:, :, None], here[:, None, :]
            g, a, b = np.nonzero((s > low[i]) & (u[i] != u[j]) & real[:, :, None] & real[:, None, :])
            out.append((u[here[g, a]], u[here[g, b]], s[g, a, b]))
        i, j, s = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s.astype(np.float32))], ["id", "near", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            to = t["to"].to_numpy()
            last = int(np.flatnonzero(np.r_[True, to[1:] != to[:-1]])[-1])  # its pool may go on in the next batch
            rest = t.slice(last)
            if last:
                yield compare(t.slice(0, last))
        if rest is not None and rest.num_rows:
            yield compare(rest)

    return run


def communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, *, total: float | None = None, passes: int = 24, levels: int = 24, seed: int = 1, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Communities of an undirected weighted graph by greedy modularity, and internal weighted degrees.

    Half of the rows at a time, by a hash of their ``names``, move to the neighbouring
    community with the largest gain until none gains; communities then become nodes of
    a smaller graph and the same goes on until none moves. ``a, b, w`` are the edges,
    each once, without loops; ``total`` is the weight of all edges of the graph that
    these are a part of. With ``total`` given and ``names`` rising, rows that no edges
    link do not bear on each other. Returns a community number for each row and the sum
    of its edges within its community.
    """
    label, names = np.arange(n), np.arange(n) if names is None else names
    ea, eb, ew, loops = a, b, w.astype(np.float64), np.zeros(n)
    total = float(ew.sum()) if total is None else total
    for level in range(levels if total > 0 else 0):
        own = _move(names, ea, eb, ew, loops, total, passes, seed + 1000 * level)
        if own is None:
            break
        at, own = np.unique(own, return_inverse=True)
        label = own[label]
        lowest = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(lowest, own, names)
        names = lowest
        ca, cb = own[ea], own[eb]
        inside = ca == cb
        loops = np.bincount(own, weights=loops, minlength=len(at)) + np.bincount(ca[inside], weights=ew[inside], minlength=len(at))
        lo, hi = np.minimum(ca, cb)[~inside], np.maximum(ca, cb)[~inside]
        key, where = np.unique(lo * len(at) + hi, return_inverse=True)
        ea, eb, ew = key // len(at), key % len(at), np.bincount(where, weights=ew[~inside], minlength=len(key))
    inner = label[a] == label[b]
    degree = np.bincount(a[inner], weights=w[inner], minlength=n) + np.bincount(b[inner], weights=w[inner], minlength=n)
    return label, degree.astype(np.float64)


def _move(names: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, loops: np.ndarray, total: float, passes: int, seed: int) -> np.ndarray | None:
    """The community of every row; None if no row would gain by a move. Ends early only where no row would."""
    n = len(names)
    src, dst, ww = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    weight = np.bincount(src, weights=ww, minlength=n) + 2 * loops
    own, size = np.arange(n), weight.copy()
    for number in range(passes):
        key, where = np.unique(src * n + own[dst], return_inverse=True)
        links = np.bincount(where, weights=ww, minlength=len(key))
        v, c = key // max(1, n), key % max(1, n)
        home = c == own[v]
        gain = links - (size[c] - np.where(home, weight[v], 0.0)) * weight[v] / (2 * total)
        stay = -(size[own] - weight) * weight / (2 * total)
        stay[v[home]] = gain[home]
        order = np.lexsort((c, -gain, v))
        best = order[np.r_[True, v[order][1:] != v[order][:-1]]] if len(v) else order
        best = best[gain[best] > stay[v[best]] + 1e-12]
        if not len(best):
            return own if number else None
        best = best[(_mix(names[v[best]], np.int64(number), seed) >> 20) & 1 == 0]
        own[v[best]] = c[best]
        size = np.bincount(own, weights=weight, minlength=n)
    return own
