"""Clusters of mutually similar vectors."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.neighbours import communities, neighbour_graph
from spectraloom.llm.vectors import cosine, lists_of, matrix, packed, select_vectors, unpack
from spectraloom.runtime import materialize, release

SLACK = 2e-3  # more than half precision moves a similarity
FOUND = "id long, community long, degree double, grp long, size long, total array<double>"
JOINED = "grp long, into long, size long, total array<double>"


@dataclass(frozen=True)
class Clusters:
    """``members(cluster_id, id, degree)`` and ``communities(community_id, id, degree)``: every valid record once.

    ``cluster_id`` and ``community_id`` are the lowest id of the cluster or community.
    ``degree`` of a member is its internal weighted degree, the sum of its cosines with
    all other members; that of ``communities`` counts the edges of the graph only.
    """

    members: DataFrame
    communities: DataFrame

    def sizes(self) -> DataFrame:
        return self.members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))

    def typical(self, n: int = 3) -> DataFrame:
        """The ``n`` records of highest internal weighted degree (to 6 decimals, ties to the lower id) of every cluster: ``cluster_id, size, rank, id, degree``."""
        rows = self.members.select("cluster_id", "id", F.round("degree", 6).alias("degree"))
        order = Window.partitionBy("cluster_id").orderBy(F.desc("degree"), "id")
        best = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
        return best.join(self.sizes(), "cluster_id").select("cluster_id", "size", "rank", "id", "degree")


def similarity_clusters(
    df: DataFrame,
    id: str,
    embedding: str,
    *,
    threshold: float = 0.85,
    dim: int = 64,
    k: int = 10,
    cell_rows: int = 500,
    probes: int = 3,
    rounds: int = 2,
    passes: int = 2,
    most: int = 20_000,
    seed: int = 7,
) -> Clusters:
    """Divide records into clusters of vectors with cosine of at least ``threshold``.

    One approximate nearest-neighbour graph of the whole table is built by neighbour
    descent (``neighbour_graph``), its edges that reach the threshold are kept, and
    modularity divides these into communities. A community's record of highest internal
    weighted degree represents it; records that do not reach the threshold with it
    become a community of their own.

    Modularity cuts a large family into several communities and keeps apart parts that
    the graph does not link. Parts are therefore put together where the mean cosine
    between their members reaches the threshold, the nearest first: those that an edge
    links, then, ``passes`` times, neighbours in a new graph of one vector a part, which
    also finds records that the first graph left alone. So chains of records of which
    the ends differ are not joined. The mean is exact, from sums of unit vectors.

    Invalid vectors (null, of another length, with a null, NaN or infinite component,
    all zero) and null ids are left out, an id counts once, extra columns are ignored;
    an empty table gives no rows. Where clusters are such that all members reach the
    threshold and no two records of different clusters do, the result is exact but for
    links that no graph finds; ``probes`` and ``passes`` raise recall.

    Records that edges link, however far, are in one task, with others up to about
    ``most`` records. They are dealt with by themselves, and moves by chance are drawn
    by id, so the result does not depend on ``most`` or on what shares a task. The rows
    that edges link are never divided, so a task is as large as the largest such part.
    """
    points = materialize(packed(select_vectors(df, id, embedding, dim)), "points")
    n = points.count()
    how = {"dim": dim, "k": k, "cell_rows": cell_rows, "probes": probes}
    graph = neighbour_graph(points, n, rounds=rounds, seed=seed, **how)
    edges = materialize(_edges(graph, threshold), "edges")
    release(graph)
    total = (edges.agg(F.sum(F.round(F.col("w") * (1 << 20)).cast("long"))).first()[0] or 0) / (1 << 20)  # the same in any order
    place = _buckets(edges, most)
    inside = edges.join(place.select(F.col("id").alias("a"), F.col("bucket").alias("own")), "a")

    def divide(nodes: pa.Table, links: pa.Table) -> pa.Table:
        ids, x = unpack(nodes, dim)
        a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in ("a", "b"))
        o = np.lexsort((b, a))
        a, b = a[o], b[o]
        w = np.concatenate([cosine(x[i], x[j]) for i, j in zip(*(np.array_split(c, 1 + len(a) // 50_000) for c in (a, b)))])
        near = w >= threshold
        label, degree = communities(len(ids), a[near], b[near], w[near], total=total, names=ids)
        u = _wide_unit(x)
        group = _stars(u, label, degree, threshold)
        names, group = np.unique(group, return_inverse=True)
        sums, size = _sums(u, group, len(names)), np.bincount(group, minlength=len(names))
        group = _agglomerate(sums, size, group[a], group[b], threshold)[group]
        return _found(ids, _lowest(ids, label), degree, _lowest(ids, group), u)

    found = points.join(place, "id").groupBy("bucket").cogroup(inside.select("own", "a", "b").groupBy("own")).applyInArrow(divide, FOUND)
    alone = points.join(place, "id", "left_anti").mapInArrow(lambda batches: (_alone(b, dim) for b in batches), FOUND)
    found = materialize(found.unionByName(alone), "communities")
    groups = found.where(F.col("id") == F.col("grp")).select("grp", "size", "total")
    of = found.select("id", "grp")
    steps: list[DataFrame] = []
    for number in range(passes):
        parts = materialize(packed(groups.select(F.col("grp").alias("id"), F.col("total").cast("array<float>").alias("v"))), "parts")
        near = neighbour_graph(parts, parts.count(), rounds=0, seed=seed + 100 * (number + 1), **how)
        groups, more = _put_together(groups, _edges(near, threshold).select("a", "b"), threshold, most)
        release(parts, near)
        steps += more
    for step in steps:
        of = of.join(step.select("grp", "into"), "grp", "left").select("id", F.coalesce("into", "grp").alias("grp"))
    final = materialize(of, "clusters")
    members = points.join(final, "id").join(groups.select("grp", "total"), "grp")
    name = final.groupBy("grp").agg(F.min("id").alias("cluster_id"))

    def degrees(batches):
        for batch in batches:
            u = _wide_unit(matrix(batch.column("v"), dim))
            sums = batch.column("total").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), pa.array(np.maximum(np.einsum("ij,ij->i", u, sums - u), 0.0))], ["id", "grp", "degree"])

    members = members.select("id", "grp", "v", "total").mapInArrow(degrees, "id long, grp long, degree double").join(name, "grp").select("cluster_id", "id", "degree")
    members = materialize(members, "members")
    release(points, edges, place, final, *steps)
    return Clusters(members, found.select(F.col("community").alias("community_id"), "id", "degree"))


def exact_neighbourhoods(df: DataFrame, id: str, embedding: str, asked: Column, *, threshold: float = 0.85, dim: int = 64, block_rows: int = 8_000) -> DataFrame:
    """``id, lowest, size`` of the records that ``asked`` (of the column ``id``) chooses: the lowest id and the number of all records that reach the threshold, compared with all, in pairs of blocks."""
    points = materialize(packed(select_vectors(df, id, embedding, dim)), "points")
    queries = points.where(asked)
    nq, nr = (max(1, -(-t.count() // block_rows)) for t in (queries, points))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q, r = queries.select("id", "v", own(nq).alias("q"), every(nr).alias("r")), points.select("id", "v", every(nq).alias("qb"), own(nr).alias("rb"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        (ids, x), (refs, y) = unpack(left, dim), unpack(right, dim)
        lowest, size = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
        u, v = _wide_unit(x), _wide_unit(y)
        for at in range(0, len(ids) if len(refs) else 0, 512):
            near = u[at : at + 512] @ v.T >= threshold
            size[at : at + 512] = near.sum(1)
            lowest[at : at + 512] = np.where(near.any(1), refs[near.argmax(1)], lowest[at : at + 512])
        return pa.table({"id": ids, "lowest": lowest, "size": size})

    found = q.groupBy("q", "r").cogroup(r.groupBy("qb", "rb")).applyInArrow(compare, "id long, lowest long, size long")
    return found.groupBy("id").agg(F.min("lowest").alias("lowest"), F.sum("size").alias("size"))


def _edges(graph: DataFrame, threshold: float) -> DataFrame:
    """Edges ``a, b, w`` of a graph that can reach the threshold, each once, a < b."""
    rows = graph.select("id", F.explode(F.arrays_zip("near", "sim")).alias("e")).where(F.col("e.sim") >= threshold - SLACK)
    return rows.groupBy(F.least("id", "e.near").alias("a"), F.greatest("id", "e.near").alias("b")).agg(F.max("e.sim").cast("double").alias("w"))


def _components(pairs: DataFrame) -> DataFrame:
    """``id, component`` of all ids in ``pairs(a, b)``: the lowest id that pairs lead to, however far.

    Every id links its higher neighbours, then its lower ones, to the lowest it knows,
    until nothing changes; so an id that very many share gathers nowhere.
    """
    links = materialize(pairs.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, links = links, materialize(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(old)
        last, state = state, links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _buckets(pairs: DataFrame, most: int) -> DataFrame:
    """``id, bucket`` of all ids in ``pairs(a, b)``: whole components, about ``most`` ids a bucket but for a component that is larger."""
    of = _components(pairs)
    buckets = max(1, -(-of.count() // most))
    return materialize(of.select("id", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int").alias("bucket")), "buckets")


def _put_together(groups: DataFrame, pairs: DataFrame, threshold: float, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Groups joined along ``pairs(a, b)`` while the mean cosine between two reaches the threshold; the new groups and the step ``grp, into``, if there is one."""
    side = lambda s: groups.select(F.col("grp").alias(s), F.col("size").alias(f"n{s}"), F.col("total").alias(f"s{s}"))
    mean = F.aggregate(F.zip_with("sa", "sb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (F.col("na") * F.col("nb"))
    pairs = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(mean >= threshold).select("a", "b"), "near-groups")
    if pairs.isEmpty():
        return groups, []
    place = _buckets(pairs, most)
    inside = pairs.join(place.select(F.col("id").alias("a"), F.col("bucket").alias("own")), "a")

    def join(nodes: pa.Table, links: pa.Table) -> pa.Table:
        o = np.argsort(nodes["grp"].to_numpy())
        ids, size = nodes["grp"].to_numpy()[o], nodes["size"].to_numpy()[o]
        sums = nodes["total"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[o]
        a, b = (np.searchsorted(ids, links[c].to_numpy()) for c in ("a", "b"))
        group = _agglomerate(sums, size, a, b, threshold)
        into = _lowest(ids, group)
        at, lead = np.unique(group, return_inverse=True)
        whole, count = np.zeros((len(at), sums.shape[1])), np.bincount(lead, weights=size)
        np.add.at(whole, lead, sums)
        head = into == ids
        return pa.Table.from_arrays([pa.array(ids), pa.array(into), pa.array(count[lead].astype(np.int64)), lists_of(whole[lead], head)], names=["grp", "into", "size", "total"])

    nodes = groups.join(place.select(F.col("id").alias("grp"), "bucket"), "grp")
    step = nodes.groupBy("bucket").cogroup(inside.select("own", "a", "b").groupBy("own")).applyInArrow(join, JOINED)
    step = materialize(step, "joined")
    kept = groups.join(step.select("grp"), "grp", "left_anti").unionByName(step.where(F.col("grp") == F.col("into")).select("grp", "size", "total"))
    return materialize(kept, "groups"), [step]


def _wide_unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sums(u: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], np.arange(n))
    return np.add.reduceat(u[order], start, axis=0) if len(u) else np.zeros((n, u.shape[1]))


def _lowest(ids: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The lowest id of each row's label; ``ids`` rise."""
    _, first, where = np.unique(label, return_index=True, return_inverse=True)
    return ids[first][where]


def _stars(u: np.ndarray, label: np.ndarray, degree: np.ndarray, threshold: float) -> np.ndarray:
    """Row number of each row's representative: of the highest degree in its community, those short of the threshold with it once more by themselves."""
    rep, todo = np.arange(len(u)), np.arange(len(u))
    while len(todo):
        order = todo[np.lexsort((todo, -degree[todo], label[todo]))]
        own = label[order]
        first = np.r_[True, own[1:] != own[:-1]]
        head = np.repeat(order[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
        parts = zip(*(np.array_split(c, 1 + len(order) // 50_000) for c in (order, head)))
        near = (np.concatenate([np.einsum("ij,ij->i", u[i], u[j]) for i, j in parts]) >= threshold) | (order == head)
        rep[order[near]] = head[near]
        todo = order[~near]
    return rep


def _agglomerate(sums: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Group of every node after joining linked nodes, the nearest first, while the mean cosine between two reaches the threshold."""
    n = len(size)
    into = list(range(n))
    sums, size = sums.copy(), size.astype(np.float64).copy()
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    key = np.unique((lo * n + hi)[lo != hi])
    lo, hi = key // max(1, n), key % max(1, n)
    mean = np.einsum("ij,ij->i", sums[lo], sums[hi]) / (size[lo] * size[hi])
    links: dict[int, set[int]] = {}
    for i, j in zip(lo.tolist(), hi.tolist()):
        links.setdefault(i, set()).add(j)
        links.setdefault(j, set()).add(i)
    heap = [(-m, i, j) for m, i, j in zip(mean.tolist(), lo.tolist(), hi.tolist()) if m >= threshold]
    heapq.heapify(heap)
    version = [0] * n
    stamps = {(i, j): (0, 0) for _, i, j in heap}
    while heap:
        _, i, j = heapq.heappop(heap)
        if into[i] != i or into[j] != j or stamps.get((i, j)) != (version[i], version[j]):
            continue
        into[j] = i
        sums[i] += sums[j]
        size[i] += size[j]
        version[i] += 1
        others = (links.pop(j, set()) | links[i]) - {i, j}
        links[i] = others
        for o in others:
            links[o].discard(j)
            links[o].add(i)
        if others:
            o = np.fromiter(sorted(others), np.int64, len(others))
            m = np.einsum("ij,j->i", sums[o], sums[i]) / (size[o] * size[i])
            for x, s in zip(o.tolist(), m.tolist()):
                if s >= threshold:
                    pair = (min(i, x), max(i, x))
                    stamps[pair] = (version[pair[0]], version[pair[1]])
                    heapq.heappush(heap, (-s, *pair))
    out = np.array(into, np.int64)
    while (out[out] != out).any():
        out = out[out]
    return out


def _found(ids: np.ndarray, community: np.ndarray, degree: np.ndarray, group: np.ndarray, u: np.ndarray) -> pa.Table:
    names, where = np.unique(group, return_inverse=True)
    sums, size = _sums(u, where, len(names)), np.bincount(where, minlength=len(names))
    return pa.Table.from_arrays([pa.array(ids), pa.array(community), pa.array(degree), pa.array(group), pa.array(size[where].astype(np.int64)), lists_of(sums[where], ids == group)], names=["id", "community", "degree", "grp", "size", "total"])


def _alone(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """Records without an edge."""
    ids = batch.column("id").to_numpy()
    u = _wide_unit(matrix(batch.column("v"), dim))
    return _found(ids, ids, np.zeros(len(ids)), ids, u[np.arange(len(ids))]).combine_chunks().to_batches()[0] if len(ids) else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))], ["id", "community", "degree", "grp", "size", "total"])
