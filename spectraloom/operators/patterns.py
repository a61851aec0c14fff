"""Search for patterns of neutral losses between the peaks of a spectrum."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.peaks import within
from spectraloom.runtime import materialize
from spectraloom.schema import require


def loss_edges(peaks: DataFrame, losses: DataFrame, tolerance: float, *, id: str = "spectrum_id", loops: bool = False, multi_edge: bool = False, max_losses: int = 1000) -> DataFrame:
    """Edges ``id, u, v, loss_type`` (u < v) between peaks whose m/z differ by a loss.

    ``peaks`` holds ``id, peak, mz`` (``peak`` an int), ``losses`` holds ``loss_idx,
    loss_type, loss_da``. Signed differences are tested in both directions, bound
    included. Of several losses for a pair the last one by (from, to, loss_idx) stays,
    unless ``multi_edge``. Loops, from losses near 0, are kept only on request.

    The peaks of a spectrum meet by difference bucket: each peak is shifted by every
    loss and joined to peaks in the same or an adjacent bucket, so the work follows the
    number of matches. The table of losses is broadcast and must not exceed
    ``max_losses`` rows.
    """
    require(peaks, [id, "peak", "mz"], "the peak table")
    if losses.limit(max_losses + 1).count() > max_losses:
        raise ValueError(f"more than {max_losses} losses")
    width = max(tolerance * (1 + 1e-6), 1e-9)
    left = peaks.where(~F.isnan("mz")).select(id, F.col("peak").alias("i"), F.col("mz").alias("mi")).join(F.broadcast(losses))
    left = left.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor((F.col("mi") - F.col("loss_da")) / width) + s)))
    right = peaks.where(~F.isnan("mz")).select(id, F.col("peak").alias("j"), F.col("mz").alias("mj"), F.floor(F.col("mz") / width).alias("bucket"))
    hits = left.join(right, [id, "bucket"]).where(F.abs((F.col("mi") - F.col("mj")) - F.col("loss_da")) <= tolerance)
    if not loops:
        hits = hits.where(F.col("i") != F.col("j"))
    u, v = F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")
    if multi_edge:
        return hits.select(id, u, v, "loss_type").distinct()
    return hits.groupBy(id, u, v).agg(F.max_by("loss_type", F.struct("i", "j", "loss_idx")).alias("loss_type"))


def match_pattern(edges: DataFrame, pattern: Sequence[tuple[int, int, int]], *, id: str = "spectrum_id", nodes: DataFrame | None = None, node_mz: dict[int, float] | None = None, tolerance: float = 3.0, unit: str = "ppm", lone_nodes: int = 0, max_joins: int = 6) -> DataFrame:
    """Ids of the spectra that contain the pattern: ``id``, each once.

    ``pattern`` lists undirected edges (node, node, loss type). Different pattern nodes
    must be different peaks; further edges between them do not matter. ``node_mz`` gives
    pattern nodes an m/z that the peak of ``nodes(id, peak, mz)`` must have; a tolerance
    of 0 or less switches that test off, and a peak without an m/z fails it.
    ``lone_nodes`` further nodes without edges ask for as many more peaks.

    The pattern becomes a chain of equality joins on spectrum, loss type and the nodes
    bound so far. A pattern of more than ``max_joins`` edges, whose chain could grow
    large, is searched by backtracking, a spectrum's edges at a time.
    """
    if len(pattern) > max_joins:
        return _backtracked(edges, pattern, id, nodes, {} if tolerance <= 0 else dict(node_mz or {}), tolerance, unit, lone_nodes)
    both = edges.select(id, F.col("u").alias("x"), F.col("v").alias("y"), "loss_type").unionByName(edges.select(id, F.col("v").alias("x"), F.col("u").alias("y"), "loss_type")).distinct()
    todo, bound, found = _connected(pattern), [], None
    tests = {} if tolerance <= 0 else dict(node_mz or {})

    def checked(df: DataFrame, node: int) -> DataFrame:
        if node not in tests:
            return df
        near = within(F.col("mz"), F.lit(float(tests[node])), tolerance, unit)
        ok = nodes.where(near).select(id, F.col("peak").alias(f"n{node}"))
        return df.join(ok, [id, f"n{node}"], "left_semi")

    for a, b, kind in todo:
        step = both.where(F.col("loss_type") == kind)
        if a in bound and b in bound:
            found = found.join(step.select(id, F.col("x").alias(f"n{a}"), F.col("y").alias(f"n{b}")), [id, f"n{a}", f"n{b}"], "left_semi")
            continue
        if b in bound:
            a, b = b, a
        edge = step.select(id, F.col("x").alias(f"n{a}"), F.col("y").alias(f"n{b}"))
        if a == b:
            edge = step.where(F.col("x") == F.col("y")).select(id, F.col("x").alias(f"n{a}"))
        if found is None:
            found = edge
        elif a in bound:
            found = found.join(edge, [id, f"n{a}"])
            found = found.where(_differs(f"n{b}", [f"n{c}" for c in bound if c != a]))
        else:
            found = found.join(edge, id)
            found = found.where(_differs(f"n{a}", [f"n{c}" for c in bound]) & _differs(f"n{b}", [f"n{c}" for c in bound]))
        for node in dict.fromkeys((a, b)):
            if node not in bound:
                bound.append(node)
                found = checked(found, node)
        found = found.distinct()
    if found is None:
        found = nodes.select(id).distinct()
    if lone_nodes:
        enough = nodes.groupBy(id).agg(F.count_distinct("peak").alias("n")).where(F.col("n") >= lone_nodes + len(bound)).select(id)
        found = found.join(enough, id, "left_semi")
    return found.select(id).distinct()


def _backtracked(edges: DataFrame, pattern: Sequence[tuple[int, int, int]], id: str, nodes: DataFrame | None, tests: dict[int, float], tolerance: float, unit: str, lone_nodes: int) -> DataFrame:
    todo = _connected(pattern)
    order = list(dict.fromkeys(x for a, b, _ in todo for x in (a, b)))
    place = {node: k for k, node in enumerate(order)}
    # the edges that end at each node, given those placed before it
    checks = [[(place[a] if place[b] == k else place[b], t) for a, b, t in todo if max(place[a], place[b]) == k] for k in range(len(order))]
    rows = edges.select(id, F.lit(-1).alias("node"), "u", "v", "loss_type")
    for node, mz in tests.items():
        fits = nodes.where(within(F.col("mz"), F.lit(float(mz)), tolerance, unit))
        rows = rows.unionByName(fits.select(id, F.lit(node).alias("node"), F.col("peak").alias("u"), F.col("peak").alias("v"), F.lit(None).cast("long").alias("loss_type")))

    def search(table: pa.Table) -> pa.Table:
        links: dict[int, set[tuple[int, int]]] = {}
        allowed: dict[int, set[int]] = {place[node]: set() for node in tests}
        for node, u, v, kind in zip(*(table[c].to_pylist() for c in ("node", "u", "v", "loss_type"))):
            if node >= 0:
                allowed[place[node]].add(u)
            else:
                links.setdefault(u, set()).add((v, kind))
                links.setdefault(v, set()).add((u, kind))

        def extend(bound: list[int]) -> bool:
            k = len(bound)
            if k == len(order):
                return True
            tied = [(o, t) for o, t in checks[k] if o < k]
            first = [v for v, t in links.get(bound[tied[0][0]], ()) if t == tied[0][1]] if tied else list(links)
            for peak in dict.fromkeys(first):
                if peak in bound or peak not in allowed.get(k, {peak}):
                    continue
                if all((peak, t) in links.get(bound[o] if o < k else peak, ()) for o, t in checks[k]) and extend([*bound, peak]):
                    return True
            return False

        return table.select([id]).slice(0, 1 if extend([]) else 0)

    found = rows.groupBy(id).applyInArrow(search, rows.select(id).schema)
    if lone_nodes:
        enough = nodes.groupBy(id).agg(F.count_distinct("peak").alias("n")).where(F.col("n") >= lone_nodes + len(order)).select(id)
        found = found.join(enough, id, "left_semi")
    return found


def _differs(name: str, others: Sequence[str]) -> Column:
    test = F.lit(True)
    for o in others:
        test = test & (F.col(name) != F.col(o))
    return test


def _connected(pattern: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The edges in an order in which each shares a node with those before, where possible."""
    left, seen, out = list(pattern), set(), []
    while left:
        edge = next((e for e in left if e[0] in seen and e[1] in seen), None) or next((e for e in left if e[0] in seen or e[1] in seen), left[0])
        left.remove(edge)
        seen |= set(edge[:2])
        out.append(edge)
    return out


def search_patterns(peaks: DataFrame, losses: DataFrame, patterns: dict[int, Sequence[tuple[int, int, int]]], loss_tolerance: float = 0.1, *, id: str = "spectrum_id", node_mz: dict[int, dict[int, float]] | None = None, tolerance: float = 3.0, unit: str = "ppm") -> DataFrame:
    """``id, pattern_id`` of all patterns found in all spectra.

    The edges are derived once and, for more than one pattern, written to the shared folder.
    """
    edges = loss_edges(peaks, losses, loss_tolerance, id=id, loops=any(a == b for p in patterns.values() for a, b, _ in p))
    if len(patterns) > 1:
        edges = materialize(edges, "loss-edges")
    out = None
    for number, pattern in patterns.items():
        hit = match_pattern(edges, pattern, id=id, nodes=peaks, node_mz=(node_mz or {}).get(number), tolerance=tolerance, unit=unit)
        hit = hit.select(id, F.lit(number).cast("long").alias("pattern_id"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        return peaks.select(id, F.lit(0).cast("long").alias("pattern_id")).limit(0)
    return out
