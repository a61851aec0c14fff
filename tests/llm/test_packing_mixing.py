import random

import numpy as np
import pytest

from spectraloom.llm.diverse import direction_code, main_part, molecule_counts, varied_subset
from spectraloom.llm.mixing import mix
from spectraloom.llm.packing import container_summary, fill_containers, pack


@pytest.mark.parametrize("seed", range(6))
def test_pack(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 400))
    sizes = np.minimum(capacity, rng.lognormal(3, 1.2, 800).astype(int) + 1)
    bins, count = pack(sizes, capacity)
    used = np.bincount(bins, weights=sizes, minlength=count)
    assert (bins >= 0).all() and len(used) == count and (used > 0).all() and (used <= capacity).all()
    assert (np.bincount(bins, weights=3 * sizes > capacity, minlength=count) <= 2).all()
    lower = max(-(-sizes.sum() // capacity), int((2 * sizes > capacity).sum()))
    assert count <= lower * 1.25 + 2


def test_pack_matches_large_items():
    bins, count = pack(np.array([60, 40, 70, 30, 50, 50, 10]), 100)
    assert count == 4 and bins[0] == bins[1] and bins[2] == bins[3] and bins[4] == bins[5]
    assert pack(np.array([], np.int64), 10)[1] == 0


def test_fill(spark, rows):
    data = [(1, 25), (2, 10), (3, 3), (4, 0), (5, None), (None, 4), (6, 7), (7, 7), (7, 7)]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in data], "id long, n int, pack_kind string, shard int")
    got = fill_containers(df, "id", "n", {"a": 10, "b": 1000})
    out = rows(got, "pack_kind", "id", "piece", "tokens")
    assert [r for r in out if r[0] == "a"] == [("a", 1, 0, 10), ("a", 1, 1, 10), ("a", 1, 2, 5), ("a", 2, 0, 10), ("a", 3, 0, 3), ("a", 6, 0, 7), ("a", 7, 0, 7), ("a", 7, 0, 7)]
    each = {}
    for r in got.collect():
        each.setdefault((r.pack_kind, r.container_id), []).append(r)
    cap = {"a": 10, "b": 1000}
    assert all(sum(r.tokens for r in rs) + rs[0].unused == cap[k[0]] and len({r.unused for r in rs}) == 1 for k, rs in each.items())
    s = {r.pack_kind: r for r in container_summary(got, "id").collect()}
    assert s["b"].containers == 1 and s["b"].tokens == 59 and s["b"].documents == 6
    assert fill_containers(df.limit(0), "id", "n", cap).count() == 0 and fill_containers(df, "id", "n", {}).count() == 0
    with pytest.raises(ValueError):
        fill_containers(df, "id", "n", {"a": 0})


def test_fill_over_shards(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([1, 5, 400, 401, 2048, 5000, rng.randint(1, 2500)])) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, n long")
    got = fill_containers(df, "id", "n", {"k": 2048}, shard_rows=300)
    total = {}
    for r in got.collect():
        total[r.id] = total.get(r.id, 0) + r.tokens
    assert total == dict(data)
    s = container_summary(got, "id").first()
    assert s.used_share > 0.9
    assert sorted(map(tuple, fill_containers(df.repartition(5), "id", "n", {"k": 2048}, shard_rows=300).collect())) == sorted(map(tuple, got.collect()))


TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 2), ("gone", 0.05, 3), (None, 0.1, 1), ("d", None, 1), ("e", 0.1, 0)]


def _docs(spark, n=3000):
    rng = random.Random(4)
    data = [(i, rng.choices("abcde", [70, 8, 20, 1, 1])[0], rng.choice([1, 100, rng.randint(1, 900)])) for i in range(n)]
    data += [(None, "a", 5), (n + 1, None, 5), (n + 2, "a", None), (n + 3, "a", 0)]
    return data, spark.createDataFrame([(*d, "x", 1) for d in data], "id long, source string, size int, copy string, bucket int")


@pytest.mark.parametrize("part", [None, 0.2, 5.0])
def test_mix(spark, part):
    data, df = _docs(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    real = {s: sum(n for i, x, n in data if x == s and i is not None and n and n > 0) for s in "abc"}
    budget = None if part is None else int(sum(real.values()) * part)
    m = mix(df, "id", "source", "size", targets, budget=budget, buckets=16, edge_rows=3)
    draws = m.draws.collect()
    total = sum(r.size for r in draws)
    most = max(n for _, _, n in data if n)
    repeats = {"a": 1, "b": 4, "c": 2}
    assert total <= m.budget
    whole = sum(real[s] * repeats[s] for s in real)
    assert total > min(m.budget, whole) - 3 * most
    uses = {}
    for r in draws:
        uses.setdefault(r.id, set()).add(r.copy)
    assert all(u == set(range(len(u))) for u in uses.values())
    assert all(len(u) <= repeats[s] for i, s, n in data if (u := uses.get(i)))
    shares = {r.source: r for r in m.shares().collect()}
    assert set(shares) == {"a", "b", "c", "gone"} and shares["gone"].total == 0
    if part != 5.0:
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
            assert shares[s].total / total == pytest.approx(w / 0.95, abs=4 * most / total)
    else:
        assert total == whole
    assert sum(r.times * r.size for r in m.documents().collect()) == total
    # by the definition: the first uses in order of virtual finish
    order = sorted((r.finish, r.source, r.id, r.copy, r.size) for r in draws)
    ends = {}
    for f, s, i, c, n in order:
        ends[s] = ends.get(s, 0) + n
        assert f == pytest.approx(ends[s] / (dict(a=0.5, b=0.3, c=0.15)[s] / 0.95), rel=1e-9)


def test_mix_empty(spark):
    _, df = _docs(spark, 50)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mix(df.limit(0), "id", "source", "size", targets).draws.count() == 0
    assert mix(df, "id", "source", "size", targets.limit(0)).draws.count() == 0
    assert mix(df.limit(0), "id", "source", "size", targets).shares().count() == 4


def test_varied_subset(spark):
    from pyspark.sql import functions as F

    data = [(i, 0 if i < 900 else i, "y") for i in range(1000)] + [(None, 1, "y"), (5, 0, "y")]
    df = spark.createDataFrame(data, "id long, f int, cell string")
    got = varied_subset(df, "id", [F.col("f")], 101).collect()
    assert len(got) == 101 and {r["rank"] for r in got} == {1} and sum(r.id < 900 for r in got) == 1
    more = varied_subset(df, "id", [F.col("f")], 120).collect()
    assert sum(r.id < 900 for r in more) == 20 and len({r.id for r in more}) == 120
    assert varied_subset(df, "id", [], 5000).count() == 1000
    assert varied_subset(df.limit(0), "id", [F.col("f")], 5, refine=F.col("f"), bits=4).count() == 0 and varied_subset(df, "id", [F.col("f")], 0).count() == 0
    assert len({r.cell for r in varied_subset(df, "id", [], 64, refine=F.col("id"), bits=10).collect()}) in range(32, 65)
    assert sorted(r.id for r in varied_subset(df, "id", [F.col("f")], 102).collect() if r.id >= 900) == list(range(900, 1000))  # the second round gives the rest
    same = [sorted(r.id for r in varied_subset(df.repartition(n), "id", [F.col("f")], 110).collect()) for n in (1, 7)]
    assert same[0] == same[1]


def test_features(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in ("c1ccccc1.Cl", " ", None, "CC", "c1cc[nH]c1Br", "[Sn]([Cl])C", "[Co]Cl", "O=C1NC2CC2C1F", "[13cH]1ccccc1")], "s string")
    n = molecule_counts(F.col("s"))
    got = {r.s: tuple(r)[1:] for r in df.select("s", main_part(F.col("s")).alias("m"), *(c.alias(k) for k, c in n.items())).collect()}
    #                                       main part, aromatic, rings, hetero, halogens, atoms
    assert got["c1ccccc1.Cl"] == ("c1ccccc1", 6, 1, 0, 0, 6) and got["CC"] == ("CC", 0, 0, 0, 0, 2)
    assert got[" "] == got[None] == (None,) * 6
    assert got["c1cc[nH]c1Br"][1:] == (5, 1, 1, 1, 6) and got["[Sn]([Cl])C"][1:] == (0, 0, 0, 1, 3) and got["[Co]Cl"][1:] == (0, 0, 0, 1, 2)
    assert got["O=C1NC2CC2C1F"][1:] == (0, 2, 2, 1, 8) and got["[13cH]1ccccc1"][1:] == (6, 1, 0, 0, 6)


def test_direction_code(spark):
    """Codes follow the direction alone; near directions share most bits, opposite ones none."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in 7 * v]) for i, v in enumerate(x)] + [(5, [float(c) for c in x[5]]), (2000, None), (2001, [0.0] * 8), (None, [1.0] * 8)]
    code = {r.id: r.code for r in direction_code(spark.createDataFrame(rows, "id long, e array<float>"), "id", "e", dim=8, bits=8).collect()}
    assert len(code) == 800 and all(0 <= c < 256 for c in code.values())
    assert sum(code[i] == code[1000 + i] for i in range(400)) >= 395
    ones = np.array([[c >> j & 1 for j in range(8)] for c in code.values()]).mean(0)
    assert (abs(ones - 0.5) < 0.15).all()  # every direction divides the records at their mean
    assert len(set(code.values())) > 100
    with pytest.raises(ValueError):
        direction_code(spark.createDataFrame(rows, "id long, e array<float>"), "id", "e", dim=8, bits=12)
