"""Mixing sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.runtime import col, materialize

HASH_BITS = 40


@dataclass(frozen=True)
class Mixture:
    """``draws(source, id, copy, size, finish)``: the mixture, in no order of rows; ``finish`` (then source, id and copy) is the order of its uses.

    ``targets(source, target_share, max_repeats, present, available)``: what was asked for.
    """

    draws: DataFrame
    targets: DataFrame
    budget: int

    def documents(self) -> DataFrame:
        """``source, id, times, size``: the chosen records and how often each is used."""
        return self.draws.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("times")).select("source", "id", "times", "size")

    def shares(self) -> DataFrame:
        """Per source, absent ones included: target, records, uses, total size and share reached."""
        got = self.documents().groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("times").alias("uses"), F.sum(F.col("times") * F.col("size")).alias("total"))
        all_ = self.targets.join(got, "source", "left").fillna(0, ["records", "uses", "total"])
        whole = F.sum("total").over(Window.partitionBy(F.lit(1)))  # a row a source
        return all_.select("source", "target_share", "max_repeats", "available", "records", "uses", "total", F.round(F.try_divide("total", whole), 6).alias("share"))


def mix(df: DataFrame, id: str, source: str, size: str, targets: DataFrame, *, budget: int | None = None, seed: int = 42, buckets: int = 1024, max_sources: int = 1000, edge_rows: int = 200_000) -> Mixture:
    """Draw records so that each source has its share of the total size.

    ``targets(source, target_share, max_repeats)``: shares are weights, brought to a sum
    of 1 over the sources that have records; no record is used more than ``max_repeats``
    times. ``budget`` is the total size; the default is the largest total at which no
    present source runs out, so that every one reaches its share to within a record.
    With a larger budget a source that runs out falls short, the others go on in
    proportion, and ``shares`` tells what was reached; the mixture ends when all have
    run out. The total never exceeds the budget.

    Weighted fair queueing: the records of a source, in an order shuffled by hash,
    finish at (cumulated size) / weight of virtual time, the second use of all after the
    first; the mixture is all uses in order of finish up to the budget.

    Rows with a null id or source, a source that is not a target, or a size that is null
    or below 1 are left out. Targets with a null source, a share that is null or not
    above 0, or fewer than 1 repeat get nothing. Ids should be unique within a source; a
    repeated one counts as a record of its own. Empty tables give an empty mixture.

    No source gathers in a task: sizes are added up per (source, hash bucket), the small
    table of sums gives each bucket its start, and records are cumulated within their
    bucket. The cut is found from sums per interval of virtual time; the interval that
    holds it is divided again until it has at most ``edge_rows`` uses, and only these are
    ordered.
    """
    want = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("repeats"))
    asked = {r["source"]: r for r in want.where(F.col("source").isNotNull() & (F.col("share") > 0) & (F.col("repeats") >= 1)).limit(max_sources + 1).collect()}
    if len(asked) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << HASH_BITS))
    rows = df.select(col(id).alias("id"), col(source).alias("source"), col(size).cast("long").alias("size")).where(F.col("id").isNotNull() & F.col("source").isin(list(asked)) & (F.col("size") >= 1))
    rows = rows.withColumn("h", place).withColumn("bucket", F.floor(F.col("h") / ((1 << HASH_BITS) // buckets)).cast("int"))
    sums = {}
    for r in rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")).orderBy("source", "bucket").collect():  # at most buckets x sources rows
        sums.setdefault(r["source"], {})[r["bucket"]] = r["size"]
    spark = df.sparkSession
    total = {s: sum(b.values()) for s, b in sums.items()}
    weights = {s: asked[s]["share"] / sum(asked[x]["share"] for x in total) for s in total}
    if budget is None:
        budget = int(min((total[s] * asked[s]["repeats"] / weights[s] for s in total), default=0))
    told = [(s, float(r["share"]), int(r["repeats"]), s in total, int(total.get(s, 0))) for s, r in asked.items()]
    told = spark.createDataFrame(told, "source string, target_share double, max_repeats long, present boolean, available long")
    starts = []
    for s, own in sums.items():
        below = 0
        for b in sorted(own):
            starts.append((s, b, below, total[s], weights[s], int(asked[s]["repeats"])))
            below += own[b]
    starts = spark.createDataFrame(starts, "source string, bucket int, start long, whole long, weight double, repeats long")
    run = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(run)).join(F.broadcast(starts), ["source", "bucket"])
    # nothing that finishes later than this can be within the budget: a source that runs out leaves its part to the others
    last = _horizon(total, weights, {s: int(asked[s]["repeats"]) for s in total}, budget)
    once = (F.col("start") + F.col("run")) / F.col("weight")
    again = F.col("whole") / F.col("weight")
    uses = F.least(F.col("repeats"), F.greatest(F.lit(0), F.floor((F.lit(last) - once) / again) + 1)).cast("int")
    rows = rows.select("source", "id", "size", once.alias("once"), again.alias("again"), uses.alias("uses")).where(F.col("uses") >= 1)
    draws = rows.select("source", "id", "size", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy"), "once", "again")
    draws = draws.select("source", "id", F.col("copy").cast("long").alias("copy"), "size", (F.col("once") + F.col("copy") * F.col("again")).alias("finish"))
    draws = materialize(draws, "draws")
    low, width, below, depth, edge = 0.0, max(last, 1.0), 0, 0, draws
    whole = None  # what lies wholly before the interval that holds the cut
    while True:
        step = width / 4096
        slot = F.floor((F.col("finish") - low) / step)
        cut = None
        for r in edge.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).orderBy("slot").collect():  # about 4096 rows
            if below + r["size"] > budget:
                cut = r
                break
            below += r["size"]
        if cut is None:
            kept = edge
        else:
            kept = edge.where(slot < cut["slot"])
            edge = edge.where(slot == cut["slot"])
            low, width, depth = low + cut["slot"] * step, step, depth + 1
        whole = kept if whole is None else whole.unionByName(kept)
        # uses that end at the very same time cannot be told apart by time, so depth is bounded
        if cut is None or cut["rows"] <= edge_rows or depth == 6:
            break
        edge = materialize(edge, "edge")
    if cut is not None:
        order = Window.partitionBy(F.lit(0)).orderBy("finish", "source", "id", "copy").rowsBetween(Window.unboundedPreceding, 0)
        last_ones = edge.withColumn("total", F.sum("size").over(order) + below).where(F.col("total") <= budget)
        whole = whole.unionByName(last_ones.select(*draws.columns))
    draws = whole
    return Mixture(draws, told, budget)


def _horizon(total: dict, weights: dict, repeats: dict, budget: int) -> float:
    """Virtual time by which the sources together give at least the budget, or all have run out."""
    ends = sorted((total[s] * repeats[s] / weights[s], weights[s]) for s in total)
    now, got, rate = 0.0, 0.0, sum(weights.values())
    for end, w in ends:
        if got + (end - now) * rate >= budget:
            break
        got, now, rate = got + (end - now) * rate, end, rate - w
    else:
        return now + 1.0
    # one record of each source may still straddle the cut
    return now + (budget - got) / rate * (1 + 1e-9) + 1.0 + max((total[s] / weights[s] for s in total), default=0.0) * 1e-3
