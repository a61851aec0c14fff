"""Choosing a varied subset by a grid over several attributes; built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.vectors import select_vectors
from spectraloom.runtime import col, materialize


def varied_subset(df: DataFrame, id: str, attributes: Sequence[Column], k: int, *, refine: Column | None = None, bits: int = 0) -> DataFrame:
    """``k`` records that spread evenly over the cells of a grid: ``id, cell, rank``.

    ``attributes`` are binned features; ``refine`` is a number of ``bits`` binary ones,
    of which as many are used, from the highest down, as keep the number of occupied
    cells at ``k`` or below. Records of a cell are ranked in an
    order shuffled by hash of the id, ties by id; all cells give their first record
    before any gives its second, in an order of cells shuffled by hash. A large group of
    similar records fills few cells, so it gets few places.

    A null attribute is a bin of its own. Rows with a null id are left out; a repeated
    id counts once per cell. Fewer than ``k`` records are returned whole; an empty
    table gives no rows; ``k`` below 1 gives none. The sizes of the cells tell the rank
    that is needed; a task sends on no more records of a cell than that, so no cell
    gathers, however many rows it has.
    """
    k = max(k, 0)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    first = F.concat_ws("|", *(text(a) for a in attributes)) if attributes else F.lit("")
    code = refine.cast("long") if refine is not None else F.lit(0).cast("long")
    rows = df.where(col(id).isNotNull()).select(col(id).alias("id"), first.alias("c0"), code.alias("code"))
    used = 0
    if refine is not None and bits:
        full = rows.groupBy("c0", "code").agg(F.count(F.lit(1)).alias("n"))  # no more rows than the finest grid has cells
        steps = full.select("c0", "code", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("n"))
        steps = steps.select("n", "c0", F.expr(f"shiftright(code, {bits} - n)").alias("code")).distinct()
        occupied = {r["n"]: r["count"] for r in steps.groupBy("n").count().collect()}  # a row a bit
        used = max((n for n, cells in occupied.items() if cells <= k), default=0)
    cell = F.concat_ws("|", "c0", F.lpad(F.bin(F.shiftright("code", bits - used)), used, "0")) if used else F.col("c0")
    rows = materialize(rows.select("id", cell.alias("cell")).distinct(), "cells")
    # how many cells have how many records: few numbers, as records are no fewer than the sum of the different ones
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("cells")).orderBy("n").collect()
    rank, left, cells = 0, k, sum(r["cells"] for r in sizes)
    for r in sizes:
        step = min(r["n"] - rank, -(-left // cells)) if left > 0 else 0
        rank, left = rank + step, left - step * cells
        cells -= r["cells"]
        if left <= 0:
            break
    rows = rows.withColumn("h", F.xxhash64("id"))
    place = Window.partitionBy("cell").orderBy("h", "id")
    ranked = rows.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= rank)
    return ranked.orderBy("rank", F.xxhash64("cell"), "cell", "h", "id").limit(k).select(F.col("id").alias(id), "cell", "rank")


def main_part(smiles: Column) -> Column:
    """The longest part of a SMILES, without counter-ions and padding; null if there is none."""
    parts = F.transform(F.split(F.trim(smiles), r"\."), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    longest = F.array_max(parts)["p"]
    return F.when(F.length(longest) > 0, longest)


def molecule_counts(smiles: Column) -> dict[str, Column]:
    """Counts of a SMILES' main part: ``aromatic`` atoms, ``rings``, ``hetero`` atoms, ``halogens`` and ``atoms``, hydrogen apart.

    Atoms in brackets are read as such: the element stands after the isotope, so ``[nH]``
    is an aromatic nitrogen and ``[Sn]`` one tin. Null for a null or empty SMILES.
    """
    main = main_part(smiles)
    open_atoms = F.regexp_replace(main, r"\[[^\]]*\]?", "")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    bracket = r"\[\d*"
    return {
        "aromatic": count(open_atoms, "[bcnops]") + count(main, bracket + r"(?:se|as|te|[bcnops])(?![a-z])"),
        "rings": F.floor(count(open_atoms, r"%\d\d|\d") / 2).cast("int"),
        "hetero": count(open_atoms, "[NOPSnops]") + count(main, bracket + r"(?:[NOPSnops](?![a-z])|[Ss]e|[Aa]s|[Tt]e)"),
        "halogens": count(open_atoms, "Cl|Br|F|I") + count(main, bracket + "(?:Cl|Br|F(?![a-z])|I(?![a-z]))"),
        "atoms": count(open_atoms, "Cl|Br|[BCNOPSFIbcnops]") + count(main, r"\[\d*(?!H[\]+])[A-Za-z]"),
    }


def direction_code(df: DataFrame, id: str, embedding: str, *, dim: int = 64, bits: int = 16) -> DataFrame:
    """``id, code``: on which side of the mean every valid vector (see ``select_vectors``) lies in ``bits`` directions, a power of two; each id once.

    Every direction weighs all components of the unit vector with plus or minus one: the
    components are added up in ``bits`` sums with alternating signs, which a
    Walsh-Hadamard transform combines in all ways. All of it is plain column arithmetic.
    """
    if bits & (bits - 1) or not 0 < bits <= 32:
        raise ValueError("bits must be a power of two up to 32")
    v = F.col("v")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = select_vectors(df, id, embedding, dim).select("id", "v", F.sqrt(square).alias("norm"))
    sign = lambda i: "+" if (i * 2654435761 >> 7) & 1 else "-"
    rows = rows.selectExpr("id", *(f"(0D {' '.join(f'{sign(i)} get(v, {i})' for i in range(r, dim, bits))}) / norm as u{r}" for r in range(bits)))
    width = 1
    while width < bits:
        pair = lambda r: f"u{r} + u{r + width}" if not r & width else f"u{r - width} - u{r}"  # noqa: B023, E731
        rows = rows.selectExpr("id", *(f"{pair(r)} as u{r}" for r in range(bits)))
        width *= 2
    rows = materialize(rows, "directions")
    mean = rows.selectExpr(*(f"avg(u{r}) as m{r}" for r in range(bits))).first()
    code = F.expr(" + ".join(f"if(u{r} > {float(mean[r] or 0.0)!r}D, {1 << (bits - 1 - r)}L, 0L)" for r in range(bits)))
    return rows.select("id", code.alias("code"))
