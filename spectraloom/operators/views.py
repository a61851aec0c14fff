"""Views of hit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_ids(hits: DataFrame, column: str) -> DataFrame:
    return hits.select(column).distinct()


def tag_refs(hits: DataFrame, order: str | None = None) -> DataFrame:
    """Candidate lists ``qry_ids, ref_ids`` for a next search: every pair once, ``position`` by first appearance.

    The order within a query is that of the column ``order``, or of the reference ids.
    """
    key = F.min(order if order else "ref_ids").alias("__first")
    pairs = hits.groupBy("qry_ids", "ref_ids").agg(key)
    w = Window.partitionBy("qry_ids").orderBy("__first", "ref_ids")
    return pairs.withColumn("position", F.row_number().over(w).cast("long")).drop("__first")


def as_lists(hits: DataFrame, queries: DataFrame | None = None, *columns: str) -> DataFrame:
    """One row per query with a list per column, in order of reference; with ``queries(id)``, null lists for those without a hit."""
    columns = columns or tuple(c for c in hits.columns if c != "qry_ids")
    packed = hits.groupBy("qry_ids").agg(F.sort_array(F.collect_list(F.struct("ref_ids", *(c for c in columns if c != "ref_ids")))).alias("h"))
    lists = packed.select("qry_ids", *(F.col(f"h.{c}").alias(c) for c in columns))
    if queries is None:
        return lists
    return queries.select(F.col("id").alias("qry_ids")).distinct().join(lists, "qry_ids", "left")


def from_lists(lists: DataFrame, *columns: str) -> DataFrame:
    """The reverse: ``qry_ids, position, columns``; null and empty lists give no rows."""
    zipped = lists.select("qry_ids", F.posexplode(F.arrays_zip(*columns)).alias("position", "h"))
    return zipped.select("qry_ids", F.col("position").cast("long").alias("position"), *(F.col(f"h.{c}").alias(c) for c in columns))


def padded(hits: DataFrame, k: int) -> DataFrame:
    """Top-k hits as two lists of length ``k`` per query, padded with -1 and -infinity."""
    packed = hits.where(F.col("topk") <= k).groupBy("qry_ids").agg(F.sort_array(F.collect_list(F.struct("topk", "ref_ids", "scores"))).alias("h"))
    fill = lambda c, x: F.slice(F.concat(F.col(f"h.{c}"), F.array_repeat(F.lit(x), k)), 1, k).alias(c)
    return packed.select("qry_ids", fill("ref_ids", -1), fill("scores", float("-inf")))


def enrich(hits: DataFrame, molecules: DataFrame, fragment_hits: DataFrame | None = None) -> DataFrame:
    """Hits with the columns of ``molecules(id, ...)`` of their reference and the adducts of their fragment hits.

    A hit stays one row: adducts are a sorted list without repeats, null where there is none.
    """
    out = hits.join(molecules.withColumnRenamed("id", "ref_ids"), "ref_ids", "left")
    if fragment_hits is not None:
        found = fragment_hits.groupBy("qry_ids", "ref_ids").agg(F.array_sort(F.collect_set("adducts")).alias("adducts"))
        out = out.join(found, ["qry_ids", "ref_ids"], "left")
    return out
