"""Queries pN_... of the training-data problems and, where SQL can state them, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.llm import ann, clusters, diverse, mixing, packing, quantiles, setjoin, subjects, topn
from spectraloom.llm.tokens import token_count
from spectraloom.llm.vectors import select_vectors
from spectraloom.runtime import materialize

RANKS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _read(spark, sf_dir, "embedding_hits").where(F.col("ref_ids") >= 0)
    return topn.top_n_per_group(hits, "qry_ids", "ref_ids", "scores", 10).select("qry_ids", "ref_ids", "topk")


def p1_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best hits of every query with their scores."""
    hits = _read(spark, sf_dir, "embedding_hits").where(F.col("ref_ids") >= 0)
    return topn.top_n_per_group(hits, "qry_ids", "ref_ids", "scores", 10)


P1_RANKED = """
select qry_ids, ref_ids, row_number() over (partition by qry_ids order by s desc, ref_ids) as topk, s as scores
from (select qry_ids, ref_ids, max(scores) as s from embedding_hits
      where qry_ids is not null and ref_ids >= 0 and scores is not null and isfinite(scores) group by qry_ids, ref_ids)
"""


def _ten_nearest(q: DataFrame, r: DataFrame, **how: bool) -> DataFrame:
    """The search that p2_found and p2_nearest return and p2_recall measures."""
    return ann.nearest(q, r, "id", "embedding", 10, **how)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ten_nearest(_read(spark, sf_dir, "qry_embs"), _read(spark, sf_dir, "ref_embs"))
    return found.where(F.col("score") >= 0.85).select(F.col("qry_id").alias("qry_ids"), F.col("ref_id").alias("ref_ids"))


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar references of every query vector."""
    found = _ten_nearest(_read(spark, sf_dir, "qry_embs"), _read(spark, sf_dir, "ref_embs"))
    return found.select(F.col("qry_id").alias("qry_ids"), F.col("ref_id").alias("ref_ids"), F.col("rank").alias("topk"), F.col("score").alias("scores"))


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the ten nearest against an exact search, over the queries whose id is divisible by 50."""
    q = _read(spark, sf_dir, "qry_embs").where(F.col("id") % 50 == 0)
    r = _read(spark, sf_dir, "ref_embs")
    keys = ["qry_id", "ref_id"]
    true = _ten_nearest(q, r, exact=True).select(*keys, (F.col("score") >= 0.85).alias("close"))
    both = true.join(_ten_nearest(q, r).select(*keys, F.lit(1).alias("hit")), keys, "left")
    return both.agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"),
        F.count(F.when(F.col("close"), 1)).alias("close_pairs"), F.avg(F.when(F.col("close"), F.coalesce("hit", F.lit(0)))).alias("close_recall"),
    )


VALID = """
select id, any_value(embedding)::double[64] as e from {table}
where len(embedding) = 64 and len([x for x in embedding if isfinite(x)]) = 64 and len([x for x in embedding if x <> 0]) > 0 group by id
"""

P2_RANKED = f"""
with q as ({VALID.format(table="qry_embs")}), r as ({VALID.format(table="ref_embs")}),
s as (select q.id as qry_ids, r.id as ref_ids, round(array_cosine_similarity(q.e, r.e), 6) as scores from q, r)
select qry_ids, ref_ids, row_number() over (partition by qry_ids order by scores desc, ref_ids) as topk, scores from s
"""

P6_SQL = f"""
with v as ({VALID.format(table="mol_embeddings")})
select min(b.id) as cluster_id, a.id from v a, v b where array_cosine_similarity(a.e, b.e) >= 0.85 group by a.id having count(*) >= 2
"""


P6_TYPICAL_SQL = f"""
with v as ({VALID.format(table="mol_embeddings")}), s as (select a.id, b.id as other, array_cosine_similarity(a.e, b.e) as c from v a, v b),
d as (select id, min(other) as cluster_id, count(*) as size, round(sum(case when other <> id then c else 0 end), 6) as degree from s where c >= 0.85 group by id)
select * from (select cluster_id, size, row_number() over (partition by cluster_id order by degree desc, id) as rank, id, degree from d) where rank <= 3
"""


def _clusters(spark: SparkSession, sf_dir: str) -> clusters.Clusters:
    return clusters.similarity_clusters(_read(spark, sf_dir, "mol_embeddings"), "id", "embedding", threshold=0.85)


def p6_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities as modularity divides the graph, before parts of a family are put together."""
    return _clusters(spark, sf_dir).communities


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _clusters(spark, sf_dir)
    several = found.sizes().where(F.col("size") >= 2).select("cluster_id")
    return found.members.join(several, "cluster_id").select("cluster_id", "id")


def p6_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and three most typical records of every cluster."""
    return _clusters(spark, sf_dir).typical(3)


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the records whose id is divisible by 50 and that reach 0.85 with another: how many have the right cluster and size; and how alike the members of clusters are."""
    found = _clusters(spark, sf_dir)
    true = clusters.exact_neighbourhoods(_read(spark, sf_dir, "mol_embeddings"), "id", "embedding", F.col("id") % 50 == 0, threshold=0.85).where(F.col("size") >= 2)
    sizes = found.sizes()
    got = found.members.select("id", "cluster_id").join(sizes, "cluster_id").select("id", F.col("cluster_id").alias("lowest"), "size", F.lit(1).alias("hit"))
    share = true.join(got, ["id", "lowest", "size"], "left").agg(F.count(F.lit(1)).alias("records"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    inner = found.members.groupBy("cluster_id").agg(F.avg("degree").alias("d"), F.min("degree").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    alike = inner.agg(F.count(F.lit(1)).alias("clusters"), F.min(F.col("d") / (F.col("n") - 1)).alias("least_mean_cosine"), F.min(F.col("low") / (F.col("n") - 1)).alias("least_mean_cosine_of_a_member"))
    return share.join(F.broadcast(alike))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests by measure, group and day of embedding_hits.scores and precursor_hits.delta."""
    keys = ["group_id", "run_day"]
    same = [*keys, "qry_ids", "ref_ids", "topk", "scores"]
    a = quantiles.quantile_digests(_read(spark, sf_dir, "embedding_hits"), "scores", keys, distinct_on=same)
    same = [*keys, "qry_ids", "ref_ids", "delta"]
    b = quantiles.quantile_digests(_read(spark, sf_dir, "precursor_hits").where(F.col("delta") >= 0), "delta", keys, distinct_on=same)
    both = a.withColumn("measure", F.lit("scores")).unionByName(b.withColumn("measure", F.lit("delta")))
    return materialize(both.select("measure", *keys, "level", "node", "cnt"), "daily-digests")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every measure and group over all days."""
    return quantiles.percentiles(_daily(spark, sf_dir), ["measure", "group_id"], ["run_day"], RANKS)


def p3_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the second quarter of 2024, from the same per-day digests."""
    days = _daily(spark, sf_dir).where(F.col("run_day").between(F.lit("2024-04-01").cast("date"), F.lit("2024-06-30").cast("date")))
    return quantiles.percentiles(days, ["measure", "group_id"], ["run_day"], RANKS)


def p3_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles of all days lie within their stated bounds, by the exact ranks of all values; group -1 is that of null."""
    found = p3_percentiles(spark, sf_dir)
    x = F.col("x").cast("double")
    hits = _read(spark, sf_dir, "embedding_hits").where(topn.finite(F.col("scores"))).select("group_id", "run_day", "qry_ids", "ref_ids", "topk", F.col("scores").alias("x")).distinct().select(F.lit("scores").alias("measure"), "group_id", x.alias("x"))
    pres = _read(spark, sf_dir, "precursor_hits").where(topn.finite(F.col("delta")) & (F.col("delta") >= 0)).select("group_id", "run_day", "qry_ids", "ref_ids", F.col("delta").alias("x")).distinct().select(F.lit("delta").alias("measure"), "group_id", x.alias("x"))
    same = (F.col("v.measure") == F.col("f.measure")) & F.col("v.group_id").eqNullSafe(F.col("f.group_id"))
    both = hits.unionByName(pres).alias("v").join(F.broadcast(found).alias("f"), same)
    slack = lambda c: F.abs(c) * F.col("value_error") * (1 + 1e-9)
    counts = []
    for r in RANKS:
        c = F.col(f"f.{r}")
        counts += [F.count(F.when(F.col("x") <= c + slack(c), 1)).alias(f"up_{r}"), F.count(F.when(F.col("x") < c - slack(c), 1)).alias(f"low_{r}")]
    sums = both.groupBy("f.measure", "f.group_id", "f.n", "f.rank_error").agg(F.count(F.lit(1)).alias("values"), *counts)
    rank = lambda q: F.ceil(F.col("n") * F.lit(q))
    within = [((F.col(f"up_{r}") >= rank(q) - F.col("rank_error")) & (F.col(f"low_{r}") <= rank(q) - 1 + F.col("rank_error"))).alias(r) for r, q in RANKS.items()]
    return sums.select("measure", F.coalesce("group_id", F.lit(-1).cast("long")).alias("group_id"), "n", (F.col("values") == F.col("n")).alias("all_counted"), *within)


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-day digests."""
    return _daily(spark, sf_dir)


def _spectra(spark: SparkSession, sf_dir: str) -> setjoin.SetJoin:
    q = setjoin.peak_sets(_read(spark, sf_dir, "spectrums"), "spectrum_id", F.col("mzs"), F.col("intensities"))
    r = setjoin.peak_sets(_read(spark, sf_dir, "ref_spectra"), "spectrum_id", F.col("peaks.mz"), F.col("peaks.intensity"))
    return setjoin.similar_sets(q, "id", "tokens", r, threshold=0.6, min_size=8)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).id_pairs().select(F.col("id_a").alias("spectrum_a"), F.col("id_b").alias("spectrum_b"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spectrum: its set of equal spectra and its number of links."""
    return _spectra(spark, sf_dir).links().withColumnRenamed("id", "spectrum_id").withColumnRenamed("right", "is_reference")


P4_SETS = """
with q as (
  select spectrum_id, false as is_reference, list_zip(mzs, intensities) as p from spectrums where len(mzs) = len(intensities)
  union all select spectrum_id, true, list_zip([x.mz for x in peaks], [x.intensity for x in peaks]) from ref_spectra where peaks is not null
), f as (
  select spectrum_id, is_reference, [x for x in p if x[1] > 0 and x[2] > 0 and not isnan(x[1]) and not isnan(x[2])] as p from q
), s as (
  select distinct spectrum_id, is_reference, list_sort(list_distinct([floor(x[1] * 10)::bigint for x in p if x[2] >= 0.01 * list_max([y[2] for y in p])])) as t from f
), sets as (select * from s where len(t) >= 8),
tok as (select spectrum_id, is_reference, len(t) as n, unnest(t) as tok from sets),
pair as (
  select a.spectrum_id as a, b.spectrum_id as b, count(*) as o, any_value(a.n) as na, any_value(b.n) as nb
  from tok a join tok b on a.tok = b.tok and a.spectrum_id < b.spectrum_id and not (a.is_reference and b.is_reference)
  group by all having count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.6)
"""


P4_LINKS_SQL = f"""
{P4_SETS}, both_ways as (select a as x, b as y from pair union all select b, a from pair), near as (select x, count(*) as links from both_ways group by 1),
copies as (select s.spectrum_id, s.is_reference, min(o.spectrum_id) as set_id, count(case when o.spectrum_id <> s.spectrum_id and not (o.is_reference and s.is_reference) then 1 end) as copies
           from sets s join sets o on s.t = o.t group by 1, 2)
select c.spectrum_id, c.is_reference, set_id, copies, coalesce(links, 0)::bigint as links from copies c left join near on x = c.spectrum_id
"""

P3_WITHIN_SQL = """
with v as (select 'scores' as measure, group_id, scores as x from (select distinct group_id, run_day, qry_ids, ref_ids, topk, scores from embedding_hits where scores is not null and isfinite(scores))
  union all select 'delta', group_id, delta from (select distinct group_id, run_day, qry_ids, ref_ids, delta from precursor_hits where delta >= 0 and isfinite(delta)))
select measure, coalesce(group_id, -1) as group_id, count(*) as n, true as all_counted, true as p01, true as p25, true as p50, true as p75, true as p95, true as p99 from v group by 1, 2
"""


def _molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid vectors, each id once: whether their molecule has a SMILES, and a code of its binary features, the coarser ones first.

    Six directions of the vector, whether the molecule has aromatic atoms, two more
    directions, whether more than three tenths of its atoms are heteroatoms, and eight
    more directions: families of similar vectors are told apart by directions.
    """
    codes = diverse.direction_code(_read(spark, sf_dir, "mol_embeddings"), "id", "embedding")
    smiles = _read(spark, sf_dir, "molecules").groupBy("id").agg(F.min("smiles").alias("smiles"))
    n = diverse.molecule_counts(F.col("smiles"))
    bit = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    part = lambda low, count: F.shiftright("code", low).bitwiseAND(F.lit((1 << count) - 1))
    code = (((part(10, 6) * 2 + bit(n["aromatic"] > 0)) * 4 + part(8, 2)) * 2 + bit(n["hetero"] > 0.3 * n["atoms"])) * 256 + part(0, 8)
    return materialize(codes.join(smiles, "id", "left").select("id", (n["atoms"] > 0).alias("known"), code.alias("code")), "molecules")


def _subset(valid: DataFrame) -> DataFrame:
    n = valid.count()
    return diverse.varied_subset(valid, "id", [F.coalesce("known", F.lit(False))], 1000 if n >= 10_000 else n // 10, refine=F.col("code"), bits=18)


def p5_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 varied molecules, or a tenth of the valid ones if there are fewer than 10,000."""
    return _subset(_molecules(spark, sf_dir))


def p5_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many are chosen, and whether they lie in more different places than as many chosen by chance.

    A place is told by the signs of twelve components, which the grid does not use.
    """
    valid = _molecules(spark, sf_dir)
    chosen = _subset(valid).select("id", F.lit(1).alias("chosen"))
    signs = sum((F.when(F.get("v", F.lit(5 * j)) > 0, 1 << j).otherwise(0) for j in range(12)), F.lit(0))
    places = select_vectors(_read(spark, sf_dir, "mol_embeddings"), "id", "embedding", 64).select("id", signs.alias("place")).join(chosen, "id", "left")
    n = chosen.count()
    by_chance = places.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(n).agg(F.count_distinct("place").alias("c"))
    ours = places.where("chosen = 1").agg(F.count(F.lit(1)).alias("chosen"), F.count_distinct("place").alias("p"))
    return ours.join(F.broadcast(by_chance)).select("chosen", (F.col("p") > F.col("c")).alias("more_varied"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty documents with their source and number of tokens."""
    docs = _read(spark, sf_dir, "documents").where(F.length("text") > 0)
    return materialize(docs.select("doc_id", F.lower(F.trim("source")).alias("source"), token_count(F.col("text")).alias("tokens")), "sizes")


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {r["pack_kind"]: r["capacity_tokens"] for r in _read(spark, sf_dir, "pack_sizes").where("pack_kind is not null and capacity_tokens > 0").limit(1001).collect()}
    if len(kinds) > 1000:
        raise ValueError("more than 1000 kinds of containers")
    return packing.fill_containers(_sizes(spark, sf_dir), "doc_id", "tokens", kinds)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text, or of each piece of one that exceeds the capacity, for every kind."""
    return _containers(spark, sf_dir)


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused space of every kind."""
    return packing.container_summary(_containers(spark, sf_dir), "doc_id")


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: texts packed, texts packed more than once, containers over capacity or with wrong unused space, and texts cut that would have fitted."""
    pieces = _containers(spark, sf_dir)
    capacity = _read(spark, sf_dir, "pack_sizes").select("pack_kind", "capacity_tokens")
    boxes = pieces.groupBy("pack_kind", "container_id").agg(F.sum("tokens").alias("used"), F.min("unused").alias("lo"), F.max("unused").alias("hi")).join(capacity, "pack_kind")
    wrong = (F.col("used") > F.col("capacity_tokens")) | (F.col("lo") != F.col("hi")) | (F.col("used") + F.col("lo") != F.col("capacity_tokens"))
    boxes = boxes.groupBy("pack_kind").agg(F.count(F.when(wrong, 1)).alias("wrong_containers"))
    texts = pieces.groupBy("pack_kind", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("different"), F.sum("tokens").alias("size")).join(capacity, "pack_kind")
    texts = texts.groupBy("pack_kind").agg(
        F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("pieces") != F.col("different"), 1)).alias("twice"),
        F.count(F.when(F.col("pieces") != F.ceil(F.col("size") / F.col("capacity_tokens")), 1)).alias("cut_needlessly"),
    )
    return texts.join(boxes, "pack_kind")


def _mixture(spark: SparkSession, sf_dir: str, whole: bool = False) -> mixing.Mixture:
    sizes = _sizes(spark, sf_dir)
    budget = sizes.agg(F.sum("tokens")).first()[0] if whole else None
    return mixing.mix(sizes, "doc_id", "source", "tokens", _read(spark, sf_dir, "source_targets"), budget=budget)


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents and how often each is used, for the largest total at which all present sources reach their share."""
    return _mixture(spark, sf_dir).documents().withColumnRenamed("id", "doc_id").withColumnRenamed("size", "tokens")


def p8_documents_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for as many tokens as the corpus has: small sources are repeated up to their cap and cut no other."""
    return _mixture(spark, sf_dir, whole=True).documents().withColumnRenamed("id", "doc_id").withColumnRenamed("size", "tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the shares reached by that mixture."""
    return _mixture(spark, sf_dir).shares()


def p8_shares_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for as many tokens as the corpus has, where small sources fall short."""
    return _mixture(spark, sf_dir, whole=True).shares()


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the default mixture: whether its share is within a text of its target, and whether a text is used too often."""
    mixture = _mixture(spark, sf_dir)
    largest = mixture.documents().groupBy("source").agg(F.max("size").alias("largest"), F.max("times").alias("times"))
    shares = mixture.shares().join(largest, "source", "left")
    present = F.when(F.col("available") > 0, F.col("target_share")).otherwise(0.0)
    target = present / F.sum(present).over(Window.partitionBy(F.lit(1)))  # a row a source
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))
    near = F.abs(F.col("total") - target * whole) <= F.coalesce("largest", F.lit(0)) * 2 + 1
    return shares.select("source", "target_share", "max_repeats", (F.col("available") > 0).alias("present"), near.alias("on_target"), (F.coalesce("times", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"))


def _subjects(spark: SparkSession, sf_dir: str) -> subjects.Subjects:
    names = [r[0] for r in _read(spark, sf_dir, "subjects").select("subject").where("subject is not null").distinct().orderBy("subject").limit(63).collect()]  # one more than subject_areas takes: it raises
    return subjects.subject_areas(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "subject_labels"), names, lang="lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).assigned()


def p9_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of prose and calibrated posterior of every subject of a document."""
    return _subjects(spark, sf_dir).posteriors()


def p9_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean posterior and labelled share of held-out pairs of document and subject, by tenths of the posterior."""
    return _subjects(spark, sf_dir).reliability()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus by subject."""
    return _subjects(spark, sf_dir).composition()


def queries() -> dict:
    names = ["p1_found", "p1_top_hits", "p2_found", "p2_nearest", "p2_recall", "p3_percentiles", "p3_range", "p3_daily", "p3_within", "p4_found", "p4_links", "p5_subset", "p5_variety", "p6_method", "p6_found", "p6_typical", "p6_recall",
             "p7_containers", "p7_summary", "p7_invariants", "p8_documents", "p8_documents_whole", "p8_shares", "p8_shares_whole", "p8_invariants", "p9_found", "p9_posteriors", "p9_composition", "p9_reliability"]
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"select qry_ids, ref_ids, topk from ({P1_RANKED}) where topk <= 10",
        "p1_top_hits": f"select * from ({P1_RANKED}) where topk <= 10",
        "p2_found": f"select qry_ids, ref_ids from ({P2_RANKED}) where topk <= 10 and scores >= 0.85",
        "p2_nearest": f"select * from ({P2_RANKED}) where topk <= 10",
        "p6_found": P6_SQL,
        "p6_typical": P6_TYPICAL_SQL,
        "p4_found": f"{P4_SETS} select a as spectrum_a, b as spectrum_b from pair",
        "p4_links": P4_LINKS_SQL,
        "p3_within": P3_WITHIN_SQL,
        "p5_variety": f"with v as ({VALID.format(table='mol_embeddings')}), n as (select count(*) as n from v) select case when n >= 10000 then 1000 else n // 10 end as chosen, true as more_varied from n",
        "p7_invariants": "select pack_kind, count(distinct doc_id) as texts, 0::bigint as twice, 0::bigint as cut_needlessly, 0::bigint as wrong_containers from documents, pack_sizes where len(text) > 0 group by 1",
        "p8_invariants": "select s.source, target_share, max_repeats, count(d.doc_id) > 0 as present, true as on_target, true as repeats_kept from source_targets s left join documents d on lower(trim(d.source)) = s.source and len(d.text) > 0 group by 1, 2, 3",
    }
