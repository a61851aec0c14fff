import duckdb
import pytest

from spectraloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings spectrums ref_spectra molecules".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _same(df, want):
    clean = lambda x: "" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    table = lambda p: sorted(tuple(map(clean, r)) for r in p[names].itertuples(index=False))
    assert table(df.toPandas()) == table(want)


@pytest.mark.parametrize("name", plans.SQL)
def test_query_equals_its_sql(spark, con, name):
    _same(plans.QUERIES[name](spark, DATA), con.execute(plans.SQL[name]).df())


def test_flagship(spark):
    assert plans.flagship(spark, DATA).count() > 0


def test_rank_batches(spark, tmp_path):
    from spectraloom.operators.search import EmbeddingSearcher
    from spectraloom.streaming.streams import rank_batches, stream_mz_join

    v = plans.vectors(spark, DATA)
    v.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    run = rank_batches(stream, lambda q: EmbeddingSearcher("cosine", 2).run(q, v).table, lambda hits, n: hits.write.mode("overwrite").parquet(str(tmp_path / f"out/{n}"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/*")).count() == 2 * v.count()
    with pytest.raises(TypeError):
        stream_mz_join(v, v)


def test_candidates_of_a_brand_are_not_listed(spark):
    plan = plans.mz_search_candidates(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join Inner") == 2
