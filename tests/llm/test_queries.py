import pytest

from spectraloom.llm import queries


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_no_kind_or_subject_is_dropped(spark, tmp_path):
    d = str(tmp_path)
    _write(spark, d, "subjects", [(f"s{i:02d}",) for i in range(63)], "subject string")
    _write(spark, d, "documents", [(1, "a text")], "doc_id long, text string")
    _write(spark, d, "subject_labels", [(1, "s00")], "doc_id long, subject string")
    _write(spark, d, "pack_sizes", [(f"k{i}", 100 + i) for i in range(1001)], "pack_kind string, capacity_tokens long")
    with pytest.raises(ValueError, match="62 subjects"):
        queries.p9_found(spark, d)
    with pytest.raises(ValueError, match="1000 kinds"):
        queries.p7_containers(spark, d)


def test_documents_of_the_whole_budget(spark, tmp_path):
    d = str(tmp_path)
    docs = [(i, "some words of a text", "large") for i in range(200)] + [(1000, "some words of a text", "tiny")]
    _write(spark, d, "documents", docs, "doc_id long, text string, source string")
    _write(spark, d, "source_targets", [("large", 0.5, 2), ("tiny", 0.5, 3)], "source string, target_share double, max_repeats long")
    got = {r.doc_id: r.times for r in queries.queries()["p8_documents_whole"](spark, d).collect()}
    assert got[1000] == 3 and len(got) >= 199  # the tiny source is used up to its cap and cuts no other
