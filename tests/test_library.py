import pytest
from pyspark.sql import functions as F

from spectraloom.functions.masses import adduct_mz, formula_mass, mass_of
from spectraloom.functions.peaks import combine, split_intensity, split_mz, strip_charge
from spectraloom.operators.selection import select_rows, with_position
from spectraloom.sources import ingest, sqlite
from spectraloom.sources.library import Library, fragments_of


@pytest.fixture()
def library(spark):
    mol = spark.createDataFrame([(1, "C6H12O6", "CC"), (2, None, None), (3, "H2O", "O")], "id long, formula string, smiles string")
    emb = ingest.embeddings(spark, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [1, 2, 3])
    return Library({"molecules": mol, "embeddings": emb}, "mine").with_adducts(["[M]", "[M+H]+"])


def test_masses(spark):
    df = spark.createDataFrame([("C6H12O6",), ("",), (None,), ("Xx2",), ("C2(H)",), ("NaCl",)], "f string")
    got = [r.m for r in df.select(formula_mass(F.col("f")).alias("m")).collect()]
    assert got[0] == pytest.approx(180.06339, abs=1e-5) and got[1:5] == [None] * 4 and got[5] == pytest.approx(mass_of("NaCl"))
    mz = spark.range(1).select(*(adduct_mz(F.lit(180.06339), a).alias(str(i)) for i, a in enumerate(["[M]", "[M+H]+", "[M-H]-", "[2M+H]+", "[M+2H]2+"]))).first()
    assert list(mz) == pytest.approx([180.06339, 181.070666, 179.056114, 361.134056, 91.038971], abs=1e-5)


def test_library(spark, rows, library):
    assert len(library) == 3 and not library.is_empty() and library.adducts() == ["[M+H]+"]
    assert rows(library.bad_ids()) == [(2,)]
    assert library.fragment_mzs("no_adducts").count() == 3 and library.fragment_mzs().count() == 3
    more = library.with_adducts(["[M+H]+", "[M+Na]+"])
    assert more.adducts() == ["[M+H]+", "[M+Na]+"] and more["fragments"].count() == 9
    one = library.select(spark.createDataFrame([(3,), (3,), (9,)], "id long"))
    assert len(one) == 1 and one["fragments"].count() == 2
    with pytest.raises(KeyError):
        library["spectra"]
    ids = lambda lib: rows(lib["molecules"], "id")
    assert ids(library[1]) == [(2,)] and ids(library[0:3:2]) == [(1,), (3,)] and ids(library[[0, 1]]) == [(1,), (2,)]
    assert ids(library[0, [3], [False, False, False]]) == [(1,), (3,)] and ids(library[None, None, [False, True, True]]) == [(2,), (3,)]
    assert ids(library[spark.createDataFrame([(2,)], "id long")]) == [(2,)] and library[7].is_empty()
    with pytest.raises(ValueError):
        Library({"things": library["molecules"]})
    with pytest.raises(TypeError):
        Library({"molecules": library["molecules"].drop("id")})


def test_store_and_sqlite(spark, rows, library, tmp_path):
    library.save(str(tmp_path / "lib"))
    library.save_sqlite(str(tmp_path / "lib.db"))
    for back in (Library.load(spark, str(tmp_path / "lib"), ["molecules"]), Library.load_sqlite(spark, str(tmp_path / "lib.db")), Library.load_sqlite(spark, library.to_bytes())):
        assert back.name == "mine" and set(back.tables) == set(library.tables)
        for block in library.tables:
            assert rows(back[block]) == rows(library[block]) and back[block].schema.simpleString() == library[block].schema.simpleString()
    with pytest.raises(ValueError):
        Library.load(spark, str(tmp_path / "lib"), ["spectra"])
    with pytest.raises(ValueError):
        Library.load_sqlite(spark, str(tmp_path / "lib.db"), ["spectra"])


def test_fragments_from_formulas(spark, rows, library):
    """Fragments without a row of the mass itself, or with one for some records only: the formula takes its place."""
    bare = Library({"molecules": library["molecules"], "fragments": library["fragments"].where("adducts = '[M+H]+'").withColumn("rt", F.lit(1.5))}, "bare")
    got = {r.id: (r.mz, r.rt) for r in bare.with_adducts(["[M+Na]+"])["fragments"].where("adducts = '[M+Na]+'").collect()}
    assert set(got) == {1, 2, 3} and got[1] == (pytest.approx(203.05261, abs=1e-4), 1.5) and got[2][0] is None
    some = Library({"molecules": library["molecules"], "fragments": library["fragments"].where("id = 1")}, "some")
    assert rows(some.with_adducts(["[M+Na]+"])["fragments"].where("adducts = '[M+Na]+'"), "id") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        Library({"embeddings": library["embeddings"]}).with_adducts(["[M+H]+"])


def test_manifest_of_several_libraries(spark, library, tmp_path):
    path = str(tmp_path / "lib")
    library.save(path)
    more = [("other", "molecules", library["molecules"].schema.json())]
    spark.createDataFrame(more, "library string, block string, schema string").write.mode("append").parquet(f"{path}/_manifest.parquet")
    with pytest.warns(UserWarning, match="several|libraries"):
        back = Library.load(spark, path)
    assert back.name in ("mine", "other")


def test_sqlite_is_for_small_tables(spark, tmp_path):
    path = str(tmp_path / "small.db")
    df = spark.range(10)
    with pytest.raises(ValueError, match="more than 9 rows"):
        sqlite.save_tables(path, {"t": df}, max_rows=9)
    assert sqlite.list_tables(path) == []  # nothing was written
    sqlite.save_tables(path, {"t": df}, max_rows=10)
    assert sqlite.load_table(spark, path, "t", df.schema, max_rows=10).count() == 10
    with pytest.raises(ValueError, match="more than 9 rows"):
        sqlite.load_table(spark, path, "t", df.schema, max_rows=9)


def test_sqlite_tables(spark, rows, tmp_path):
    path = str(tmp_path / "x.db")
    df = spark.createDataFrame([(1, [1.0, 2.0], {"a": 1}, True, None)], "id long, xs array<double>, m map<string,int>, b boolean, n string")
    sqlite.save_tables(path, {"t": df})
    sqlite.save_tables(path, {"t": df}, if_exists="append")
    assert rows(sqlite.load_table(spark, path, "t", df.schema), "id", "xs", "b", "n") == [(1, (1.0, 2.0), True, None)] * 2
    with pytest.raises(ValueError):
        sqlite.save_tables(path, {"u": df, "t": df}, if_exists="fail")
    assert sqlite.list_tables(path) == ["t"]  # the transaction was rolled back


def test_selection(spark, rows):
    df = with_position(spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, odd int").repartition(3), "id")
    assert rows(df, "id", "position") == [(i, i) for i in range(10)]
    assert rows(select_rows(df, positions=[0, 3], keys=[3, 77], mask=F.col("id") > 8), "id", "ordinal") == [(0, 0), (3, 0), (3, 1), (9, 2)]
    assert rows(select_rows(df, positions=slice(1, 8, 3)), "id") == [(1,), (4,), (7,)]
    assert rows(select_rows(df, keys=spark.createDataFrame([(5,)], "k long")), "id") == [(5,)]
    assert select_rows(df).count() == 0
    with pytest.raises(ValueError):
        select_rows(df, positions=slice(-2, None))


def test_ingest(spark, rows):
    wide = spark.createDataFrame([(1, "H2O", 18.0, 19.0, 2.0)], "id long, formula string, `[M]` double, `[M+H]+` double, RT double")
    assert rows(ingest.unpivot_adducts(wide)) == [(1, "[M+H]+", 19.0, 2.0)]
    assert rows(ingest.ions(spark, [1, 2], [0.5, float("nan")], ["a", "b"])) == [("a", 1.0, 0.5), ("b", 2.0, None)]
    assert ingest.drop_empty_columns(spark.createDataFrame([(1, None)], "a int, b int")).columns == ["a"]
    for bad in (lambda: ingest.ions(spark, [1.0], [1.0, 2.0]), lambda: ingest.fragments(spark, [[1.0]], ["a", "b"]), lambda: ingest.embeddings(spark, [[1.0], [1.0, 2.0]]), lambda: ingest.spectra(spark, [[1.0]], [[1.0, 2.0]])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        fragments_of(spark.createDataFrame([(1, 2.0)], "id long, mass double"), "both")
    df = spark.createDataFrame([([1.0], [2.0], "C2H4+"), ([1.0], [], "CO-")], "m array<double>, i array<double>, f string").select(combine(F.col("m"), F.col("i")).alias("p"), strip_charge(F.col("f")).alias("f"))
    got = df.select(split_mz(F.col("p")).alias("m"), split_intensity(F.col("p")).alias("i"), "f").collect()
    assert [tuple(r) for r in got] == [([1.0], [2.0], "C2H4"), (None, None, "CO")]


def test_molecules_and_nested(spark, rows):
    from spectraloom.functions.nested import flatten, restructure

    df = spark.createDataFrame([(1, "CC", "InChI=1S/C2H6/c1-2"), (2, None, "InChI=1S/H2O"), (3, None, None)], "id long, smiles string, inchi string")
    assert rows(ingest.molecules(df), "id", "smiles", "formula") == [(1, "CC", "C2H6"), (2, None, "H2O"), (3, None, None)]
    assert rows(ingest.molecules(df.drop("inchi")), "id", "formula") == [(1, "C2H6"), (2, None), (3, None)]  # from the SMILES
    assert rows(ingest.molecules(df, inchi_to_smiles=lambda c: F.concat(F.lit("of "), c)), "smiles") == [("CC",), ("of InChI=1S/H2O",), (None,)]
    nested = spark.createDataFrame([(1, [[3, 1], [2]]), (2, [[5]]), (3, [])], "id long, x array<array<int>>")
    flat = flatten(nested, ["id"], "x", levels=2)
    assert rows(flat) == [(1, 0, 0, 3), (1, 0, 1, 1), (1, 1, 0, 2), (2, 0, 0, 5)]
    back = {r.id: r.value for r in restructure(flat, ["id"], levels=2).collect()}
    assert back == {1: [[3, 1], [2]], 2: [[5]]}
    holes = spark.createDataFrame([(1, [[], [2], []]), (2, []), (3, [[]]), (4, None), (5, [[None, 7]])], "id long, x array<array<int>>")
    whole = flatten(holes, ["id"], "x", levels=2, keep_empty=True)
    assert {r.id: r.value for r in restructure(whole, ["id"], levels=2).collect()} == {1: [[], [2], []], 2: [], 3: [[]], 4: [], 5: [[None, 7]]}
    with pytest.raises(Exception, match="another length"):
        restructure(flat.withColumn("n", F.lit(7)), ["id"], levels=2, lengths="n").collect()


def test_search_library(spark, rows):
    from spectraloom.plans.two_stage import search_library

    mol = spark.createDataFrame([(1, "C6H12O6", "sugar"), (2, "H2O", "water"), (3, None, "none")], "id long, formula string, smiles string")
    emb = ingest.embeddings(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [1, 2, 3])
    spec = spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 100.0)], "id long, pi double")
    lib = Library({"molecules": mol, "embeddings": emb, "spectra": spec}).with_adducts(["[M]", "[M+H]+", "[M+Na]+"])
    vectors = ingest.embeddings(spark, [[1.0, 0.1], [0.5, 0.5]], [7, 8])
    ions = ingest.ions(spark, [181.070666, 500.0], ids=[7, 8])
    assert rows(search_library(lib, ions, vectors), "qry_ids", "ref_ids", "topk", "smiles", "adducts") == [(7, 1, 1, "sugar", ("[M+H]+",))]
    assert rows(search_library(lib, ions, vectors, keep_unmatched=True), "qry_ids", "ref_ids") == [(7, 1), (8, None)]
    found = search_library(lib, ingest.ions(spark, [100.0, 200.0], ids=[7, 8]), vectors, by="precursors", top_k=1)
    assert rows(found, "qry_ids", "ref_ids", "formula") == [(7, 1, "C6H12O6"), (8, 2, "H2O")]
    with pytest.raises(ValueError):
        search_library(lib, ions, vectors, by="luck")


def test_released_tables_are_gone(spark):
    import glob

    from spectraloom.runtime import materialize, release, shared_dir

    where = shared_dir(spark).removeprefix("file:")
    a, b = materialize(spark.range(5), "kept-table"), materialize(spark.range(5), "gone-table")
    release(b, spark.range(3))
    assert a.count() == 5 and glob.glob(f"{where}/kept-table-*") and not glob.glob(f"{where}/gone-table-*")
    release(b)  # once more does no harm
