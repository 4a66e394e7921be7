from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from starloom.sources import runs, tables, text
from starloom.sources.shapes import read_shapes

HEADER = "#ID(1)\thostHalo(2)\tnumSubStruct(3)\tnpart(4)\tMhalo(5)\tXc(6)\t"


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_header_names(spark, tmp_path):
    path = write(tmp_path / "a.AHF_halos", HEADER, "1\t0\t0\t5\t1.0\t2.0")
    assert text.read_header(spark, path) == ["halo_id", "hostHalo", "numSubStruct", "npart", "Mhalo", "Xc"]


@pytest.mark.parametrize(
    ("token", "name"),
    [("ID(1)", "halo_id"), ("hostHalo(2)", "hostHalo"), ("Mvir(4) ", "Mvir(4)"), ("b(25)", "b"), ("plain", "plain")],
)
def test_clean_header_name(spark, token, name):
    assert spark.range(1).select(text.clean_header_name(F.lit(token))).first()[0] == name


def test_no_header_raises(spark, tmp_path):
    path = write(tmp_path / "a.AHF_halos", "1\t2")
    with pytest.raises(ValueError, match="no header"):
        text.read_header(spark, path)


def test_schema_types():
    kinds = {f.name: f.dataType.simpleString() for f in text.schema_of(["halo_id", "npart", "n_star_excised", "Mhalo"])}
    assert kinds == {"halo_id": "bigint", "npart": "bigint", "n_star_excised": "bigint", "Mhalo": "double"}


def test_one_file_each(spark, tmp_path):
    write(tmp_path / "a" / "x.AHF_halos", HEADER)
    write(tmp_path / "b" / "y.AHF_halos", HEADER)
    write(tmp_path / "b" / "other.txt", "")
    got = text.one_file_each(spark, {"s1": str(tmp_path / "a"), "s2": str(tmp_path / "b")}, text.CATALOGUE_GLOB)
    assert {k: v.rsplit("/", 1)[1] for k, v in got.items()} == {"s1": "x.AHF_halos", "s2": "y.AHF_halos"}


def test_missing_and_duplicate_files(spark, tmp_path):
    write(tmp_path / "a" / "other.txt", "")
    with pytest.raises(FileNotFoundError):
        text.one_file_each(spark, {"s": str(tmp_path / "a")}, text.MATCH_GLOB)
    write(tmp_path / "a" / "p_croco", "")
    write(tmp_path / "a" / "q_croco", "")
    with pytest.raises(ValueError, match="more than one"):
        text.one_file_each(spark, {"s": str(tmp_path / "a")}, text.MATCH_GLOB)


def test_catalogue_with_blanks_and_trailing_tabs(spark, tmp_path):
    a = write(tmp_path / "a.AHF_halos", HEADER, "0\t 0\t1\t500\t 7.13775e+12\t1000.0\t", "1\t0\t0\t 200\t5.6e+11\t 4000.0")
    b = write(tmp_path / "b.AHF_halos", HEADER, "0\t0\t0\t9\t1.0\t2.0\t")
    out = text.read_catalogue(spark, {"s1": a, "s2": b})
    assert out.columns == ["simulation_id", "halo_id", "hostHalo", "numSubStruct", "npart", "Mhalo", "Xc"]
    assert {tuple(r) for r in out.collect()} == {
        ("s1", 0, 0, 1, 500, 7.13775e12, 1000.0),
        ("s1", 1, 0, 0, 200, 5.6e11, 4000.0),
        ("s2", 0, 0, 0, 9, 1.0, 2.0),
    }


def test_short_row_raises(spark, tmp_path):
    path = write(tmp_path / "a.AHF_halos", HEADER, "0\t0\t1")
    with pytest.raises(Exception, match="expected rows of 6 columns, found 3"):
        text.read_catalogue(spark, {"s": path}).collect()


def test_bad_cell_raises(spark, tmp_path):
    path = write(tmp_path / "a.AHF_halos", HEADER, "0\t0\t1\t500\tabc\t1.0")
    with pytest.raises(Exception, match="Mhalo is no double: abc"):
        text.read_catalogue(spark, {"s": path}).collect()
    path = write(tmp_path / "b.AHF_halos", HEADER, "0\t0\t1\t5.5\t1.0\t1.0")
    with pytest.raises(Exception, match="npart is no bigint: 5.5"):
        text.read_catalogue(spark, {"s": path}).collect()
    path = write(tmp_path / "c_croco", "1 2 1", "  3 x 5 0.5")
    with pytest.raises(Exception, match="is no bigint: x"):
        text.read_matches(spark, {"p": path}).collect()


def test_blank_cells_are_null(spark, tmp_path):
    path = write(tmp_path / "a.AHF_halos", HEADER, "0\t\t1\t500\t \t1.0")
    row = text.read_catalogue(spark, {"s": path}).first()
    assert row["hostHalo"] is None and row["Mhalo"] is None and row["npart"] == 500


@pytest.mark.parametrize("name", ["with blank", "pct%41", "a+b", "ünï"])
def test_paths_that_need_encoding_lose_no_row(spark, tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    a = write(folder / "x.AHF_halos", HEADER, "0\t0\t1\t500\t7e12\t1.0", "1\t0\t1\t500\t7e12\t1.0")
    assert [r["simulation_id"] for r in text.read_catalogue(spark, {"s": a}).collect()] == ["s", "s"]
    m = write(folder / "x_croco", *MATCH_LINES)
    assert text.read_matches(spark, {"p": m}).count() == 3
    found = text.one_file_each(spark, {"s": str(folder)}, text.CATALOGUE_GLOB)
    assert text.read_catalogue(spark, found).count() == 2


def test_rows_without_an_owner_raise(spark):
    rows = spark.createDataFrame([("/x/a", 1), ("/x/b", 2)], "path string, v long")
    with pytest.raises(Exception, match="no population owns the file /x/b"):
        text.tag_by_path(rows, {"s": "/x/a"}, "path", "id").collect()


def test_catalogue_text_is_scanned_once(spark, tmp_path):
    a = write(tmp_path / "a.AHF_halos", HEADER, "0\t0\t1\t500\t7e12\t1.0")
    plan = text.read_catalogue(spark, {"s": a})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_headers_must_agree(spark, tmp_path):
    a = write(tmp_path / "a.AHF_halos", "#ID(1)\tnpart(2)", "0\t1")
    b = write(tmp_path / "b.AHF_halos", "#ID(1)\tMhalo(2)", "0\t1")
    with pytest.raises(ValueError, match="expected a header"):
        text.read_catalogue(spark, {"s1": a, "s2": b})


MATCH_LINES = [
    "# comment", "  9 9 9 0.9", "", "100  500  2", "  250  200  400  0.350", "  125  300  600  0.150", "# inside",
    "200  800  1", "  400  400  800  0.420",
]


def test_two_level_file(spark, tmp_path):
    path = write(tmp_path / "x_croco", *MATCH_LINES)
    out = text.read_matches(spark, {"z39_fixed": path})
    assert out.columns == [f.name for f in text.MATCH_SCHEMA]
    assert {tuple(r) for r in out.collect()} == {
        ("z39_fixed", 100, 500, 200, 400, 250, 0.35),
        ("z39_fixed", 100, 500, 300, 600, 125, 0.15),
        ("z39_fixed", 200, 800, 400, 800, 400, 0.42),
    }


def test_two_level_file_over_many_splits(spark, tmp_path):
    """A file cut into small splits gives the same rows: parents are carried over split borders."""
    lines, want = [], set()
    for parent in range(40):
        lines.append(f"{parent}  {parent + 1000}  25")
        for child in range(25):
            lines.append(f"  {child}  {parent * 100 + child}  7  0.5")
            want.add((parent, parent + 1000, parent * 100 + child))
    path = write(tmp_path / "x_croco", *lines)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(path).rdd.getNumPartitions() > 8
        out = text.read_matches(spark, {"p": path}).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r["wdm_halo_id"], r["wdm_npart"], r["cdm_halo_id"]) for r in out} == want
    assert len(out) == len(want)


def test_empty_match_files_keep_their_type(spark, tmp_path):
    path = write(tmp_path / "x_croco", "# nothing")
    out = text.read_matches(spark, {"p": path})
    assert out.count() == 0
    assert [f.dataType for f in out.schema] == [f.dataType for f in text.MATCH_SCHEMA]
    assert text.read_matches(spark, {}).schema == text.MATCH_SCHEMA


def test_shapes_prune_wide_columns(spark, tmp_path):
    from conftest import plan_of

    df = spark.createDataFrame(
        [(7, 0.4, "snap_056-z0.000", 1e9, bytearray(b"x"))],
        "halo_id long, sphericity_halfmaxmass double, halfmaxmass string, mhalo_halfmaxmass double, blob binary",
    )
    path = str(tmp_path / "s.parquet")
    df.write.parquet(path)
    out = read_shapes(spark, {"s1": path, "s2": path})
    assert {tuple(r) for r in out.collect()} == {("s1", 7, 0.4, 56, 1.0, 1e9), ("s2", 7, 0.4, 56, 1.0, 1e9)}
    assert "blob" not in plan_of(out)


def test_shapes_need_their_columns(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    spark.createDataFrame([(7, 0.4)], "halo_id long, sphericity_halfmaxmass double").write.parquet(path)
    with pytest.raises(ValueError, match="mhalo_halfmaxmass"):
        read_shapes(spark, {"s": path})


def test_layers_and_table_replacement(spark):
    layers = ["t_one", "t_two"]
    tables.reset_layers(spark, layers)
    first = tables.replace_table(spark.range(5).toDF("a"), "t_one.x")
    assert first.count() == 5
    again = tables.replace_table(first.where("a > 2"), "t_one.x")
    assert again.count() == spark.table("t_one.x").count() == 2
    tables.reset_layers(spark, layers)
    assert not spark.catalog.tableExists("t_one.x")


def test_run_log(spark):
    tables.reset_layers(spark, ["t_runs"])
    for model, ap in (("lr", 0.5), ("rf", 0.9)):
        runs.append_run(runs.run_row(spark, model, "s1", {"C": 1.0}, {"test_average_precision": ap, "test_f1": ap}), "t_runs.log")
    runs.append_run(runs.run_row(spark, "lr", "s2", {}, {"average_precision": 0.4, "f1": 0.1, "roc_auc": 0.2}), "t_runs.log")
    log = spark.table("t_runs.log")
    best = runs.split_metrics(log, "s1", ["test_average_precision", "test_f1", "test_unknown"])
    assert best.columns == ["model", "test_average_precision", "test_f1"]
    assert [r["model"] for r in best.collect()] == ["rf", "lr"]
    assert [tuple(r)[:3] for r in runs.generalisation_table(log).collect()] == [("lr", "s2", 0.4)]
    assert log.where("model = 'lr' and split_name = 's1'").first()["params"] == {"C": "1.0", "model": "lr", "split_name": "s1"}


def test_a_replacement_that_breaks_off_leaves_a_table(spark):
    tables.reset_layers(spark, ["t_broken"])
    tables.replace_table(spark.range(3).toDF("a"), "t_broken.x")
    with pytest.raises(Exception, match="broken"):
        tables.replace_table(spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("a")), "t_broken.x")
    assert spark.table("t_broken.x").count() == 3
    assert not tables.recover_table(spark, "t_broken.x")
    # as it is when a run ends between the renames
    spark.range(7).toDF("a").write.format("parquet").saveAsTable("t_broken.y__staging")
    tables.replace_table(spark.range(3).toDF("a"), "t_broken.z")
    spark.sql("ALTER TABLE t_broken.z RENAME TO t_broken.y__former")
    assert tables.recover_table(spark, "t_broken.y") and spark.table("t_broken.y").count() == 7
    # and if a former one is all there is
    spark.sql("ALTER TABLE t_broken.y RENAME TO t_broken.y__former")
    assert tables.replace_table(spark.table("t_broken.x"), "t_broken.y").count() == 3
    assert {t.name for t in spark.catalog.listTables("t_broken")} == {"x", "y"}
