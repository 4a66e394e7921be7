from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from starloom import functions as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_log10_guards_and_propagates_null(spark):
    rows = spark.createDataFrame([(1e9,), (0.0,), (-5.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(S.log10_positive("x")).collect()] == [9.0, None, None, None]


def test_log10_of_mass_and_particles(spark):
    rows = spark.createDataFrame([(1e10, 100), (1e11, 1000)], "m double, n long")
    got = rows.select(S.log10_positive("m"), S.log10_positive("n")).collect()
    assert [tuple(r) for r in got] == [(10.0, 2.0), (11.0, 3.0)]


def test_box_fraction(spark):
    assert one(spark, S.box_fraction(F.lit(5000.0), F.lit(25.0))) == pytest.approx(0.2)


def test_snapshot_text(spark):
    rows = spark.createDataFrame([("snap_056-z0.000",), ("snap_010-z3.000",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(S.snapshot_number("t"), S.scale_factor("t")).collect()]
    assert got == [(56, 1.0), (10, 0.25), (None, None)]


@pytest.mark.parametrize("text", ["056-z0", "snap_x-z0.0", "snap_056"])
def test_snapshot_text_rejects(spark, text):
    with pytest.raises(PySparkException, match="not a snapshot"):
        one(spark, S.snapshot_number(F.lit(text)))


def test_setup_id(spark):
    rows = spark.createDataFrame([("z39_adapt",), ("z99_fixed",)], "t string")
    got = [tuple(r) for r in rows.select(S.setup_redshift("t"), S.setup_softening("t")).collect()]
    assert got == [(39, "adaptive"), (99, "fixed")]


@pytest.mark.parametrize("text", ["z39", "39_fixed", "zabc_fixed", "z39_parallel"])
def test_setup_id_rejects(spark, text):
    with pytest.raises(PySparkException, match="not a setup id"):
        one(spark, S.setup_softening(F.lit(text)))


def test_quantise_is_half_up_on_doubles(spark):
    rows = spark.createDataFrame([(0.125,), (-0.125,), (2.5,)], "x double")
    assert [r[0] for r in rows.select(S.quantise("x", 2)).collect()] == [0.13, -0.12, 2.5]


def test_merit(spark):
    assert one(spark, S.merit(F.lit(250), F.lit(500), F.lit(400))) == pytest.approx(0.3125)
    assert one(spark, S.merit(F.lit(1), F.lit(0), F.lit(4))) is None


def test_percent_of_nothing_is_null(spark):
    assert one(spark, S.percent(F.lit(1), F.lit(0))) is None
