import math

import pytest
from pyspark.sql import functions as F

from tutorlens.functions import scalars as S


def one(spark, expr, value, schema="x double"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("x,expected", [(84.125, 84.12), (84.135, 84.14), (2.675, 2.68), (90.0, 90.0), (0.005, 0.0)])
def test_round2_is_numpy_half_even(spark, x, expected):
    # numpy: rint(x * 100) / 100 on the binary value
    assert one(spark, S.round2("x"), x) == expected
    assert expected == float(__import__("numpy").round(x, 2))


@pytest.mark.parametrize("x", [0.25, 0.15, 84.25, 12.35, 2.45, 99.95, 0.05, 1 / 3 * 100, 7.65, 1e-9, 33.25])
def test_format_one_decimal_matches_python(spark, x):
    assert one(spark, S.format_fixed("x", 1), x) == f"{x:.1f}"


def test_pct_label(spark):
    df = spark.createDataFrame([(1, 400), (0, 0), (2, 10)], "c long, t long")
    out = [r[0] for r in df.select(S.pct_label("c", "t")).collect()]
    assert out == [f"{1 / 400 * 100:.1f}%", "0%", "20.0%"]


@pytest.mark.parametrize("pct,level", [(74.99, "ALTO"), (75.0, "MEDIO"), (84.99, "MEDIO"), (85.0, "ALERTA"),
                                       (94.99, "ALERTA"), (95.0, "OPTIMO"), (100.0, "OPTIMO"), (0.0, "ALTO")])
def test_risk_attendance_boundaries(spark, pct, level):
    assert one(spark, S.risk_attendance("x"), pct) == level


@pytest.mark.parametrize("nota,level", [(3.99, "ALTO"), (4.0, "MEDIO"), (6.0, "ALERTA"), (8.0, "OPTIMO"),
                                        (None, "SIN_DATOS")])
def test_risk_grade_boundaries(spark, nota, level):
    assert one(spark, S.risk_grade("x"), nota) == level


def test_custom_thresholds(spark):
    th = dict(S.DEFAULT_THRESHOLDS, asistencia_riesgo=50.0, asistencia_alerta=60.0, asistencia_optima=70.0)
    assert one(spark, S.risk_attendance("x", th), 65.0) == "ALERTA"


@pytest.mark.parametrize("a,b,final", [("ALTO", "OPTIMO", "ALTO"), ("SIN_DATOS", "MEDIO", "MEDIO"),
                                       ("SIN_DATOS", "SIN_DATOS", "OPTIMO"), ("ALERTA", "MEDIO", "MEDIO"),
                                       ("raro", "ALERTA", "ALERTA")])
def test_risk_combined(spark, a, b, final):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(S.risk_combined("a", "b")).first()[0] == final


@pytest.mark.parametrize("text,expected", [
    ("true", True), ("TRUE", True), ("Sí", True), ("si", True), ("x", True), ("yes", True), ("t", True),
    ("verdadero", True), ("1", True), ("2", True), ("1.0", True), ("  true ", True),
    ("false", False), ("no", False), ("0", False), ("0.0", False), ("", False), (None, False), ("nope", False),
])
def test_parse_bool(spark, text, expected):
    assert one(spark, S.parse_bool("x"), text, "x string") is expected


@pytest.mark.parametrize("text,expected", [
    ("2024-01-08", "2024-01-08"), ("2024-1-8", "2024-01-08"), ("08/01/2024", "2024-01-08"), ("8/1/2024", "2024-01-08"),
    ("08-01-2024", "2024-01-08"), ("2024/01/08", "2024-01-08"), ("08.01.2024", "2024-01-08"),
    ("2024-01-08 10:30:00", "2024-01-08"), ("2024-01-08T10:30:00", "2024-01-08"), ("31/02/2024", None),
    ("ayer", None), (None, None), ("15/13/2024", None),
])
def test_parse_date_day_first(spark, text, expected):
    got = one(spark, S.parse_date("x"), text, "x string")
    assert (got.isoformat() if got else None) == expected


@pytest.mark.parametrize("text,expected", [("7.5", 7.5), (" 8 ", 8.0), ("7,5", None), ("NaN", None), ("abc", None),
                                           ("1e1", 10.0), ("-1", -1.0), ("7.5d", None), ("", None)])
def test_parse_grade(spark, text, expected):
    assert one(spark, S.parse_grade("x"), text, "x string") == expected


def test_parse_grade_numeric_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,)], "x double")
    assert [r[0] for r in df.select(S.parse_grade("x", df.schema["x"].dataType)).collect()] == [None, 5.0]


def test_grade_range(spark):
    df = spark.createDataFrame([(x,) for x in (-0.01, 0.0, 10.0, 10.01, None)], "x double")
    assert [r[0] for r in df.select(S.grade_in_range("x")).collect()] == [False, True, True, False, False]


@pytest.mark.parametrize("text,expected", [(" ce1 ", "CE1"), ("\tce2\n", "CE2"), ("ce3 ", "CE3"), ("CE4", "CE4"),
                                           (None, None)])
def test_normalize_competency(spark, text, expected):
    assert one(spark, S.normalize_competency("x"), text, "x string") == expected


def test_weight_defaults(spark):
    df = spark.createDataFrame([("2",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in df.select(S.parse_weight("x")).collect()] == [2.0, 1.0, 1.0]


def test_student_id_format_keeps_wide_ranks(spark):
    df = spark.createDataFrame([(1,), (9999,), (10000,)], "x long")
    assert [r[0] for r in df.select(S.format_student_id("x")).collect()] == ["EST0001", "EST9999", "EST10000"]


def test_null_tokens(spark):
    df = spark.createDataFrame([("NA",), ("null",), ("x",), ("NaN",), ("na",)], "x string")
    assert [r[0] for r in df.select(S.null_tokens("x")).collect()] == [None, None, "x", None, "na"]
    assert not math.isnan(0.0)
    _ = F
