"""One case per semantic decision and per edge fixture (FIXTURES §4)."""

import pytest
from pyspark.sql import functions as F

from tutorlens.operators import clean, courses, metrics
from tutorlens.operators.combine import student_table
from tutorlens.operators.ml import run_clustering
from tutorlens.config import thresholds
from tutorlens.sources.csv import csv_dialect_profile, read_csv_robust

from helpers import att_df, by_id, gr_df


def test_attendance_duplicates_first_wins(spark):
    att = att_df(spark, [("A", "C", "2024-01-08", "false", "false", "false"),
                         ("A", "C", "2024-01-08", "true", "false", "false"),
                         ("A", "C", "2024-01-09", "true", "false", "false")])
    out = clean.clean_attendance(att)
    assert out.count() == 2
    assert by_id(metrics.attendance_counts(out))["A"]["asistencias"] == 1


def test_null_dates_are_one_key_and_sort_last(spark):
    att = att_df(spark, [("A", "C1", None, "true", "false", "false"),
                         ("A", "C1", "junk", "false", "false", "false"),
                         ("A", "C2", "2024-01-08", "true", "false", "false")])
    cleaned = clean.clean_attendance(att)
    assert cleaned.count() == 2                      # the two null dates collapse, first wins
    # last row in (date, input) order has a null date -> its course C1
    assert by_id(metrics.current_course(cleaned))["A"]["CursoID"] == "C1"
    assert by_id(metrics.attendance_profile(cleaned))["A"]["CursoID"] == "C1"


def test_student_on_one_side_gets_defaults(spark):
    att = att_df(spark, [("A", "C", "2024-01-0%d" % d, "true", "false", "false") for d in range(1, 4)])
    gr = gr_df(spark, [("B", "C", "Eval1", "7", "CE1", "1", "2024-01-01")])
    st = by_id(student_table(clean.clean_attendance(att), clean.clean_grades(gr)))
    assert st["A"]["nivel_riesgo_rendimiento"] == "SIN_DATOS" and st["A"]["rend_nota_media"] == 0.0
    assert st["A"]["nivel_riesgo_final"] == "OPTIMO"
    assert st["B"]["nivel_riesgo_asistencia"] == "SIN_DATOS" and st["B"]["asist_porcentaje_asistencia"] == 0.0
    assert st["B"]["nivel_riesgo_final"] == "ALERTA"


def test_unequal_weights_and_zero_weight(spark):
    gr = gr_df(spark, [("A", "C", "E1", "4", "CE1", "1", None), ("A", "C", "E1", "10", "CE2", "3", None),
                       ("Z", "C", "E1", "9", "CE1", "0", None)])
    m = by_id(metrics.grade_metrics(clean.clean_grades(gr)))
    assert m["A"]["nota_media"] == 8.5                # (4*1 + 10*3) / 4
    assert m["A"]["aprobado"] is True and m["A"]["nivel_riesgo"] == "OPTIMO"
    assert m["Z"]["nota_media"] is None and m["Z"]["nivel_riesgo"] == "SIN_DATOS" and m["Z"]["aprobado"] is False


def test_one_grade_has_zero_std_and_short_series_are_stable(spark):
    gr = gr_df(spark, [("A", "C", "E1", "7", "CE1", "1", "2024-01-01"),
                       ("B", "C", "E1", "2", "CE1", "1", "2024-01-01"), ("B", "C", "E2", "9", "CE1", "1", "2024-02-01")])
    m = by_id(metrics.grade_metrics(clean.clean_grades(gr)))
    assert m["A"]["nota_std"] == 0.0 and m["A"]["tendencia"] == "ESTABLE"
    assert m["B"]["tendencia"] == "ESTABLE"           # two rows


def test_constant_series_is_stable(spark):
    att = att_df(spark, [("A", "C", f"2024-01-{d:02d}", "true", "false", "false") for d in range(1, 11)])
    assert by_id(metrics.attendance_metrics(clean.clean_attendance(att)))["A"]["tendencia"] == "ESTABLE"


def test_trend_direction(spark):
    up = [("U", "C", f"2024-01-{d:02d}", "true" if d > 5 else "false", "false", "false") for d in range(1, 11)]
    down = [("D", "C", f"2024-01-{d:02d}", "true" if d <= 5 else "false", "false", "false") for d in range(1, 11)]
    m = by_id(metrics.attendance_metrics(clean.clean_attendance(att_df(spark, up + down))))
    assert m["U"]["tendencia"] == "MEJORANDO" and m["D"]["tendencia"] == "EMPEORANDO"


def test_student_in_two_courses_takes_last(spark):
    att = att_df(spark, [("A", "C2", "2024-01-02", "true", "false", "false"),
                         ("A", "C1", "2024-01-01", "true", "false", "false")])
    st = by_id(student_table(clean.clean_attendance(att), clean.clean_grades(
        gr_df(spark, [("A", "C9", "E", "5", "CE1", "1", None)]))))
    assert st["A"]["CursoID"] == "C2"


def test_course_fallback_to_grades_then_default(spark):
    att = att_df(spark, [("A", None, "2024-01-01", "true", "false", "false")])
    gr = gr_df(spark, [("A", "G1", "E", "5", "CE1", "1", None), ("A", "G2", "E", "6", "CE2", "1", None)])
    st = by_id(student_table(clean.clean_attendance(att), clean.clean_grades(gr)))
    assert st["A"]["CursoID"] == "G2"                 # last grade row in input order
    gr2 = gr_df(spark, [("B", "E", "5", "CE1", "1")], "IDEstudiante string, Evaluacion string, Nota string, "
                                                       "Competencia string, Peso string")
    st2 = by_id(student_table(clean.clean_attendance(att), clean.clean_grades(gr2)))
    assert st2["B"]["CursoID"] == "CURSO01"


def test_generated_ids_wide(spark):
    names = spark.range(10001).select(F.format_string("n%06d", "id").alias("NombreEstudiante"),
                                      F.lit("5").alias("Nota"))
    out = clean.gen_student_id(names)
    ids = {r["NombreEstudiante"]: r["IDEstudiante"] for r in out.collect()}
    assert ids["n000000"] == "EST0001" and ids["n009998"] == "EST9999" and ids["n010000"] == "EST10001"
    assert len(set(ids.values())) == 10001


def test_generated_ids_sorted_names_and_null(spark):
    df = spark.createDataFrame([("Zoe", "5"), ("Ana", "6"), (None, "7"), ("Ana", "8")], "NombreEstudiante string, Nota string")
    out = [(r["NombreEstudiante"], r["IDEstudiante"]) for r in clean.gen_student_id(df).collect()]
    assert sorted(out, key=str) == sorted([("Zoe", "EST0002"), ("Ana", "EST0001"), (None, None), ("Ana", "EST0001")], key=str)


def test_case_sensitive_columns_and_mapping(spark):
    df = spark.createDataFrame([("7", "3", "A")], "Nota string, nota string, id_estudiante string")
    out = clean.map_columns(df)
    assert out.columns == ["Nota", "nota", "IDEstudiante"]   # Nota present: nota is not mapped


def test_anonymize_exact_names(spark):
    df = spark.createDataFrame([("x", "y", "z")], "Email string, email string, Nota string")
    assert clean.anonymize(df).columns == ["email", "Nota"]


def test_require_columns_message(spark):
    df = spark.createDataFrame([("A",)], "IDEstudiante string")
    with pytest.raises(ValueError, match="Asistencia: no se encuentran"):
        clean.prepare_attendance(df)


def test_decimal_comma_and_out_of_range_dropped(spark):
    gr = gr_df(spark, [("A", "C", "E", "7,5", "CE1", "1", None), ("A", "C", "E", "10.01", "CE2", "1", None),
                       ("A", "C", "E", "-1", "CE3", "1", None), ("A", "C", "E", "10", "CE4", "1", None),
                       ("A", "C", "E", "NaN", "CE5", "1", None)])
    assert [r["Nota"] for r in clean.clean_grades(gr).collect()] == [10.0]
    q = clean.grade_quality(gr).first().asDict()
    assert (q["sin_nota"], q["fuera_de_rango"], q["registros_finales"]) == (2, 2, 1)


def test_empty_attendance_keeps_schema(spark):
    att = att_df(spark, [])
    gr = gr_df(spark, [("A", "C", "E", "5", "CE1", "1", None)])
    st = student_table(clean.clean_attendance(att), clean.clean_grades(gr))
    assert "asist_porcentaje_asistencia" in st.columns and st.count() == 1
    assert courses.summary(st).first()["total_estudiantes"] == 1


def test_ml_gate_below_min_samples(spark):
    att = att_df(spark, [(s, "C", "2024-01-01", "true", "false", "false") for s in "ABC"])
    st = student_table(clean.clean_attendance(att), clean.clean_grades(gr_df(spark, [])))
    res = run_clustering(st, thresholds())
    assert res.success is False and res.n_students == 3


def test_semicolon_latin1_file(spark, tmp_dir):
    path = f"{tmp_dir}/asis.csv"
    with open(path, "wb") as f:
        f.write("IDEstudiante; CursoID ;Fecha;Presente;Retraso;FaltaJustificada\n".encode("latin-1"))
        f.write("E1;C;08/01/2024;Sí;no;NA\n".encode("latin-1"))
        f.write("E1;C;09/01/2024;0;x;\n".encode("latin-1"))
    prof = csv_dialect_profile(spark, path).first()
    assert (prof["delimitador"], prof["encoding"]) == (";", "ISO-8859-1")
    att = clean.prepare_attendance(read_csv_robust(spark, path))
    rows = sorted((r["Fecha"].isoformat(), r["Presente"], r["Retraso"], r["FaltaJustificada"]) for r in att.collect())
    assert rows == [("2024-01-08", True, False, False), ("2024-01-09", False, True, False)]
    assert att.columns[:2] == ["IDEstudiante", "CursoID"]


def test_course_filter_only_that_course(spark):
    from tutorlens.plans.analysis import analyze
    att = att_df(spark, [("A", "C1", "2024-01-01", "true", "false", "false"),
                         ("B", "C2", "2024-01-01", "false", "false", "false")])
    res = analyze(clean.clean_attendance(att), clean.clean_grades(gr_df(spark, [])), course="C1")
    assert [r["IDEstudiante"] for r in res.students.collect()] == ["A"]
