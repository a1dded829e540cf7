"""Mergeable statistics, quality counters from written tables, delimiters by agreement of all lines."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tutorlens.operators import clean
from tutorlens.operators.sketches import STANDARD_ERROR, merged_stats, partial_stats
from tutorlens.sources.csv import csv_dialect_profile, read_csv_robust
from tutorlens.streaming.ingest import running_stats, start_attendance_ingest

from helpers import att_df, gr_df


def test_sketches_merge_to_the_distinct_count(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("s"), F.col("id") % 20_000).alias("IDEstudiante"), (F.col("id") % 7).alias("CursoID"),
                                      F.when(F.col("id") % 2 == 0, F.lit("E1")).alias("Evaluacion"),
                                      F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 90).cast("int")).alias("Fecha"))
    for by in (None, ["CursoID"], ["Fecha"]):
        got = merged_stats(partial_stats(rows, by)).first()
        assert abs(got["estudiantes_unicos"] - 20_000) <= 4 * STANDARD_ERROR * 20_000
        assert (got["registros"], got["cursos_unicos"], got["evaluaciones_unicas"]) == (60_000, 7, 1)
        assert (got["fecha_min"], got["fecha_max"]) == (dt.date(2024, 1, 1), dt.date(2024, 3, 30))
    once, twice = partial_stats(rows), partial_stats(rows).unionAll(partial_stats(rows.repartition(13)))
    assert abs(merged_stats(once).first()["estudiantes_unicos"] - merged_stats(twice).first()["estudiantes_unicos"]) <= 2 * STANDARD_ERROR * 20_000


def test_sketches_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([], "IDEstudiante string, CursoID string, Fecha date")
    nulls = spark.createDataFrame([(None, None, None)], none.schema)
    for df, n in ((none, 0), (nulls, 1)):
        got = merged_stats(partial_stats(df)).first()
        assert tuple(got) == (n, 0, 0, None, None)
        assert tuple(merged_stats(partial_stats(df, ["CursoID"])).first())[1:3] == (0, 0)


def test_running_statistics_of_batches(spark, tmp_dir):
    src, table, stats, ckpt = (f"{tmp_dir}/{n}" for n in ("src", "table", "stats", "ckpt"))
    os.makedirs(src)
    for day, rows in ((8, 30), (9, 50)):
        with open(f"{src}/{day}.csv", "w", encoding="utf-8") as f:
            f.write("IDEstudiante,CursoID,Fecha,Presente\n" + "".join(f"e{i},C{i % 3},2024-01-{day:02d},true\n" for i in range(rows)))
        start_attendance_ingest(spark, src, table, ckpt, stats_dir=stats).awaitTermination()
        got = running_stats(spark, stats).first()
        assert (got["estudiantes_unicos"], got["cursos_unicos"], got["fecha_max"].day) == (rows, 3, day)
    assert got["registros"] == 80 and got["fecha_min"].day == 8


ATT = [("a", "1", "2024-01-08", "true", "x", ""), ("a", "1", "08/01/2024", "false", "", ""), ("b", "1", None, "true", "", ""),
       ("b", "1", "junk", "true", "", ""), ("b", "2", "2024-01-08", "true", "", "")]
GR = [("a", "1", "E", "5", "ce1", "1", None), ("a", "1", "E", "6", "CE1 ", "1", None), ("a", "1", "E", "11", "CE1", "1", None),
      ("a", "2", "E", "7,5", "CE1", "1", None), (None, None, None, None, None, None, None), ("b", "1", "E", "-1", "CE1", "1", None)]


@pytest.mark.parametrize("rows", [0, 1, 6])
def test_quality_of_written_tables_equals_the_grouped_counters(spark, rows, tmp_dir):
    att, gr = att_df(spark, ATT[:rows]), gr_df(spark, GR[:rows])
    for raw, cleaned, quality in ((att, clean.clean_attendance(att), clean.attendance_quality),
                                  (gr, clean.clean_grades(gr), clean.grade_quality)):
        path = f"{tmp_dir}/{quality.__name__}"
        cleaned.write.parquet(path)
        counted = quality(raw, spark.read.parquet(path))
        assert counted.first().asDict() == quality(raw).first().asDict()
        assert "hashpartitioning" not in counted._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text,sep", [
    ("Nota, final;Curso\n7;C1\n8;C2\n", ";"),                              # a comma in the first name, one of each in the header
    ("a,b;c\n1;2\n3;4\n", ";"),
    ("Alumno\na;b\nc;d\n", ";"),                                           # the header names one column only
    ("Alumno\nuno\ndos\n", ","),                                           # one column: the default
    ("x;n\nE1;7,5\nE2;8,5\n", ";"),                                        # decimal commas in every line but the header
    ('x,t\n1,"a;b;c"\n2,"d;e;f"\n', ","),                                  # other delimiters only inside quotes
    ("a\tb|c\n1\t2\n", "\t"), ("a|b\n1|2\n\n3|4\n", "|"), ("a;b\n", ";"), ("a;b,c;d\n", ";"),
])
def test_delimiter_by_agreement(spark, tmp_dir, text, sep):
    path = f"{tmp_dir}/f.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    got = csv_dialect_profile(spark, path).first()
    assert (got["delimitador"], got["encoding"]) == (sep, "UTF-8")
    assert got["lineas"] == len([x for x in text.split("\n") if x]) - 1


def test_names_with_commas_are_read(spark, tmp_dir):
    path = f"{tmp_dir}/f.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("Nota, final;Curso\n7;C1\n8,5;C2\n9;C3\n")
    df = read_csv_robust(spark, path)
    assert df.columns == ["Nota, final", "Curso", "_rid"]
    assert [(r[0], r[1]) for r in df.orderBy("_rid").collect()] == [("7", "C1"), ("8,5", "C2"), ("9", "C3")]
