"""Report sets behind a manifest, and tables kept by course."""

import os

import pytest
from pyspark.sql import functions as F

from tutorlens.operators import clean
from tutorlens.operators.combine import student_table
from tutorlens.plans.analysis import analyze
from tutorlens.sources.sinks import (current_report_set, read_course, read_table, write_by_course, write_report_set)

from helpers import att_df, gr_df

ATT = [("s1", "01", "2024-01-08", "true", "false", "false"), ("s2", "02", "2024-01-08", "false", "false", "false"),
       ("s3", "02", "2024-01-08", "true", "false", "false"), ("s3", "02", "2024-01-08", "false", "false", "false"),
       ("s4", "", "2024-01-09", "true", "false", "false"), ("s5", None, "2024-01-09", "true", "false", "false")]
GR = [("s1", "01", "E", "5.9", "CE1", "1", "2024-01-08"), ("s3", "02", "E", "8", "CE1", "1", "2024-01-08"),
      ("s3", "02", "E", "2", "CE1", "1", "2024-01-09"), ("s3", "01", "E", "11", "CE2", "1", "2024-01-09")]


@pytest.fixture
def school(spark):
    return att_df(spark, ATT), gr_df(spark, GR)


def test_readers_see_whole_sets_only(spark, school, tmp_dir):
    st = student_table(clean.clean_attendance(school[0]), clean.clean_grades(school[1]))
    with pytest.raises(FileNotFoundError):
        current_report_set(spark, tmp_dir)
    first = write_report_set(spark, st, tmp_dir)
    broken = st.limit(1).select(F.raise_error(F.lit("se rompe")).cast("string").alias("x"))
    with pytest.raises(Exception, match="se rompe"):
        write_report_set(spark, st.limit(2), tmp_dir, extra={"zzz": broken})
    paths, fmt = current_report_set(spark, tmp_dir)
    assert paths == first and fmt == "parquet" and read_table(spark, paths["estudiantes"], fmt).count() == 5
    assert len([d for d in os.listdir(tmp_dir) if not d.startswith("_")]) == 1        # nothing is left of the broken set


def test_replaced_sets_go_after_the_next(spark, school, tmp_dir):
    st = student_table(clean.clean_attendance(school[0]), clean.clean_grades(school[1]))
    sets = [write_report_set(spark, st.where(F.col("IDEstudiante") <= f"s{n}"), tmp_dir, fmt) for n, fmt in ((1, "json"), (2, "csv"), (5, "json"))]
    paths, fmt = current_report_set(spark, tmp_dir)
    assert paths == sets[2] and fmt == "json" and read_table(spark, paths["estudiantes"], fmt).count() == 5
    assert read_table(spark, sets[1]["estudiantes"], "csv").count() == 2              # a reader of the set before may go on
    assert not os.path.exists(sets[0]["estudiantes"])


def rows(df):
    return sorted(map(str, df.drop("_rid").collect()))


def test_course_before_cleaning_equals_course_after(spark, school):
    att, gr = school
    for course in ("01", "02", "", "none"):
        for prepare, raw in ((clean.prepare_attendance, att), (clean.prepare_grades, gr)):
            assert rows(prepare(raw, course)) == rows(prepare(raw).where(F.col("CursoID") == course))


def test_one_course_reads_its_own_folder(spark, school, tmp_dir):
    att, gr = clean.clean_attendance(school[0]), clean.clean_grades(school[1])
    for name, df in (("a", att), ("g", gr)):
        write_by_course(df, f"{tmp_dir}/{name}")
    assert rows(read_course(spark, f"{tmp_dir}/a", att.schema)) == rows(att)
    for course in ("01", "02", "", "none"):
        a, g = read_course(spark, f"{tmp_dir}/a", att.schema, course), read_course(spark, f"{tmp_dir}/g", gr.schema, course)
        assert a.columns == att.columns and rows(analyze(a, g).students) == rows(analyze(att, gr, course=course).students)
    plan = read_course(spark, f"{tmp_dir}/a", att.schema, "02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_curso" in plan
    assert [os.path.basename(os.path.dirname(f)) for f in read_course(spark, f"{tmp_dir}/a", att.schema, "02").inputFiles()] != []
    assert {r[0] for r in read_course(spark, f"{tmp_dir}/a", att.schema, "02").select("_metadata.file_path").distinct().collect()
            if "_curso=02" not in r[0]} == set()


def test_report_set_cleans_the_tables_once(spark, school, monkeypatch, tmp_dir):
    """Both sets of the query come from one pass over the cleaned tables."""
    from tutorlens.plans import registry
    st = student_table(clean.clean_attendance(school[0]), clean.clean_grades(school[1]))
    passed = spark.sparkContext.accumulator(0)
    names = st.columns

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    rows = st.mapInArrow(counted, st.schema).select(*names)
    monkeypatch.setattr(registry, "students", lambda spark, sf: rows)
    found = {r["tabla"]: r["filas"] for r in registry.REGISTRY["report_set"](spark, "").collect()}
    assert found["estudiantes"] == found["listado"] == 5 and passed.value == 5
