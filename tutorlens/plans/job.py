"""The whole analysis as one Spark job: files in, report tables out.

    spark-submit tutorlens/plans/job.py --asistencia A --calificaciones C --output OUT \\
        [--umbrales JSON | --umbrales-file F] [--curso X] [--formato parquet|csv|json] [--no-ml] \\
        [--sobrescribir | --publicar]

The student table is computed once and written to the shared folder; the
clustering and every report table then read that copy. Excel/Word layout is
not produced: each report section is a table in the chosen format.
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tutorlens.operators.clean import (attendance_quality, attendance_stats, cross_validate, gen_course_id,  # noqa: E402
                                       grade_quality, grade_stats, map_columns, of_course, prepare_attendance,
                                       prepare_grades)
from tutorlens.operators.ml import attach_predictions, run_clustering  # noqa: E402
from tutorlens.plans.analysis import analyze  # noqa: E402
from tutorlens.session import clear_scratch, get_spark, scratch_path  # noqa: E402
from tutorlens.sources.csv import read_csv_robust  # noqa: E402
from tutorlens.sources.sinks import write_report_set, write_report_tables  # noqa: E402
from tutorlens.sources.thresholds import load_thresholds, validate_thresholds  # noqa: E402


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Análisis de riesgo académico (Spark)")
    p.add_argument("--asistencia", required=True, help="CSV file or folder with attendance")
    p.add_argument("--calificaciones", required=True, help="CSV file or folder with grades")
    p.add_argument("--umbrales", default=None, help="thresholds as a JSON object")
    p.add_argument("--umbrales-file", default=None, help="thresholds JSON file")
    p.add_argument("--curso", default=None, help="clean, check and analyse only this CursoID")
    p.add_argument("--output", default="outputs", help="output folder; each run gets a dated folder in it")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--sobrescribir", action="store_true", help="write into the output folder itself and replace its tables")
    where.add_argument("--publicar", action="store_true",
                       help="write a whole new set below the output folder, current for readers once it is complete")
    p.add_argument("--formato", choices=["parquet", "csv", "json"], default="parquet")
    p.add_argument("--no-ml", action="store_true", help="skip clustering (no ML columns)")
    return p.parse_args(argv)


def _check_course(raw, name: str, course: str) -> None:
    """The raw table must have a row of the course."""
    if "CursoID" in raw.columns and raw.where(F.col("CursoID") == course).limit(1).isEmpty():
        raise ValueError(f"no hay filas del curso {course} en {name}")


def check_tables(att_raw, gr_raw, att, gr, course: str | None = None) -> dict:
    """Validation, quality counters and load statistics of both inputs (of one course, if asked for), one table each.
    ``att`` and ``gr`` are the written cleaned tables."""
    marks = of_course(gen_course_id(map_columns(gr_raw)), course)
    return {"validacion": cross_validate(att, gr), "calidad_asistencia": attendance_quality(of_course(att_raw, course), att),
            "calidad_calificaciones": grade_quality(marks, gr),
            "carga_asistencia": attendance_stats(att), "carga_calificaciones": grade_stats(gr)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parse_args(argv)
    spark = spark or get_spark()
    th = load_thresholds(args.umbrales, args.umbrales_file, spark)
    validate_thresholds(th)
    att_raw, gr_raw = read_csv_robust(spark, args.asistencia), read_csv_robust(spark, args.calificaciones)
    if args.curso:
        _check_course(att_raw, "asistencia", args.curso)
        _check_course(map_columns(gr_raw), "calificaciones", args.curso)
    # the cleaned tables are read by the analysis, the checks and the statistics: written once
    tables = {}
    for name, df in (("asistencia", prepare_attendance(att_raw, args.curso)),
                     ("calificaciones", prepare_grades(gr_raw, args.curso))):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        tables[name] = spark.read.schema(df.schema).parquet(path)
    att, gr = tables["asistencia"], tables["calificaciones"]
    res = analyze(att, gr, th)
    stage = scratch_path(spark, "estudiantes")
    res.students.write.parquet(stage)
    students = spark.read.schema(res.students.schema).parquet(stage)
    extra = check_tables(att_raw, gr_raw, att, gr, args.curso)
    predictions = None
    if not args.no_ml:
        ml = run_clustering(students, th)
        extra["ml_resultado"] = ml.summary_frame(spark)
        if args.formato == "csv":   # a CSV cell holds no list
            extra["ml_resultado"] = extra["ml_resultado"].withColumn("features_usados", F.array_join("features_usados", " "))
        if ml.success:
            predictions = ml.predictions
            students = attach_predictions(students, predictions)
    if args.publicar:
        paths = write_report_set(spark, students, args.output, args.formato, predictions, extra)
        clear_scratch(spark)
        return paths
    out = args.output if args.sobrescribir else f"{args.output.rstrip('/')}/analisis_{datetime.now():%Y%m%d_%H%M%S}"
    paths = write_report_tables(spark, students, out, args.formato, predictions, extra, overwrite=args.sobrescribir)
    clear_scratch(spark)
    return paths


if __name__ == "__main__":
    for name, path in main().items():
        print(f"{name}\t{path}")
