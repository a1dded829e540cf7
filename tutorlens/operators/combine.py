"""Joining the per-student sides: full outer join, defaults, combined level, course."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_COURSE, NO_DATA, PREFIX_RENAMES
from ..functions.scalars import risk_combined, risk_order
from .metrics import KEY, attendance_profile, current_course, current_course_grades, grade_profile

# Defaults for a student missing one side.
SIDE_DEFAULTS = {
    "nivel_riesgo_asist": NO_DATA,
    "nivel_riesgo_rend": NO_DATA,
    "porcentaje_asistencia": 0.0,
    "nota_media": 0.0,
    "tendencia_asist": "ESTABLE",
    "tendencia_rend": "ESTABLE",
    "sesiones_totales": 0,
    "asistencias": 0,
    "faltas": 0,
    "faltas_justificadas": 0,
    "faltas_injustificadas": 0,
    "retrasos": 0,
    "n_evaluaciones": 0,
    "nota_std": 0.0,
    "nota_min": 0.0,
    "nota_max": 0.0,
    "aprobado": False,
}
_TEXT_DEFAULTS = {"nivel_riesgo_asist", "nivel_riesgo_rend", "tendencia_asist", "tendencia_rend"}


def combine_students(att_metrics: DataFrame, grade_metrics: DataFrame,
                     missing_as_null: bool = False) -> DataFrame:
    """Full outer join on IDEstudiante. The two overlapping columns get the
    ``_asist``/``_rend`` suffixes, missing sides get the defaults above (with
    ``missing_as_null`` only the text columns are filled and numbers stay null),
    the final level is the more severe side (SIN_DATOS counts as OPTIMO), and
    columns are renamed to their ``asist_``/``rend_`` names."""
    a = att_metrics.withColumnsRenamed({"nivel_riesgo": "nivel_riesgo_asist", "tendencia": "tendencia_asist"})
    r = grade_metrics.withColumnsRenamed({"nivel_riesgo": "nivel_riesgo_rend", "tendencia": "tendencia_rend"})
    joined = a.join(r, KEY, "full_outer")
    fill = {c: v for c, v in SIDE_DEFAULTS.items()
            if c in joined.columns and (not missing_as_null or c in _TEXT_DEFAULTS)}
    # one projection, written as SQL text: fills, combined level, final names
    exprs = []
    for c in joined.columns:
        e = f"coalesce(`{c}`, {_sql_literal(fill[c])})" if c in fill else f"`{c}`"
        exprs.append(f"{e} AS `{PREFIX_RENAMES.get(c, c)}`")
    final = risk_combined("nivel_riesgo_asist", "nivel_riesgo_rend").alias("nivel_riesgo_final")
    return joined.select(*map(F.expr, exprs), final)


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    return "'" + str(v).replace("'", "''") + "'"


def assign_course(students: DataFrame, att: DataFrame, gr: DataFrame | None = None) -> DataFrame:
    """CursoID of each student: the last attendance course, else the last grade
    course, else CURSO01. Both lookups are per-student aggregates joined on the key."""
    out = students.join(current_course(att), KEY, "left") if "CursoID" in att.columns else \
        students.withColumn("CursoID", F.lit(None).cast("string"))
    if gr is not None and "CursoID" in gr.columns:
        out = (out.join(current_course_grades(gr).withColumnRenamed("CursoID", "_curso_rend"), KEY, "left")
               .withColumn("CursoID", F.coalesce(F.col("CursoID"), F.col("_curso_rend")))
               .drop("_curso_rend"))
    return out.withColumn("CursoID", F.coalesce(F.col("CursoID"), F.lit(DEFAULT_COURSE)))


def student_table(att: DataFrame, gr: DataFrame, th: dict | None = None,
                  missing_as_null: bool = False) -> DataFrame:
    """One row per student from the cleaned tables: both sides (one sweep each),
    full outer join, defaults, final level, and the course (last attendance
    course, else last grade course, else CURSO01)."""
    ap = attendance_profile(att, th).withColumnRenamed("CursoID", "_curso_asist")
    gp = grade_profile(gr, th).withColumnRenamed("CursoID", "_curso_rend")
    out = combine_students(ap, gp, missing_as_null)
    return (out.withColumn("CursoID", F.coalesce(F.col("_curso_asist"), F.col("_curso_rend"), F.lit(DEFAULT_COURSE)))
            .drop("_curso_asist", "_curso_rend"))


def classify_students(att_metrics: DataFrame, grade_metrics: DataFrame, sort: bool = True) -> DataFrame:
    """Eight-column classification: levels of both sides (SIN_DATOS if missing),
    final level, %, mean mark (0.0 if missing) and both trends, most severe
    first (ties by id; a distributed range sort) unless ``sort`` is False."""
    a = att_metrics.select(KEY, F.col("nivel_riesgo").alias("nivel_riesgo_asistencia"),
                           "porcentaje_asistencia", F.col("tendencia").alias("asist_tendencia"))
    r = grade_metrics.select(KEY, F.col("nivel_riesgo").alias("nivel_riesgo_rendimiento"),
                             "nota_media", F.col("tendencia").alias("rend_tendencia"))
    j = a.join(r, KEY, "full_outer")
    out = j.select(
        KEY,
        F.coalesce("nivel_riesgo_asistencia", F.lit(NO_DATA)).alias("nivel_riesgo_asistencia"),
        F.coalesce("nivel_riesgo_rendimiento", F.lit(NO_DATA)).alias("nivel_riesgo_rendimiento"),
        risk_combined("nivel_riesgo_asistencia", "nivel_riesgo_rendimiento").alias("nivel_riesgo_final"),
        F.coalesce("porcentaje_asistencia", F.lit(0.0)).alias("porcentaje_asistencia"),
        F.coalesce("nota_media", F.lit(0.0)).alias("nota_media"),
        F.coalesce("asist_tendencia", F.lit("ESTABLE")).alias("asist_tendencia"),
        F.coalesce("rend_tendencia", F.lit("ESTABLE")).alias("rend_tendencia"))
    return out.orderBy(risk_order("nivel_riesgo_final"), KEY) if sort else out
