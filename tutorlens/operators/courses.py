"""Aggregates over the student table: per course, global summary, level distribution.

Means of 2dp values are taken over exact integer hundredths (sum of longs),
so the result does not depend on the order in which partitions are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DISTRIBUTION_LABELS, RISK_LEVELS
from ..functions.scalars import pct_label, round2


def cents(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.rint(col * F.lit(100.0)).cast("long")


def mean_2dp(c: str) -> Column:
    """Mean of a column holding 2dp values, from exact hundredths."""
    return F.sum(cents(c)).cast("double") / F.count(F.col(c)).cast("double") / F.lit(100.0)


def course_metrics(students: DataFrame) -> DataFrame:
    """Per CursoID: students, mean/min/max attendance %, mean mark, pass rate %,
    students with final level ALTO and with mark level ALTO; 2dp half-even.
    Students missing a side enter with the 0.0 defaults."""
    g = students.groupBy("CursoID").agg(
        F.count("IDEstudiante").alias("estudiantes"),
        mean_2dp("asist_porcentaje_asistencia").alias("_pm"),
        F.min("asist_porcentaje_asistencia").alias("_pmin"),
        F.max("asist_porcentaje_asistencia").alias("_pmax"),
        mean_2dp("rend_nota_media").alias("_nm"),
        (F.count_if(F.col("rend_aprobado")).cast("double") / F.count(F.lit(1)).cast("double")
         * F.lit(100.0)).alias("_rate"),
        F.count_if(F.col("nivel_riesgo_final") == "ALTO").alias("estudiantes_riesgo_alto"),
        F.count_if(F.col("nivel_riesgo_rendimiento") == "ALTO").alias("rend_estudiantes_riesgo_alto"))
    return g.select(
        F.col("CursoID").alias("curso_id"), "estudiantes",
        round2("_pm").alias("porcentaje_medio"), round2("_pmin").alias("porcentaje_min"),
        round2("_pmax").alias("porcentaje_max"), round2("_nm").alias("rend_nota_media"),
        round2("_rate").alias("rend_tasa_aprobados"),
        "estudiantes_riesgo_alto", "rend_estudiantes_riesgo_alto")


def _level_counts(level: Column) -> list[Column]:
    return [F.count_if(level == "ALTO").alias("estudiantes_riesgo_alto"),
            F.count_if(level == "MEDIO").alias("estudiantes_riesgo_medio"),
            F.count_if(level == "ALERTA").alias("estudiantes_alerta"),
            F.count_if(level == "OPTIMO").alias("estudiantes_optimo")]


def summary(students: DataFrame) -> DataFrame:
    """One row: totals, counts per final level, % ALTO and % MEDIO (null when empty)."""
    lv = F.col("nivel_riesgo_final")
    g = students.agg(F.count(F.lit(1)).alias("total_estudiantes"),
                     F.countDistinct("CursoID").alias("total_cursos"), *_level_counts(lv))
    total = F.col("total_estudiantes").cast("double")
    return g.select(
        "*",
        F.when(F.col("total_estudiantes") > 0, F.col("estudiantes_riesgo_alto") / total * F.lit(100.0))
        .alias("porcentaje_riesgo_alto"),
        F.when(F.col("total_estudiantes") > 0, F.col("estudiantes_riesgo_medio") / total * F.lit(100.0))
        .alias("porcentaje_riesgo_medio"))


def risk_distribution(students: DataFrame, level_col: str = "nivel_riesgo_final") -> DataFrame:
    """Always four rows (ALTO, MEDIO, ALERTA, OPTIMO): count and '{:.1f}%' of the
    total ('0%' when there are no students). One global aggregate, then the
    one-row result is unpivoted; no join."""
    lv = F.col(level_col)
    g = students.agg(F.count(F.lit(1)).alias("_total"),
                     *[F.count_if(lv == name).alias(f"_n{i}") for i, (name, *_) in enumerate(RISK_LEVELS)])
    labels = dict(DISTRIBUTION_LABELS)
    rows = F.array(*[F.struct(F.lit(i).alias("orden"), F.lit(name).alias("nivel"),
                              F.lit(labels[name]).alias("etiqueta"), F.col(f"_n{i}").alias("estudiantes"),
                              F.lit(emoji).alias("estado"), F.lit(color).alias("color"))
                     for i, (name, _code, color, emoji, _d) in enumerate(RISK_LEVELS)])
    return (g.select(F.col("_total"), F.inline(rows))
            .withColumn("porcentaje", pct_label("estudiantes", "_total"))
            .drop("_total"))


def attendance_summary(att_metrics: DataFrame) -> DataFrame:
    """Attendance-only summary: students, mean % (0.0 if none), counts per level.
    ``estudiantes_sin_riesgo`` counts the label NINGUNO, which no level rule
    produces, so it is 0 as in the original report; OPTIMO is counted apart."""
    lv = F.col("nivel_riesgo")
    return att_metrics.agg(
        F.count(F.lit(1)).alias("total_estudiantes"),
        F.coalesce(mean_2dp("porcentaje_asistencia"), F.lit(0.0)).alias("porcentaje_asistencia_promedio"),
        *_level_counts(lv)[:3], F.count_if(lv == "NINGUNO").alias("estudiantes_sin_riesgo"),
        _level_counts(lv)[3])


def grade_summary(grade_metrics: DataFrame) -> DataFrame:
    lv = F.col("nivel_riesgo")
    n = F.count(F.lit(1))
    return grade_metrics.agg(
        n.alias("total_estudiantes"),
        F.coalesce(mean_2dp("nota_media"), F.lit(0.0)).alias("nota_media_general"),
        F.when(n > 0, F.count_if(F.col("aprobado")).cast("double") / n.cast("double") * F.lit(100.0))
        .otherwise(F.lit(0.0)).alias("tasa_aprobados"),
        *_level_counts(lv)[:3], F.count_if(lv == "NINGUNO").alias("estudiantes_sin_riesgo"),
        _level_counts(lv)[3])


def level_metadata(df: DataFrame, level_col: str) -> DataFrame:
    """Adds codigo, color, emoji, descripcion of a level column; unknown levels
    get colour FFFFFF and an empty emoji. Map lookups on fixed literals: no join."""
    lv = F.col(level_col)
    code = F.create_map(*[x for name, c, *_ in RISK_LEVELS for x in (F.lit(name), F.lit(c))])
    color = F.create_map(*[x for name, _c, col, *_ in RISK_LEVELS for x in (F.lit(name), F.lit(col))])
    emoji = F.create_map(*[x for name, _c, _col, e, _d in RISK_LEVELS for x in (F.lit(name), F.lit(e))])
    desc = F.create_map(*[x for name, *_r, d in RISK_LEVELS for x in (F.lit(name), F.lit(d))])
    return df.withColumns({
        "codigo": F.try_element_at(code, lv),
        "color": F.coalesce(F.try_element_at(color, lv), F.lit("FFFFFF")),
        "emoji": F.coalesce(F.try_element_at(emoji, lv), F.lit("")),
        "descripcion": F.try_element_at(desc, lv),
    })

