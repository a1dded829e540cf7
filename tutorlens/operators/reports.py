"""Report tables: the data of each report section, without document formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (DISPLAY_COLUMNS, DISPLAY_LABELS, DISTRIBUTION_LABELS, GENERAL_RECOMMENDATIONS,
                      RECOMMENDATION_HEADINGS, RECOMMENDATION_LEAD, RECOMMENDATIONS, RISK_LEVELS)
from ..functions.scalars import format_fixed, pct_label, risk_order


def students_at_level(students: DataFrame, level: str) -> DataFrame:
    return students.where(F.col("nivel_riesgo_final") == F.lit(level))


def report_summary(students: DataFrame) -> DataFrame:
    """Four rows, one per level: label, count, '{:.1f}%', emoji, colour, plus the
    totals (students, courses). One global aggregate, unpivoted."""
    lv = F.col("nivel_riesgo_final")
    g = students.agg(F.count(F.lit(1)).alias("total_estudiantes"),
                     F.countDistinct("CursoID").alias("total_cursos"),
                     *[F.count_if(lv == name).alias(f"_n{i}") for i, (name, *_) in enumerate(RISK_LEVELS)])
    labels = dict(DISTRIBUTION_LABELS)
    rows = F.array(*[F.struct(F.lit(i).alias("orden"), F.lit(labels[name]).alias("nivel"),
                              F.col(f"_n{i}").alias("estudiantes"), F.lit(emoji).alias("estado"),
                              F.lit(color).alias("color"))
                     for i, (name, _c, color, emoji, _d) in enumerate(RISK_LEVELS)])
    return (g.select("total_estudiantes", "total_cursos", F.inline(rows))
            .withColumn("porcentaje", pct_label("estudiantes", "total_estudiantes")))


def report_courses(course_table: DataFrame) -> DataFrame:
    return course_table.orderBy("curso_id")


def report_students(students: DataFrame) -> DataFrame:
    """Display columns that exist (ML level and cluster third and fourth when
    present), most severe level first, then by id; columns get display labels."""
    cols = list(DISPLAY_COLUMNS)
    if "NivelRiesgoML" in students.columns:
        cols.insert(2, "NivelRiesgoML")
        cols.insert(3, "Cluster")
    cols = [c for c in cols if c in students.columns]
    return (students.orderBy(risk_order("nivel_riesgo_final"), F.col("IDEstudiante"))
            .select(*[F.col(c).alias(DISPLAY_LABELS.get(c, c)) for c in cols]))


def at_risk_label(students: DataFrame) -> DataFrame:
    return students.withColumn("detalle", F.format_string(
        "Asistencia: %s%%, Nota: %s, Tendencia: %s/%s",
        format_fixed("asist_porcentaje_asistencia", 1), format_fixed("rend_nota_media", 2),
        F.coalesce(F.col("asist_tendencia"), F.lit("N/A")), F.coalesce(F.col("rend_tendencia"), F.lit("N/A"))))


def report_at_risk(students: DataFrame) -> DataFrame:
    """Students at ALTO then MEDIO: id, detail line, and the count of their
    section. The section counts are a two-row aggregate joined back."""
    risky = students.where(F.col("nivel_riesgo_final").isin("ALTO", "MEDIO"))
    counts = risky.groupBy("nivel_riesgo_final").agg(F.count(F.lit(1)).alias("total_nivel"))
    return (at_risk_label(risky).join(F.broadcast(counts), "nivel_riesgo_final")
            .select("nivel_riesgo_final", "total_nivel", "IDEstudiante", "detalle")
            .orderBy(risk_order("nivel_riesgo_final"), "IDEstudiante"))


def report_recommendations(summary_row: DataFrame) -> DataFrame:
    """ALTO row if any student is ALTO, MEDIO row if any is MEDIO, then the
    seven general recommendations (orden, seccion, texto)."""
    alto, medio = F.col("estudiantes_riesgo_alto"), F.col("estudiantes_riesgo_medio")

    def specific(i, level, n, key):
        lead = RECOMMENDATION_LEAD[level].split("{n}")
        text = F.concat(F.lit(lead[0]), n.cast("string"), F.lit(lead[1]), F.lit(RECOMMENDATIONS[key]))
        return F.struct(F.lit(i).alias("orden"), F.lit(RECOMMENDATION_HEADINGS[level]).alias("seccion"),
                        text.alias("texto"), (n > 0).alias("_keep"))

    rows = [specific(0, "ALTO", alto, "ALTO_asistencia"), specific(1, "MEDIO", medio, "MEDIO_asistencia")]
    rows += [F.struct(F.lit(2 + i).alias("orden"), F.lit("Recomendaciones Generales").alias("seccion"),
                      F.lit(t).alias("texto"), F.lit(True).alias("_keep"))
             for i, t in enumerate(GENERAL_RECOMMENDATIONS)]
    return summary_row.select(F.inline(F.array(*rows))).where("_keep").drop("_keep")


def student_list(students: DataFrame) -> DataFrame:
    """id, course, level and 'Asistencia: {:.1f}% | Nota: {:.2f}'."""
    return students.select(
        "IDEstudiante", "CursoID", "nivel_riesgo_final",
        F.format_string("Asistencia: %s%% | Nota: %s", format_fixed("asist_porcentaje_asistencia", 1),
                        format_fixed("rend_nota_media", 2)).alias("detalle"))
