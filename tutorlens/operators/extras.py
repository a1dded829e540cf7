"""Metrics the documentation and configuration describe but the original
pipeline never computes. Their exact rules are ours; each docstring states it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPETENCIES, DEFAULT_THRESHOLDS, LEVELS_BY_SEVERITY, NO_DATA
from ..sources.thresholds import threshold_frame
from .metrics import weighted_mean_2dp


def _th(th):
    return DEFAULT_THRESHOLDS if th is None else th


def feature_ratios(students: DataFrame) -> DataFrame:
    """Absences and lateness per session (null without sessions)."""
    ses = F.col("asist_sesiones_totales").cast("double")
    return students.select("IDEstudiante",
                           F.try_divide(F.col("asist_faltas").cast("double"), ses).alias("ratio_faltas"),
                           F.try_divide(F.col("asist_retrasos").cast("double"), ses).alias("ratio_retrasos"))


def perf_attendance_ratio(students: DataFrame) -> DataFrame:
    """Mean mark over attendance on a 0-10 scale: nota / (pct / 10); null at 0 %."""
    return students.select("IDEstudiante", F.try_divide(
        F.col("rend_nota_media"), F.col("asist_porcentaje_asistencia") / F.lit(10.0)).alias("ratio_rend_asist"))


def manual_risk_score(students: DataFrame, th: dict | None = None) -> DataFrame:
    """Number of breached limits (0-5): % below asistencia_riesgo, mark below
    nota_riesgo (each only when that side has data), justified absences, unjustified
    absences and lateness above their max_* limits."""
    t = _th(th)
    has_att = F.col("nivel_riesgo_asistencia") != NO_DATA
    has_gr = F.col("nivel_riesgo_rendimiento") != NO_DATA
    conds = [has_att & (F.col("asist_porcentaje_asistencia") < F.lit(float(t["asistencia_riesgo"]))),
             has_gr & (F.col("rend_nota_media") < F.lit(float(t["nota_riesgo"]))),
             F.col("asist_faltas_justificadas") > F.lit(t["max_faltas_justificadas"]),
             F.col("asist_faltas_injustificadas") > F.lit(t["max_faltas_injustificadas"]),
             F.col("asist_retrasos") > F.lit(t["max_retrasos"])]
    score = sum((F.when(c, 1).otherwise(0) for c in conds), F.lit(0))
    return students.select("IDEstudiante", score.alias("puntuacion_riesgo"))


def absence_limits(students: DataFrame, th: dict | None = None) -> DataFrame:
    t = _th(th)
    return students.select(
        "IDEstudiante",
        (F.col("asist_faltas_justificadas") > F.lit(t["max_faltas_justificadas"])).alias("exceso_justificadas"),
        (F.col("asist_faltas_injustificadas") > F.lit(t["max_faltas_injustificadas"])).alias("exceso_injustificadas"),
        (F.col("asist_retrasos") > F.lit(t["max_retrasos"])).alias("exceso_retrasos"))


def sample_sufficiency(students: DataFrame, th: dict | None = None) -> DataFrame:
    t = _th(th)
    return students.select(
        "IDEstudiante",
        (F.col("rend_n_evaluaciones") >= F.lit(t["min_evaluaciones"])).alias("evaluaciones_suficientes"),
        (F.col("asist_sesiones_totales") >= F.lit(t["min_sesiones"])).alias("sesiones_suficientes"))


def competency_names(grades: DataFrame) -> DataFrame:
    """Adds the competency's name (null for codes outside CE1..CE5)."""
    names = F.create_map(*[x for code, name, _d in COMPETENCIES for x in (F.lit(code), F.lit(name))])
    return grades.withColumn("competencia_nombre", F.try_element_at(names, F.col("Competencia")))


def competency_metrics(grades: DataFrame) -> DataFrame:
    """Per student, the weighted mean mark of each competency CE1..CE5 (2dp),
    one column per competency (a pivot on the fixed code list: one aggregate)."""
    codes = [code for code, *_ in COMPETENCIES]
    g = (grades.where(F.col("IDEstudiante").isNotNull())
         .groupBy("IDEstudiante").pivot("Competencia", codes)
         .agg(weighted_mean_2dp()))
    return g.select("IDEstudiante", *codes)


# Grid of the what-if count table: places of a hundredth, from the best value down
PCT_TOP, NOTA_TOP = 100 * 100, 10 * 100
PCT_LEVELS, NOTA_LEVELS = (PCT_TOP + 4).bit_length(), (NOTA_TOP + 4).bit_length()
NODE = 1 << max(PCT_LEVELS, NOTA_LEVELS)


def _hundredth(value: Column, top: int) -> Column:
    return F.least(F.greatest(F.rint(value * F.lit(100.0)), F.lit(-1.0)), F.lit(top + 1.0))


def _place(value: Column, top: int) -> Column:
    """Place of a value, 0 for none (which passes every limit), then from the highest value to the lowest."""
    return F.when(value.isNull(), 0).otherwise(F.lit(top + 2) - _hundredth(value, top).cast("int"))


def _passing(limit: Column, top: int) -> Column:
    """How many places, counted from 0, are not below a limit (null: all). A limit may lie between two hundredths."""
    near = _hundredth(limit, top)
    return F.when(limit.isNull(), top + 4).otherwise(
        F.lit(top + 3) - near.cast("int") - (near / F.lit(100.0) < limit).cast("int"))


def _nodes_over(place: str, levels: int) -> Column:
    """Dyadic blocks that hold a place and that some prefix uses (those of even number at each level)."""
    return F.expr(f"transform(filter(sequence(0, {levels - 1}), l -> shiftright({place}, l) % 2 = 0), "
                  f"l -> l * {NODE} + shiftright({place}, l))")


def _nodes_of_prefix(length: str, levels: int) -> Column:
    """The disjoint dyadic blocks, one for each bit of ``length``, that make up the places before it."""
    return F.expr(f"transform(filter(sequence(0, {levels - 1}), l -> shiftright({length}, l) % 2 = 1), "
                  f"l -> l * {NODE} + shiftright({length}, l) - 1)")


def what_if_counts(students: DataFrame) -> DataFrame:
    """(na, ng, n): students by dyadic block of attendance place and of mark place. Its size is bounded by the grid of
    hundredths (0..100 % by 0..10), whatever the number of students; any number of threshold sets is answered from it."""
    pct = F.when(F.col("nivel_riesgo_asistencia") != NO_DATA, F.col("asist_porcentaje_asistencia"))
    nota = F.when(F.col("nivel_riesgo_rendimiento") != NO_DATA, F.col("rend_nota_media"))
    cells = (students.select(_place(pct, PCT_TOP).alias("pa"), _place(nota, NOTA_TOP).alias("pg"))
             .groupBy("pa", "pg").agg(F.count(F.lit(1)).alias("n")))
    return (cells.select(F.explode(_nodes_over("pa", PCT_LEVELS)).alias("na"), "pg", "n")
            .select("na", F.explode(_nodes_over("pg", NOTA_LEVELS)).alias("ng"), "n")
            .groupBy("na", "ng").agg(F.sum("n").alias("n")))


def prefix_counts(students: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pa, pg, n): students in the first pa places of attendance and the first pg of marks, for distinct ``pairs``; prefixes
    without a student have no row."""
    marks = pairs.select("pg").distinct().select("pg", F.explode(_nodes_of_prefix("pg", NOTA_LEVELS)).alias("ng"))
    lines = what_if_counts(students).join(F.broadcast(marks), "ng").groupBy("na", "pg").agg(F.sum("n").alias("n"))
    return (pairs.select("pa", "pg", F.explode(_nodes_of_prefix("pa", PCT_LEVELS)).alias("na"))
            .join(lines, ["na", "pg"]).groupBy("pa", "pg").agg(F.sum("n").alias("n")))


def threshold_what_if(students: DataFrame, sets: list[dict] | DataFrame) -> DataFrame:
    """Level distribution under any number of threshold sets: rows (conjunto, nivel, estudiantes), also of 0 students.

    ``sets``: dicts (conjunto = position), or a table with a unique ``conjunto`` and the thresholds as columns. Students are
    read once, into the count table of ``what_if_counts``. A level no worse than s means that both values pass all limits of
    the levels worse than s: a count over a prefix of both axes. Each distinct prefix is counted once, however many sets ask for
    it: first the blocks of marks (at most 10 for each of the scale's 1,004 prefixes, a broadcast table) are added up for
    each attendance block, then at most 14 of these sums for each prefix, found by an equi-join. The number of distinct
    prefixes and of sums is bounded by the grid; what is left for a set is a join of four rows. The trend's thresholds do not enter. Values have two decimals (as the student table has them); what lies outside
    0..100 % or 0..10 stands at the edge of the grid."""
    if not isinstance(sets, DataFrame):
        sets = threshold_frame(students.sparkSession, sets)
    limits = [("asistencia_riesgo", "nota_riesgo"), ("asistencia_alerta", "nota_alerta"), ("asistencia_optima", "nota_excelente")]
    corners = []
    for severity in range(len(LEVELS_BY_SEVERITY)):
        worse = limits[:len(limits) - severity]
        pa = F.least(F.lit(PCT_TOP + 4), *[_passing(F.col(a), PCT_TOP) for a, _ in worse]) if worse else F.lit(PCT_TOP + 4)
        pg = F.least(F.lit(NOTA_TOP + 4), *[_passing(F.col(g), NOTA_TOP) for _, g in worse]) if worse else F.lit(NOTA_TOP + 4)
        corners.append(F.struct(F.lit(severity).alias("s"), pa.alias("pa"), pg.alias("pg")))
    asked = sets.select("conjunto", F.inline(F.array(*corners)))
    found = prefix_counts(students, asked.select("pa", "pg").distinct())
    upto = asked.join(found, ["pa", "pg"], "left").groupBy("conjunto").agg(*[
        F.coalesce(F.sum(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).alias(f"_{s}") for s in range(len(LEVELS_BY_SEVERITY))])
    return upto.select("conjunto", F.inline(F.array(*[
        F.struct(F.lit(level).alias("nivel"), (F.col(f"_{s}") - (F.col(f"_{s - 1}") if s else F.lit(0))).cast("long").alias("estudiantes"))
        for s, level in enumerate(LEVELS_BY_SEVERITY)])))
