"""Per-student metrics: attendance counts, weighted marks, trends, current course.

Each side of the analysis is computed in one sweep over its cleaned table
(``attendance_profile`` / ``grade_profile``): rows are range-partitioned on
(student, date, input order) and numbered (``ordered.range_numbered``), every
(student, range) pair is reduced to partial sums, and the partials of a student
are merged. The cleaned table is shuffled once (by range), no task ever holds
a whole student, and the counts, the trend and the last course all come out of
the same pass; only the small partial rows are shuffled after it.

The narrower functions (``attendance_counts``, ``grade_aggregates``, ``trend``,
``current_course``...) are plain aggregates for when only one of them is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLDS
from ..functions.scalars import risk_attendance, risk_grade, round2
from .ordered import position_sums, range_numbered

KEY = "IDEstudiante"
RID = "_rid"


def _th(th):
    return DEFAULT_THRESHOLDS if th is None else th


def _has_date(df: DataFrame, col: str = "Fecha") -> bool:
    return col in df.columns and df.schema[col].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")


def input_order(df: DataFrame, date_col: str | None = "Fecha") -> list[Column]:
    """Date ascending with missing dates last, then input order. Without a
    date column the series is in input order (its trend is ESTABLE anyway)."""
    order = []
    if date_col and _has_date(df, date_col):
        order.append(F.col(date_col).asc_nulls_last())
    order.append(F.col(RID).asc())
    return order


def trend_label(n: str, y_sum: str, y_min: str, y_max: str, xy_sum: str, th: dict | None = None) -> Column:
    """Least-squares slope of y on x = 0..n-1 turned into a change over the whole
    series relative to the mean: ``slope * n / mean * 100``.
    n < 3, a constant series, or a zero mean -> ESTABLE.

    With x = 0..n-1 and D = 2 sum(x*y) - (n-1) sum(y), the change is
    600 * n * D / ((n^2 - 1) * sum(y)). The sums come in exact (whole numbers or
    decimals), so D is exact too, and the change is compared with the cut-off
    without a division: equal series get equal labels wherever their rows lie.
    Arguments are column names; the expression is SQL text (one JVM call).
    """
    t = _th(th)
    n, y_sum, y_min, y_max, xy_sum = (_q(x) for x in (n, y_sum, y_min, y_max, xy_sum))
    nd = f"CAST({n} AS DOUBLE)"
    left = f"600.0D * {nd} * CAST(2 * {xy_sum} - ({n} - 1) * {y_sum} AS DOUBLE) * signum({y_sum})"
    right = f"(({nd} * {nd} - 1.0D) * abs(CAST({y_sum} AS DOUBLE)))"
    return F.expr(
        f"CASE WHEN {n} < 3 OR {y_min} = {y_max} OR {y_sum} = 0 THEN 'ESTABLE' "
        f"WHEN {left} >= CAST({float(t['tendencia_positiva'])!r} AS DOUBLE) * {right} THEN 'MEJORANDO' "
        f"WHEN {left} <= CAST({float(t['tendencia_negativa'])!r} AS DOUBLE) * {right} THEN 'EMPEORANDO' "
        "ELSE 'ESTABLE' END")


# ---------------------------------------------------------------------------
# one-sweep profiles
# ---------------------------------------------------------------------------

def _sweep(df: DataFrame, order: list[Column]) -> DataFrame:
    return range_numbered(df.where(F.col(KEY).isNotNull()), [F.col(KEY).asc()] + order)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _r2(x: str) -> str:
    """``round2`` as SQL text."""
    return f"(rint(({x}) * 100.0D) / 100.0D)"


# Window over the (student, range) partial rows: rows of the student in earlier ranges.
_EARLIER = (f"coalesce(sum(_n) OVER (PARTITION BY {_q(KEY)} ORDER BY _range "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
# sum of x*y of a (student, range) with x counted from the student's first row
_SHIFTED_XY = "_sry + CAST(_off - _row0 AS DECIMAL(20,0)) * _sy"
# marks and weights as exact decimals: their sums do not depend on the order or the ranges of the rows
MARK, WEIGHT = "DECIMAL(12,8)", "DECIMAL(18,8)"


# quotient of two exact sums (null if the divisor is 0), and the sample deviation from n, sum and sum of squares
_MEAN = "try_divide(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE))"
_STD = ("sqrt(greatest(0.0D, CAST({q} AS DOUBLE) - CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / CAST({n} AS DOUBLE)) "
        "/ CAST({n} - 1 AS DOUBLE))")


# the same quotient to 12 decimals, for figures that are rounded to 2: a mean that lies on a tie stays on it
_MEAN_12 = "CAST(try_divide(CAST({0} AS DECIMAL(34,16)), CAST({1} AS DECIMAL(22,8))) AS DOUBLE)"


def weighted_mean(mark: str = "Nota", weight: str = "Peso") -> Column:
    """sum(mark * weight) / sum(weight) over exact decimals; null when the weights add to 0."""
    return F.expr(_MEAN.format(*_weighted_sums(mark, weight)))


def weighted_mean_2dp(mark: str = "Nota", weight: str = "Peso") -> Column:
    """``weighted_mean`` rounded half-even to 2 decimals."""
    return round2(F.expr(_MEAN_12.format(*_weighted_sums(mark, weight))))


def _weighted_sums(mark: str, weight: str) -> tuple[str, str]:
    y, w = f"CAST({_q(mark)} AS {MARK})", f"CAST({_q(weight)} AS {WEIGHT})"
    return f"sum({y} * {w})", f"sum({w})"


def plain_mean(value: str = "Nota") -> Column:
    """Mean over exact decimals."""
    y = f"CAST({_q(value)} AS {MARK})"
    return F.expr(_MEAN.format(f"sum({y})", f"count({y})"))


def _exprs(*sql: str) -> list[Column]:
    return [F.expr(x) for x in sql]


def attendance_profile(att: DataFrame, th: dict | None = None) -> DataFrame:
    """Per student: attendance metrics, trend, and the course of the last row in
    (date, input) order (``CursoID``). Expressions are SQL text (one JVM call each)."""
    t = _th(th)
    has_date = _has_date(att)
    late = _q("Retraso") if "Retraso" in att.columns else "false"
    excused = _q("FaltaJustificada") if "FaltaJustificada" in att.columns else "false"
    y = "CAST(CAST(`Presente` AS INT) AS DECIMAL(1,0))"
    course = F.col("CursoID") if "CursoID" in att.columns else F.lit(None).cast("string")
    num = _sweep(att.withColumn("_course", course), input_order(att))
    parts = num.groupBy(KEY, "_range").agg(*_exprs(
        "count(1) AS _n", "count_if(`Presente`) AS _asis", f"count_if({late}) AS _late",
        f"count_if(NOT `Presente` AND {excused}) AS _just",
        f"sum({y}) AS _sy", f"sum({y} * CAST(_row AS DECIMAL(18,0))) AS _sry", "min(_row) AS _row0",
        f"min({y}) AS _ymin", f"max({y}) AS _ymax", "max_by(_course, _row) AS _last_course"))
    g = parts.withColumn("_off", F.expr(_EARLIER)).groupBy(KEY).agg(*_exprs(
        "sum(_n) AS sesiones_totales", "sum(_asis) AS asistencias", "sum(_late) AS retrasos",
        "sum(_just) AS faltas_justificadas", "sum(_sy) AS _sy", f"sum({_SHIFTED_XY}) AS _sxy",
        "min(_ymin) AS _ymin", "max(_ymax) AS _ymax", "max_by(_last_course, _range) AS CursoID"))
    pct = _r2("CAST(asistencias AS DOUBLE) / CAST(sesiones_totales AS DOUBLE) * 100.0D")
    trend = trend_label("sesiones_totales", "_sy", "_ymin", "_ymax", "_sxy", t) if has_date else F.lit("ESTABLE")
    out = g.select(
        F.col(KEY), "sesiones_totales", "asistencias", "retrasos",
        F.expr("sesiones_totales - asistencias AS faltas"), F.expr(f"{pct} AS porcentaje_asistencia"),
        "faltas_justificadas",
        F.expr("sesiones_totales - asistencias - faltas_justificadas AS faltas_injustificadas"),
        trend.alias("tendencia"), "CursoID")
    return out.select(KEY, "sesiones_totales", "asistencias", "retrasos", "faltas", "porcentaje_asistencia",
                      "faltas_justificadas", "faltas_injustificadas",
                      risk_attendance("porcentaje_asistencia", t).alias("nivel_riesgo"),
                      "tendencia", "CursoID")


def grade_profile(gr: DataFrame, th: dict | None = None, weighted: bool = True) -> DataFrame:
    """Per student: grade metrics, trend (rows in date order), and the course of
    the last row in input order (``CursoID``).

    Sums of marks, squares, weighted marks and position times mark are exact
    decimals (marks and weights to 8 places), so equal sets of marks give equal
    figures however the rows are cut into ranges."""
    t = _th(th)
    has_date = _has_date(gr)
    peso = F.col("Peso") if (weighted and "Peso" in gr.columns) else F.lit(1.0)
    course = F.col("CursoID") if "CursoID" in gr.columns else F.lit(None).cast("string")
    num = _sweep(gr.withColumn("_course", course).withColumn("_w", peso.cast("double")), input_order(gr))
    y, w = f"CAST(Nota AS {MARK})", f"CAST(_w AS {WEIGHT})"
    parts = num.groupBy(KEY, "_range").agg(*_exprs(
        "count(1) AS _n", "count(Nota) AS _cnt", f"sum({y} * {w}) AS _swy", f"sum({w}) AS _sw",
        f"sum({y}) AS _sy", f"sum({y} * {y}) AS _syy", f"sum({y} * CAST(_row AS DECIMAL(18,0))) AS _sry",
        "min(_row) AS _row0", "min(Nota) AS _ymin", "max(Nota) AS _ymax",
        f"max({_q(RID)}) AS _rid_max", f"max_by(_course, {_q(RID)}) AS _last_course"))
    g = parts.select("*", F.expr(f"{_EARLIER} AS _off")).groupBy(KEY).agg(*_exprs(
        "sum(_cnt) AS n_evaluaciones", "sum(_n) AS _n", f"{_MEAN_12.format('sum(_swy)', 'sum(_sw)')} AS _wmean",
        "sum(_syy) AS _syy", "min(_ymin) AS _min", "max(_ymax) AS _max",
        "sum(_sy) AS _sy", f"sum({_SHIFTED_XY}) AS _sxy", "max_by(_last_course, _rid_max) AS CursoID"))
    trend = trend_label("_n", "_sy", "_min", "_max", "_sxy", t) if has_date else F.lit("ESTABLE")
    std = f"CASE WHEN n_evaluaciones > 1 THEN {_STD.format(n='n_evaluaciones', s='_sy', q='_syy')} END"
    out = g.select(F.col(KEY), "n_evaluaciones", F.expr(f"{_r2('_wmean')} AS nota_media"),
                   F.expr(f"coalesce({_r2(std)}, 0.0D) AS nota_std"), F.expr(f"{_r2('_min')} AS nota_min"),
                   F.expr(f"{_r2('_max')} AS nota_max"), trend.alias("tendencia"), "CursoID")
    return out.select(
        KEY, "n_evaluaciones", "nota_media", "nota_std", "nota_min", "nota_max",
        risk_grade("nota_media", t).alias("nivel_riesgo"),
        F.expr(f"coalesce(nota_media >= CAST({float(t['nota_aprobado'])!r} AS DOUBLE), false) AS aprobado"),
        "tendencia", "CursoID")


def attendance_metrics(att: DataFrame, th: dict | None = None) -> DataFrame:
    """Attendance metrics + trend per student (one sweep)."""
    return attendance_profile(att, th).drop("CursoID")


def grade_metrics(gr: DataFrame, th: dict | None = None) -> DataFrame:
    """Grade metrics + trend per student (one sweep)."""
    return grade_profile(gr, th).drop("CursoID")


# ---------------------------------------------------------------------------
# single-purpose aggregates
# ---------------------------------------------------------------------------

def trend(df: DataFrame, value: Column, th: dict | None = None, date_col: str = "Fecha",
          out_col: str = "tendencia") -> DataFrame:
    """Per student: trend of ``value`` over rows ordered by (date, input order).
    Without a date column every student is ESTABLE."""
    keyed = df.where(F.col(KEY).isNotNull())
    if not _has_date(df, date_col):
        return keyed.select(KEY).distinct().withColumn(out_col, F.lit("ESTABLE"))
    sums = position_sums(keyed, KEY, input_order(df, date_col), {"y": value.cast(MARK)})
    return sums.select(KEY, trend_label("n", "y_sum", "y_min", "y_max", "y_xsum", th).alias(out_col))


def attendance_trend(att: DataFrame, th: dict | None = None) -> DataFrame:
    return trend(att, F.col("Presente").cast("int"), th)


def grade_trend(gr: DataFrame, th: dict | None = None) -> DataFrame:
    return trend(gr, F.col("Nota"), th)


def attendance_counts(att: DataFrame, th: dict | None = None) -> DataFrame:
    """sesiones, asistencias, retrasos, faltas, % (2dp, half-even), justified and
    unjustified absences, risk level. One aggregate over the cleaned table."""
    present = F.col("Presente")
    late = F.col("Retraso") if "Retraso" in att.columns else F.lit(False)
    excused = F.col("FaltaJustificada") if "FaltaJustificada" in att.columns else F.lit(False)
    g = (att.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count(present).alias("sesiones_totales"),
        F.count_if(present).alias("asistencias"),
        F.count_if(late).alias("retrasos"),
        F.count_if(~present & excused).alias("faltas_justificadas")))
    pct = round2(F.col("asistencias").cast("double") / F.col("sesiones_totales").cast("double") * F.lit(100.0))
    return g.select(
        KEY, "sesiones_totales", "asistencias", "retrasos",
        (F.col("sesiones_totales") - F.col("asistencias")).alias("faltas"),
        pct.alias("porcentaje_asistencia"),
        "faltas_justificadas",
        (F.col("sesiones_totales") - F.col("asistencias") - F.col("faltas_justificadas")).alias("faltas_injustificadas"),
    ).withColumn("nivel_riesgo", risk_attendance("porcentaje_asistencia", th))


def grade_aggregates(gr: DataFrame, th: dict | None = None, weighted: bool = True) -> DataFrame:
    """n, weighted mean sum(Nota*Peso)/sum(Peso) (null when the weights add to 0),
    sample std (0 for one mark), min, max, all rounded to 2dp; level; pass flag
    on the rounded mean."""
    t = _th(th)
    nota = F.col("Nota")
    if weighted and "Peso" in gr.columns:
        mean = weighted_mean_2dp()
    else:
        mean = weighted_mean_2dp(weight="_one")
        gr = gr.withColumn("_one", F.lit(1))
    y = f"CAST(Nota AS {MARK})"
    std = f"CASE WHEN count(Nota) > 1 THEN {_STD.format(n='count(Nota)', s=f'sum({y})', q=f'sum({y} * {y})')} END"
    g = gr.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count(nota).alias("n_evaluaciones"), mean.alias("_mean"), F.expr(std).alias("_std"),
        F.min(nota).alias("_min"), F.max(nota).alias("_max"))
    out = g.select(
        KEY, "n_evaluaciones",
        F.col("_mean").alias("nota_media"),
        F.coalesce(round2("_std"), F.lit(0.0)).alias("nota_std"),
        round2("_min").alias("nota_min"),
        round2("_max").alias("nota_max"))
    return (out.withColumn("nivel_riesgo", risk_grade("nota_media", t))
            .withColumn("aprobado", F.coalesce(F.col("nota_media") >= F.lit(float(t["nota_aprobado"])),
                                               F.lit(False))))


def current_course(att: DataFrame) -> DataFrame:
    """Course of each student's last attendance row in (date, input) order, missing dates last."""
    last = F.struct(F.col("Fecha").isNull(), F.col("Fecha"), F.col(RID)) if "Fecha" in att.columns else F.col(RID)
    return (att.where(F.col(KEY).isNotNull()).groupBy(KEY)
            .agg(F.max_by(F.col("CursoID"), last).alias("CursoID")))


def current_course_grades(gr: DataFrame) -> DataFrame:
    """Course of each student's last grade row in input order."""
    return (gr.where(F.col(KEY).isNotNull()).groupBy(KEY)
            .agg(F.max_by(F.col("CursoID"), F.col(RID)).alias("CursoID")))
