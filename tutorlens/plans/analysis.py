"""The full analysis as one lazy plan.

``analyze`` wires the operators together and returns lazy DataFrames; nothing
runs until the caller acts on one of them. Inside the student table each
cleaned table is consumed by exactly one range sweep (``metrics.*_profile``);
the course table, summary and distribution are aggregates over the student
table. To run several outputs over large data without recomputing the student
table, write it once (``sources.sinks.write_report_tables`` does).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import thresholds as make_thresholds
from ..operators.clean import clean_attendance, clean_grades
from ..operators.combine import student_table as _student_table
from ..operators.courses import course_metrics, risk_distribution, summary
from ..operators.metrics import attendance_metrics, grade_metrics


@dataclass
class AnalysisResult:
    thresholds: dict
    attendance: DataFrame          # cleaned attendance
    grades: DataFrame              # cleaned grades
    attendance_metrics: DataFrame
    grade_metrics: DataFrame
    students: DataFrame            # analisis_individual (without ML columns)
    courses: DataFrame             # analisis_cursos
    summary: DataFrame             # resumen, one row
    distribution: DataFrame        # four level rows


def student_table(att: DataFrame, gr: DataFrame, th: dict | None = None,
                  missing_as_null: bool = False) -> DataFrame:
    """Cleaned attendance + cleaned grades -> one row per student with both
    sides, final level and course."""
    return _student_table(att, gr, make_thresholds(th), missing_as_null)


def analyze(att_clean: DataFrame, gr_clean: DataFrame, th: dict | None = None,
            missing_as_null: bool = False, course: str | None = None) -> AnalysisResult:
    """Full analysis of cleaned inputs. ``course`` keeps only that CursoID on
    both sides first (a plain filter, pushed to the scan where possible)."""
    th = make_thresholds(th)
    if course is not None:
        att_clean = att_clean.where(F.col("CursoID") == F.lit(course))
        gr_clean = gr_clean.where(F.col("CursoID") == F.lit(course))
    am = attendance_metrics(att_clean, th)
    gm = grade_metrics(gr_clean, th)
    students = _student_table(att_clean, gr_clean, th, missing_as_null)
    return AnalysisResult(th, att_clean, gr_clean, am, gm, students, course_metrics(students),
                          summary(students), risk_distribution(students))


def analyze_raw(att_raw: DataFrame, gr_raw: DataFrame, th: dict | None = None, **kw) -> AnalysisResult:
    """Clean both raw tables, then ``analyze``."""
    return analyze(clean_attendance(att_raw), clean_grades(gr_raw), th, **kw)
