"""Running load statistics: mergeable HyperLogLog sketches of distinct counts.

The load statistics of the reports are exact (``clean.attendance_stats``). Where batches keep arriving, exact distinct counts
need every earlier row again; a sketch for each batch (or course, day ...) is small and merges, whatever the order and however
often rows repeat. The relative standard error is 1.04 / 2^(LG_K / 2), 0.8 %; few values (some thousand) are counted nearly exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)
COUNTED = {"IDEstudiante": "estudiantes_unicos", "CursoID": "cursos_unicos", "Evaluacion": "evaluaciones_unicas"}


def partial_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows taken in, first and last date and a sketch for each column of ``COUNTED`` that there is; one row for each group of ``by``,
    without it one row. Nulls are not counted."""
    aggs = [F.count(F.lit(1)).alias("registros")]
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(name) for c, name in COUNTED.items() if c in df.columns]
    if "Fecha" in df.columns:
        aggs += [F.min("Fecha").alias("fecha_min"), F.max("Fecha").alias("fecha_max")]
    return df.groupBy(*(by or [])).agg(*aggs)


def merged_stats(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parts of ``partial_stats`` brought together: the same columns, sketches replaced by the estimated counts."""
    aggs = [F.coalesce(F.sum("registros"), F.lit(0)).alias("registros")]
    aggs += [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0)).alias(name)
             for name in COUNTED.values() if name in parts.columns]
    if "fecha_min" in parts.columns:
        aggs += [F.min("fecha_min").alias("fecha_min"), F.max("fecha_max").alias("fecha_max")]
    return parts.groupBy(*(by or [])).agg(*aggs)
