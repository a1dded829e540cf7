"""Stand-in inputs built from the driver's test tables.

These only re-shape rows into the attendance and grade schemas the loaders
expect; they compute nothing the analysis computes. ``events`` becomes
attendance (one row per event: student, course, day, flags) and
``lineitem JOIN orders`` becomes grades (customer as student, line as
competency, discount as mark, quantity as weight).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, row_index: bool = False) -> DataFrame:
    """One test table; ``row_index`` adds ``_row_index``, the row's place in the
    table: (file, row of the file), taken at the scan, before any shuffle."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if row_index:
        df = df.withColumn("_row_index", F.struct(F.col("_metadata.file_path").alias("archivo"),
                                                  F.col("_metadata.row_index").alias("fila")))
    return df


def attendance_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDEstudiante, CursoID, Fecha (date), Presente, Retraso, FaltaJustificada, _rid."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") * 20).cast("string").alias("IDEstudiante"),
        F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string")).alias("CursoID"),
        F.col("ts").cast("date").alias("Fecha"),
        (F.col("event_type") != "error").alias("Presente"),
        (F.col("event_type") == "click").alias("Retraso"),
        (F.col("value") > 50).alias("FaltaJustificada"),
        F.col("event_id").alias("_rid"))


def grades_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDEstudiante, CursoID, Evaluacion, Nota, Competencia (raw text), Peso, Fecha, _rid.

    The input order ``_rid`` is the row's position in the ``lineitem`` file, as
    a line number would be in a CSV export."""
    li = table(spark, sf_dir, "lineitem", row_index=True)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nota = F.rint(F.col("l_discount") * F.lit(100.0))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("IDEstudiante"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("CursoID"),
        F.col("l_returnflag").alias("Evaluacion"),
        nota.alias("Nota"),
        F.concat(F.lit(" ce"), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("Competencia"),
        F.col("l_quantity").alias("Peso"),
        F.col("l_shipdate").cast("date").alias("Fecha"),
        F.col("_row_index").alias("_rid"))


# ---------------------------------------------------------------------------
# Text variants: the same rows written the way a CSV file would hold them, so
# the text parsers have real work. Which spelling a row gets is picked from its
# event/line number; every spelling is listed here in full.
# ---------------------------------------------------------------------------

TRUE_SPELLINGS = ["true", "1", "Sí", "si", "YES", "t", "verdadero", "X", " True ", "2"]
FALSE_SPELLINGS = ["false", "0", "no", "f", "", None, "nope", "0.0", "N"]
# (Spark pattern, kind) per row: date text in five shapes, a timestamp, junk.
DATE_SPELLINGS = ["yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", None]
ID_NULL_SPELLINGS = ["NA", "N/A", "null", "None", "NaN", "-"]


def _pick(options: list, idx):
    return F.element_at(F.array(*[F.lit(o).cast("string") for o in options]),
                        (idx % F.lit(len(options))).cast("int") + F.lit(1))


def flag_text(flag, idx):
    return F.when(flag, _pick(TRUE_SPELLINGS, idx)).otherwise(_pick(FALSE_SPELLINGS, idx))


def date_text(ts, idx):
    k = (idx % F.lit(len(DATE_SPELLINGS))).cast("int")
    expr = F.when(k == 0, F.date_format(ts, DATE_SPELLINGS[0]))
    for i, pat in enumerate(DATE_SPELLINGS[1:-1], start=1):
        expr = expr.when(k == i, F.date_format(ts, pat))
    return expr.otherwise(F.lit("sin fecha"))


def attendance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``attendance_raw`` with every column as text: flags in many spellings,
    dates in the five accepted shapes plus timestamps and junk, and every 13th
    student id replaced by a null token."""
    ev = table(spark, sf_dir, "events")
    idx = F.col("event_id")
    sid = (F.col("user_id") * 20).cast("string")
    return ev.select(
        F.when(idx % 13 == 0, _pick(ID_NULL_SPELLINGS, idx)).otherwise(sid).alias("IDEstudiante"),
        F.concat(F.lit("C"), (F.col("user_id") % 5).cast("string")).alias("CursoID"),
        date_text(F.col("ts"), idx).alias("Fecha"),
        flag_text(F.col("event_type") != "error", idx).alias("Presente"),
        flag_text(F.col("event_type") == "click", idx + 3).alias("Retraso"),
        flag_text(F.col("value") > 50, idx + 5).alias("FaltaJustificada"),
        F.col("props").alias("Observaciones"),
        idx.alias("_rid"))


def grade_text_value(nota, idx):
    """Mark text: plain, integer, decimal comma, NaN, -1, +0.5, null, padded, junk, x1.5."""
    k = (idx % F.lit(10)).cast("int")
    return (F.when(k == 0, nota.cast("string"))
            .when(k == 1, nota.cast("int").cast("string"))
            .when(k == 2, F.regexp_replace(nota.cast("string"), r"\.", ","))
            .when(k == 3, F.lit("NaN"))
            .when(k == 4, F.lit("-1"))
            .when(k == 5, (nota + F.lit(0.5)).cast("string"))
            .when(k == 6, F.lit(None).cast("string"))
            .when(k == 7, F.concat(F.lit(" "), nota.cast("string"), F.lit(" ")))
            .when(k == 8, F.lit("abc"))
            .otherwise((nota * F.lit(1.5)).cast("string")))


def weight_text_value(peso, idx):
    k = (idx % F.lit(4)).cast("int")
    return (F.when(k == 0, peso.cast("string")).when(k == 1, F.lit("n/a"))
            .when(k == 2, F.lit(None).cast("string")).otherwise(peso.cast("int").cast("string")))


def grades_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades as a teacher's export would hold them: alternative column names
    (``NombreEstudiante``, ``Curso``, ``instrumento``, ``nota``, ``Criterio``,
    ``ponderacion``, ``fecha``), a personal-data column, text marks/weights/dates."""
    li = table(spark, sf_dir, "lineitem", row_index=True)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nota = F.rint(F.col("l_discount") * F.lit(100.0))
    idx = F.col("l_orderkey") + F.col("l_linenumber")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("Alumno "), F.col("o_custkey").cast("string")).alias("NombreEstudiante"),
        F.concat(F.lit("alumno"), F.col("o_custkey").cast("string"), F.lit("@centro.example")).alias("Email"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")).alias("Curso"),
        F.col("l_returnflag").alias("instrumento"),
        grade_text_value(nota, idx).alias("nota"),
        F.concat(F.lit(" ce"), F.col("l_linenumber").cast("string"), F.lit(" ")).alias("Criterio"),
        weight_text_value(F.col("l_quantity"), idx).alias("ponderacion"),
        date_text(F.col("l_shipdate"), idx).alias("fecha"),
        F.col("_row_index").alias("_rid"))
