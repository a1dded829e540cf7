"""Loading steps after the scan: column mapping, generated columns, anonymisation,
type parsing, first-wins de-duplication, quality counters and load statistics.

Input order matters for "first row wins": every table carries ``_rid``, an
orderable column (number or struct) that gives the input order. It is taken
right after the scan, before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import (ATTENDANCE_REQUIRED, DEFAULT_COURSE, DEFAULT_EVALUATION, GRADE_COLUMN_ALTERNATIVES,
                      GRADES_REQUIRED, ID_PREFIX, SENSITIVE_COLUMNS)
from ..functions.scalars import (format_student_id, grade_in_range, normalize_competency, null_tokens,
                                 parse_bool, parse_date, parse_grade, parse_weight)
from .ordered import dense_index

RID = "_rid"
ATTENDANCE_KEYS = ["IDEstudiante", "CursoID", "Fecha"]
GRADE_KEYS = ["IDEstudiante", "CursoID", "Evaluacion", "Competencia"]


def _dtype(df: DataFrame, name: str):
    return df.schema[name].dataType


# ---------------------------------------------------------------------------
# schema-level steps
# ---------------------------------------------------------------------------

def apply_null_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Null tokens -> null in every string column (what the CSV reader does)."""
    cols = {f.name: null_tokens(f.name, tokens) for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns(cols) if cols else df


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def map_columns(df: DataFrame, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename the first listed alternative present to its standard name, when
    the standard name itself is absent (exact, case-sensitive names)."""
    mapping = GRADE_COLUMN_ALTERNATIVES if mapping is None else mapping
    cols = set(df.columns)
    renames: dict[str, str] = {}
    for standard, alternatives in mapping.items():
        if standard in cols:
            continue
        for alt in alternatives:
            if alt in cols and alt not in renames:
                renames[alt] = standard
                break
    return df.withColumnsRenamed(renames) if renames else df


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str], name: str) -> DataFrame:
    """Raise ``ValueError`` naming the missing and the available columns."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name}: no se encuentran {missing} entre las columnas {df.columns}")
    return df


def anonymize(df: DataFrame, sensitive: list[str] | None = None) -> DataFrame:
    """Drop personal-data columns (exact names)."""
    drop = set(SENSITIVE_COLUMNS if sensitive is None else sensitive)
    keep = [c for c in df.columns if c not in drop]
    return df if len(keep) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in keep])


def gen_course_id(df: DataFrame) -> DataFrame:
    return df if "CursoID" in df.columns else df.withColumn("CursoID", F.lit(DEFAULT_COURSE))


def gen_evaluation(df: DataFrame) -> DataFrame:
    return df if "Evaluacion" in df.columns else df.withColumn("Evaluacion", F.lit(DEFAULT_EVALUATION))


def gen_student_id(df: DataFrame, names_of: DataFrame | None = None) -> DataFrame:
    """Without IDEstudiante but with NombreEstudiante: ``EST`` + 4-digit rank of
    the name among the sorted distinct names (wider when there are more than
    9,999 names). A null name gets a null id.

    The distinct names are ranked with a distributed sort (``dense_index``), not
    a single-partition window, and joined back on the name; Spark picks the
    join strategy from the measured size of the name table. Only digests of the
    names are written to the shared folder. ``names_of``: the table whose names
    are ranked, when ``df`` holds only some of its rows.
    """
    if "IDEstudiante" in df.columns or "NombreEstudiante" not in df.columns:
        return df
    names = (df if names_of is None else names_of).select("NombreEstudiante").where(F.col("NombreEstudiante").isNotNull()).distinct()
    digest = F.sha2(F.col("NombreEstudiante"), 256)
    ids = (dense_index(names, "NombreEstudiante", "_rank", keep=digest)
           .select(F.col("NombreEstudiante").alias("_name_digest"), format_student_id("_rank", ID_PREFIX).alias("IDEstudiante")))
    return df.join(ids, digest == F.col("_name_digest"), "left").select(*df.columns, "IDEstudiante")


# ---------------------------------------------------------------------------
# de-duplication
# ---------------------------------------------------------------------------

def dedup_first(df: DataFrame, keys: list[str], order_col: str = RID, valid: Column | None = None) -> DataFrame:
    """Keep the first row (lowest ``order_col``) of each key; nulls in a key are
    equal to each other.

    Written as ``row_number() == 1``: Spark plans it with a partial
    ``WindowGroupLimit`` before the shuffle, so every map task keeps one row
    per key and a key with millions of copies never reaches one task whole.

    ``valid`` (true or false): the first of the rows for which it holds is kept. They sort first and the others go behind the
    window: a filter before it would be pushed through the parsing below and evaluate that anew at every mention."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df if valid is None else df.where(valid)
    if valid is None:
        w, first = Window.partitionBy(*keys).orderBy(F.col(order_col).asc()), F.col("_first_rn") == 1
    else:
        df = df.withColumn("_valid", valid)
        w = Window.partitionBy(*keys).orderBy(F.col("_valid").desc(), F.col(order_col).asc())
        first = (F.col("_first_rn") == 1) & F.col("_valid")
    return df.withColumn("_first_rn", F.row_number().over(w)).where(first).drop("_first_rn", "_valid")


# ---------------------------------------------------------------------------
# type parsing
# ---------------------------------------------------------------------------

def parse_attendance(df: DataFrame) -> DataFrame:
    """Flags to boolean (absent optional flags -> False), Fecha to date."""
    cols: dict[str, Column] = {"Presente": parse_bool("Presente", _dtype(df, "Presente"))}
    for flag in ("Retraso", "FaltaJustificada"):
        cols[flag] = parse_bool(flag, _dtype(df, flag)) if flag in df.columns else F.lit(False)
    if "Fecha" in df.columns:
        cols["Fecha"] = parse_date("Fecha", _dtype(df, "Fecha"))
    return df.withColumns(cols)


def parse_grades(df: DataFrame) -> DataFrame:
    """Nota to double (bad text -> null), Competencia normalised, Peso to double
    (bad/absent -> 1.0), Fecha to date."""
    return parse_grade_details(parse_grade_keys(df))


def parse_grade_keys(df: DataFrame) -> DataFrame:
    """What the range filter and the de-duplication of grades look at: Nota and Competencia."""
    cols: dict[str, Column] = {"Nota": parse_grade("Nota", _dtype(df, "Nota"))}
    if "Competencia" in df.columns:
        cols["Competencia"] = normalize_competency("Competencia")
    return df.withColumns(cols)


def parse_grade_details(df: DataFrame) -> DataFrame:
    """Peso and Fecha."""
    cols: dict[str, Column] = {"Peso": parse_weight("Peso", _dtype(df, "Peso")) if "Peso" in df.columns else F.lit(1.0)}
    if "Fecha" in df.columns:
        cols["Fecha"] = parse_date("Fecha", _dtype(df, "Fecha"))
    return df.withColumns(cols)


def filter_grade_range(df: DataFrame) -> DataFrame:
    return df.where(grade_in_range("Nota"))


def clean_attendance(df: DataFrame) -> DataFrame:
    """Parse, then keep the first row per (IDEstudiante, CursoID, Fecha).
    Date order is not materialised: consumers order by (Fecha, _rid)."""
    return dedup_first(parse_attendance(df), ATTENDANCE_KEYS)


def clean_grades(df: DataFrame, keys: list[str] = GRADE_KEYS) -> DataFrame:
    """Parse, keep 0 <= Nota <= 10, then the first row per existing subset of
    (IDEstudiante, CursoID, Evaluacion, Competencia). Weights and dates are parsed
    behind the exchange of the de-duplication, for the rows that stay."""
    return parse_grade_details(dedup_first(parse_grade_keys(df), keys, valid=grade_in_range("Nota")))


def of_course(df: DataFrame, course: str | None) -> DataFrame:
    """Rows of one course (None: all). The course is part of every de-duplication key and no step changes it, so it is
    filtered before parsing and de-duplication."""
    return df if course is None or "CursoID" not in df.columns else df.where(F.col("CursoID") == F.lit(course))


def prepare_attendance(df: DataFrame, course: str | None = None) -> DataFrame:
    """Required columns -> one course, if asked for -> anonymise -> clean (the attendance load path)."""
    return clean_attendance(anonymize(of_course(require_columns(df, ATTENDANCE_REQUIRED, "Asistencia"), course)))


def prepare_grades(df: DataFrame, course: str | None = None) -> DataFrame:
    """Map columns -> generate course/evaluation -> required columns -> one course, if asked for -> clean -> generate ids ->
    anonymise (the grades load path).

    Generated ids stand for names one to one (null for null), so rows are de-duplicated by name and only those that stay
    are joined with the ids; these rank the names of all rows and courses."""
    rows = gen_evaluation(gen_course_id(map_columns(df)))
    if "IDEstudiante" in rows.columns or "NombreEstudiante" not in rows.columns:
        return clean_grades(anonymize(of_course(require_columns(rows, GRADES_REQUIRED, "Calificaciones"), course)))
    require_columns(rows, [c for c in GRADES_REQUIRED if c != "IDEstudiante"], "Calificaciones")
    named = anonymize(of_course(rows, course), [c for c in SENSITIVE_COLUMNS if c != "NombreEstudiante"])
    first = clean_grades(named, ["NombreEstudiante" if k == "IDEstudiante" else k for k in GRADE_KEYS])
    return anonymize(gen_student_id(first, names_of=rows))


# ---------------------------------------------------------------------------
# quality counters, statistics, set operations
# ---------------------------------------------------------------------------

def attendance_quality(raw: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """One row: rows read, rows kept, duplicates removed. With the ``cleaned`` table (written before) both are plain counts,
    without a shuffle by key; without it the keys are grouped (one shuffle)."""
    if cleaned is not None:
        counts = raw.agg(F.count(F.lit(1)).alias("registros_leidos")).crossJoin(   # two tables of one row
            cleaned.agg(F.count(F.lit(1)).alias("registros_finales")))
    else:
        parsed = parse_attendance(raw)
        keys = [k for k in ATTENDANCE_KEYS if k in parsed.columns]
        per_key = parsed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        counts = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("registros_leidos"),
                             F.count(F.lit(1)).cast("long").alias("registros_finales"))
    return counts.withColumn("duplicados_eliminados", F.col("registros_leidos") - F.col("registros_finales"))


def grade_quality(raw: DataFrame, cleaned: DataFrame | None = None) -> DataFrame:
    """One row: rows read, unparseable/missing marks, marks outside 0..10,
    duplicates removed, rows kept. Missing and out-of-range are counted apart.
    With the ``cleaned`` table (written before) no keys are needed: ``raw`` may lack generated ids, and its marks alone are
    read and counted without a shuffle by key; without it the keys are grouped (one shuffle)."""
    ok = grade_in_range("Nota")
    counted = [F.count(F.lit(1)).alias("_n"), F.count_if(F.col("Nota").isNull()).alias("_null"),
               F.count_if(F.col("Nota").isNotNull() & ~ok).alias("_out"), F.count_if(ok).alias("_ok")]
    if cleaned is not None:
        marks = raw.select(parse_grade("Nota", _dtype(raw, "Nota")).alias("Nota"))
        totals = marks.agg(*counted).crossJoin(cleaned.agg(F.count(F.lit(1)).alias("_kept")))   # two tables of one row
    else:
        parsed = parse_grades(raw)
        keys = [k for k in GRADE_KEYS if k in parsed.columns]
        totals = parsed.groupBy(*keys).agg(*counted).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", "_null", "_out", "_ok")], F.count_if(F.col("_ok") > 0).alias("_kept"))
    return totals.select(F.col("_n").cast("long").alias("registros_leidos"), F.col("_null").cast("long").alias("sin_nota"),
                         F.col("_out").cast("long").alias("fuera_de_rango"),
                         (F.col("_ok") - F.col("_kept")).cast("long").alias("duplicados_eliminados"),
                         F.col("_kept").cast("long").alias("registros_finales"))


def attendance_stats(att: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("registros"),
            F.countDistinct("IDEstudiante").alias("estudiantes_unicos"),
            F.countDistinct("CursoID").alias("cursos_unicos")]
    if "Fecha" in att.columns:
        aggs += [F.min("Fecha").alias("fecha_min"), F.max("Fecha").alias("fecha_max")]
    return att.agg(*aggs)


def grade_stats(gr: DataFrame) -> DataFrame:
    return gr.agg(F.count(F.lit(1)).alias("registros"),
                  F.countDistinct("IDEstudiante").alias("estudiantes_unicos"),
                  F.countDistinct("CursoID").alias("cursos_unicos"),
                  F.countDistinct("Evaluacion").alias("evaluaciones_unicas"),
                  F.avg("Nota").alias("nota_media"),
                  F.min("Nota").alias("nota_min"),
                  F.max("Nota").alias("nota_max"))


def common_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col`` present in both tables (nulls excluded)."""
    return (a.select(col).where(F.col(col).isNotNull())
            .intersect(b.select(col).where(F.col(col).isNotNull())))


def all_values(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).union(b.select(col)).where(F.col(col).isNotNull()).distinct()


def cross_validate(att: DataFrame, gr: DataFrame) -> DataFrame:
    """Check table (comprobacion, valor, ok): students and courses in common.
    Never raises; a zero count is reported with ok = false."""
    checks = []
    for name, col in (("estudiantes_comunes", "IDEstudiante"), ("cursos_comunes", "CursoID")):
        if col in att.columns and col in gr.columns:
            checks.append(common_values(att, gr, col).agg(F.count(F.lit(1)).alias("valor"))
                          .select(F.lit(name).alias("comprobacion"), "valor", (F.col("valor") > 0).alias("ok")))
    if not checks:
        return att.sparkSession.createDataFrame([], "comprobacion string, valor long, ok boolean")
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
