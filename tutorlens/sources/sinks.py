"""Report tables written with ``DataFrameWriter``.

The student table is written first and read back; every other table is then
derived from the written copy, so the cleaning and per-student work runs once
and later tables do not depend on the upstream lineage (a lost executor only
costs the small derived tables).

A report set that readers share is written whole into a folder of its own; one manifest, written last, makes it the
current set. Cleaned tables can be kept by course, so that one course's analysis reads only its own folders."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import courses, reports


def _write(df: DataFrame, path: str, fmt: str, overwrite: bool, partition_by: list[str] | None = None) -> None:
    if partition_by:   # one writer for each small course, several for a large one
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_table(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    """A written table; with ``schema`` no type is inferred from file or folder names."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def kept_students(students: DataFrame, path: str) -> DataFrame:
    """The student table written to ``path`` and read back: report sets of several courses or of all students can be made from
    it, and cleaning and per-student work run once for all of them."""
    students.write.parquet(path)
    return read_table(students.sparkSession, path, "parquet", students.schema)


def write_report_tables(spark: SparkSession, students: DataFrame, out_dir: str, fmt: str = "parquet",
                        predictions: DataFrame | None = None, extra: dict[str, DataFrame] | None = None,
                        overwrite: bool = False) -> dict[str, str]:
    """Write estudiantes (partitioned by course), cursos, resumen, distribucion,
    en_riesgo, recomendaciones, listado and, when given, ml and the ``extra``
    tables, all in format ``fmt``. Returns name -> path. Tables that are already
    in ``out_dir`` are an error unless ``overwrite``."""
    base = out_dir.rstrip("/")
    paths = {"estudiantes": f"{base}/estudiantes"}
    _write(students, paths["estudiantes"], fmt, overwrite, ["CursoID"])
    st = read_table(spark, paths["estudiantes"], fmt, students.schema)
    summary = courses.summary(st)
    tables = {
        "cursos": reports.report_courses(courses.course_metrics(st)),
        "resumen": summary,
        "distribucion": reports.report_summary(st),
        "en_riesgo": reports.report_at_risk(st),
        "recomendaciones": reports.report_recommendations(summary),
        "listado": reports.report_students(st),
    }
    if predictions is not None:
        from ..operators.ml import cluster_distribution
        tables["ml"] = cluster_distribution(predictions)
    for name, df in {**tables, **(extra or {})}.items():
        paths[name] = f"{base}/{name}"
        _write(df, paths[name], fmt, overwrite)
    return paths


def written_row_counts(spark: SparkSession, paths: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """(tabla, filas) of written tables, read back from storage."""
    out = None
    for name, p in paths.items():
        c = read_table(spark, p, fmt).agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        out = c if out is None else out.unionByName(c)
    return out


# ---------------------------------------------------------------------------
# report sets behind a manifest
# ---------------------------------------------------------------------------

MANIFESTS = "_conjuntos"
KEPT_SETS = 2    # the current set, and the one before it for readers that have begun


def _storage(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _manifests(spark: SparkSession, base: str) -> list[str]:
    """Versions that have a manifest, oldest first."""
    fs, folder = _storage(spark, f"{base}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))


def _publish(spark: SparkSession, base: str, version: str, manifest: dict) -> None:
    """The manifest appears under its name by one rename, complete or not at all."""
    fs, hidden = _storage(spark, f"{base}/{MANIFESTS}/.{version}.tmp")
    _, final = _storage(spark, f"{base}/{MANIFESTS}/{version}.json")
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False, sort_keys=True).encode("utf-8")))
    out.close()
    if not fs.rename(hidden, final):
        raise OSError(f"no se puede publicar {final}")


def write_report_set(spark: SparkSession, students: DataFrame, out_dir: str, fmt: str = "parquet",
                     predictions: DataFrame | None = None, extra: dict[str, DataFrame] | None = None) -> dict[str, str]:
    """``write_report_tables`` into a new folder below ``out_dir``, which becomes the current set once all its tables are
    written. A failed write changes nothing for readers and its folder is removed; sets older than the one before
    the current are removed. Returns name -> path of the new set."""
    base = out_dir.rstrip("/")
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    try:
        paths = write_report_tables(spark, students, f"{base}/{version}", fmt, predictions, extra)
        _publish(spark, base, version, {"formato": fmt, "tablas": sorted(paths)})
    except BaseException:
        fs, folder = _storage(spark, f"{base}/{version}")
        fs.delete(folder, True)
        raise
    for old in _manifests(spark, base)[:-KEPT_SETS]:
        for path in (f"{base}/{MANIFESTS}/{old}.json", f"{base}/{old}"):   # first the manifest: no reader starts on it any more
            fs, place = _storage(spark, path)
            fs.delete(place, True)
    return paths


def current_report_set(spark: SparkSession, out_dir: str) -> tuple[dict[str, str], str]:
    """(name -> path, format) of the newest complete set below ``out_dir``; none -> ``FileNotFoundError``."""
    base = out_dir.rstrip("/")
    versions = _manifests(spark, base)
    if not versions:
        raise FileNotFoundError(f"no hay ningún conjunto de informes en {out_dir}")
    text = spark.read.option("wholetext", True).text(f"{base}/{MANIFESTS}/{versions[-1]}.json").first()[0]
    manifest = json.loads(text)
    return {name: f"{base}/{versions[-1]}/{name}" for name in manifest["tablas"]}, manifest["formato"]


# ---------------------------------------------------------------------------
# cleaned tables by course
# ---------------------------------------------------------------------------

COURSE_FOLDER = "_curso"


def write_by_course(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A cleaned table as Parquet, one folder for each course. CursoID also stays a column, so ids keep their text ('' and
    null share a folder). Writers are balanced: small courses take one, a large one several."""
    _write(df.withColumn(COURSE_FOLDER, F.col("CursoID")), path, "parquet", overwrite, [COURSE_FOLDER])


def read_course(spark: SparkSession, path: str, schema, course: str | None = None) -> DataFrame:
    """The table that ``write_by_course`` wrote, with its ``schema``; of one course only that course's folder is listed and read."""
    df = spark.read.schema(StructType([*schema.fields, StructField(COURSE_FOLDER, StringType())])).parquet(path)
    if course is not None:
        folder = F.col(COURSE_FOLDER)
        df = df.where((folder == F.lit(course) if course else folder.isNull()) & (F.col("CursoID") == F.lit(course)))
    return df.drop(COURSE_FOLDER)
