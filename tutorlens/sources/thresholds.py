"""Threshold sets: JSON text or file merged over the defaults, and validation.

The set of one job is a parameter of its plan (its values become literals). Many sets are data:
``threshold_sets`` reads a folder of JSON files from any storage that Spark reads, ``threshold_violations`` checks all of them.
"""

from __future__ import annotations

import json

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLDS, thresholds

# (low, comparison, high) of each rule, in the order in which they are checked; a text is a threshold's name
RULES: list[tuple[str | float, str, str | float]] = [
    ("asistencia_riesgo", "<", "asistencia_alerta"),
    ("asistencia_alerta", "<", "asistencia_optima"),
    ("nota_riesgo", "<", "nota_alerta"),
    (0, "<=", "asistencia_riesgo"), ("asistencia_riesgo", "<=", 100),
    (0, "<=", "nota_aprobado"), ("nota_aprobado", "<=", 10),
    (2, "<=", "ml_n_clusters"),
]


def rule_text(rule) -> str:
    return "umbral no válido: se exige {} {} {}".format(*rule)


def load_thresholds(json_string: str | None = None, json_file: str | None = None, spark: SparkSession | None = None) -> dict:
    """Defaults updated with a JSON object given as text or, if there is none, as a file on any storage that Spark reads
    (without ``spark``: through the active session, else one made with the library's settings).
    Anything that is not a readable JSON object -> ValueError."""
    source = "el texto" if json_string else json_file
    if not source:
        return thresholds(None)
    try:
        custom = json.loads(json_string or file_text(json_file, spark))
    except (OSError, ValueError, PySparkException) as e:
        raise ValueError(f"no se pueden leer umbrales de {source}: {e}") from e
    if not isinstance(custom, dict):
        raise ValueError(f"no se pueden leer umbrales de {source}: no es un objeto JSON")
    return thresholds(custom)


def file_text(path: str, spark: SparkSession | None) -> str:
    from ..session import get_spark
    spark = spark or SparkSession.getActiveSession() or get_spark()
    row = spark.read.option("wholetext", True).text(path).first()
    return row[0] if row else ""


def threshold_sets(spark: SparkSession, path: str | list[str], one_object_a_file: bool = True) -> DataFrame:
    """Sets read as data: nombre (as the set names itself, else its file), every threshold as a column (what the set leaves out or does not
    give as a number has its default), and corrupto: the text of what is not a JSON object. Files hold one object each, or one a line."""
    keys = list(DEFAULT_THRESHOLDS)
    schema = "nombre string, _corrupt string, " + ", ".join(f"{k} double" for k in keys)
    raw = spark.read.schema(schema).option("multiLine", one_object_a_file).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.select(F.coalesce("nombre", "_metadata.file_name").alias("nombre"), *[
        F.coalesce(k, F.lit(float(DEFAULT_THRESHOLDS[k]))).alias(k) for k in keys], F.col("_corrupt").alias("corrupto"))


def validate_thresholds(th: dict) -> bool:
    """True, or ValueError naming the first rule that fails."""
    for rule in RULES:
        low, comparison, high = (th.get(x, x) for x in rule)
        if not (low < high or comparison == "<=" and low == high):
            raise ValueError(rule_text(rule))
    return True


def threshold_frame(spark: SparkSession, sets: list[dict]) -> DataFrame:
    """One row per threshold set (``conjunto`` = position) with every key as a column."""
    keys = list(DEFAULT_THRESHOLDS)
    rows = [(i, *[float(thresholds(s)[k]) for k in keys]) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "conjunto int, " + ", ".join(f"{k} double" for k in keys))


def threshold_violations(frame: DataFrame) -> DataFrame:
    """Adds ``violaciones``: the messages of every failed rule, in rule order."""
    msgs = F.array(*[F.when(~F.expr("{} {} {}".format(*rule)), F.lit(rule_text(rule))) for rule in RULES])
    return frame.withColumn("violaciones", F.filter(msgs, lambda m: m.isNotNull()))
