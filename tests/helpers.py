"""Small builders for inline fixtures."""

from pyspark.sql import functions as F

ATT_SCHEMA = "IDEstudiante string, CursoID string, Fecha string, Presente string, Retraso string, FaltaJustificada string"
GR_SCHEMA = "IDEstudiante string, CursoID string, Evaluacion string, Nota string, Competencia string, Peso string, Fecha string"


def with_rid(df):
    """Input order as it was given (the test rows are created in one partition)."""
    return df.coalesce(1).withColumn("_rid", F.monotonically_increasing_id())


def att_df(spark, rows):
    return with_rid(spark.createDataFrame(rows, ATT_SCHEMA))


def gr_df(spark, rows, schema=GR_SCHEMA):
    return with_rid(spark.createDataFrame(rows, schema))


def by_id(df, key="IDEstudiante"):
    return {r[key]: r.asDict() for r in df.collect()}
