"""Risk clusters: features, mean imputation, z-scores, K-Means with restarts (``kmeans.py``; lowest cost wins),
cluster -> level by score, exact Euclidean silhouette.

Fitting is an action by nature, and so are the few steps around it: the row
count (gate and k), the one-row aggregates whose results become literals
(means, deviations), and the written table of distinct feature vectors that the restarts
iterate over. Labels and distributions stay lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)

from ..config import ML_FALLBACK_LEVEL, ML_FEATURES, ML_LEVELS
from . import kmeans

KEY = "IDEstudiante"


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in ML_FEATURES if c in df.columns]


def features(students: DataFrame) -> DataFrame:
    """IDEstudiante + the existing feature columns as doubles."""
    return students.select(KEY, *[F.col(c).cast("double").alias(c) for c in feature_columns(students)])


UNITS = "decimal(38,8)"


def impute_mean(feats: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing feature values -> the column mean (a scalar subquery: one aggregate
    for all columns, run with the query). A column with no values at all is left
    as it is. Sums are exact decimals of 8 places."""
    cols = cols or [c for c in feats.columns if c != KEY]
    if not cols:
        return feats
    means = feats.agg(F.struct(*[F.try_divide(F.sum(F.col(c).cast(UNITS)).cast("double"), F.count(c).cast("double")).alias(c)
                                 for c in cols]).alias("m")).scalar()
    return feats.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})


def standardize(feats: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """z = (x - mean) / population std over the values there are; a constant or
    empty column gives 0, a missing value stays missing.

    Mean and mean square come from one aggregate (a scalar subquery) over exact
    decimals of 8 places, so they do not depend on how partitions are combined."""
    cols = cols or [c for c in feats.columns if c != KEY]
    if not cols:
        return feats
    aggs = []
    for c in cols:
        x = F.col(c).cast(UNITS)
        n, total = F.count(c).cast("double"), F.sum(x).cast("double")
        square = F.sum((F.col(c) * F.col(c)).cast(UNITS)).cast("double")
        aggs.append(F.struct(F.try_divide(total, n).alias("mean"),
                             F.sqrt(F.greatest(F.lit(0.0), F.try_divide(square - total * total / F.nullif(n, F.lit(0.0)), n)))
                             .alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi")).alias(c))
    st = feats.agg(F.struct(*aggs).alias("st")).scalar()
    return feats.withColumns({c: F.when(F.coalesce(st[c]["lo"] == st[c]["hi"], F.lit(True)), F.lit(0.0))
                              .otherwise((F.col(c) - st[c]["mean"]) / st[c]["std"]) for c in cols})


def _score(feats: DataFrame):
    cols = feature_columns(feats)
    has_p, has_n = "asist_porcentaje_asistencia" in cols, "rend_nota_media" in cols
    if has_p and has_n:
        return F.col("asist_porcentaje_asistencia") + F.col("rend_nota_media") * F.lit(10.0)
    if has_p:
        return F.col("asist_porcentaje_asistencia")
    if has_n:
        return F.col("rend_nota_media")
    return None


def cluster_scores(feats: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean risk score (pct + 10 * mark, or the one available) per cluster,
    with its rank (0 = lowest score = highest risk). Scores are 2dp values,
    averaged over exact hundredths. k rows."""
    score = _score(feats)
    if score is None:
        return clusters.select("Cluster").distinct().withColumn("score_medio", F.lit(None).cast("double")) \
            .withColumn("rango", F.lit(None).cast("int"))
    j = feats.select(KEY, F.rint(score * F.lit(100.0)).cast("long").alias("_sc")).join(clusters, KEY)
    g = j.groupBy("Cluster").agg((F.sum("_sc").cast("double") / F.count(F.lit(1)).cast("double")
                                  / F.lit(100.0)).alias("score_medio"))
    w = Window.orderBy(F.col("score_medio").asc(), F.col("Cluster").asc())   # k rows only
    return g.withColumn("rango", (F.row_number().over(w) - 1).cast("int"))


def label_clusters(feats: DataFrame, clusters: DataFrame) -> DataFrame:
    """(IDEstudiante, Cluster, NivelRiesgoML): clusters by ascending mean score
    get ALTO, MEDIO, ALERTA, OPTIMO, any further cluster OPTIMO; without score
    columns every student gets ALERTA. The k-row level table is broadcast."""
    if _score(feats) is None:
        return clusters.withColumn("NivelRiesgoML", F.lit(ML_FALLBACK_LEVEL))
    ranks = cluster_scores(feats, clusters)
    levels = F.array(*[F.lit(x) for x in ML_LEVELS])
    lv = ranks.select("Cluster", F.coalesce(F.try_element_at(levels, F.col("rango") + 1),
                                            F.lit(ML_LEVELS[-1])).alias("NivelRiesgoML"))
    return clusters.select(KEY, "Cluster").join(F.broadcast(lv), "Cluster").select(KEY, "Cluster", "NivelRiesgoML")


def cluster_distribution(predictions: DataFrame) -> DataFrame:
    """Count per (Cluster, NivelRiesgoML) and '{:.1f}%' of all predictions."""
    from ..functions.scalars import pct_label
    g = predictions.groupBy("Cluster", "NivelRiesgoML").agg(F.count(F.lit(1)).alias("estudiantes"))
    total = F.sum("estudiantes").over(Window.partitionBy(F.lit(1)))          # at most k rows
    return (g.withColumn("_total", total).withColumn("porcentaje", pct_label("estudiantes", "_total"))
            .drop("_total").orderBy("Cluster"))


@dataclass
class ClusteringResult:
    success: bool
    message: str
    predictions: DataFrame | None = None
    n_clusters: int = 0
    silhouette: float | None = None
    silhouette_sq: float | None = None
    cost: float | None = None
    features_used: list[str] = field(default_factory=list)
    n_students: int = 0

    SCHEMA = StructType([
        StructField("exito", BooleanType()), StructField("mensaje", StringType()),
        StructField("n_clusters", IntegerType()), StructField("silhouette", DoubleType()), StructField("silhouette_sq", DoubleType()),
        StructField("coste", DoubleType()), StructField("features_usados", ArrayType(StringType())),
        StructField("n_estudiantes", LongType())])

    def summary_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.success, self.message, self.n_clusters, self.silhouette, self.silhouette_sq, self.cost,
                                       self.features_used, self.n_students)], self.SCHEMA)


def run_clustering(students: DataFrame, th: dict, n_init: int = 10, evaluate: bool = True) -> ClusteringResult:
    """Gate on ml_min_samples, k = min(ml_n_clusters, n - 1), impute, scale,
    best of ``n_init`` fits, label clusters by score, silhouettes (not without ``evaluate``)."""
    feats = features(students)
    cols = feature_columns(students)
    if len(cols) < 2:
        return ClusteringResult(False, "Insuficientes features")
    feats = feats.persist()
    try:
        n = feats.count()
        if n < th["ml_min_samples"]:
            return ClusteringResult(False, f"Insuficientes estudiantes para ML ({n} < {th['ml_min_samples']})",
                                    n_students=n)
        k = min(int(th["ml_n_clusters"]), n - 1)
        if k < 2:
            return ClusteringResult(False, "Muy pocos estudiantes", n_students=n)
        imputed = impute_mean(feats, cols)
        # unscaled values ride along (for the cluster scores), so everything
        # after the fit reads only the written vectors
        raw = imputed.select(KEY, *cols, *[F.col(c).alias(f"_raw_{c}") for c in cols])
        vec = kmeans.grid(standardize(raw, cols), cols, [KEY, *[f"_raw_{c}" for c in cols]])
        points = kmeans.distinct_points(vec, KEY, len(cols)).persist()
        try:
            fit = kmeans.fit_best(points, len(cols), [k], int(th["ml_random_state"]), n_init)[k]
            sil, sil_sq = kmeans.silhouettes(points, len(cols), [fit])[0] if evaluate else (None, None)
        finally:
            points.unpersist()
        unscaled = vec.select(KEY, *[F.col(f"_raw_{c}").alias(c) for c in cols])
        labels = label_clusters(unscaled, vec.select(KEY, kmeans.nearest(fit.centres, len(cols)).alias("Cluster")))
        return ClusteringResult(True, "OK", labels, k, sil, sil_sq, fit.cost, cols, n)
    finally:
        feats.unpersist()


K_SEARCH_MAX = 8     # the search range k = 2..8 is a parameter of ``best_k``


def best_k(students: DataFrame, th: dict, k_max: int = K_SEARCH_MAX, n_init: int = 10) -> DataFrame:
    """Silhouette for k = 2..min(k_max, n-1), each with the restarts of the clustering itself; the highest Euclidean one is
    chosen (ties: the smaller k). All fits of all k run in the same passes over one written table of vectors."""
    spark = students.sparkSession
    cols = feature_columns(students)
    vec = kmeans.grid(standardize(impute_mean(features(students), cols), cols), cols, [KEY])
    points = kmeans.distinct_points(vec, KEY, len(cols)).persist()
    try:
        n = points.agg(F.sum("w")).first()[0] or 0
        ks = list(range(2, min(k_max, n - 1) + 1))
        fits = kmeans.fit_best(points, len(cols), ks, int(th["ml_random_state"]), n_init) if ks else {}
        scores = kmeans.silhouettes(points, len(cols), [fits[k] for k in ks]) if ks else []
    finally:
        points.unpersist()
    best = max(zip(ks, scores), key=lambda x: (x[1][0], -x[0]), default=(None,))[0]
    return spark.createDataFrame([(k, *s, fits[k].cost, k == best) for k, s in zip(ks, scores)],
                                 "k int, silhouette double, silhouette_sq double, coste double, elegido boolean")


def attach_predictions(students: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cluster and ML level joined back onto the student table (left join on the
    student key; both sides have one row per student)."""
    return students.join(predictions.select(KEY, "Cluster", "NivelRiesgoML"), KEY, "left")
