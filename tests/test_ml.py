"""Clustering against plain numpy (no scikit-learn here to compare with)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tutorlens.config import thresholds
from tutorlens.operators import kmeans, ml
from tutorlens.operators.courses import mean_2dp


@pytest.fixture(scope="module")
def students(spark):
    rows = []
    for i in range(60):
        grp = i % 3
        pct = [40.0, 80.0, 98.0][grp] + (i % 5)
        nota = [3.0, 6.0, 9.0][grp] + (i % 4) * 0.1
        rows.append((f"E{i:03d}", pct, nota, 10 - grp * 4, i % 3, 5 + grp))
    return spark.createDataFrame(rows, "IDEstudiante string, asist_porcentaje_asistencia double, rend_nota_media double, "
                                       "asist_faltas long, asist_retrasos long, rend_n_evaluaciones long")


def test_clusters_and_levels(spark, students):
    res = ml.run_clustering(students, thresholds(), n_init=3)
    assert res.success and res.n_clusters == 3 and res.features_used == ml.feature_columns(students)
    pred = res.predictions
    assert pred.count() == 60 and pred.select("Cluster").distinct().count() == 3
    # levels are ordered by mean score: ALTO has the lowest, then MEDIO, then ALERTA
    score = F.col("asist_porcentaje_asistencia") + F.col("rend_nota_media") * 10
    means = {r["NivelRiesgoML"]: r["m"] for r in pred.join(students, "IDEstudiante")
             .groupBy("NivelRiesgoML").agg(F.avg(score).alias("m")).collect()}
    assert means["ALTO"] < means["MEDIO"] < means["ALERTA"] and "OPTIMO" not in means
    assert 0.5 < res.silhouette < res.silhouette_sq <= 1.0


def points_of(students, cols, parts=3):
    vec = kmeans.grid(ml.standardize(students.repartition(parts), cols), cols, ["IDEstudiante"])
    return kmeans.distinct_points(vec, "IDEstudiante", len(cols))


def test_restarts_pick_lowest_cost_and_repeat(spark, students):
    cols = ml.feature_columns(students)
    points = points_of(students, cols)
    best = kmeans.fit_best(points, len(cols), [3], 42, n_init=4)[3]
    again = kmeans.fit_best(points_of(students, cols, 7), len(cols), [3], 42, n_init=4)[3]
    assert again == best       # the same whatever the partitions
    runs = {r: (3, r) for r in range(4)}
    centres = kmeans.move(points, len(cols), kmeans.seed(points, len(cols), runs, 42), 300, 1e-4)
    x = np.array([[r[f"x{i}"] for i in range(len(cols))] for r in points.collect() for _ in range(r["w"])]) / kmeans.SCALE
    cost = [((x[:, None] - np.array(c)[None] / kmeans.SCALE) ** 2).sum(axis=2).min(axis=1).sum() for c in centres.values()]
    assert best.cost == pytest.approx(min(cost), abs=1e-6)
    for c in centres.values():     # every centre is the mean of its rows
        near = ((x[:, None] - np.array(c)[None] / kmeans.SCALE) ** 2).sum(axis=2).argmin(axis=1)
        for k in set(near.tolist()):
            assert x[near == k].mean(axis=0) == pytest.approx(np.array(c[k]) / kmeans.SCALE, abs=2e-2)


def plain_silhouette(x, labels, power=1):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) ** (power / 2)
    out = []
    for i, own in enumerate(labels):
        alike = labels == own
        if alike.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][alike].sum() / (alike.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels.tolist()) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_silhouette_equals_brute_force(spark, monkeypatch):
    """500 students, repeated vectors, one alone in its cluster, over many blocks."""
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(7)
    x = np.rint(np.concatenate([rng.normal(size=(440, 3)) * 1e6, np.zeros((59, 3)), [[9e7, 9e7, 9e7]]]))
    vec = spark.createDataFrame([(f"s{i}", *map(int, r)) for i, r in enumerate(x)], "IDEstudiante string, x0 long, x1 long, x2 long")
    points = kmeans.distinct_points(vec, "IDEstudiante", 3)
    fits = [kmeans.Fit([[-1e6, 0.0, 0.0], [1e6, 0.0, 0.0], [9e7, 9e7, 9e7]], 0.0), kmeans.Fit([[0.0, -1e6, 0.0], [0.0, 1e6, 5e5]], 0.0)]
    for fit, (got, got_sq) in zip(fits, kmeans.silhouettes(points, 3, fits)):
        labels = ((x[:, None] - np.array(fit.centres)[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert got == pytest.approx(plain_silhouette(x / 1e6, labels), abs=1e-5)
        assert got_sq == pytest.approx(plain_silhouette(x / 1e6, labels, 2), abs=1e-5)


def test_fewer_vectors_than_clusters(spark):
    vec = spark.createDataFrame([("a", 0), ("b", 0), ("c", 10)], "IDEstudiante string, x0 long")
    points = kmeans.distinct_points(vec, "IDEstudiante", 1)
    fit = kmeans.fit_best(points, 1, [3], 1, n_init=2)[3]
    assert sorted(map(tuple, fit.centres)) == [(0.0,), (10.0,)] and fit.cost == 0


def test_standardize_population_std(spark, students):
    z = ml.standardize(students.select("IDEstudiante", "asist_porcentaje_asistencia"))
    r = z.agg(F.avg("asist_porcentaje_asistencia").alias("m"), F.stddev_pop("asist_porcentaje_asistencia").alias("s")).first()
    assert abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1.0)
    const = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "IDEstudiante string, x double")
    assert [r[0] for r in ml.standardize(const).select("x").collect()] == [0.0, 0.0]


def test_impute_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "IDEstudiante string, x double")
    assert sorted(r[0] for r in ml.impute_mean(df).select("x").collect()) == [1.0, 1.5, 2.0]


def test_labels_without_scores_fall_back(spark):
    feats = spark.createDataFrame([("a", 1.0)], "IDEstudiante string, asist_faltas double")
    cl = spark.createDataFrame([("a", 0)], "IDEstudiante string, Cluster int")
    assert ml.label_clusters(feats, cl).first()["NivelRiesgoML"] == "ALERTA"
    _ = mean_2dp


def test_silhouette_sends_a_vector_once_for_each_tile(spark, monkeypatch):
    """However small the steps are, a vector goes to at most TILES tiles, and the sums of distances stay the same."""
    rng = np.random.default_rng(2)
    x = rng.integers(-3_000_000, 3_000_000, (70, 3))
    rows = [(i, 1 + i % 3, *map(int, x[i]), [i % 2, i % 3]) for i in range(70)]
    points = spark.createDataFrame(rows, "vid long, w long, x0 long, x1 long, x2 long, labels array<int>").repartition(3)
    cls, sent = type(points), []
    real = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda self, *a, **k: sent.append(self) or real(self, *a, **k))

    def sums():
        return sorted(map(tuple, kmeans.distance_sums(points, 3, [2, 3]).collect()))

    whole = sums()
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 2)
    assert sums() == whole and len(whole) == 70 * 5
    assert sent[-1].count() <= 70 * 16 and max(r["n"] for r in sent[-1].groupBy("vid").count().withColumnRenamed("count", "n").collect()) <= 16
    w, far = np.array([r[1] for r in rows]), np.rint(np.sqrt(((x[:, None] - x[None]).astype(float) ** 2).sum(axis=2)))
    for vid, fit, cluster, total, _ in whole:
        own = np.arange(70) % (2 + fit) == cluster
        assert int(total) == int((far[vid] * w)[own].sum())
