"""Many threshold sets from one count table, against a direct count."""

import random

from tutorlens.config import DEFAULT_THRESHOLDS
from tutorlens.operators import extras
from tutorlens.operators.extras import threshold_what_if, what_if_counts

SCHEMA = "nivel_riesgo_asistencia string, asist_porcentaje_asistencia double, nivel_riesgo_rendimiento string, rend_nota_media double"
KEYS = ("asistencia_riesgo", "asistencia_alerta", "asistencia_optima", "nota_riesgo", "nota_alerta", "nota_excelente")
ORDER = ["OPTIMO", "ALERTA", "MEDIO", "ALTO"]


def severity(value, limits):
    if value is None:
        return 0
    return next((3 - i for i, limit in enumerate(limits) if value < limit), 0)


def direct(rows, sets):
    counts = {(i, lv): 0 for i in range(len(sets)) for lv in ORDER}
    for i, th in enumerate(sets):
        for la, pct, lg, nota in rows:
            a = severity(None if la == "SIN_DATOS" else pct, [th[k] for k in KEYS[:3]])
            g = severity(None if lg == "SIN_DATOS" else nota, [th[k] for k in KEYS[3:]])
            counts[i, ORDER[max(a, g)]] += 1
    return counts


def got(df):
    return {(r["conjunto"], r["nivel"]): r["estudiantes"] for r in df.collect()}


def random_rows(rng, n):
    return [(rng.choice(["ALTO", "OPTIMO", "SIN_DATOS"]), round(float(rng.choice([0, 100, 75, rng.uniform(0, 100)])), 2),
             rng.choice(["ALTO", "OPTIMO", "SIN_DATOS"]), rng.choice([None, 0.0, 10.0, 4.0, round(rng.uniform(0, 10), 2)]))
            for _ in range(n)]


def test_a_thousand_sets_equal_the_direct_count(spark):
    rng = random.Random(3)
    rows = random_rows(rng, 150)
    near = [v for r in rows for v in (r[1], r[3]) if v is not None]
    sets = [dict(DEFAULT_THRESHOLDS, **{k: rng.choice([rng.uniform(-5, 105) if k.startswith("a") else rng.uniform(-1, 11),
                                                       rng.choice(near), rng.choice(near) + 0.004, rng.choice(near) - 0.004])
                                        for k in KEYS}) for _ in range(1000)]
    st = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(threshold_what_if(st, sets)) == direct(rows, sets)


def test_limits_at_and_beyond_the_ends(spark):
    rows = [("X", 0.0, "X", 0.0), ("X", 100.0, "X", 10.0), ("SIN_DATOS", 0.0, "X", None), ("X", 0.01, "SIN_DATOS", 0.0), ("X", 99.99, "X", 9.99)]
    ends = [(-10.0, 0.0, 100.0), (0.0, 0.01, 100.01), (100.0, 100.0, 100.0), (101.0, 0.0, 0.0), (1e300, 1e300, -1e300), (0.0, 0.0, 0.0)]
    marks = [(-1.0, 0.0, 10.0), (0.0, 0.01, 10.01), (10.0, 10.0, 10.0), (11.0, 0.0, 0.0), (0.005, 9.995, 9.985)]
    sets = [dict(DEFAULT_THRESHOLDS, **dict(zip(KEYS, a + g))) for a in ends for g in marks]
    assert got(threshold_what_if(spark.createDataFrame(rows, SCHEMA), sets)) == direct(rows, sets)


def test_no_students_and_table_size(spark):
    none = threshold_what_if(spark.createDataFrame([], SCHEMA), [DEFAULT_THRESHOLDS])
    assert got(none) == {(0, lv): 0 for lv in ORDER}
    same = spark.createDataFrame(random_rows(random.Random(1), 20), SCHEMA)
    many = same
    for _ in range(3):
        many = many.unionAll(many)
    assert what_if_counts(many).count() == what_if_counts(same).count()      # grows with cells, not with students


def test_a_prefix_is_counted_once_for_all_sets(spark, monkeypatch):
    """Sets that ask for the same prefixes add no rows to the step that adds up blocks."""
    rng = random.Random(4)
    rows = random_rows(rng, 40)
    sets = [dict(DEFAULT_THRESHOLDS, nota_riesgo=float(i % 2)) for i in range(60)]
    asked = []
    real = extras.prefix_counts
    monkeypatch.setattr(extras, "prefix_counts", lambda st, pairs: asked.append(pairs) or real(st, pairs))
    assert got(threshold_what_if(spark.createDataFrame(rows, SCHEMA), sets)) == direct(rows, sets)
    assert asked[0].count() <= 2 * len(ORDER)
