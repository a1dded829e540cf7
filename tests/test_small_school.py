"""A small school on files: loaders, student table, reports and the job against plain Python."""

import datetime as dt
from collections import defaultdict
from fractions import Fraction as Fr

import numpy as np
import pytest

from tutorlens.operators import clean, courses
from tutorlens.operators.combine import student_table
from tutorlens.operators.extras import competency_metrics
from tutorlens.plans.job import main
from tutorlens.sources.csv import read_csv_robust

STUDENTS = [f"al{i:02d}" for i in range(11)]     # al10 has marks only, al09 attendance only


def sessions():
    """(id, course, date or None, present, late, excused) in input order; some rows repeat with other flags."""
    rows = []
    for i, sid in enumerate(STUDENTS[:10]):
        for d in range(14):
            day = None if (i, d) in ((2, 3), (4, 0)) else dt.date(2025, 2, 1) + dt.timedelta(days=(d * 5) % 14)
            here = (d * (i + 2) + i) % 7 >= i % 4
            rows.append((sid, "01" if i < 6 else "02", day, here, here and d % 5 == 0, not here and d % 3 == 0))
    return rows + [(*rows[3][:3], not rows[3][3], False, True), (*rows[20][:3], not rows[20][3], False, False)]


def marks():
    """(id, course, evaluation, mark, competency, weight, date); tenths, unequal weights, one set of zero weights."""
    rows = []
    for i, sid in enumerate(STUDENTS):
        if sid == "al09":
            continue
        for e in range(6):
            mark = Fr((i * 17 + e * (7 if i % 2 else -3) + 31) % 101, 10)
            weight = Fr(0) if sid == "al08" else Fr(1 + (e * i) % 4, 2)
            day = None if (i, e) == (5, 2) else dt.date(2025, 3, 1) + dt.timedelta(days=(e * 11) % 40)
            rows.append((sid, "01" if i < 6 else "02", f"ev{e % 3}", mark, f"CE{e % 5 + 1}", weight, day))
    return rows + [("al00", "01", "ev9", Fr(11), "CE1", Fr(1), None), (*rows[0][:3], Fr(10), *rows[0][4:])]


def write_files(folder):
    flag = {True: "sí", False: "no"}
    att, half = sessions(), 70
    (folder / "asist").mkdir()
    lines = ["IDEstudiante,CursoID,Fecha,Presente,Retraso,FaltaJustificada"]
    lines += [f"{s},{c},{d or ''},{flag[p]},{flag[r]},{flag[j]}" for s, c, d, p, r, j in att[:half]]
    (folder / "asist" / "1.csv").write_text("\n".join(lines), encoding="utf-8")
    lines = ["Presente; Fecha ;CursoID;FaltaJustificada;Retraso;IDEstudiante"]     # another order, dialect and date format
    lines += [f"{flag[p]};{d.strftime('%d/%m/%Y') if d else 'NA'};{c};{flag[j]};{flag[r]};{s}" for s, c, d, p, r, j in att[half:]]
    (folder / "asist" / "2.csv").write_text("\n".join(lines), encoding="latin-1")
    lines = ["Estudiante,IDEstudiante,CursoID,Evaluacion,Nota,Competencia,Peso,Fecha"]
    lines += [f"Nombre {s},{s},{c},{e},{float(n)},{' ' + k.lower()},{float(w)},{d or ''}" for s, c, e, n, k, w, d in marks()]
    (folder / "notas.csv").write_text("\n".join(lines), encoding="utf-8")
    return str(folder / "asist"), str(folder / "notas.csv")


def r2(x):
    return float(np.rint(float(x) * 100.0) / 100.0)


def trend(values):
    n, total = len(values), sum(values)
    if n < 3 or len(set(values)) == 1 or total == 0:
        return "ESTABLE"
    d = 2 * sum(x * y for x, y in enumerate(values)) - (n - 1) * total
    change = Fr(600 * n) * d / ((n * n - 1) * total)
    return "MEJORANDO" if change >= 5 else "EMPEORANDO" if change <= -5 else "ESTABLE"


def level(x, low, mid, high):
    return "ALTO" if x < low else "MEDIO" if x < mid else "ALERTA" if x < high else "OPTIMO"


def first_rows(rows, key):
    seen = {}
    for r in rows:
        seen.setdefault(key(r), r)
    return list(seen.values())


def by_date(rows, at):
    return sorted(rows, key=lambda r: (r[at] is None, r[at] or dt.date.min))


def expected():
    att, gr = defaultdict(list), defaultdict(list)
    for r in first_rows(sessions(), lambda r: r[:3]):
        att[r[0]].append(r)
    for r in first_rows([m for m in marks() if 0 <= m[3] <= 10], lambda r: (*r[:3], r[4])):
        gr[r[0]].append(r)
    out = {}
    for sid in STUDENTS:
        a, g = by_date(att.get(sid, []), 2), by_date(gr.get(sid, []), 6)
        row = dict(sessions=len(a), present=sum(r[3] for r in a), late=sum(r[4] for r in a), n=len(g),
                   excused=sum(r[5] and not r[3] for r in a), pct=0.0, ra="SIN_DATOS", ta=trend([Fr(r[3]) for r in a]),
                   mean=0.0, std=0.0, rg="SIN_DATOS", ok=False, tg=trend([r[3] for r in g]))
        if a:
            row["pct"] = r2(row["present"] / row["sessions"] * 100)
            row["ra"] = level(row["pct"], 75, 85, 95)
        if g:
            w = sum(r[5] for r in g)
            row["std"] = r2(np.std([float(r[3]) for r in g], ddof=1)) if len(g) > 1 else 0.0
            row["mean"] = r2(sum(r[3] * r[5] for r in g) / w) if w else 0.0
            row["rg"] = level(row["mean"], 4, 6, 8) if w else "SIN_DATOS"
            row["ok"] = bool(w) and row["mean"] >= 5
        out[sid] = row
    return out


@pytest.fixture(scope="module")
def school(spark, tmp_path_factory):
    a, g = write_files(tmp_path_factory.mktemp("school"))
    att = clean.prepare_attendance(read_csv_robust(spark, a))
    gr = clean.prepare_grades(read_csv_robust(spark, g))
    return a, g, att.cache(), gr.cache(), student_table(att, gr).cache()


NAMES = {"sessions": "asist_sesiones_totales", "present": "asist_asistencias", "late": "asist_retrasos",
         "excused": "asist_faltas_justificadas", "pct": "asist_porcentaje_asistencia", "ra": "nivel_riesgo_asistencia",
         "ta": "asist_tendencia", "n": "rend_n_evaluaciones", "mean": "rend_nota_media", "std": "rend_nota_std",
         "rg": "nivel_riesgo_rendimiento", "ok": "rend_aprobado", "tg": "rend_tendencia"}


def test_student_table(school):
    *_, st = school
    got = {r["IDEstudiante"]: r for r in st.collect()}
    want = expected()
    assert sorted(got) == STUDENTS
    for sid, row in want.items():
        mean = got[sid]["rend_nota_media"]
        assert {k: got[sid][c] for k, c in NAMES.items() if k != "mean"} == {k: v for k, v in row.items() if k != "mean"}, sid
        assert (0.0 if mean is None else mean) == row["mean"]
        order = ["OPTIMO", "ALERTA", "MEDIO", "ALTO"]
        worst = max(order.index(x) if x in order else 0 for x in (row["ra"], row["rg"]))
        assert got[sid]["nivel_riesgo_final"] == order[worst]
        assert got[sid]["CursoID"] == ("01" if sid < "al06" else "02")


def test_courses_summary_and_competencies(school):
    _, _, att, gr, st = school
    rows = {r["IDEstudiante"]: r for r in st.collect()}
    summary = courses.summary(st).first()
    assert (summary["total_estudiantes"], summary["total_cursos"]) == (11, 2)
    counts = {r["nivel"]: r["estudiantes"] for r in courses.risk_distribution(st).collect()}
    assert counts == {x: sum(r["nivel_riesgo_final"] == x for r in rows.values()) for x in ("ALTO", "MEDIO", "ALERTA", "OPTIMO")}
    per = {r["curso_id"]: r["estudiantes"] for r in courses.course_metrics(st).collect()}
    assert per == {"01": 6, "02": 5}
    means = {r["IDEstudiante"]: r["CE2"] for r in competency_metrics(gr).collect()}
    for sid in STUDENTS[:8]:
        own = [m for m in marks() if m[0] == sid and m[4] == "CE2"]
        assert means[sid] == r2(sum(m[3] * m[5] for m in own) / sum(m[5] for m in own))
    assert clean.common_values(att, gr, "IDEstudiante").count() == 9
    assert {r["comprobacion"]: r["valor"] for r in clean.cross_validate(att, gr).collect()} == {
        "estudiantes_comunes": 9, "cursos_comunes": 2}
    assert clean.cross_validate(att.drop("IDEstudiante", "CursoID"), gr).count() == 0


def test_row_order_of_sorted_tables(school):
    from tutorlens.operators import metrics, reports
    from tutorlens.operators.combine import classify_students
    _, _, att, gr, st = school
    order = ["ALTO", "MEDIO", "ALERTA", "OPTIMO"]
    rows = classify_students(metrics.attendance_metrics(att), metrics.grade_metrics(gr)).collect()
    keys = [(order.index(r["nivel_riesgo_final"]), r["IDEstudiante"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 11
    listed = [r[0] for r in reports.report_students(st).collect()]
    level = {r["IDEstudiante"]: order.index(r["nivel_riesgo_final"]) for r in st.collect()}
    assert [level[s] for s in listed] == sorted(level.values())
    days = [(r["Fecha"] is None, r["Fecha"], tuple(r["_rid"])) for r in att.orderBy(*metrics.input_order(att)).collect()]
    assert days == sorted(days, key=lambda d: (d[0], d[1] or dt.date.min, d[2]))


def test_job(spark, school, tmp_path):
    a, g, *_ = school
    args = ["--asistencia", a, "--calificaciones", g, "--output", str(tmp_path / "out")]
    paths = main(args, spark=spark)
    st = spark.read.schema("IDEstudiante string, CursoID string, Cluster int, NivelRiesgoML string").parquet(paths["estudiantes"])
    assert {r["CursoID"] for r in st.collect()} == {"01", "02"} and st.where("Cluster is null").isEmpty()
    assert {r["curso_id"] for r in spark.read.parquet(paths["cursos"]).collect()} == {"01", "02"}
    assert spark.read.parquet(paths["ml_resultado"]).first()["exito"]
    assert spark.read.parquet(paths["calidad_asistencia"]).first()["duplicados_eliminados"] == 2
    assert spark.read.parquet(paths["calidad_calificaciones"]).first()["fuera_de_rango"] == 1
    assert spark.read.parquet(paths["carga_calificaciones"]).first()["estudiantes_unicos"] == 10
    assert spark.read.parquet(paths["validacion"]).count() == 2
    only = main([*args, "--curso", "02", "--no-ml", "--formato", "csv", "--sobrescribir"], spark=spark)
    assert "ml" not in only and only["estudiantes"] == str(tmp_path / "out" / "estudiantes")
    assert spark.read.option("header", True).csv(only["listado"]).count() == 5
    assert spark.read.parquet(paths["estudiantes"]).count() == 11          # the earlier run is still there
    with pytest.raises(ValueError, match="no hay filas del curso 77"):
        main([*args, "--curso", "77"], spark=spark)
