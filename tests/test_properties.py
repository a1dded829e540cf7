"""Property checks on generated inputs (few examples: each one is a Spark job)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tutorlens.operators import clean, courses
from tutorlens.operators.combine import student_table

from helpers import att_df, gr_df

SEV = {"OPTIMO": 0, "ALERTA": 1, "MEDIO": 2, "ALTO": 3, "SIN_DATOS": 0}

att_rows = st.lists(st.tuples(st.sampled_from(["A", "B", "C", "D"]), st.sampled_from(["C1", "C2"]),
                              st.integers(1, 28), st.booleans(), st.booleans(), st.booleans()),
                    min_size=1, max_size=40)
gr_rows = st.lists(st.tuples(st.sampled_from(["A", "B", "E"]), st.sampled_from(["E1", "E2"]),
                             st.integers(0, 20), st.sampled_from(["CE1", "CE2", "CE3"]), st.integers(0, 3)),
                   max_size=30)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=att_rows, g=gr_rows)
def test_invariants(spark, a, g):
    att = att_df(spark, [(s, c, f"2024-01-{d:02d}", str(p).lower(), str(r).lower(), str(j).lower())
                         for s, c, d, p, r, j in a])
    gr = gr_df(spark, [(s, "C1", e, str(n / 2), ce, str(w), None) for s, e, n, ce, w in g])
    tab = student_table(clean.clean_attendance(att), clean.clean_grades(gr)).collect()
    for r in tab:
        assert r["asist_faltas"] == r["asist_faltas_justificadas"] + r["asist_faltas_injustificadas"]
        assert r["asist_sesiones_totales"] == r["asist_asistencias"] + r["asist_faltas"]
        assert SEV[r["nivel_riesgo_final"]] == max(SEV[r["nivel_riesgo_asistencia"]], SEV[r["nivel_riesgo_rendimiento"]])
        assert 0.0 <= r["asist_porcentaje_asistencia"] <= 100.0
    s = courses.summary(student_table(clean.clean_attendance(att), clean.clean_grades(gr))).first()
    assert s["total_estudiantes"] == len(tab) == (s["estudiantes_riesgo_alto"] + s["estudiantes_riesgo_medio"]
                                                 + s["estudiantes_alerta"] + s["estudiantes_optimo"])
