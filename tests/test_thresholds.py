import json

import pytest

from tutorlens.config import DEFAULT_THRESHOLDS
from tutorlens.sources.thresholds import (load_thresholds, threshold_frame, threshold_sets, threshold_violations,
                                          validate_thresholds)


def test_defaults_and_merge(spark, tmp_path):
    assert load_thresholds() == DEFAULT_THRESHOLDS
    th = load_thresholds(json_string='{"asistencia_riesgo": 70}')
    assert th["asistencia_riesgo"] == 70 and th["nota_riesgo"] == 4.0
    p = tmp_path / "u.json"
    p.write_text(json.dumps({"nota_aprobado": 6}), encoding="utf-8")
    assert load_thresholds(json_file=str(p))["nota_aprobado"] == 6
    assert load_thresholds(json_file=p.as_uri(), spark=spark)["nota_aprobado"] == 6


def test_bad_json_and_missing_file(spark):
    with pytest.raises(ValueError, match="objeto JSON"):
        load_thresholds(json_string="[1]")
    with pytest.raises(ValueError, match="no se pueden leer umbrales"):
        load_thresholds(json_string="{no")
    with pytest.raises(ValueError, match="no se pueden leer umbrales"):
        load_thresholds(json_file="/nonexistent/umbrales.json")


@pytest.mark.parametrize("change,msg", [
    ({"asistencia_riesgo": 90}, "asistencia_riesgo < asistencia_alerta"),
    ({"asistencia_optima": 80}, "asistencia_alerta < asistencia_optima"),
    ({"nota_riesgo": 7}, "nota_riesgo < nota_alerta"),
    ({"asistencia_riesgo": -1}, "0 <= asistencia_riesgo"),
    ({"nota_aprobado": 11}, "nota_aprobado <= 10"),
    ({"ml_n_clusters": 1}, "2 <= ml_n_clusters"),
])
def test_validation(change, msg):
    th = dict(DEFAULT_THRESHOLDS, **change)
    with pytest.raises(ValueError, match=msg):
        validate_thresholds(th)
    assert validate_thresholds(DEFAULT_THRESHOLDS)


def test_violation_table(spark):
    f = threshold_frame(spark, [DEFAULT_THRESHOLDS, {"asistencia_riesgo": 90, "ml_n_clusters": 1}])
    got = {r["conjunto"]: r["violaciones"] for r in threshold_violations(f).collect()}
    assert got[0] == [] and got[1] == ["umbral no válido: se exige asistencia_riesgo < asistencia_alerta",
                                       "umbral no válido: se exige 2 <= ml_n_clusters"]


def test_sets_from_a_folder(spark, tmp_path):
    for name, text in (("a", '{"nombre": "estricto", "asistencia_riesgo": 90}'), ("b", "{}"), ("c", "{no"), ("d", '{"ml_n_clusters": 1,\n"otra": "x"}')):
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    rows = {r["nombre"]: r for r in threshold_violations(threshold_sets(spark, str(tmp_path))).collect()}
    assert rows["estricto"]["asistencia_riesgo"] == 90 and rows["estricto"]["nota_riesgo"] == DEFAULT_THRESHOLDS["nota_riesgo"]
    assert rows["estricto"]["violaciones"] == ["umbral no válido: se exige asistencia_riesgo < asistencia_alerta"]
    assert rows["b.json"]["violaciones"] == [] and rows["b.json"]["corrupto"] is None
    assert rows["c.json"]["corrupto"] and rows["d.json"]["violaciones"] == ["umbral no válido: se exige 2 <= ml_n_clusters"]
