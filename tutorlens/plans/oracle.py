"""DuckDB SQL for each registered query, written independently of the Spark code
from the stated semantics (row_number windows and ``regr_slope`` where the
Spark side uses aggregates and range partitioning).

The test tables are views: events, lineitem, orders, ... Every statement
re-derives its inputs from them.
"""

from __future__ import annotations

from . import oracle_kmeans as kmeans_sql
from ..config import COMPETENCIES, DISTRIBUTION_LABELS, GENERAL_RECOMMENDATIONS, RECOMMENDATIONS, RISK_LEVELS

# Written out here, not taken from the code under test.
TRUE_TOKENS = ["true", "1", "sí", "si", "yes", "t", "verdadero", "x"]
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
               "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
# spellings of the stand-in text tables
TRUE_SPELLINGS = ["true", "1", "Sí", "si", "YES", "t", "verdadero", "X", " True ", "2"]
FALSE_SPELLINGS = ["false", "0", "no", "f", "", None, "nope", "0.0", "N"]
ID_NULL_SPELLINGS = ["NA", "N/A", "null", "None", "NaN", "-"]

NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
D = "::DOUBLE"


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def R2(x: str) -> str:
    return f"(round_even(({x}) * 100.0{D}, 0) / 100.0{D})"


def mean2(x: str) -> str:
    """Mean over exact hundredths (the library's definition for 2dp values)."""
    return (f"(CAST(SUM(CAST(round_even(({x}) * 100.0{D}, 0) AS BIGINT)) AS DOUBLE) "
            f"/ CAST(COUNT({x}) AS DOUBLE) / 100.0{D})")


def risk_att(p: str, r=75.0, a=85.0, o=95.0) -> str:
    return (f"CASE WHEN {p} < {r}{D} THEN 'ALTO' WHEN {p} < {a}{D} THEN 'MEDIO' "
            f"WHEN {p} < {o}{D} THEN 'ALERTA' ELSE 'OPTIMO' END")


def risk_gr(n: str, r=4.0, a=6.0, e=8.0) -> str:
    return (f"CASE WHEN {n} IS NULL THEN 'SIN_DATOS' WHEN {n} < {r}{D} THEN 'ALTO' WHEN {n} < {a}{D} THEN 'MEDIO' "
            f"WHEN {n} < {e}{D} THEN 'ALERTA' ELSE 'OPTIMO' END")


def sev(lv: str) -> str:
    return f"(CASE {lv} WHEN 'ALTO' THEN 3 WHEN 'MEDIO' THEN 2 WHEN 'ALERTA' THEN 1 ELSE 0 END)"


def combined(a: str, b: str) -> str:
    return f"(['OPTIMO', 'ALERTA', 'MEDIO', 'ALTO'])[greatest({sev(a)}, {sev(b)}) + 1]"


def pct_label(cnt: str, total: str) -> str:
    return (f"CASE WHEN {total} > 0 THEN printf('%.1f', CAST({cnt} AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0{D})"
            f" || '%' ELSE '0%' END")


def trend_case(n="n", slope="slope", mean="mean_y", mn="mn", mx="mx", pos=5.0, neg=-5.0) -> str:
    ch = f"({slope} * {n} / {mean} * 100.0{D})"
    return (f"CASE WHEN {n} < 3 OR {mn} = {mx} OR {mean} = 0 THEN 'ESTABLE' WHEN {ch} >= {pos}{D} THEN 'MEJORANDO' "
            f"WHEN {ch} <= {neg}{D} THEN 'EMPEORANDO' ELSE 'ESTABLE' END")


def parse_bool(t: str) -> str:
    x = f"lower(trim({t}))"
    return (f"COALESCE({x} IN ({', '.join(q(v) for v in TRUE_TOKENS)}) OR "
            f"(regexp_matches({x}, '{NUM}') AND TRY_CAST({x} AS DOUBLE) <> 0), false)")


def parse_num(t: str) -> str:
    x = f"trim({t})"
    return f"CASE WHEN regexp_matches({x}, '{NUM}') THEN TRY_CAST({x} AS DOUBLE) END"


DATE_FMTS = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y"]
TIME_SUFFIXES = [" %H:%M:%S", " %H:%M", "T%H:%M:%S"]


def parse_date(t: str) -> str:
    x = f"trim({t})"
    tries = [f"try_strptime({x}, '{f}')" for f in DATE_FMTS]
    tries += [f"try_strptime({x}, '{f}{s}')" for f in DATE_FMTS for s in TIME_SUFFIXES]
    return f"CAST(COALESCE({', '.join(tries)}) AS DATE)"


def null_tok(x: str) -> str:
    return f"CASE WHEN {x} IN ({', '.join(q(v) for v in NULL_TOKENS)}) THEN NULL ELSE {x} END"


def norm_comp(x: str) -> str:
    return f"trim(upper({x}), {q(WHITESPACE)})"


def pick(options, idx: str) -> str:
    return f"({lst(options)})[({idx}) % {len(options)} + 1]"


def flag_text(cond: str, idx: str) -> str:
    return f"CASE WHEN {cond} THEN {pick(TRUE_SPELLINGS, idx)} ELSE {pick(FALSE_SPELLINGS, idx)} END"


def date_text(ts: str, idx: str) -> str:
    fm = ["%Y-%m-%d", "%d/%m/%Y", "%-d-%-m-%Y", "%Y/%m/%d", "%d.%m.%Y", "%Y-%m-%d %H:%M:%S"]
    whens = " ".join(f"WHEN {i} THEN strftime({ts}, '{f}')" for i, f in enumerate(fm))
    return f"CASE ({idx}) % 7 {whens} ELSE 'sin fecha' END"


RID_COLS = "_rid"
# lineitem rows numbered in file order (the input order of the grades stand-in)
LINEITEM_ROWS = "(SELECT *, row_number() OVER () - 1 AS _rid FROM lineitem)"


def with_(*parts: tuple[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" + body


# ---------------------------------------------------------------------------
# input adapters
# ---------------------------------------------------------------------------

ATT_RAW = ("att_raw", """
SELECT CAST(user_id * 20 AS VARCHAR) AS IDEstudiante, 'C' || CAST(user_id % 5 AS VARCHAR) AS CursoID,
       CAST(ts AS DATE) AS Fecha, COALESCE(event_type <> 'error', false) AS Presente,
       COALESCE(event_type = 'click', false) AS Retraso, COALESCE(value > 50, false) AS FaltaJustificada,
       event_id AS _rid
FROM events""")

ATT = ("att", """
SELECT IDEstudiante, CursoID, Fecha, Presente, Retraso, FaltaJustificada, _rid FROM (
  SELECT *, row_number() OVER (PARTITION BY IDEstudiante, CursoID, Fecha ORDER BY _rid) AS rn FROM att_raw)
WHERE rn = 1""")

GR_RAW = ("gr_raw", f"""
SELECT CAST(o_custkey AS VARCHAR) AS IDEstudiante, 'C' || CAST(o_custkey % 5 AS VARCHAR) AS CursoID,
       l_returnflag AS Evaluacion, round_even(l_discount * 100.0{D}, 0) AS Nota,
       ' ce' || CAST(l_linenumber AS VARCHAR) || ' ' AS Competencia, l_quantity AS Peso,
       CAST(l_shipdate AS DATE) AS Fecha, _rid
FROM {LINEITEM_ROWS} JOIN orders ON l_orderkey = o_orderkey""")

GR = ("gr", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY IDEstudiante, CursoID, Evaluacion, Competencia ORDER BY {RID_COLS}) AS rn
  FROM (SELECT * REPLACE ({norm_comp('Competencia')} AS Competencia) FROM gr_raw
        WHERE Nota >= 0 AND Nota <= 10))
WHERE rn = 1""")

ATT_TEXT = ("att_text", f"""
SELECT CASE WHEN event_id % 13 = 0 THEN {pick(ID_NULL_SPELLINGS, 'event_id')}
            ELSE CAST(user_id * 20 AS VARCHAR) END AS IDEstudiante,
       'C' || CAST(user_id % 5 AS VARCHAR) AS CursoID,
       {date_text('ts', 'event_id')} AS Fecha,
       {flag_text("event_type <> 'error'", 'event_id')} AS Presente,
       {flag_text("event_type = 'click'", 'event_id + 3')} AS Retraso,
       {flag_text('value > 50', 'event_id + 5')} AS FaltaJustificada,
       props AS Observaciones, event_id AS _rid
FROM events""")

GRADE_TEXT_CASE = f"""CASE (l_orderkey + l_linenumber) % 10
  WHEN 0 THEN CAST(nota AS VARCHAR) WHEN 1 THEN CAST(CAST(nota AS INTEGER) AS VARCHAR)
  WHEN 2 THEN replace(CAST(nota AS VARCHAR), '.', ',') WHEN 3 THEN 'NaN' WHEN 4 THEN '-1'
  WHEN 5 THEN CAST(nota + 0.5{D} AS VARCHAR) WHEN 6 THEN NULL WHEN 7 THEN ' ' || CAST(nota AS VARCHAR) || ' '
  WHEN 8 THEN 'abc' ELSE CAST(nota * 1.5{D} AS VARCHAR) END"""

WEIGHT_TEXT_CASE = """CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN CAST(l_quantity AS VARCHAR) WHEN 1 THEN 'n/a'
  WHEN 2 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"""

GR_TEXT = ("gr_text", f"""
SELECT 'Alumno ' || CAST(o_custkey AS VARCHAR) AS NombreEstudiante,
       'alumno' || CAST(o_custkey AS VARCHAR) || '@centro.example' AS Email,
       'C' || CAST(o_custkey % 5 AS VARCHAR) AS Curso, l_returnflag AS instrumento,
       {GRADE_TEXT_CASE} AS nota,
       ' ce' || CAST(l_linenumber AS VARCHAR) || ' ' AS Criterio,
       {WEIGHT_TEXT_CASE} AS ponderacion,
       {date_text('l_shipdate', 'l_orderkey + l_linenumber')} AS fecha, _rid
FROM (SELECT *, round_even(l_discount * 100.0{D}, 0) AS nota FROM {LINEITEM_ROWS}) JOIN orders ON l_orderkey = o_orderkey""")

# grades text after the reader's null tokens and column mapping, with generated ids
GR_MAPPED = ("gr_mapped", f"""
SELECT {null_tok('NombreEstudiante')} AS NombreEstudiante, {null_tok('Email')} AS Email,
       {null_tok('Curso')} AS CursoID, {null_tok('instrumento')} AS Evaluacion, {null_tok('nota')} AS Nota,
       {null_tok('Criterio')} AS Competencia, {null_tok('ponderacion')} AS Peso, {null_tok('fecha')} AS Fecha, _rid
FROM gr_text""")

GR_IDS = ("gr_ids", """
SELECT m.*, CASE WHEN m.NombreEstudiante IS NULL THEN NULL ELSE printf('EST%04d', r.rk) END AS IDEstudiante
FROM gr_mapped m LEFT JOIN (
  SELECT NombreEstudiante, row_number() OVER (ORDER BY NombreEstudiante) AS rk
  FROM (SELECT DISTINCT NombreEstudiante FROM gr_mapped WHERE NombreEstudiante IS NOT NULL)) r
ON m.NombreEstudiante = r.NombreEstudiante""")

GR_PARSED = ("gr_parsed", f"""
SELECT IDEstudiante, CursoID, Evaluacion, {norm_comp('Competencia')} AS Competencia,
       {parse_num('Nota')} AS Nota, COALESCE({parse_num('Peso')}, 1.0{D}) AS Peso, {parse_date('Fecha')} AS Fecha, _rid
FROM gr_ids""")

GR_LOADED = ("gr_loaded", f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY IDEstudiante, CursoID, Evaluacion, Competencia ORDER BY {RID_COLS}) AS rn
  FROM gr_parsed WHERE Nota >= 0 AND Nota <= 10)
WHERE rn = 1""")

ATT_PARSED = ("att_parsed", f"""
SELECT {null_tok('IDEstudiante')} AS IDEstudiante, {null_tok('CursoID')} AS CursoID,
       {parse_date(null_tok('Fecha'))} AS Fecha, {parse_bool(null_tok('Presente'))} AS Presente,
       {parse_bool(null_tok('Retraso'))} AS Retraso, {parse_bool(null_tok('FaltaJustificada'))} AS FaltaJustificada,
       {null_tok('Observaciones')} AS Observaciones, _rid
FROM att_text""")

ATT_LOADED = ("att_loaded", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY IDEstudiante, CursoID, Fecha ORDER BY _rid) AS rn FROM att_parsed)
WHERE rn = 1""")


# ---------------------------------------------------------------------------
# metrics over a cleaned attendance / grades relation
# ---------------------------------------------------------------------------

def am_counts_sql(att: str) -> str:
    pct = "CAST(asistencias AS DOUBLE) / CAST(sesiones_totales AS DOUBLE) * 100.0::DOUBLE"
    return f"""
SELECT IDEstudiante, sesiones_totales, asistencias, retrasos, sesiones_totales - asistencias AS faltas,
       {R2(pct)} AS porcentaje_asistencia, faltas_justificadas,
       sesiones_totales - asistencias - faltas_justificadas AS faltas_injustificadas,
       {risk_att(R2(pct))} AS nivel_riesgo
FROM (SELECT IDEstudiante, COUNT(*) AS sesiones_totales, COUNT(*) FILTER (WHERE Presente) AS asistencias,
             COUNT(*) FILTER (WHERE Retraso) AS retrasos,
             COUNT(*) FILTER (WHERE NOT Presente AND FaltaJustificada) AS faltas_justificadas
      FROM {att} WHERE IDEstudiante IS NOT NULL GROUP BY IDEstudiante)"""


def trend_sql(src: str, y: str, order: str) -> str:
    return f"""
SELECT IDEstudiante, {trend_case()} AS tendencia FROM (
  SELECT IDEstudiante, COUNT(*) AS n, regr_slope(y, x) AS slope, AVG(y) AS mean_y, MIN(y) AS mn, MAX(y) AS mx
  FROM (SELECT IDEstudiante, CAST({y} AS DOUBLE) AS y,
               CAST(row_number() OVER (PARTITION BY IDEstudiante ORDER BY {order}) - 1 AS DOUBLE) AS x
        FROM {src} WHERE IDEstudiante IS NOT NULL)
  GROUP BY IDEstudiante)"""


def att_trend_sql(att: str) -> str:
    return trend_sql(att, "Presente", "Fecha ASC NULLS LAST, _rid ASC")


def gr_trend_sql(gr: str) -> str:
    return trend_sql(gr, "Nota", f"Fecha ASC NULLS LAST, {RID_COLS}")


def am_sql(att: str) -> str:
    return f"""
SELECT c.*, COALESCE(t.tendencia, 'ESTABLE') AS tendencia
FROM ({am_counts_sql(att)}) c LEFT JOIN ({att_trend_sql(att)}) t ON c.IDEstudiante = t.IDEstudiante"""


def gm_aggs_sql(gr: str) -> str:
    mean = "CASE WHEN SUM(Peso) = 0 THEN NULL ELSE SUM(Nota * Peso) / SUM(Peso) END"
    return f"""
SELECT *, {risk_gr('nota_media')} AS nivel_riesgo, COALESCE(nota_media >= 5.0{D}, false) AS aprobado FROM (
  SELECT IDEstudiante, COUNT(Nota) AS n_evaluaciones, {R2(mean)} AS nota_media,
         COALESCE({R2('stddev_samp(Nota)')}, 0.0{D}) AS nota_std, {R2('MIN(Nota)')} AS nota_min,
         {R2('MAX(Nota)')} AS nota_max
  FROM {gr} WHERE IDEstudiante IS NOT NULL GROUP BY IDEstudiante)"""


def gm_sql(gr: str) -> str:
    return f"""
SELECT a.*, COALESCE(t.tendencia, 'ESTABLE') AS tendencia
FROM ({gm_aggs_sql(gr)}) a LEFT JOIN ({gr_trend_sql(gr)}) t ON a.IDEstudiante = t.IDEstudiante"""


def combined_sql(am: str, gm: str, missing_as_null: bool = False) -> str:
    def f(x, d):
        return x if missing_as_null else f"COALESCE({x}, {d})"
    return f"""
SELECT COALESCE(a.IDEstudiante, r.IDEstudiante) AS IDEstudiante,
  {f('a.sesiones_totales', 0)} AS asist_sesiones_totales, {f('a.asistencias', 0)} AS asist_asistencias,
  {f('a.retrasos', 0)} AS asist_retrasos, {f('a.faltas', 0)} AS asist_faltas,
  {f('a.porcentaje_asistencia', '0.0::DOUBLE')} AS asist_porcentaje_asistencia,
  {f('a.faltas_justificadas', 0)} AS asist_faltas_justificadas,
  {f('a.faltas_injustificadas', 0)} AS asist_faltas_injustificadas,
  COALESCE(a.nivel_riesgo, 'SIN_DATOS') AS nivel_riesgo_asistencia,
  COALESCE(a.tendencia, 'ESTABLE') AS asist_tendencia,
  {f('r.n_evaluaciones', 0)} AS rend_n_evaluaciones, {f('r.nota_media', '0.0::DOUBLE')} AS rend_nota_media,
  {f('r.nota_std', '0.0::DOUBLE')} AS rend_nota_std, {f('r.nota_min', '0.0::DOUBLE')} AS rend_nota_min,
  {f('r.nota_max', '0.0::DOUBLE')} AS rend_nota_max,
  COALESCE(r.nivel_riesgo, 'SIN_DATOS') AS nivel_riesgo_rendimiento,
  {f('r.aprobado', 'false')} AS rend_aprobado, COALESCE(r.tendencia, 'ESTABLE') AS rend_tendencia,
  {combined('a.nivel_riesgo', 'r.nivel_riesgo')} AS nivel_riesgo_final
FROM ({am}) a FULL OUTER JOIN ({gm}) r ON a.IDEstudiante = r.IDEstudiante"""


def course_att_sql(att: str) -> str:
    return f"""
SELECT IDEstudiante, CursoID FROM (
  SELECT IDEstudiante, CursoID,
         row_number() OVER (PARTITION BY IDEstudiante ORDER BY Fecha DESC NULLS FIRST, _rid DESC) AS rn
  FROM {att} WHERE IDEstudiante IS NOT NULL) WHERE rn = 1"""


def course_gr_sql(gr: str) -> str:
    desc = ", ".join(f"{c} DESC" for c in RID_COLS.split(", "))
    return f"""
SELECT IDEstudiante, CursoID FROM (
  SELECT IDEstudiante, CursoID, row_number() OVER (PARTITION BY IDEstudiante ORDER BY {desc}) AS rn
  FROM {gr} WHERE IDEstudiante IS NOT NULL) WHERE rn = 1"""


def students_sql(att: str, gr: str, missing_as_null: bool = False) -> str:
    return f"""
SELECT c.*, COALESCE(ca.CursoID, cg.CursoID, 'CURSO01') AS CursoID
FROM ({combined_sql(am_sql(att), gm_sql(gr), missing_as_null)}) c
LEFT JOIN ({course_att_sql(att)}) ca ON c.IDEstudiante = ca.IDEstudiante
LEFT JOIN ({course_gr_sql(gr)}) cg ON c.IDEstudiante = cg.IDEstudiante"""


BASE = (ATT_RAW, ATT, GR_RAW, GR)
STUDENTS = ("students", students_sql("att", "gr"))


def on_students(body: str) -> str:
    return with_(*BASE, STUDENTS, body=body)


LEVELS_VALUES = "(VALUES " + ", ".join(
    f"({i}, {q(name)}, {q(dict(DISTRIBUTION_LABELS)[name])}, {q(emoji)}, {q(color)})"
    for i, (name, _c, color, emoji, _d) in enumerate(RISK_LEVELS)) + ") AS lv(orden, nivel, etiqueta, estado, color)"


def level_counts(lv: str) -> str:
    return (f"COUNT(*) FILTER (WHERE {lv} = 'ALTO') AS estudiantes_riesgo_alto, "
            f"COUNT(*) FILTER (WHERE {lv} = 'MEDIO') AS estudiantes_riesgo_medio, "
            f"COUNT(*) FILTER (WHERE {lv} = 'ALERTA') AS estudiantes_alerta")


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    grade_cols = "IDEstudiante, CursoID, Evaluacion, Competencia, Nota, Peso, Fecha"
    att_cols = "IDEstudiante, CursoID, Fecha, Presente, Retraso, FaltaJustificada"

    # -- parsing / loading ---------------------------------------------------
    o["null_tokens"] = with_(ATT_TEXT, body=f"""
SELECT _rid AS event_id, {null_tok('IDEstudiante')} AS IDEstudiante, {null_tok('Presente')} AS Presente,
       {null_tok('Fecha')} AS Fecha FROM att_text""")
    o["parse_bool"] = with_(ATT_TEXT, body=f"""
SELECT _rid AS event_id, Presente AS texto, {parse_bool('Presente')} AS Presente, {parse_bool('Retraso')} AS Retraso,
       {parse_bool('FaltaJustificada')} AS FaltaJustificada FROM att_text""")
    o["parse_date"] = with_(ATT_TEXT, body=f"SELECT _rid AS event_id, Fecha AS texto, {parse_date('Fecha')} AS Fecha "
                                           "FROM att_text")
    o["parse_grade"] = with_(GR_TEXT, body=f"SELECT _rid AS fila, nota AS texto, {parse_num('nota')} AS Nota FROM gr_text")
    o["parse_weight"] = with_(GR_TEXT, body=f"""
SELECT _rid AS fila, ponderacion AS texto, COALESCE({parse_num('ponderacion')}, 1.0{D}) AS Peso FROM gr_text""")
    o["normalize_competency"] = with_(GR_RAW, body=f"SELECT IDEstudiante, Competencia AS texto, "
                                                   f"{norm_comp('Competencia')} AS Competencia FROM gr_raw")
    o["filter_grade_range"] = with_(GR_TEXT, body=f"""
SELECT fila, Nota FROM (SELECT _rid AS fila, {parse_num(null_tok('nota'))} AS Nota FROM gr_text)
WHERE Nota >= 0 AND Nota <= 10""")
    o["dedup_attendance"] = with_(ATT_RAW, ATT, body=f"SELECT {att_cols}, _rid AS event_id FROM att")
    o["dedup_grades"] = with_(GR_RAW, GR, body=f"SELECT {grade_cols} FROM gr")
    o["default_flags"] = with_(ATT_RAW, body="SELECT IDEstudiante, Fecha, Presente, false AS Retraso, "
                                               "false AS FaltaJustificada, _rid AS event_id FROM att_raw")
    o["sort_by_date"] = with_(ATT_RAW, ATT, body=f"SELECT {att_cols}, _rid AS event_id FROM att "
                                                 "ORDER BY Fecha ASC NULLS LAST, _rid")
    o["map_columns"] = with_(GR_TEXT, body="""
SELECT NombreEstudiante, Email, Curso AS CursoID, instrumento AS Evaluacion, nota AS Nota, Criterio AS Competencia,
       ponderacion AS Peso, fecha AS Fecha FROM gr_text""")
    o["gen_student_id"] = with_(GR_TEXT, body="""
SELECT NombreEstudiante, printf('EST%04d', row_number() OVER (ORDER BY NombreEstudiante)) AS IDEstudiante
FROM (SELECT DISTINCT NombreEstudiante FROM gr_text)""")
    o["gen_course_evaluation"] = with_(GR_RAW, body="SELECT IDEstudiante, 'CURSO01' AS CursoID, 'Eval1' AS Evaluacion, "
                                                    "Nota FROM gr_raw")
    o["anonymize"] = with_(GR_TEXT, body="""
SELECT Curso AS CursoID, instrumento AS Evaluacion, nota AS Nota, Criterio AS Competencia, ponderacion AS Peso,
       fecha AS Fecha FROM gr_text""")
    o["load_attendance"] = with_(ATT_TEXT, ATT_PARSED, ATT_LOADED, body=f"SELECT {att_cols}, Observaciones FROM att_loaded")
    gl = (GR_TEXT, GR_MAPPED, GR_IDS, GR_PARSED, GR_LOADED)
    o["load_grades"] = with_(*gl, body=f"SELECT {grade_cols} FROM gr_loaded")
    o["quality_attendance"] = with_(ATT_TEXT, ATT_PARSED, body="""
SELECT SUM(n)::BIGINT AS registros_leidos, COUNT(*)::BIGINT AS registros_finales,
       (SUM(n) - COUNT(*))::BIGINT AS duplicados_eliminados
FROM (SELECT COUNT(*) AS n FROM att_parsed GROUP BY IDEstudiante, CursoID, Fecha)""")
    o["quality_grades"] = with_(GR_TEXT, GR_MAPPED, GR_IDS, GR_PARSED, body="""
SELECT COUNT(*)::BIGINT AS registros_leidos, COUNT(*) FILTER (WHERE Nota IS NULL)::BIGINT AS sin_nota,
       COUNT(*) FILTER (WHERE Nota IS NOT NULL AND NOT (Nota >= 0 AND Nota <= 10))::BIGINT AS fuera_de_rango,
       (COUNT(*) FILTER (WHERE Nota >= 0 AND Nota <= 10)
        - COUNT(DISTINCT (IDEstudiante, CursoID, Evaluacion, Competencia)) FILTER (WHERE Nota >= 0 AND Nota <= 10)
       )::BIGINT AS duplicados_eliminados,
       COUNT(DISTINCT (IDEstudiante, CursoID, Evaluacion, Competencia))
         FILTER (WHERE Nota >= 0 AND Nota <= 10)::BIGINT AS registros_finales
FROM gr_parsed""")
    o["load_stats_attendance"] = with_(ATT_RAW, ATT, body="""
SELECT COUNT(*) AS registros, COUNT(DISTINCT IDEstudiante) AS estudiantes_unicos,
       COUNT(DISTINCT CursoID) AS cursos_unicos, MIN(Fecha) AS fecha_min, MAX(Fecha) AS fecha_max FROM att""")
    o["load_stats_grades"] = with_(GR_RAW, GR, body="""
SELECT COUNT(*) AS registros, COUNT(DISTINCT IDEstudiante) AS estudiantes_unicos,
       COUNT(DISTINCT CursoID) AS cursos_unicos, COUNT(DISTINCT Evaluacion) AS evaluaciones_unicas,
       AVG(Nota) AS nota_media, MIN(Nota) AS nota_min, MAX(Nota) AS nota_max FROM gr""")
    o["common_students"] = with_(*BASE, body="""
SELECT DISTINCT IDEstudiante FROM att WHERE IDEstudiante IS NOT NULL
  AND IDEstudiante IN (SELECT IDEstudiante FROM gr)""")
    o["common_courses"] = with_(*BASE, body="""
SELECT DISTINCT CursoID FROM att WHERE CursoID IS NOT NULL AND CursoID IN (SELECT CursoID FROM gr)""")
    o["all_students"] = with_(*BASE, body="""
SELECT IDEstudiante FROM att WHERE IDEstudiante IS NOT NULL
UNION SELECT IDEstudiante FROM gr WHERE IDEstudiante IS NOT NULL""")
    o["cross_validate"] = with_(*BASE, body="""
SELECT 'estudiantes_comunes' AS comprobacion, COUNT(*) AS valor, COUNT(*) > 0 AS ok FROM
  (SELECT DISTINCT IDEstudiante FROM att WHERE IDEstudiante IN (SELECT IDEstudiante FROM gr))
UNION ALL
SELECT 'cursos_comunes', COUNT(*), COUNT(*) > 0 FROM
  (SELECT DISTINCT CursoID FROM att WHERE CursoID IN (SELECT CursoID FROM gr))""")

    # -- metrics -------------------------------------------------------------
    o["attendance_metrics"] = with_(ATT_RAW, ATT, body=am_sql("att"))
    o["justified_absences"] = with_(ATT_RAW, ATT, body=f"""
SELECT IDEstudiante, faltas, faltas_justificadas, faltas_injustificadas FROM ({am_counts_sql('att')})""")
    o["grade_metrics"] = with_(GR_RAW, GR, body=gm_sql("gr"))
    o["weighted_mean"] = with_(GR_RAW, GR, body="""
SELECT IDEstudiante, CASE WHEN SUM(Peso) = 0 THEN NULL ELSE SUM(Nota * Peso) / SUM(Peso) END AS nota_ponderada,
       AVG(Nota) AS nota_simple FROM gr GROUP BY IDEstudiante""")
    o["trend_attendance"] = with_(ATT_RAW, ATT, body=att_trend_sql("att"))
    o["trend_grades"] = with_(GR_RAW, GR, body=gr_trend_sql("gr"))
    o["trend_grades_text"] = with_(*gl, body=gr_trend_sql("gr_loaded"))
    o["current_course"] = with_(ATT_RAW, ATT, body=course_att_sql("att"))
    o["current_course_grades"] = with_(GR_RAW, GR, body=course_gr_sql("gr"))
    v = "l_extendedprice * l_discount"
    o["round2"] = f"SELECT l_orderkey, l_linenumber, {v} AS valor, {R2(v)} AS valor_2dp, " \
                  f"printf('%.1f', {v}) AS valor_1dp_texto FROM lineitem"
    o["risk_attendance"] = with_(ATT_RAW, ATT, body=f"""
SELECT IDEstudiante, porcentaje_asistencia, nivel_riesgo,
       {risk_att('porcentaje_asistencia', 60.0, 70.0, 80.0)} AS nivel_riesgo_umbral_bajo
FROM ({am_counts_sql('att')})""")
    o["risk_grade"] = with_(GR_RAW, GR, body=f"SELECT IDEstudiante, nota_media, nivel_riesgo FROM ({gm_aggs_sql('gr')})")
    classify = f"""
SELECT COALESCE(a.IDEstudiante, r.IDEstudiante) AS IDEstudiante,
       COALESCE(a.nivel_riesgo, 'SIN_DATOS') AS nivel_riesgo_asistencia,
       COALESCE(r.nivel_riesgo, 'SIN_DATOS') AS nivel_riesgo_rendimiento,
       {combined('a.nivel_riesgo', 'r.nivel_riesgo')} AS nivel_riesgo_final,
       COALESCE(a.porcentaje_asistencia, 0.0{D}) AS porcentaje_asistencia, COALESCE(r.nota_media, 0.0{D}) AS nota_media,
       COALESCE(a.tendencia, 'ESTABLE') AS asist_tendencia, COALESCE(r.tendencia, 'ESTABLE') AS rend_tendencia
FROM ({am_sql('att')}) a FULL OUTER JOIN ({gm_sql('gr')}) r ON a.IDEstudiante = r.IDEstudiante"""
    o["classify_students"] = with_(*BASE, body=classify)
    o["risk_combined"] = with_(*BASE, body=f"""
SELECT IDEstudiante, nivel_riesgo_asistencia, nivel_riesgo_rendimiento, nivel_riesgo_final FROM ({classify})""")
    lv_case = lambda col, idx: "CASE " + col + " " + " ".join(
        f"WHEN {q(r[0])} THEN {q(r[idx]) if idx else r[1]}" for r in RISK_LEVELS)
    o["level_metadata"] = on_students(f"""
SELECT IDEstudiante, nivel_riesgo_final, {lv_case('nivel_riesgo_final', 0)} END AS codigo,
       COALESCE({lv_case('nivel_riesgo_final', 2)} END, 'FFFFFF') AS color,
       COALESCE({lv_case('nivel_riesgo_final', 3)} END, '') AS emoji,
       {lv_case('nivel_riesgo_final', 4)} END AS descripcion
FROM students""")
    comp_case = "CASE Competencia " + " ".join(f"WHEN {q(c)} THEN {q(n)}" for c, n, _ in COMPETENCIES) + " END"
    o["competency_metadata"] = with_(GR_RAW, GR, body=f"""
SELECT Competencia, {comp_case} AS competencia_nombre, COUNT(*) AS evaluaciones FROM gr GROUP BY ALL""")

    # -- student table and joins ----------------------------------------------
    o["combine_students"] = with_(*BASE, body=combined_sql(am_sql("att"), gm_sql("gr")))
    o["combine_students_nulls"] = with_(*BASE, body=combined_sql(am_sql("att"), gm_sql("gr"), True))
    o["assign_course"] = on_students("SELECT IDEstudiante, CursoID FROM students")
    o["student_analysis"] = on_students("SELECT * FROM students")
    o["full_analysis"] = on_students("SELECT * FROM students")
    o["filter_course"] = with_(ATT_RAW, ("att0", ATT[1].replace("att_raw", "att_raw")), GR_RAW,
                               ("gr0", GR[1]),
                               ("att", "SELECT * FROM att0 WHERE CursoID = 'C1'"),
                               ("gr", "SELECT * FROM gr0 WHERE CursoID = 'C1'"),
                               body=students_sql("att", "gr"))
    o["filter_course_curated"] = o["filter_course"]
    o["filter_risk_level"] = on_students("SELECT * FROM students WHERE nivel_riesgo_final = 'ALTO'")

    # -- aggregates and reports ----------------------------------------------
    o["course_metrics"] = on_students(COURSE_SQL)
    o["report_courses"] = on_students(COURSE_SQL)
    o["summary"] = on_students(f"""
SELECT COUNT(*) AS total_estudiantes, COUNT(DISTINCT CursoID) AS total_cursos, {level_counts('nivel_riesgo_final')},
       COUNT(*) FILTER (WHERE nivel_riesgo_final = 'OPTIMO') AS estudiantes_optimo,
       CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE nivel_riesgo_final = 'ALTO') AS DOUBLE)
            / CAST(COUNT(*) AS DOUBLE) * 100.0{D} END AS porcentaje_riesgo_alto,
       CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE nivel_riesgo_final = 'MEDIO') AS DOUBLE)
            / CAST(COUNT(*) AS DOUBLE) * 100.0{D} END AS porcentaje_riesgo_medio
FROM students""")
    dist = f"""
SELECT lv.orden, lv.nivel, lv.etiqueta, COALESCE(c.n, 0) AS estudiantes, lv.estado, lv.color,
       {pct_label('COALESCE(c.n, 0)', 't.total')} AS porcentaje
FROM {LEVELS_VALUES}
LEFT JOIN (SELECT nivel_riesgo_final AS nivel, COUNT(*) AS n FROM students GROUP BY 1) c ON lv.nivel = c.nivel
CROSS JOIN (SELECT COUNT(*) AS total FROM students) t"""
    o["risk_distribution"] = on_students(dist)
    o["report_summary"] = on_students(f"""
SELECT t.total AS total_estudiantes, t.cursos AS total_cursos, lv.orden, lv.etiqueta AS nivel,
       COALESCE(c.n, 0) AS estudiantes, lv.estado, lv.color, {pct_label('COALESCE(c.n, 0)', 't.total')} AS porcentaje
FROM {LEVELS_VALUES}
LEFT JOIN (SELECT nivel_riesgo_final AS nivel, COUNT(*) AS n FROM students GROUP BY 1) c ON lv.nivel = c.nivel
CROSS JOIN (SELECT COUNT(*) AS total, COUNT(DISTINCT CursoID) AS cursos FROM students) t""")
    o["attendance_summary"] = with_(ATT_RAW, ATT, body=f"""
SELECT COUNT(*) AS total_estudiantes, COALESCE({mean2('porcentaje_asistencia')}, 0.0{D}) AS porcentaje_asistencia_promedio,
       {level_counts('nivel_riesgo')}, COUNT(*) FILTER (WHERE nivel_riesgo = 'NINGUNO') AS estudiantes_sin_riesgo,
       COUNT(*) FILTER (WHERE nivel_riesgo = 'OPTIMO') AS estudiantes_optimo
FROM ({am_sql('att')})""")
    o["grade_summary"] = with_(GR_RAW, GR, body=f"""
SELECT COUNT(*) AS total_estudiantes, COALESCE({mean2('nota_media')}, 0.0{D}) AS nota_media_general,
       CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE aprobado) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)
            * 100.0{D} ELSE 0.0{D} END AS tasa_aprobados,
       {level_counts('nivel_riesgo')}, COUNT(*) FILTER (WHERE nivel_riesgo = 'NINGUNO') AS estudiantes_sin_riesgo,
       COUNT(*) FILTER (WHERE nivel_riesgo = 'OPTIMO') AS estudiantes_optimo
FROM ({gm_sql('gr')})""")
    o["distinct_counts"] = with_(GR_RAW, GR, body="""
SELECT COUNT(DISTINCT IDEstudiante) AS estudiantes, COUNT(DISTINCT CursoID) AS cursos,
       COUNT(DISTINCT Evaluacion) AS evaluaciones FROM gr""")
    o["distinct_counts_sketch"] = with_(ATT_RAW, ATT, GR_RAW, GR, body=" UNION ALL ".join(
        f"SELECT {q(side)} AS tabla, COUNT(*) AS registros, {q(name)} AS medida, COUNT(DISTINCT {c}) AS exacto, TRUE AS dentro FROM {t}"
        for side, t, cols in (("asistencia", "att", 2), ("calificaciones", "gr", 3))
        for c, name in (("IDEstudiante", "estudiantes_unicos"), ("CursoID", "cursos_unicos"), ("Evaluacion", "evaluaciones_unicas"))[:cols]))
    labels = {"IDEstudiante": "ID Estudiante", "nivel_riesgo_final": "Nivel Riesgo",
              "asist_porcentaje_asistencia": "Asistencia %", "asist_faltas": "Faltas", "asist_retrasos": "Retrasos",
              "rend_nota_media": "Nota Media", "rend_n_evaluaciones": "N° Evaluaciones",
              "asist_tendencia": "Tendencia Asist.", "rend_tendencia": "Tendencia Rend."}
    o["report_students"] = on_students("SELECT " + ", ".join(f'{c} AS "{lab}"' for c, lab in labels.items())
                                       + " FROM students")
    at_risk_detail = ("'Asistencia: ' || printf('%.1f', asist_porcentaje_asistencia) || '%, Nota: ' || "
                      "printf('%.2f', rend_nota_media) || ', Tendencia: ' || asist_tendencia || '/' || rend_tendencia")
    o["report_at_risk"] = on_students(f"""
SELECT nivel_riesgo_final, COUNT(*) OVER (PARTITION BY nivel_riesgo_final) AS total_nivel, IDEstudiante,
       {at_risk_detail} AS detalle
FROM students WHERE nivel_riesgo_final IN ('ALTO', 'MEDIO')""")
    o["student_list"] = on_students("""
SELECT IDEstudiante, CursoID, nivel_riesgo_final,
       'Asistencia: ' || printf('%.1f', asist_porcentaje_asistencia) || '% | Nota: ' || printf('%.2f', rend_nota_media)
         AS detalle FROM students""")
    gen = " UNION ALL ".join(f"SELECT {2 + i} AS orden, 'Recomendaciones Generales' AS seccion, {q(t)} AS texto"
                             for i, t in enumerate(GENERAL_RECOMMENDATIONS))
    o["report_recommendations"] = on_students(f"""
SELECT 0 AS orden, 'Acción Inmediata Requerida' AS seccion,
       'Hay ' || CAST(n AS VARCHAR) || ' estudiantes en RIESGO ALTO. ' || {q(RECOMMENDATIONS['ALTO_asistencia'])} AS texto
FROM (SELECT COUNT(*) FILTER (WHERE nivel_riesgo_final = 'ALTO') AS n FROM students) WHERE n > 0
UNION ALL
SELECT 1, 'Seguimiento Estrecho',
       'Hay ' || CAST(n AS VARCHAR) || ' estudiantes en RIESGO MEDIO. ' || {q(RECOMMENDATIONS['MEDIO_asistencia'])}
FROM (SELECT COUNT(*) FILTER (WHERE nivel_riesgo_final = 'MEDIO') AS n FROM students) WHERE n > 0
UNION ALL {gen}""")

    # -- clustering helpers with fixed stand-in labels --------------------------
    feats = ("asist_porcentaje_asistencia", "rend_nota_media", "asist_faltas", "asist_retrasos", "rend_n_evaluaciones")
    o["ml_features"] = on_students("SELECT IDEstudiante, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in feats)
                                   + " FROM students")
    def dec(x):
        return f"CAST(CAST({x} AS DOUBLE) AS DECIMAL(28,8))"

    o["ml_impute"] = with_(*BASE, ("students", students_sql("att", "gr", True)), body=(
        "SELECT IDEstudiante, " + ", ".join(
            f"COALESCE(CAST({c} AS DOUBLE), CAST(SUM({dec(c)}) OVER () AS DOUBLE) / CAST(COUNT({c}) OVER () AS DOUBLE)) AS {c}"
            for c in feats) + " FROM students"))
    scaled = []
    for c in feats:
        total, n = f"CAST(SUM({dec(c)}) OVER () AS DOUBLE)", f"CAST(COUNT({c}) OVER () AS DOUBLE)"
        square = f"CAST(SUM({dec(f'CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)')}) OVER () AS DOUBLE)"
        std = f"sqrt(({square} - {total} * {total} / {n}) / {n})"
        scaled.append(f"CASE WHEN MIN({c}) OVER () = MAX({c}) OVER () THEN 0.0{D} "
                      f"ELSE (CAST({c} AS DOUBLE) - {total} / {n}) / {std} END AS {c}")
    o["ml_scale"] = on_students("SELECT IDEstudiante, " + ", ".join(scaled) + " FROM students")
    scores = """
SELECT Cluster, score_medio, CAST(row_number() OVER (ORDER BY score_medio, Cluster) - 1 AS INTEGER) AS rango FROM (
  SELECT Cluster, CAST(SUM(CAST(round_even((asist_porcentaje_asistencia + rend_nota_media * 10.0::DOUBLE) * 100.0::DOUBLE, 0)
         AS BIGINT)) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) / 100.0::DOUBLE AS score_medio
  FROM (SELECT *, CAST(CAST(IDEstudiante AS BIGINT) % 3 AS INTEGER) AS Cluster FROM students) GROUP BY Cluster)"""
    o["cluster_scores"] = on_students(scores)
    labelled = f"""
SELECT s.IDEstudiante, CAST(CAST(s.IDEstudiante AS BIGINT) % 3 AS INTEGER) AS Cluster,
       COALESCE((['ALTO', 'MEDIO', 'ALERTA', 'OPTIMO'])[r.rango + 1], 'OPTIMO') AS NivelRiesgoML
FROM students s JOIN ({scores}) r ON CAST(CAST(s.IDEstudiante AS BIGINT) % 3 AS INTEGER) = r.Cluster"""
    o["ml_risk_label"] = on_students(labelled)
    o["cluster_distribution"] = on_students(f"""
SELECT Cluster, NivelRiesgoML, COUNT(*) AS estudiantes,
       {pct_label('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS porcentaje
FROM ({labelled}) GROUP BY Cluster, NivelRiesgoML""")

    o["ml_join"] = on_students(f"""
SELECT s.IDEstudiante, s.CursoID, s.nivel_riesgo_final, l.Cluster, l.NivelRiesgoML
FROM students s LEFT JOIN ({labelled}) l ON s.IDEstudiante = l.IDEstudiante""")
    def on_clusters(body: str, ks=(3,), scored: bool = False) -> str:
        parts = kmeans_sql.clustering("SELECT IDEstudiante, " + ", ".join(scaled) + " FROM students", feats, list(ks))
        if scored:
            parts += kmeans_sql.silhouettes(list(ks))
        return "WITH RECURSIVE " + with_(*BASE, STUDENTS, *parts, body=body).removeprefix("WITH ")

    by_cluster = scores.replace("SELECT *, CAST(CAST(IDEstudiante AS BIGINT) % 3 AS INTEGER) AS Cluster FROM students",
                                "SELECT s.*, l.Cluster FROM students s JOIN labels l ON s.IDEstudiante = l.IDEstudiante")
    predicted = f"""
SELECT l.IDEstudiante, l.Cluster, COALESCE((['ALTO', 'MEDIO', 'ALERTA', 'OPTIMO'])[r.rango + 1], 'OPTIMO') AS NivelRiesgoML
FROM labels l JOIN ({by_cluster}) r ON l.Cluster = r.Cluster"""
    o["ml_kmeans"] = on_clusters(predicted)
    o["report_ml"] = on_clusters(f"""
SELECT Cluster, NivelRiesgoML, COUNT(*) AS estudiantes,
       {pct_label('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS porcentaje
FROM ({predicted}) GROUP BY Cluster, NivelRiesgoML""")
    o["ml_result"] = on_clusters(f"""
SELECT true AS exito, 'OK' AS mensaje, 3 AS n_clusters, s.silhouette, s.silhouette_sq, f.coste,
       [{', '.join(map(q, feats))}] AS features_usados, (SELECT COUNT(*) FROM students) AS n_estudiantes
FROM silhouettes s JOIN fits f ON s.k = f.k""", scored=True)
    o["best_k"] = on_clusters("""
SELECT s.k, s.silhouette, s.silhouette_sq, f.coste, row_number() OVER (ORDER BY s.silhouette DESC, s.k) = 1 AS elegido
FROM silhouettes s JOIN fits f ON s.k = f.k""", ks=range(2, 9), scored=True)
    o["student_analysis_ml"] = on_clusters("SELECT " + ", ".join(
        f's.{c} AS "{lab}"' for c, lab in labels.items()) + f', p.NivelRiesgoML AS "Nivel Riesgo ML", p.Cluster AS "Cluster ML" FROM students s JOIN ({predicted}) p ON s.IDEstudiante = p.IDEstudiante')
    o["ml_kmeans_levels"] = on_students(
        "SELECT 3 AS clusters, COUNT(*) AS estudiantes, true AS niveles_en_orden FROM students")
    strict_a, strict_g = (60.0, 70.0, 80.0), (3.0, 5.0, 8.0)
    o["thresholds_json"] = on_students(f"""
SELECT IDEstudiante, a AS nivel_riesgo_asistencia, g AS nivel_riesgo_rendimiento, {combined('a', 'g')} AS nivel_riesgo_final
FROM (SELECT IDEstudiante,
             CASE WHEN nivel_riesgo_asistencia = 'SIN_DATOS' THEN 'SIN_DATOS'
                  ELSE {risk_att('asist_porcentaje_asistencia', *strict_a)} END AS a,
             CASE WHEN nivel_riesgo_rendimiento = 'SIN_DATOS' THEN 'SIN_DATOS'
                  ELSE {risk_gr('rend_nota_media', *strict_g)} END AS g FROM students)""")

    # -- files in and out --------------------------------------------------------
    o["csv_dialect_profile"] = "SELECT ';' AS delimitador, 'ISO-8859-1' AS encoding, COUNT(*) AS lineas FROM events"
    o["csv_quoted_fields"] = """
SELECT CAST(event_id AS VARCHAR) AS id, 'dijo "' || coalesce(event_type, 'nada') || '"' ||
       CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) || 'alumno; ' || CAST(user_id AS VARCHAR) || ', fin' ELSE '' END AS Observaciones,
       CAST(user_id AS VARCHAR) AS alumno FROM events"""
    o["require_columns"] = """
SELECT carpeta, columna, columna <> 'Peso' AS obligatoria, usada IS NOT NULL AS presente, usada
FROM (VALUES ('click', 'IDEstudiante', 'IDEstudiante'), ('click', 'CursoID', 'curso'), ('click', 'Nota', 'nota'), ('click', 'Peso', NULL),
             ('error', 'IDEstudiante', 'id_estudiante'), ('error', 'CursoID', NULL), ('error', 'Nota', NULL), ('error', 'Peso', NULL),
             ('otros', 'IDEstudiante', 'EstudianteID'), ('otros', 'CursoID', NULL), ('otros', 'Nota', 'Calificacion'),
             ('otros', 'Peso', 'Ponderacion')) t(carpeta, columna, usada)
WHERE carpeta IN (SELECT CASE WHEN event_type IN ('click', 'error') THEN event_type ELSE 'otros' END FROM events)"""
    o["thresholds_validate"] = """
SELECT nombre, r AS asistencia_riesgo, a AS nota_aprobado, len(v)::INTEGER AS reglas,
       array_to_string(list_transform(v, lambda x: 'umbral no válido: se exige ' || x), ' | ') AS violaciones
FROM (SELECT *, list_filter([CASE WHEN NOT r < 85 THEN 'asistencia_riesgo < asistencia_alerta' END, CASE WHEN NOT 0 <= r THEN '0 <= asistencia_riesgo' END,
        CASE WHEN NOT r <= 100 THEN 'asistencia_riesgo <= 100' END, CASE WHEN NOT a <= 10 THEN 'nota_aprobado <= 10' END,
        CASE WHEN NOT 2 <= k THEN '2 <= ml_n_clusters' END], lambda x: x IS NOT NULL) AS v
  FROM (SELECT 'conjunto ' || CAST(s_suppkey AS VARCHAR) AS nombre, CAST(s_suppkey % 120 - 10 AS DOUBLE) AS r,
               CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 13 AS DOUBLE) ELSE 5.0::DOUBLE END AS a, s_suppkey % 4 AS k FROM supplier))"""
    o["read_csv_robust"] = with_(ATT_TEXT, ATT_PARSED, ATT_LOADED, body=(
        "SELECT IDEstudiante, CursoID, Fecha, Presente, Retraso, FaltaJustificada FROM att_loaded"))
    o["stream_ingest_attendance"] = with_(ATT_TEXT, ATT_PARSED, ATT_LOADED, body=am_sql("att_loaded"))
    o["stream_running_stats"] = with_(ATT_TEXT, ATT_PARSED, body="""
SELECT COUNT(*) AS registros, COUNT(DISTINCT CursoID)::INTEGER AS cursos_unicos, MIN(Fecha) AS fecha_min, MAX(Fecha) AS fecha_max
FROM att_parsed""")
    o["write_report_tables"] = " UNION ALL ".join(
        f"SELECT {q(t)} AS tabla, COUNT(*) AS filas FROM ({o[name]})" for t, name in (
            ("estudiantes", "student_analysis"), ("cursos", "report_courses"), ("resumen", "summary"),
            ("distribucion", "report_summary"), ("en_riesgo", "report_at_risk"),
            ("recomendaciones", "report_recommendations"), ("listado", "report_students")))

    o["report_set"] = o["write_report_tables"]

    # -- extras ----------------------------------------------------------------
    o["feature_ratios"] = on_students("""
SELECT IDEstudiante,
  CASE WHEN asist_sesiones_totales = 0 THEN NULL ELSE CAST(asist_faltas AS DOUBLE) / CAST(asist_sesiones_totales AS DOUBLE) END AS ratio_faltas,
  CASE WHEN asist_sesiones_totales = 0 THEN NULL ELSE CAST(asist_retrasos AS DOUBLE) / CAST(asist_sesiones_totales AS DOUBLE) END AS ratio_retrasos
FROM students""")
    o["perf_attendance_ratio"] = on_students(f"""
SELECT IDEstudiante, CASE WHEN asist_porcentaje_asistencia / 10.0{D} = 0 THEN NULL
       ELSE rend_nota_media / (asist_porcentaje_asistencia / 10.0{D}) END AS ratio_rend_asist FROM students""")
    o["manual_risk_score"] = on_students(f"""
SELECT IDEstudiante, CAST(
  (nivel_riesgo_asistencia <> 'SIN_DATOS' AND asist_porcentaje_asistencia < 75.0{D})::INT
  + (nivel_riesgo_rendimiento <> 'SIN_DATOS' AND rend_nota_media < 4.0{D})::INT
  + (asist_faltas_justificadas > 3)::INT + (asist_faltas_injustificadas > 1)::INT + (asist_retrasos > 5)::INT
  AS INTEGER) AS puntuacion_riesgo FROM students""")
    o["absence_limits"] = on_students("""
SELECT IDEstudiante, asist_faltas_justificadas > 3 AS exceso_justificadas,
       asist_faltas_injustificadas > 1 AS exceso_injustificadas, asist_retrasos > 5 AS exceso_retrasos FROM students""")
    o["sample_sufficiency"] = on_students("""
SELECT IDEstudiante, rend_n_evaluaciones >= 3 AS evaluaciones_suficientes,
       asist_sesiones_totales >= 10 AS sesiones_suficientes FROM students""")
    wm = "CASE WHEN SUM(Peso) = 0 THEN NULL ELSE SUM(Nota * Peso) / SUM(Peso) END"
    ce = ", ".join(f"{R2(wm.replace('Nota', f'(CASE WHEN Competencia = {q(c)} THEN Nota END)').replace('Peso', f'(CASE WHEN Competencia = {q(c)} THEN Peso END)'))} AS {c}"
                   for c, *_ in COMPETENCIES)
    o["competency_metrics"] = with_(GR_RAW, GR, body=f"SELECT IDEstudiante, {ce} FROM gr GROUP BY IDEstudiante")
    sets = [(75.0, 85.0, 95.0, 4.0, 6.0, 8.0), (70.0, 80.0, 90.0, 4.0, 6.0, 8.0), (75.0, 85.0, 95.0, 3.0, 5.0, 7.0)]
    parts = []
    for i, (r, a, op, nr, na, ne) in enumerate(sets):
        la = f"CASE WHEN nivel_riesgo_asistencia = 'SIN_DATOS' THEN 'SIN_DATOS' ELSE {risk_att('asist_porcentaje_asistencia', r, a, op)} END"
        lg = f"CASE WHEN nivel_riesgo_rendimiento = 'SIN_DATOS' THEN 'SIN_DATOS' ELSE {risk_gr('rend_nota_media', nr, na, ne)} END"
        parts.append(f"SELECT {i} AS conjunto, {combined(la, lg)} AS nivel FROM students")
    o["threshold_what_if"] = on_students(f"""
SELECT s.conjunto, lv.nivel, COUNT(x.nivel) AS estudiantes
FROM (VALUES (0), (1), (2)) s(conjunto) CROSS JOIN (VALUES ('ALTO'), ('MEDIO'), ('ALERTA'), ('OPTIMO')) lv(nivel)
LEFT JOIN ({' UNION ALL '.join(parts)}) x ON x.conjunto = s.conjunto AND x.nivel = lv.nivel
GROUP BY s.conjunto, lv.nivel""")
    a, g = [f"CASE WHEN {level} = 'SIN_DATOS' THEN 'SIN_DATOS' WHEN {v} < t.{r} THEN 'ALTO' WHEN {v} < t.{al} THEN 'MEDIO' "
            f"WHEN {v} < t.{best} THEN 'ALERTA' ELSE 'OPTIMO' END" for level, v, r, al, best in (
                ("nivel_riesgo_asistencia", "asist_porcentaje_asistencia", "ar", "aa", "ao"),
                ("nivel_riesgo_rendimiento", "rend_nota_media", "nr", "na", "ne"))]
    k = "CAST(p_partkey AS BIGINT)"
    o["threshold_what_if_many"] = on_students(f"""
SELECT s.conjunto, lv.nivel, COUNT(x.nivel) AS estudiantes
FROM (SELECT {k} AS conjunto FROM part) s CROSS JOIN (VALUES ('ALTO'), ('MEDIO'), ('ALERTA'), ('OPTIMO')) lv(nivel)
LEFT JOIN (
  SELECT conjunto, {combined('la', 'lg')} AS nivel FROM (SELECT t.conjunto, {a} AS la, {g} AS lg FROM students CROSS JOIN (
    SELECT {k} AS conjunto, CAST({k} * 37 % 1100 AS DOUBLE) / 10.0{D} - 5.0{D} AS ar, CAST({k} * 53 % 10007 AS DOUBLE) / 100.0{D} AS aa,
           CAST({k} * 71 % 100003 AS DOUBLE) / 1000.0{D} AS ao, CAST({k} * 17 % 130 AS DOUBLE) / 10.0{D} - 1.0{D} AS nr,
           CAST({k} * 29 % 1009 AS DOUBLE) / 100.0{D} AS na, CAST({k} * 41 % 10009 AS DOUBLE) / 1000.0{D} AS ne FROM part) t)) x
  ON x.conjunto = s.conjunto AND x.nivel = lv.nivel
GROUP BY s.conjunto, lv.nivel""")
    return o


COURSE_SQL = f"""
SELECT CursoID AS curso_id, COUNT(IDEstudiante) AS estudiantes,
       {R2(mean2('asist_porcentaje_asistencia'))} AS porcentaje_medio,
       {R2('MIN(asist_porcentaje_asistencia)')} AS porcentaje_min, {R2('MAX(asist_porcentaje_asistencia)')} AS porcentaje_max,
       {R2(mean2('rend_nota_media'))} AS rend_nota_media,
       {R2("CAST(COUNT(*) FILTER (WHERE rend_aprobado) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) * 100.0::DOUBLE")}
         AS rend_tasa_aprobados,
       COUNT(*) FILTER (WHERE nivel_riesgo_final = 'ALTO') AS estudiantes_riesgo_alto,
       COUNT(*) FILTER (WHERE nivel_riesgo_rendimiento = 'ALTO') AS rend_estudiantes_riesgo_alto
FROM students GROUP BY CursoID"""


ORACLE_SQL = build()
