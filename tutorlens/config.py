"""Configuration: thresholds and the fixed vocabularies of the domain.

Everything below the FIXED VALUES marker must keep exactly these values for the
results (level names, thresholds, column names, tokens, texts) to be right.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (domain constants; keep verbatim)
# ---------------------------------------------------------------------------

DEFAULT_THRESHOLDS: dict[str, float] = {
    "asistencia_riesgo": 75.0,
    "asistencia_alerta": 85.0,
    "asistencia_optima": 95.0,
    "nota_aprobado": 5.0,
    "nota_riesgo": 4.0,
    "nota_alerta": 6.0,
    "nota_excelente": 8.0,
    "competencia_riesgo": 2.0,
    "competencia_alerta": 2.5,
    "competencia_optima": 3.5,
    "max_faltas_justificadas": 3,
    "max_faltas_injustificadas": 1,
    "max_retrasos": 5,
    "min_evaluaciones": 3,
    "min_sesiones": 10,
    "ml_n_clusters": 3,
    "ml_min_samples": 5,
    "ml_test_size": 0.2,
    "ml_random_state": 42,
    "tendencia_positiva": 5.0,
    "tendencia_negativa": -5.0,
}

# Risk levels: name, severity code, colour, emoji, description.
RISK_LEVELS: list[tuple[str, int, str, str, str]] = [
    ("ALTO", 3, "FF0000", "\U0001F534", "Riesgo Alto - Requiere intervención inmediata"),
    ("MEDIO", 2, "FFA500", "\U0001F7E0", "Riesgo Medio - Requiere seguimiento estrecho"),
    ("ALERTA", 1, "FFFF00", "\U0001F7E1", "Alerta - Requiere monitorización"),
    ("OPTIMO", 0, "00FF00", "\U0001F7E2", "Óptimo - Sin intervención necesaria"),
]
NO_DATA = "SIN_DATOS"

# Row labels of the risk distribution table, in report order.
DISTRIBUTION_LABELS: list[tuple[str, str]] = [
    ("ALTO", "RIESGO ALTO"),
    ("MEDIO", "RIESGO MEDIO"),
    ("ALERTA", "ALERTA"),
    ("OPTIMO", "ÓPTIMO"),
]


COMPETENCIES: list[tuple[str, str, str]] = [
    ("CE1", "Resolución de problemas motrices", "Capacidad para resolver situaciones motrices variadas"),
    ("CE2", "Gestión de vida activa y saludable", "Adopción de hábitos de vida saludable y actividad física"),
    ("CE3", "Interacción social y cooperación", "Habilidades sociales y trabajo en equipo"),
    ("CE4", "Expresión corporal y creatividad", "Expresión a través del movimiento y creatividad motriz"),
    ("CE5", "Valoración crítica y reflexión", "Análisis crítico de la actividad física y deporte"),
]

ATTENDANCE_REQUIRED = ["IDEstudiante", "CursoID", "Fecha", "Presente"]
ATTENDANCE_OPTIONAL = ["Retraso", "FaltaJustificada", "Observaciones"]
GRADES_REQUIRED = ["Nota"]

# Standard grade column -> accepted alternative names, first match wins.
GRADE_COLUMN_ALTERNATIVES: dict[str, list[str]] = {
    "IDEstudiante": ["IDEstudiante", "id_estudiante", "EstudianteID"],
    "NombreEstudiante": ["NombreEstudiante", "nombre_estudiante", "Nombre", "nombre"],
    "CursoID": ["CursoID", "curso_id", "Curso", "CursoEvaluado", "curso"],
    "Evaluacion": ["Evaluacion", "evaluacion", "NombreInstrumento", "Instrumento", "instrumento"],
    "Nota": ["Nota", "nota", "PuntuacionCriterio", "CalificacionTotalInstrumento", "Calificacion", "calificacion"],
    "Fecha": ["Fecha", "fecha", "FechaEvaluacion", "fecha_evaluacion"],
    "Competencia": ["Competencia", "competencia", "NombreCriterioEvaluado", "Criterio"],
    "Peso": ["Peso", "peso", "ponderacion", "Ponderacion"],
}

CSV_DELIMITERS = [",", ";", "\t", "|"]
# Only these two are distinguishable: ISO-8859-1 decodes any byte sequence.
DEFAULT_DIALECT = (",", "UTF-8")

SENSITIVE_COLUMNS = ["NombreEstudiante", "Nombre", "Apellido", "Email", "Telefono", "Direccion"]

# Text read as True in flag columns (compared after lower-casing and trimming).
TRUE_TOKENS = ["true", "1", "sí", "si", "yes", "t", "verdadero", "x"]

# Null tokens: the caller's list '', 'NA', 'N/A', 'null', 'None' on top of the
# default missing-value strings of the pandas CSV reader.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Accepted date shapes, day-first (Spark datetime patterns, one digit or two),
# with the regular expression of the text each one reads.
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy"]
DATE_SHAPES = [r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}",
               r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"]
TIMESTAMP_SUFFIXES = [" H:m:s", " H:m", "'T'H:m:s"]
TIMESTAMP_SUFFIX_SHAPES = [r" [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}", r" [0-9]{1,2}:[0-9]{1,2}", r"T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"]

DEFAULT_COURSE = "CURSO01"
DEFAULT_EVALUATION = "Eval1"
ID_PREFIX = "EST"

# Rename of the per-student metric columns after the outer join.
PREFIX_RENAMES: dict[str, str] = {
    "nivel_riesgo_asist": "nivel_riesgo_asistencia",
    "nivel_riesgo_rend": "nivel_riesgo_rendimiento",
    "porcentaje_asistencia": "asist_porcentaje_asistencia",
    "nota_media": "rend_nota_media",
    "n_evaluaciones": "rend_n_evaluaciones",
    "tendencia_asist": "asist_tendencia",
    "tendencia_rend": "rend_tendencia",
    "faltas": "asist_faltas",
    "retrasos": "asist_retrasos",
    "sesiones_totales": "asist_sesiones_totales",
    "asistencias": "asist_asistencias",
    "faltas_justificadas": "asist_faltas_justificadas",
    "faltas_injustificadas": "asist_faltas_injustificadas",
    "nota_std": "rend_nota_std",
    "nota_min": "rend_nota_min",
    "nota_max": "rend_nota_max",
    "aprobado": "rend_aprobado",
}

# Display columns of the student list, and their labels.
DISPLAY_COLUMNS = [
    "IDEstudiante", "nivel_riesgo_final", "asist_porcentaje_asistencia", "asist_faltas",
    "asist_retrasos", "rend_nota_media", "rend_n_evaluaciones", "asist_tendencia", "rend_tendencia",
]
DISPLAY_LABELS: dict[str, str] = {
    "IDEstudiante": "ID Estudiante",
    "nivel_riesgo_final": "Nivel Riesgo",
    "NivelRiesgoML": "Nivel Riesgo ML",
    "Cluster": "Cluster ML",
    "asist_porcentaje_asistencia": "Asistencia %",
    "asist_faltas": "Faltas",
    "asist_retrasos": "Retrasos",
    "rend_nota_media": "Nota Media",
    "rend_n_evaluaciones": "N° Evaluaciones",
    "asist_tendencia": "Tendencia Asist.",
    "rend_tendencia": "Tendencia Rend.",
}

ML_FEATURES = [
    "asist_porcentaje_asistencia", "rend_nota_media", "asist_faltas", "asist_retrasos", "rend_n_evaluaciones",
]
ML_LEVELS = ["ALTO", "MEDIO", "ALERTA", "OPTIMO"]
ML_FALLBACK_LEVEL = "ALERTA"

RECOMMENDATIONS = {
    "ALTO_asistencia": "\U0001F534 URGENTE: Contactar a familias inmediatamente. "
                       "Considerar plan de seguimiento personalizado.",
    "ALTO_rendimiento": "\U0001F534 URGENTE: Revisar metodología y adaptar actividades. "
                        "Plantear refuerzo individual o en pequeño grupo.",
    "MEDIO_asistencia": "\U0001F7E0 IMPORTANTE: Comunicar con familias. "
                        "Investigar causas y establecer plan de mejora.",
    "MEDIO_rendimiento": "\U0001F7E0 IMPORTANTE: Revisar estrategias didácticas. "
                         "Considerar adaptaciones curriculares.",
    "ALERTA": "\U0001F7E1 Mantener seguimiento cercano. Prevenir deterioro mediante monitorización.",
}
RECOMMENDATION_HEADINGS = {"ALTO": "Acción Inmediata Requerida", "MEDIO": "Seguimiento Estrecho"}
RECOMMENDATION_LEAD = {"ALTO": "Hay {n} estudiantes en RIESGO ALTO. ", "MEDIO": "Hay {n} estudiantes en RIESGO MEDIO. "}
GENERAL_RECOMMENDATIONS = [
    "Revisar individualmente a cada estudiante en riesgo alto para identificar causas específicas.",
    "Establecer tutorías personalizadas para estudiantes con tendencias negativas.",
    "Comunicar los resultados con las familias de estudiantes en riesgo.",
    "Adaptar metodologías para mejorar la motivación y participación.",
    "Realizar seguimiento quincenal de estudiantes en riesgo medio y alto.",
    "Considerar adaptaciones curriculares cuando sea necesario.",
    "Reforzar competencias específicas donde se detecten debilidades generalizadas.",
]

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

LEVEL_CODE = {name: code for name, code, *_ in RISK_LEVELS}
LEVELS_BY_SEVERITY = [name for name, *_ in sorted(RISK_LEVELS, key=lambda r: r[1])]  # OPTIMO..ALTO


def thresholds(custom: dict | None = None) -> dict:
    """Defaults overlaid with ``custom`` (unknown keys are kept, like a dict update)."""
    out = dict(DEFAULT_THRESHOLDS)
    if custom:
        out.update(custom)
    return out
