"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the test tables through ``sources.testdata`` (attendance from
``events``, grades from ``lineitem JOIN orders``) and runs the library's own
operators over the whole tables. Oracle SQL for the same names lives in
``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLDS, thresholds
from ..functions.scalars import (format_fixed, null_tokens, parse_bool, parse_date, parse_grade, parse_weight,
                                 normalize_competency, risk_attendance, risk_combined, risk_grade, round2)
from ..operators import clean, combine, courses, extras, metrics, ml, reports
from ..sources import testdata as td

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def att(spark, sf):
    return clean.clean_attendance(td.attendance_raw(spark, sf))


def gr(spark, sf):
    return clean.clean_grades(td.grades_raw(spark, sf))


def am(spark, sf):
    return metrics.attendance_metrics(att(spark, sf))


def gm(spark, sf):
    return metrics.grade_metrics(gr(spark, sf))


def students(spark, sf, missing_as_null=False):
    return combine.student_table(att(spark, sf), gr(spark, sf), missing_as_null=missing_as_null)


GRADE_COLS = ["IDEstudiante", "CursoID", "Evaluacion", "Competencia", "Nota", "Peso", "Fecha"]
ATT_COLS = ["IDEstudiante", "CursoID", "Fecha", "Presente", "Retraso", "FaltaJustificada"]


# ---------------------------------------------------------------------------
# 2.A / 2.B / 2.C  parsing, cleaning, loading
# ---------------------------------------------------------------------------

@query("null_tokens")
def q_null_tokens(spark, sf):
    t = td.attendance_text(spark, sf)
    return t.select(F.col("_rid").alias("event_id"), null_tokens("IDEstudiante").alias("IDEstudiante"),
                    null_tokens("Presente").alias("Presente"), null_tokens("Fecha").alias("Fecha"))


@query("parse_bool")
def q_parse_bool(spark, sf):
    t = td.attendance_text(spark, sf)
    return t.select(F.col("_rid").alias("event_id"), F.col("Presente").alias("texto"),
                    parse_bool("Presente").alias("Presente"), parse_bool("Retraso").alias("Retraso"),
                    parse_bool("FaltaJustificada").alias("FaltaJustificada"))


@query("parse_date")
def q_parse_date(spark, sf):
    t = td.attendance_text(spark, sf)
    return t.select(F.col("_rid").alias("event_id"), F.col("Fecha").alias("texto"), parse_date("Fecha").alias("Fecha"))


@query("parse_grade")
def q_parse_grade(spark, sf):
    t = td.grades_text(spark, sf)
    return t.select(F.col("_rid.fila").alias("fila"), F.col("nota").alias("texto"), parse_grade("nota").alias("Nota"))


@query("parse_weight")
def q_parse_weight(spark, sf):
    t = td.grades_text(spark, sf)
    return t.select(F.col("_rid.fila").alias("fila"), F.col("ponderacion").alias("texto"),
                    parse_weight("ponderacion").alias("Peso"))


@query("normalize_competency")
def q_normalize_competency(spark, sf):
    g = td.grades_raw(spark, sf)
    return g.select("IDEstudiante", F.col("Competencia").alias("texto"),
                    normalize_competency("Competencia").alias("Competencia"))


@query("filter_grade_range")
def q_filter_grade_range(spark, sf):
    t = clean.map_columns(clean.apply_null_tokens(td.grades_text(spark, sf)))
    parsed = clean.parse_grades(t)
    return clean.filter_grade_range(parsed).select(F.col("_rid.fila").alias("fila"), "Nota")


@query("dedup_attendance")
def q_dedup_attendance(spark, sf):
    return att(spark, sf).select(*ATT_COLS, F.col("_rid").alias("event_id"))


@query("dedup_grades")
def q_dedup_grades(spark, sf):
    return gr(spark, sf).select(*GRADE_COLS)


@query("default_flags")
def q_default_flags(spark, sf):
    """Attendance without the optional flag columns: both become False."""
    raw = td.attendance_raw(spark, sf).drop("Retraso", "FaltaJustificada")
    return clean.parse_attendance(raw).select("IDEstudiante", "Fecha", "Presente", "Retraso", "FaltaJustificada",
                                              F.col("_rid").alias("event_id"))


@query("sort_by_date")
def q_sort_by_date(spark, sf):
    """Cleaned attendance in date order (missing dates last, then input order): a range-partitioned sort."""
    from ..operators.metrics import input_order
    a = att(spark, sf)
    return a.orderBy(*input_order(a)).select(*ATT_COLS, F.col("_rid").alias("event_id"))


@query("map_columns")
def q_map_columns(spark, sf):
    return clean.map_columns(td.grades_text(spark, sf)).drop("_rid")


@query("gen_student_id")
def q_gen_student_id(spark, sf):
    t = clean.gen_student_id(td.grades_text(spark, sf))
    return t.select("NombreEstudiante", "IDEstudiante").distinct()


@query("gen_course_evaluation")
def q_gen_course_evaluation(spark, sf):
    g = td.grades_raw(spark, sf).drop("CursoID", "Evaluacion")
    return clean.gen_evaluation(clean.gen_course_id(g)).select("IDEstudiante", "CursoID", "Evaluacion", "Nota")


@query("anonymize")
def q_anonymize(spark, sf):
    return clean.anonymize(clean.map_columns(td.grades_text(spark, sf))).drop("_rid")


@query("load_attendance")
def q_load_attendance(spark, sf):
    return clean.prepare_attendance(clean.apply_null_tokens(td.attendance_text(spark, sf))).select(
        *ATT_COLS, "Observaciones")


@query("load_grades")
def q_load_grades(spark, sf):
    return clean.prepare_grades(clean.apply_null_tokens(td.grades_text(spark, sf))).select(*GRADE_COLS)


@query("quality_attendance")
def q_quality_attendance(spark, sf):
    return clean.attendance_quality(clean.apply_null_tokens(td.attendance_text(spark, sf)))


@query("quality_grades")
def q_quality_grades(spark, sf):
    return clean.grade_quality(clean.gen_evaluation(clean.gen_course_id(clean.gen_student_id(
        clean.map_columns(clean.apply_null_tokens(td.grades_text(spark, sf)))))))


@query("load_stats_attendance")
def q_load_stats_attendance(spark, sf):
    return clean.attendance_stats(att(spark, sf))


@query("load_stats_grades")
def q_load_stats_grades(spark, sf):
    return clean.grade_stats(gr(spark, sf))


@query("common_students")
def q_common_students(spark, sf):
    return clean.common_values(att(spark, sf), gr(spark, sf), "IDEstudiante")


@query("common_courses")
def q_common_courses(spark, sf):
    return clean.common_values(att(spark, sf), gr(spark, sf), "CursoID")


@query("all_students")
def q_all_students(spark, sf):
    return clean.all_values(att(spark, sf), gr(spark, sf), "IDEstudiante")


@query("cross_validate")
def q_cross_validate(spark, sf):
    return clean.cross_validate(att(spark, sf), gr(spark, sf))


# ---------------------------------------------------------------------------
# 2.D / 2.E / 2.F  metrics, trends, levels
# ---------------------------------------------------------------------------

@query("attendance_metrics")
def q_attendance_metrics(spark, sf):
    return am(spark, sf)


@query("justified_absences")
def q_justified_absences(spark, sf):
    return metrics.attendance_counts(att(spark, sf)).select(
        "IDEstudiante", "faltas", "faltas_justificadas", "faltas_injustificadas")


@query("grade_metrics")
def q_grade_metrics(spark, sf):
    return gm(spark, sf)


@query("weighted_mean")
def q_weighted_mean(spark, sf):
    g = gr(spark, sf)
    return g.groupBy("IDEstudiante").agg(
        metrics.weighted_mean().alias("nota_ponderada"), metrics.plain_mean().alias("nota_simple"))


@query("trend_attendance")
def q_trend_attendance(spark, sf):
    return metrics.attendance_trend(att(spark, sf))


@query("trend_grades")
def q_trend_grades(spark, sf):
    return metrics.grade_trend(gr(spark, sf))


@query("trend_grades_text")
def q_trend_grades_text(spark, sf):
    """Trend over grades loaded from text: missing dates sort last."""
    return metrics.grade_trend(clean.prepare_grades(clean.apply_null_tokens(td.grades_text(spark, sf))))


@query("current_course")
def q_current_course(spark, sf):
    return metrics.current_course(att(spark, sf))


@query("current_course_grades")
def q_current_course_grades(spark, sf):
    return metrics.current_course_grades(gr(spark, sf))


@query("round2")
def q_round2(spark, sf):
    li = td.table(spark, sf, "lineitem")
    v = F.col("l_extendedprice") * F.col("l_discount")
    return li.select("l_orderkey", "l_linenumber", v.alias("valor"), round2(v).alias("valor_2dp"),
                     format_fixed(v, 1).alias("valor_1dp_texto"))


@query("risk_attendance")
def q_risk_attendance(spark, sf):
    a = metrics.attendance_counts(att(spark, sf))
    strict = thresholds({"asistencia_riesgo": 60.0, "asistencia_alerta": 70.0, "asistencia_optima": 80.0})
    return a.select("IDEstudiante", "porcentaje_asistencia",
                    risk_attendance("porcentaje_asistencia").alias("nivel_riesgo"),
                    risk_attendance("porcentaje_asistencia", strict).alias("nivel_riesgo_umbral_bajo"))


@query("risk_grade")
def q_risk_grade(spark, sf):
    g = metrics.grade_aggregates(gr(spark, sf))
    return g.select("IDEstudiante", "nota_media", risk_grade("nota_media").alias("nivel_riesgo"))


@query("risk_combined")
def q_risk_combined(spark, sf):
    c = combine.classify_students(am(spark, sf), gm(spark, sf), sort=False)
    return c.select("IDEstudiante", "nivel_riesgo_asistencia", "nivel_riesgo_rendimiento",
                    risk_combined("nivel_riesgo_asistencia", "nivel_riesgo_rendimiento").alias("nivel_riesgo_final"))


def classify(spark, sf):
    return combine.classify_students(am(spark, sf), gm(spark, sf))


@query("level_metadata")
def q_level_metadata(spark, sf):
    s = students(spark, sf).select("IDEstudiante", "nivel_riesgo_final")
    return courses.level_metadata(s, "nivel_riesgo_final")


@query("competency_metadata")
def q_competency_metadata(spark, sf):
    return extras.competency_names(gr(spark, sf)).groupBy("Competencia", "competencia_nombre").agg(
        F.count(F.lit(1)).alias("evaluaciones"))


# ---------------------------------------------------------------------------
# 2.G  joins and the student table
# ---------------------------------------------------------------------------

@query("combine_students")
def q_combine_students(spark, sf):
    return combine.combine_students(am(spark, sf), gm(spark, sf))


@query("combine_students_nulls")
def q_combine_students_nulls(spark, sf):
    return combine.combine_students(am(spark, sf), gm(spark, sf), missing_as_null=True)


@query("assign_course")
def q_assign_course(spark, sf):
    """Course lookup as two per-student aggregates joined onto the combined table."""
    a, g = att(spark, sf), gr(spark, sf)
    comb = combine.combine_students(metrics.attendance_metrics(a), metrics.grade_metrics(g))
    return combine.assign_course(comb, a, g).select("IDEstudiante", "CursoID")


@query("student_analysis")
def q_student_analysis(spark, sf):
    return students(spark, sf)


@query("full_analysis")
def q_full_analysis(spark, sf):
    """The composed plan (``plans.analysis.analyze_raw``): raw tables -> student table."""
    from .analysis import analyze_raw
    return analyze_raw(td.attendance_raw(spark, sf), td.grades_raw(spark, sf)).students


@query("classify_students")
def q_classify_students(spark, sf):
    return classify(spark, sf)


# ---------------------------------------------------------------------------
# 2.D aggregates over students / 2.H / 2.J reports
# ---------------------------------------------------------------------------

@query("course_metrics")
def q_course_metrics(spark, sf):
    return courses.course_metrics(students(spark, sf))


@query("summary")
def q_summary(spark, sf):
    return courses.summary(students(spark, sf))


@query("risk_distribution")
def q_risk_distribution(spark, sf):
    return courses.risk_distribution(students(spark, sf))


@query("attendance_summary")
def q_attendance_summary(spark, sf):
    return courses.attendance_summary(am(spark, sf))


@query("grade_summary")
def q_grade_summary(spark, sf):
    return courses.grade_summary(gm(spark, sf))


@query("distinct_counts")
def q_distinct_counts(spark, sf):
    g = gr(spark, sf)
    return g.agg(F.countDistinct("IDEstudiante").alias("estudiantes"), F.countDistinct("CursoID").alias("cursos"),
                 F.countDistinct("Evaluacion").alias("evaluaciones"))


@query("distinct_counts_sketch")
def q_distinct_counts_sketch(spark, sf):
    """Sketches by course and day of both sides merged, beside the exact counts: is each estimate within four standard errors?"""
    from ..operators.sketches import COUNTED, STANDARD_ERROR, merged_stats, partial_stats
    out = None
    for side, df in (("asistencia", att(spark, sf)), ("calificaciones", gr(spark, sf))):
        names = [n for c, n in COUNTED.items() if c in df.columns]
        near = merged_stats(partial_stats(df, ["CursoID", "Fecha"]))
        exact = df.agg(*[F.countDistinct(c).alias(f"_{n}") for c, n in COUNTED.items() if c in df.columns])
        rows = near.crossJoin(exact).select(F.lit(side).alias("tabla"), "registros", F.inline(F.array(*[   # two tables of one row
            F.struct(F.lit(n).alias("medida"), F.col(f"_{n}").alias("exacto"),
                     (F.abs(F.col(n) - F.col(f"_{n}")) <= F.greatest(F.lit(1.0), 4 * STANDARD_ERROR * F.col(f"_{n}"))).alias("dentro"))
            for n in names])))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("filter_course")
def q_filter_course(spark, sf):
    from .analysis import analyze
    return analyze(att(spark, sf), gr(spark, sf), course="C1").students


@query("filter_course_curated")
def q_filter_course_curated(spark, sf):
    """Cleaned tables kept by course; the analysis of one course reads that course's folders only."""
    from ..session import scratch_path
    from ..sources.sinks import read_course, write_by_course
    from .analysis import analyze
    kept = []
    for name, df in (("asistencia", att(spark, sf)), ("calificaciones", gr(spark, sf))):
        path = scratch_path(spark, f"{name}-por-curso")
        write_by_course(df, path)
        kept.append(read_course(spark, path, df.schema, "C1"))
    return analyze(*kept).students


@query("filter_risk_level")
def q_filter_risk_level(spark, sf):
    return reports.students_at_level(students(spark, sf), "ALTO")


@query("report_summary")
def q_report_summary(spark, sf):
    return reports.report_summary(students(spark, sf))


@query("report_courses")
def q_report_courses(spark, sf):
    return reports.report_courses(courses.course_metrics(students(spark, sf)))


@query("report_students")
def q_report_students(spark, sf):
    return reports.report_students(students(spark, sf))


@query("report_at_risk")
def q_report_at_risk(spark, sf):
    return reports.report_at_risk(students(spark, sf))


@query("report_recommendations")
def q_report_recommendations(spark, sf):
    return reports.report_recommendations(courses.summary(students(spark, sf)))


@query("student_list")
def q_student_list(spark, sf):
    return reports.student_list(students(spark, sf))


# ---------------------------------------------------------------------------
# 2.I  clustering
# ---------------------------------------------------------------------------

@query("ml_features")
def q_ml_features(spark, sf):
    return ml.features(students(spark, sf))


@query("ml_impute")
def q_ml_impute(spark, sf):
    return ml.impute_mean(ml.features(students(spark, sf, missing_as_null=True)))


@query("ml_scale")
def q_ml_scale(spark, sf):
    return ml.standardize(ml.features(students(spark, sf)))


def stand_in_clusters(s: DataFrame, k: int = 3) -> DataFrame:
    """Fixed cluster labels (numeric id modulo k) to check the labelling steps
    with SQL independently of the clustering itself."""
    return s.select("IDEstudiante", F.pmod(F.col("IDEstudiante").cast("long"), F.lit(k)).cast("int").alias("Cluster"))


@query("cluster_scores")
def q_cluster_scores(spark, sf):
    s = students(spark, sf)
    return ml.cluster_scores(ml.features(s), stand_in_clusters(s))


@query("ml_risk_label")
def q_ml_risk_label(spark, sf):
    s = students(spark, sf)
    return ml.label_clusters(ml.features(s), stand_in_clusters(s))


@query("cluster_distribution")
def q_cluster_distribution(spark, sf):
    s = students(spark, sf)
    return ml.cluster_distribution(ml.label_clusters(ml.features(s), stand_in_clusters(s)))


@query("ml_join")
def q_ml_join(spark, sf):
    """Stand-in clusters labelled and joined back onto the student table."""
    s = students(spark, sf)
    labels = ml.label_clusters(ml.features(s), stand_in_clusters(s))
    return ml.attach_predictions(s, labels).select("IDEstudiante", "CursoID", "nivel_riesgo_final", "Cluster", "NivelRiesgoML")


@query("ml_kmeans_levels")
def q_ml_kmeans_levels(spark, sf):
    """What every K-Means result must satisfy, whatever its labels: as many clusters as asked for, every student in
    one, and levels in the order of the mean scores."""
    s = students(spark, sf)
    pred = ml.run_clustering(s, thresholds(), evaluate=False).predictions
    scores = ml.cluster_scores(ml.features(s), pred.select("IDEstudiante", "Cluster"))
    levels = pred.groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"), F.min("NivelRiesgoML").alias("nivel"),
                                         F.max("NivelRiesgoML").alias("otro"))
    fixed = F.array(*[F.lit(x) for x in ("ALTO", "MEDIO", "ALERTA", "OPTIMO")])
    return levels.join(scores, "Cluster").agg(
        F.count(F.lit(1)).cast("int").alias("clusters"), F.sum("n").alias("estudiantes"),
        F.bool_and((F.col("nivel") == F.col("otro"))
                   & (F.col("nivel") == F.element_at(fixed, F.least(F.col("rango") + 1, F.lit(4))))).alias("niveles_en_orden"))


STRICT_JSON = '{"asistencia_riesgo": 60, "asistencia_alerta": 70, "asistencia_optima": 80, "nota_riesgo": 3, "nota_alerta": 5}'


@query("thresholds_json")
def q_thresholds_json(spark, sf):
    """Levels of all students under thresholds given as JSON, merged over the defaults and validated."""
    from ..sources.thresholds import load_thresholds, validate_thresholds
    th = load_thresholds(json_string=STRICT_JSON)
    validate_thresholds(th)
    return combine.student_table(att(spark, sf), gr(spark, sf), th).select(
        "IDEstudiante", "nivel_riesgo_asistencia", "nivel_riesgo_rendimiento", "nivel_riesgo_final")


@query("ml_kmeans")
def q_ml_kmeans(spark, sf):
    return ml.run_clustering(students(spark, sf), thresholds(), evaluate=False).predictions


@query("ml_result")
def q_ml_result(spark, sf):
    return ml.run_clustering(students(spark, sf), thresholds()).summary_frame(spark)


@query("report_ml")
def q_report_ml(spark, sf):
    return ml.cluster_distribution(ml.run_clustering(students(spark, sf), thresholds(), evaluate=False).predictions)


@query("student_analysis_ml")
def q_student_analysis_ml(spark, sf):
    """Student table with Cluster / NivelRiesgoML, shown as the student report."""
    st = students(spark, sf)
    res = ml.run_clustering(st, thresholds(), evaluate=False)
    return reports.report_students(ml.attach_predictions(st, res.predictions))


@query("best_k")
def q_best_k(spark, sf):
    return ml.best_k(students(spark, sf), thresholds())


# ---------------------------------------------------------------------------
# 2.K  documented extras
# ---------------------------------------------------------------------------

@query("feature_ratios")
def q_feature_ratios(spark, sf):
    return extras.feature_ratios(students(spark, sf))


@query("perf_attendance_ratio")
def q_perf_attendance_ratio(spark, sf):
    return extras.perf_attendance_ratio(students(spark, sf))


@query("manual_risk_score")
def q_manual_risk_score(spark, sf):
    return extras.manual_risk_score(students(spark, sf))


@query("competency_metrics")
def q_competency_metrics(spark, sf):
    return extras.competency_metrics(gr(spark, sf))


@query("absence_limits")
def q_absence_limits(spark, sf):
    return extras.absence_limits(students(spark, sf))


@query("sample_sufficiency")
def q_sample_sufficiency(spark, sf):
    return extras.sample_sufficiency(students(spark, sf))


WHAT_IF_SETS = [
    DEFAULT_THRESHOLDS,
    thresholds({"asistencia_riesgo": 70.0, "asistencia_alerta": 80.0, "asistencia_optima": 90.0}),
    thresholds({"nota_riesgo": 3.0, "nota_alerta": 5.0, "nota_excelente": 7.0}),
]


@query("threshold_what_if")
def q_threshold_what_if(spark, sf):
    return extras.threshold_what_if(students(spark, sf), WHAT_IF_SETS)


@query("threshold_what_if_many")
def q_threshold_what_if_many(spark, sf):
    """Level counts under one threshold set for each part: limits between hundredths, in any order, also outside the scale."""
    k = F.col("p_partkey").cast("long")
    sets = td.table(spark, sf, "part").select(
        k.alias("conjunto"), ((k * 37 % 1100).cast("double") / 10.0 - 5.0).alias("asistencia_riesgo"),
        ((k * 53 % 10007).cast("double") / 100.0).alias("asistencia_alerta"),
        ((k * 71 % 100003).cast("double") / 1000.0).alias("asistencia_optima"), ((k * 17 % 130).cast("double") / 10.0 - 1.0).alias("nota_riesgo"),
        ((k * 29 % 1009).cast("double") / 100.0).alias("nota_alerta"), ((k * 41 % 10009).cast("double") / 1000.0).alias("nota_excelente"))
    return extras.threshold_what_if(students(spark, sf), sets)


# ---------------------------------------------------------------------------
# 2.A  files in and out
# ---------------------------------------------------------------------------

def _attendance_csv(spark, sf, sep=";", encoding="ISO-8859-1") -> str:
    """The attendance text written, in input order, as CSV files into the shared folder."""
    from ..session import scratch_path
    path = scratch_path(spark, "asistencia-csv")
    (td.attendance_text(spark, sf).orderBy("_rid").drop("_rid").write.option("header", True).option("sep", sep)
     .option("encoding", encoding).csv(path))
    return path


@query("csv_dialect_profile")
def q_csv_dialect_profile(spark, sf):
    """Data lines by detected dialect."""
    from ..sources.csv import csv_dialect_profile
    return csv_dialect_profile(spark, _attendance_csv(spark, sf)).groupBy("delimitador", "encoding").agg(
        F.sum("lineas").alias("lineas"))


@query("read_csv_robust")
def q_read_csv_robust(spark, sf):
    """Detect the dialect, read, then the attendance load path."""
    from ..sources.csv import read_csv_robust
    return clean.prepare_attendance(read_csv_robust(spark, _attendance_csv(spark, sf))).select(*ATT_COLS)


@query("write_report_tables")
def q_write_report_tables(spark, sf):
    from ..session import scratch_path
    from ..sources.sinks import write_report_tables, written_row_counts
    paths = write_report_tables(spark, students(spark, sf), scratch_path(spark, "informes"))
    return written_row_counts(spark, paths)


@query("report_set")
def q_report_set(spark, sf):
    """Two report sets written one after the other, from one written student table; readers find the tables of the newer one
    through its manifest."""
    from ..session import scratch_path
    from ..sources.sinks import current_report_set, kept_students, write_report_set, written_row_counts
    base = scratch_path(spark, "conjuntos")
    st = kept_students(students(spark, sf), scratch_path(spark, "estudiantes"))
    write_report_set(spark, st.where(F.col("CursoID") == "C1"), base)
    write_report_set(spark, st, base)
    paths, fmt = current_report_set(spark, base)
    return written_row_counts(spark, paths, fmt)


@query("stream_ingest_attendance")
def q_stream_ingest_attendance(spark, sf):
    """CSV files -> Structured Streaming ingest -> curated table -> attendance metrics."""
    from ..session import scratch_path
    from ..streaming.ingest import read_curated_attendance, start_attendance_ingest
    src = _attendance_csv(spark, sf, sep=",", encoding="UTF-8")
    table = scratch_path(spark, "asistencia-curada")
    start_attendance_ingest(spark, src, table).awaitTermination()
    return metrics.attendance_metrics(clean.clean_attendance(read_curated_attendance(spark, table)))


@query("stream_running_stats")
def q_stream_running_stats(spark, sf):
    """CSV files taken in batch by batch; the statistics so far come from the batches' sketches alone."""
    from ..session import scratch_path
    from ..streaming.ingest import running_stats, start_attendance_ingest
    src, stats = _attendance_csv(spark, sf, sep=",", encoding="UTF-8"), scratch_path(spark, "asistencia-estadisticas")
    start_attendance_ingest(spark, src, scratch_path(spark, "asistencia-lotes"), max_files_per_trigger=2, stats_dir=stats).awaitTermination()
    return running_stats(spark, stats).select("registros", F.col("cursos_unicos").cast("int").alias("cursos_unicos"), "fecha_min", "fecha_max")


@query("csv_quoted_fields")
def q_csv_quoted_fields(spark, sf):
    """Files whose quoted fields hold line breaks, delimiters and doubled quotes, written and read back."""
    from ..session import scratch_path
    from ..sources.csv import read_csv_robust
    path = scratch_path(spark, "observaciones-csv")
    note = F.concat(F.lit('dijo "'), F.coalesce("event_type", F.lit("nada")), F.lit('"'))
    told = F.when(F.col("event_id") % 3 == 0, F.concat(note, F.lit("\n\nalumno; "), F.col("user_id").cast("string"), F.lit(", fin"))).otherwise(note)
    spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").select(
        F.col("event_id").cast("string").alias("id"), told.alias("Observaciones"), F.col("user_id").cast("string").alias("alumno")).write.option(
        "header", True).option("sep", ";").option("escape", '"').csv(path)
    return read_csv_robust(spark, path).drop("_rid")


@query("require_columns")
def q_require_columns(spark, sf):
    """Files with drifted headers (a folder for each kind of event): which required grade columns their files lack."""
    from ..session import scratch_path
    from ..sources.csv import layout_catalogue
    base = scratch_path(spark, "cabeceras-csv")
    events = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    headers = {"click": ["IDEstudiante", "nota", "curso"], "error": ["id_estudiante", "Fecha"], "otros": ["EstudianteID", "Calificacion", "Ponderacion"]}
    for kind, names in headers.items():
        own = events.where(F.col("event_type") == kind) if kind != "otros" else events.where("coalesce(event_type, '') not in ('click', 'error')")
        own.select(*[F.col(c).cast("string").alias(n) for n, c in zip(names, ("user_id", "event_id", "user_id"))]).coalesce(1).write.option(
            "header", True).csv(f"{base}/{kind}")
    rows = layout_catalogue(spark, [f"{base}/{k}" for k in headers], ["IDEstudiante", "CursoID", "Nota"], ["Peso"])
    return rows.select(F.regexp_extract("archivo", "/([a-z]+)/[^/]*$", 1).alias("carpeta"), "columna", "obligatoria", "presente", "usada")


@query("thresholds_validate")
def q_thresholds_validate(spark, sf):
    """Threshold sets (one for each supplier) written as JSON, read back over the defaults, and the rules that they break."""
    from ..session import scratch_path
    from ..sources.thresholds import threshold_sets, threshold_violations
    path = scratch_path(spark, "umbrales-json")
    key = F.col("s_suppkey").cast("long")
    spark.read.parquet(f"{sf.rstrip('/')}/supplier.parquet").select(
        F.concat(F.lit("conjunto "), key.cast("string")).alias("nombre"), (key % 120 - 10).cast("double").alias("asistencia_riesgo"),
        F.when(key % 2 == 0, (key % 13).cast("double")).alias("nota_aprobado"), (key % 4).cast("double").alias("ml_n_clusters")).write.json(path)
    sets = threshold_violations(threshold_sets(spark, path, one_object_a_file=False))
    return sets.select("nombre", "asistencia_riesgo", "nota_aprobado", F.size("violaciones").alias("reglas"),
                       F.array_join("violaciones", " | ").alias("violaciones"))
