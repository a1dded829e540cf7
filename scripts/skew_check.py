"""Skew evidence: one student owns a third of the attendance and grade rows.

The attendance stand-in is re-keyed so that every third event belongs to
student "0" (each in its own course, so the rows survive de-duplication), and
so does every third lineitem row (each with its own competency); the student
table is then run with Spark's event log written to a
fresh scratch folder, and for every stage the largest task's share of the
records the stage read is printed. With a per-student window the hot student
would put >= 1/3 of the sweep's rows into one task; here every stage stays
near 1/slots.

    python scripts/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-eventlog-", dir="/tmp")
    from tutorlens.session import SESSION_CONF
    b = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = (b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .getOrCreate())
    from tutorlens.operators import clean
    from tutorlens.operators.combine import student_table
    from tutorlens.sources import testdata as td

    raw = td.attendance_raw(spark, sf)
    is_hot = F.col("_rid") % 3 == 0
    # hot rows keep distinct (student, course, day) keys so that they survive de-duplication
    hot = raw.withColumns({
        "IDEstudiante": F.when(is_hot, F.lit("0")).otherwise(F.col("IDEstudiante")),
        "CursoID": F.when(is_hot, F.concat(F.lit("H"), F.col("_rid").cast("string"))).otherwise(F.col("CursoID"))})
    att = clean.clean_attendance(hot)
    share = att.agg((F.count_if(F.col("IDEstudiante") == "0") / F.count(F.lit(1))).alias("s")).first()["s"]
    graw = td.grades_raw(spark, sf)
    g_hot = graw.withColumns({
        "IDEstudiante": F.when(F.col("_rid.fila") % 3 == 0, F.lit("0")).otherwise(F.col("IDEstudiante")),
        "Competencia": F.when(F.col("_rid.fila") % 3 == 0, F.concat(F.lit("H"), F.col("_rid.fila").cast("string")))
        .otherwise(F.col("Competencia"))})
    gr = clean.clean_grades(g_hot)
    gshare = gr.agg((F.count_if(F.col("IDEstudiante") == "0") / F.count(F.lit(1))).alias("s")).first()["s"]
    st = student_table(att, gr)
    st.write.format("noop").mode("overwrite").save()
    # the name -> id join with one name on a third of the rows
    text = td.grades_text(spark, sf)
    named = text.withColumn("NombreEstudiante", F.when(F.col("_rid.fila") % 3 == 0, F.lit("Alumno 0")).otherwise(
        F.col("NombreEstudiante")))
    clean.gen_student_id(clean.map_columns(named)).write.format("noop").mode("overwrite").save()
    app = spark.sparkContext.applicationId
    spark.stop()

    path = [p for p in glob.glob(f"{log_dir}/*") if app in p][0]
    stages: dict[int, list[int]] = {}
    for line in open(path):
        e = json.loads(line)
        if e.get("Event") != "SparkListenerTaskEnd" or "Task Metrics" not in e:
            continue
        m = e["Task Metrics"]
        recs = m.get("Input Metrics", {}).get("Records Read", 0) + \
            m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
        stages.setdefault(e["Stage ID"], []).append(recs)
    print(f"hot student holds {share:.1%} of the cleaned attendance rows and {gshare:.1%} of the cleaned grade rows")
    print("stage  tasks  records  largest-task-share")
    for sid in sorted(stages):
        r = stages[sid]
        total = sum(r)
        if total:
            print(f"{sid:5d} {len(r):6d} {total:8d}   {max(r) / total:6.1%}")


if __name__ == "__main__":
    main()
