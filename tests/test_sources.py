"""Files in and out: mixed-dialect folders, streaming ingest, the driver contract."""

import os

import pytest

from tutorlens.operators import clean, metrics
from tutorlens.sources.csv import csv_dialect_profile, layout_catalogue, missing_in_files, read_csv_robust
from tutorlens.streaming.ingest import read_curated_attendance, start_attendance_ingest

HEADER = "IDEstudiante,CursoID,Fecha,Presente,Retraso,FaltaJustificada,Observaciones\n"


def _write(path, text, enc="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(enc))


def test_folder_with_two_dialects(spark, tmp_dir):
    d = f"{tmp_dir}/mixed"
    os.makedirs(d)
    _write(f"{d}/a.csv", HEADER + 'E1,C1,2024-01-08,true,false,false,"nota, con coma"\n')
    _write(f"{d}/b.csv", HEADER.replace(",", ";") + "E2;C1;09/01/2024;sí;no;no;ok\n", "latin-1")
    prof = {os.path.basename(r["archivo"]): (r["delimitador"], r["encoding"]) for r in csv_dialect_profile(spark, d).collect()}
    assert prof == {"a.csv": (",", "UTF-8"), "b.csv": (";", "ISO-8859-1")}
    att = clean.prepare_attendance(read_csv_robust(spark, d))
    got = sorted((r["IDEstudiante"], r["Fecha"].isoformat(), r["Presente"]) for r in att.collect())
    assert got == [("E1", "2024-01-08", True), ("E2", "2024-01-09", True)]


def test_folder_with_other_column_orders_and_sizes(spark, tmp_dir):
    d = f"{tmp_dir}/swapped"
    os.makedirs(d)
    _write(f"{d}/2024-01.csv", "IDEstudiante,CursoID,Fecha,Presente\nE1,C1,2024-01-08,true\n")
    more = "".join(f"false,2024-01-{8 + i % 20:02d},C1,E1\n" for i in range(200))
    _write(f"{d}/2024-02.csv", "Presente,Fecha,CursoID,IDEstudiante\n" + more)      # larger, later by name
    raw = read_csv_robust(spark, d)
    assert {(r["IDEstudiante"], r["CursoID"]) for r in raw.collect()} == {("E1", "C1")}
    first = {r["Fecha"].isoformat(): r["Presente"] for r in clean.prepare_attendance(raw).collect()}
    assert first["2024-01-08"] is True and len(first) == 20


def test_reports_keep_ids_formats_and_earlier_runs(spark, tmp_dir):
    import pytest
    from tutorlens.operators.combine import student_table
    from tutorlens.sources.sinks import read_table, write_report_tables
    from helpers import att_df, gr_df
    att = clean.prepare_attendance(att_df(spark, [("s1", "01", "2024-01-08", "true", "false", "false"),
                                                  ("s2", "02", "2024-01-08", "false", "false", "false")]))
    gr = clean.prepare_grades(gr_df(spark, [("s1", "01", "E", "5.9", "CE1", "1", "2024-01-08")]))
    st = student_table(att, gr)
    for fmt in ("parquet", "csv", "json"):
        paths = write_report_tables(spark, st, f"{tmp_dir}/{fmt}", fmt)
        back = read_table(spark, paths["estudiantes"], fmt, st.schema)
        assert sorted(r["CursoID"] for r in back.collect()) == ["01", "02"]
        assert all(f.endswith(fmt) or f.startswith((".", "_")) for f in os.listdir(paths["cursos"]))
        with pytest.raises(Exception, match="(?i)exists"):
            write_report_tables(spark, st, f"{tmp_dir}/{fmt}", fmt)


def test_shared_folder_rule(spark):
    import pytest
    from tutorlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    path = session.scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) >= 1
    assert not os.path.exists(path.replace("file:", ""))


def test_streaming_ingest_matches_batch(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    rows = [f"E{i % 4},C{i % 2},2024-01-{1 + i % 20:02d},{'true' if i % 3 else 'false'},false,false,x\n" for i in range(60)]
    _write(f"{src}/part1.csv", HEADER + "".join(rows[:30]))
    swapped = ["Presente,IDEstudiante,Observaciones,Fecha,CursoID\n"]      # another order, two optional columns absent
    for line in rows[30:]:
        e, c, d, p, *_ = line.split(",")
        swapped.append(f"{p},{e},y,{d},{c}\n")
    _write(f"{src}/part2.csv", "".join(swapped))
    table = f"{tmp_dir}/curated"
    start_attendance_ingest(spark, src, table, checkpoint_dir=f"{tmp_dir}/ckpt", max_files_per_trigger=1) \
        .awaitTermination()
    streamed = metrics.attendance_metrics(clean.clean_attendance(read_curated_attendance(spark, table)))
    batch = metrics.attendance_metrics(clean.prepare_attendance(read_csv_robust(spark, [f"{src}/part1.csv",
                                                                                        f"{src}/part2.csv"])))
    assert streamed.columns == batch.columns
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    # a second run finds nothing new: the checkpoint remembers consumed files
    start_attendance_ingest(spark, src, table, checkpoint_dir=f"{tmp_dir}/ckpt").awaitTermination()
    assert read_curated_attendance(spark, table).count() == 60


def test_entry_contract(spark):
    import __spark_entry__ as e
    qs, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(qs)
    rows_only = set(qs) - set(sqls)
    assert not {q for q in rows_only if not q.startswith("op") and q != "pipeline"}
    df = e.entry(spark)
    assert df.count() > 0 and "nivel_riesgo_final" in df.columns


MULTILINE = [
    ("a.csv", 'id;obs;n\r\n1;"dos\nlineas, con coma";5\r\n\r\n2;"dijo ""hola"" y\n\nse fue; ya";6\n3;suelta 5" tubo;7\n4;"cerrada";8\n'
              '5;"tres\n""x""\nfin"  ;9\n6;;10\n'),
    ("b.csv", 'n,id,obs\n1,x,"uno, dos"\n2,y,"a\nb"\n3,z,plain\n'),
    ("c.csv", 'id;obs;n\n7;"nunca cerrada;1\n8;b;2\n'),
    ("d.csv", "id;obs;n\n9;sin comillas;3\n"),
]


def plain_rows(text):
    import csv
    import io
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=";" if ";" in text.split("\n")[0] else ",", skipinitialspace=True) if r]
    return [dict(zip([c.strip() for c in rows[0]], r)) for r in rows[1:]]


@pytest.mark.parametrize("split", [None, 40, 17])
def test_quoted_fields_with_line_breaks(spark, tmp_dir, split):
    """Against the standard library's reader; also with files cut into blocks of a few bytes."""
    for name, text in MULTILINE:
        with open(f"{tmp_dir}/{name}", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = [r.asDict() for r in read_csv_robust(spark, tmp_dir).orderBy("_rid").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    tidy = lambda v: None if v is None or v == "" else v.replace("\r\n", "\n").strip()
    got = [{k: tidy(r[k]) for k in ("id", "obs", "n")} for r in got]
    want = [{k: tidy(r.get(k)) for k in ("id", "obs", "n")} for name, text in MULTILINE if name != "c.csv" for r in plain_rows(text)]
    assert [r for r in got if r["id"] not in ("7", "8")] == want
    assert {"id": "8", "obs": "b", "n": "2"} in got     # an unclosed quote does not swallow what follows


def test_layout_catalogue_of_drifted_files(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", "IDEstudiante,CursoID,Nota,Fecha\nE1,C1,5,2024-01-01\n")
    _write(f"{tmp_dir}/b.csv", "id_estudiante;curso;calificacion\nE1;C1;5\n")
    _write(f"{tmp_dir}/c.csv", "EstudianteID,Observaciones\nE1,x\n")
    rows = {(os.path.basename(r["archivo"]), r["columna"]): (r["presente"], r["usada"], r["obligatoria"])
            for r in layout_catalogue(spark, tmp_dir, ["IDEstudiante", "CursoID", "Nota"], ["Fecha"]).collect()}
    assert len(rows) == 12
    assert rows["a.csv", "Nota"] == (True, "Nota", True) and rows["b.csv", "IDEstudiante"] == (True, "id_estudiante", True)
    assert rows["b.csv", "CursoID"] == (True, "curso", True) and rows["b.csv", "Fecha"] == (False, None, False)
    gone = {(os.path.basename(r["archivo"]), r["columna"]): r["disponibles"] for r in missing_in_files(
        spark, tmp_dir, ["IDEstudiante", "CursoID", "Nota"]).collect()}
    assert gone == {("c.csv", "CursoID"): ["EstudianteID", "Observaciones"], ("c.csv", "Nota"): ["EstudianteID", "Observaciones"]}
