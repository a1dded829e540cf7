"""Attendance files arriving over time -> a curated table, with Structured Streaming.

New CSV files in a folder are parsed as they arrive (the same null tokens and
flag/date parsing as the batch loader) and appended to a Parquet table. Each
micro-batch is written to its own ``batch=<id>`` folder with overwrite, so a
replayed batch (after a failure) replaces its own output instead of adding
rows twice; the checkpoint in the shared folder records which files were
consumed. Input order is kept as ``_rid = (batch, file, place in the file)``, so the
batch analysis (first row wins, last course wins) reads the curated table
exactly like one big file.

With ``stats_dir`` each batch also leaves one row of mergeable statistics there (a replayed batch replaces its own), so
``running_stats`` tells rows, students, courses and dates so far without reading the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ATTENDANCE_OPTIONAL, ATTENDANCE_REQUIRED
from ..operators.clean import parse_attendance, require_columns
from ..operators.sketches import merged_stats, partial_stats
from ..session import scratch_path
from ..sources.csv import RID, lines_of, parse_lines


def start_attendance_ingest(spark: SparkSession, src_dir: str, table_dir: str, checkpoint_dir: str | None = None,
                            sep: str | None = None, encoding: str | None = None, available_now: bool = True,
                            max_files_per_trigger: int | None = None, stats_dir: str | None = None):
    """Start the stream; returns the ``StreamingQuery``. With ``available_now``
    it processes what is there and stops (a scheduled incremental job). Columns
    go by each file's own header; a file without a required column fails its batch."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(src_dir).select("value", "_metadata")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = require_columns(parse_lines(lines_of(batch), sep, encoding), ATTENDANCE_REQUIRED, "Asistencia")
        absent = {c: F.lit(None).cast("string") for c in ATTENDANCE_OPTIONAL if c not in rows.columns}
        rows = parse_attendance(rows.withColumns(absent) if absent else rows)
        (rows.select(*ATTENDANCE_REQUIRED, *ATTENDANCE_OPTIONAL,
                     F.struct(F.lit(batch_id).cast("long").alias("lote"), f"{RID}.archivo", f"{RID}.bloque",
                              f"{RID}.fila").alias(RID))
         .write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/batch={batch_id}"))
        if stats_dir:
            written = spark.read.parquet(f"{table_dir.rstrip('/')}/batch={batch_id}")
            partial_stats(written).write.mode("overwrite").parquet(f"{stats_dir.rstrip('/')}/batch={batch_id}")

    writer = (lines.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "ingest-ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_curated_attendance(spark: SparkSession, table_dir: str) -> DataFrame:
    """The curated table, ready for ``clean_attendance`` (``batch`` column dropped)."""
    return spark.read.parquet(table_dir).drop("batch")


def running_stats(spark: SparkSession, stats_dir: str) -> DataFrame:
    """One row over all batches so far: registros (rows taken in, repeats too), estimated distinct students and courses, dates."""
    return merged_stats(spark.read.parquet(stats_dir))
