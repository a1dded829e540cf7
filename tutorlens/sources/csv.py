"""CSV input: dialect and header of every file in a folder, and the robust reader.

Lines are read as raw text once for the profile (first line, line count, UTF-8
validity per file) and once for the data. Files are grouped by what their header
line says, so files with other column orders, delimiters or encodings are read
right next to each other; only one row per *distinct layout* reaches the driver.

A quoted field may hold line breaks. Files stay splittable: each line is a function from "outside" or "inside a quoted field" to the
state at its end, one of four (same, turned, always outside, always inside). These compose over the lines of a file block, the blocks of a file
pass their state on, and the lines between an opening and its closing quote are joined to one record. Only files
in which a line leaves a quote open take this way; all others are read line by line, without a shuffle.
"""

from __future__ import annotations

import csv as pycsv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CSV_DELIMITERS, DEFAULT_DIALECT, GRADE_COLUMN_ALTERNATIVES
from ..operators.clean import apply_null_tokens
from ..session import scratch_path

RID = "_rid"
MAX_BROADCAST_FILES = 100_000   # up to so many files the table of files is broadcast to the lines, beyond it is joined by a shuffle


def raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines, blank ones too, with their place: archivo, bloque (start of the file block), fila (order in the block).
    The text source keeps the bytes as they are, whatever the encoding."""
    return lines_of(spark.read.text(path).select("value", "_metadata"))


def lines_of(text: DataFrame) -> DataFrame:
    return (text.select(F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("bloque"),
                        F.monotonically_increasing_id().alias("fila"), "value"))


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.length(F.trim("value")) > 0)


def odd_quotes(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1


def left_open(value: Column, sep: Column, begins_field: bool = True) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted field. A quote opens a field at the field's beginning only.
    ``sep``: a character class of delimiters; ``begins_field``: the line's beginning is a field's."""
    start = F.concat(F.lit("(^|" if begins_field else "("), sep, F.lit(")\\s*"))
    closed = F.regexp_replace(value, F.concat(start, F.lit('"(?:[^"]++|"")*+"(?=\\s*(?:$|'), sep, F.lit("))")), F.lit("$1"))
    rest = F.call_function("regexp_extract", closed, F.concat(start, F.lit('(".*)$')), F.lit(2))
    return F.when(F.contains(value, F.lit('"')), odd_quotes(rest)).otherwise(F.lit(False))


def states(value: Column, sep: Column) -> tuple[Column, Column]:
    """The state (0 outside, 1 inside quotes) at a line's end if it begins outside, and if it begins inside."""
    closing = F.lit('^(?:[^"]++|"")*+"')
    after = F.regexp_replace(value, closing, F.lit(""))
    return (left_open(value, sep).cast("int"),
            F.when(F.regexp_like(value, closing), left_open(after, sep, False).cast("int")).otherwise(F.lit(1)))


def joined_records(lines: DataFrame) -> DataFrame:
    """lines(archivo, bloque, fila, value, delimitador, ...) of files with open quotes -> the same, one row for each record, at the
    place of its first line. A quote that is open at the file's end opens nothing: the lines after it stay lines."""
    in_block = Window.partitionBy("archivo", "bloque").orderBy("fila")
    upto, earlier = in_block.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("archivo").orderBy("bloque").rowsBetween(
        Window.unboundedPreceding, -1)
    out, inside = states(F.col("value"), F.concat(F.lit("["), F.col("delimitador"), F.lit("]")))
    own = lines.withColumns({"_0": out, "_1": inside})
    own = own.withColumn("_turns", F.sum((F.col("_0") > F.col("_1")).cast("int")).over(upto))
    # what the last line that fixes the state leaves, less the turns before it
    own = own.withColumn("_fixed", F.last(F.when(F.col("_0") == F.col("_1"), F.pmod(F.col("_0") - F.col("_turns"), F.lit(2))),
                                          ignorenulls=True).over(upto))
    blocks = own.groupBy("archivo", "bloque").agg(F.max_by(F.struct("_turns", "_fixed"), "fila").alias("b"))
    blocks = blocks.withColumn("_sum", F.coalesce(F.sum("b._turns").over(earlier.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    blocks = blocks.withColumn("_from", F.when(F.col("b._fixed").isNotNull(), F.pmod(
        F.col("b._fixed") - F.col("_sum") + F.col("b._turns"), F.lit(2))))
    blocks = blocks.select("archivo", "bloque", F.pmod(
        F.coalesce(F.last("_from", ignorenulls=True).over(earlier), F.lit(0)) + F.col("_sum") - F.col("b._turns"), F.lit(2)).alias("_begin"))
    own = own.join(blocks, ["archivo", "bloque"])
    own = own.withColumn("_end", F.pmod(F.coalesce("_fixed", "_begin") + F.col("_turns"), F.lit(2)))
    own = own.withColumn("_starts", F.coalesce(F.lag("_end").over(in_block), F.col("_begin")) == 0)
    place = F.struct("bloque", "fila")
    own = own.withColumn("_record", F.last(F.when(F.col("_starts"), place), ignorenulls=True).over(upto))
    # a record that began in an earlier block; the last record of a file that ends inside quotes
    last = own.groupBy("archivo", "bloque").agg(F.max("_record").alias("_last"), F.max_by("_end", "fila").alias("_state"))
    last = last.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier))
    whole = Window.partitionBy("archivo").orderBy("bloque").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = last.withColumn("_broken", F.when(F.last("_state").over(whole) == 1, F.last("_last", ignorenulls=True).over(whole)))
    own = own.join(last.select("archivo", "bloque", "_before", "_broken"), ["archivo", "bloque"])
    record = F.coalesce("_record", "_before", place)
    record = F.when(record == F.col("_broken"), place).otherwise(record)
    rest = [c for c in lines.columns if c not in ("archivo", "bloque", "fila", "value")]
    parts = F.sort_array(F.collect_list(F.struct("bloque", "fila", "value")))
    return own.withColumn("_record", record).groupBy("archivo", "_record").agg(
        F.concat_ws("\n", F.transform(parts, lambda p: p["value"])).alias("value"), *[F.first(c).alias(c) for c in rest]).select(
        "archivo", "_record.bloque", "_record.fila", "value", *rest)


def bare(value: Column) -> Column:
    """A line without its quoted parts."""
    return F.when(F.contains(value, F.lit('"')), F.regexp_replace(value, '"[^"]*"', "")).otherwise(value)


def delimiter_counts(value: Column) -> Column:
    """How often each of ``CSV_DELIMITERS`` stands in a line, outside double quotes."""
    text = bare(value)
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(d), F.lit(""))) for d in CSV_DELIMITERS])


def layouts(lines: DataFrame) -> DataFrame:
    """One row per file: archivo, cabecera (its first line), inicio (that line's place), delimitador, encoding, lineas
    (data lines), abiertas (some line leaves a quote open).

    The delimiter is the one of ``, ; TAB |`` on which most lines agree: that stand in most lines equally often, at least once,
    outside double quotes. Equal agreement: the one that the header line holds most often, then the first (none: ','). Lines
    meet in a histogram of counts by file and delimiter, so a file of any size is reduced by partial aggregates.
    Encoding is UTF-8 when every line is valid UTF-8, else ISO-8859-1 (which reads any byte sequence)."""
    place = F.struct("bloque", "fila")
    any_sep = F.lit("[" + "".join(map(re.escape, CSV_DELIMITERS)) + "]")
    same = not_blank(lines).groupBy("archivo", delimiter_counts(F.col("value")).alias("veces")).agg(
        F.min_by("value", place).alias("cabecera"), F.min(place).alias("inicio"), F.count(F.lit(1)).alias("n"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(left_open(F.col("value"), any_sep)).alias("abiertas"))

    def merged(*more: Column) -> list[Column]:
        return [F.min_by("cabecera", "inicio").alias("cabecera"), F.min("inicio").alias("inicio"),
                F.bool_and("utf8").alias("utf8"), F.bool_or("abiertas").alias("abiertas"), *more]

    counts = same.select("*", F.posexplode("veces").alias("i", "v")).groupBy("archivo", "i", "v").agg(*merged(F.sum("n").alias("n")))
    agreed = F.max(F.when(F.col("v") > 0, F.col("n")))
    of_header = F.element_at(delimiter_counts(F.col("cabecera")), F.col("i") + 1)
    files = (counts.groupBy("archivo", "i").agg(*merged(agreed.alias("de_acuerdo"), F.sum("n").alias("n")))
             .withColumn("rango", F.when(F.col("de_acuerdo").isNotNull(), F.struct("de_acuerdo", of_header, -F.col("i"))))
             .groupBy("archivo").agg(*merged(F.max_by("i", "rango").alias("i"), F.max("rango").alias("rango"), F.first("n").alias("n"))))
    return files.select(
        "archivo", "cabecera", "inicio",
        F.when(F.col("rango").isNotNull(), F.element_at(F.array(*map(F.lit, CSV_DELIMITERS)), F.col("i") + 1))
        .otherwise(F.lit(DEFAULT_DIALECT[0])).alias("delimitador"),
        F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"), (F.col("n") - 1).alias("lineas"), "abiertas")


def csv_dialect_profile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: (archivo, delimitador, encoding, lineas); see ``layouts``. ``lineas`` counts data lines."""
    return layouts(raw_lines(spark, path)).select("archivo", "delimitador", "encoding", "lineas")


def decoded(value: str, encoding: str):
    return F.when(F.col(encoding) == "UTF-8", F.col(value)).otherwise(F.decode(F.col(value).cast("binary"), "ISO-8859-1"))


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header line, trimmed; a name that repeats gets its position."""
    names = [c.strip() for c in next(pycsv.reader([header.lstrip("\ufeff")], delimiter=sep))]
    return [c if c and names.count(c) == 1 else f"{c}{i}" for i, c in enumerate(names)]


def layout_catalogue(spark: SparkSession, path: str | list[str], required: list[str], optional: list[str] = (),
                     alternatives: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each file and expected column: archivo, columna, obligatoria, presente, usada (the name in the file: the column's own,
    else the first alternative there is; null: none), disponibles (all names of the file). Of the files only the header lines
    are looked at, and only distinct ones reach the driver."""
    alternatives = GRADE_COLUMN_ALTERNATIVES if alternatives is None else alternatives
    files = layouts(raw_lines(spark, path)).select("archivo", decoded("cabecera", "encoding").alias("cabecera"), "delimitador")
    target = scratch_path(spark, "csv-layouts")
    files.write.parquet(target)
    files = spark.read.schema(files.schema).parquet(target)
    kinds = [(r[0], r[1], header_names(r[0], r[1])) for r in files.select("cabecera", "delimitador").distinct().collect()]
    known = spark.createDataFrame(kinds, "cabecera string, delimitador string, disponibles array<string>")
    wanted = F.array(*[F.struct(
        F.lit(c).alias("columna"), F.lit(c in required).alias("obligatoria"),
        F.array(*[F.lit(x) for x in dict.fromkeys([c, *alternatives.get(c, [])])]).alias("nombres")) for c in [*required, *optional]])
    used = F.try_element_at(F.filter("nombres", lambda n: F.array_contains("disponibles", n)), F.lit(1))
    return files.join(F.broadcast(known), ["cabecera", "delimitador"]).select("archivo", "disponibles", F.inline(wanted)).select(
        "archivo", "columna", "obligatoria", used.isNotNull().alias("presente"), used.alias("usada"), "disponibles")


def missing_in_files(spark: SparkSession, path: str | list[str], required: list[str],
                     alternatives: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each required column that a file lacks: archivo, columna, disponibles."""
    return layout_catalogue(spark, path, required, (), alternatives).where("not presente").select("archivo", "columna", "disponibles")


def parse_lines(lines: DataFrame, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """Lines (see ``raw_lines``) to columns of text by each file's own header, united by column name, with ``_rid`` =
    (archivo, bloque, fila). Leading blanks of values are skipped, null tokens become null."""
    files = layouts(lines)
    if sep is not None:
        files = files.withColumn("delimitador", F.lit(sep))
    if encoding is not None:
        files = files.withColumn("encoding", F.lit("UTF-8" if encoding.upper().replace("-", "") == "UTF8" else "ISO-8859-1"))
    files = files.withColumn("cabecera", decoded("cabecera", "encoding"))
    spark, path = lines.sparkSession, scratch_path(lines.sparkSession, "csv-files")
    files.drop("lineas").write.parquet(path)
    files = spark.read.schema(files.drop("lineas").schema).parquet(path)
    kinds = files.select("cabecera", "delimitador").distinct().collect()
    if not kinds:
        raise ValueError("no hay líneas CSV que leer")
    if files.count() <= MAX_BROADCAST_FILES:
        files = F.broadcast(files)
    placed = lines.join(files, "archivo").where(F.struct("bloque", "fila") > F.col("inicio"))
    if files.where("abiertas").isEmpty():
        placed = not_blank(placed)
    else:
        placed = not_blank(placed.where("not abiertas").unionByName(joined_records(placed.where("abiertas"))))
    out = None
    for kind in sorted(kinds):
        names = header_names(kind["cabecera"], kind["delimitador"])
        own = placed.where((F.col("cabecera") == kind["cabecera"]) & (F.col("delimitador") == kind["delimitador"]))
        row = F.from_csv(decoded("value", "encoding"), _ddl(names),
                         {"sep": kind["delimitador"], "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "escape": '"',
                          "multiLine": "true"})
        part = own.select(row.alias("r"), F.struct("archivo", "bloque", "fila").alias(RID)).select("r.*", RID)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return apply_null_tokens(out)


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + c.replace("`", "``") + "` STRING" for c in names)


def read_csv_robust(spark: SparkSession, path: str | list[str], sep: str | None = None,
                    encoding: str | None = None) -> DataFrame:
    """Read CSV text as all-string columns: header names trimmed, leading blanks
    of values skipped, null tokens -> null, and ``_rid``: the order of the rows by
    file name and place in the file. A missing ``sep`` or ``encoding`` is found per file."""
    return parse_lines(raw_lines(spark, path), sep, encoding)
