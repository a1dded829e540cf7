"""Exact dedup through a persistent index of text digests.

The index is a Parquet table, bucketed and sorted by digest (``CLUSTERED BY (digest) SORTED BY (digest)``), in a folder
of its own. Each load of documents

1. is reduced to one row for each digest (partially aggregated, so thousands of copies of a text never meet in one task),
2. meets the index in a sort-merge anti join. The index side is read bucket by bucket and is not shuffled,
3. is appended: digests that the index lacks as new entries, the others as repeats of an entry (their count and largest
   doc_id), in the same buckets. A load counts once its row stands in ``loads``, written last; what a broken
   load has left behind is never read.

The text itself is read once, for its SHA-256; texts with one digest count as identical.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ids_and_text, join_groups, scratch_path, written

ENTRY = "digest BINARY, doc_id BIGINT, load BIGINT, row BIGINT, n BIGINT, fresh BOOLEAN"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text in UTF-8, null: empty)."""
    return ids_and_text(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a unique ``row``, written down so that the numbers never change."""
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


class DigestIndex:
    """The index in folder ``path`` (shared by driver and executors); made there if there is none yet.

    ``buckets`` is fixed when the index is made (the session's number of shuffle partitions unless given)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets, self.entries = spark.read.parquet(f"{self.path}/layout").orderBy(F.desc("made")).first()[:2]
        except AnalysisException:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.entries = self.layout()
        self.open()

    def layout(self) -> str:
        """A new, empty folder of entries, from now on the one that holds."""
        entries = f"entries-{uuid.uuid4().hex[:12]}"
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(entries).alias("entries"),
                                   F.lit(time.time_ns()).alias("made")).write.mode("append").parquet(f"{self.path}/layout")
        return entries

    def open(self) -> None:
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        self.create(self.table, self.entries)

    def create(self, table: str, entries: str) -> None:
        self.spark.sql(f"CREATE TABLE {table} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{entries}'")

    def loads(self) -> list[int]:
        """The loads that are complete: one number for each call of ``append``."""
        try:
            return [r[0] for r in self.spark.read.parquet(f"{self.path}/loads").select("load").distinct().collect()]
        except AnalysisException:
            return []

    def log(self) -> DataFrame:
        return self.spark.table(self.table).where(F.col("load").isin(self.loads()))

    def append(self, rows: DataFrame) -> int:
        """Enters rows(doc_id, digest, row); returns the number of the load."""
        load = time.time_ns()
        groups = written(rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).select(
            "digest", "top.doc_id", F.lit(load).alias("load"), "top.row", "n"), "digest-groups")
        known = self.log().where("fresh").select("digest").hint("merge")
        groups.join(known, "digest", "left_anti").withColumn("fresh", F.lit(True)).write.insertInto(self.table)
        groups.join(known, "digest", "left_semi").withColumn("fresh", F.lit(False)).write.insertInto(self.table)
        self.spark.range(1).select(F.lit(load).alias("load")).write.mode("append").parquet(f"{self.path}/loads")
        return load

    def groups(self) -> DataFrame:
        """One row for each text: digest, top (doc_id, load, row of the row that stays: the largest doc_id, null lowest),
        group_size. Reads the buckets as they lie, without a shuffle."""
        return self.log().groupBy("digest").agg(F.max(F.struct("doc_id", "load", "row")).alias("top"),
                                                F.sum("n").alias("group_size"))

    def compact(self) -> None:
        """Rewrites the entries as one file a bucket, one entry for each text."""
        whole = self.groups().select("digest", "top.doc_id", "top.load", "top.row", F.col("group_size").alias("n"),
                                     F.lit(True).alias("fresh"))
        entries, table = f"entries-{uuid.uuid4().hex[:12]}", f"digest_index_{uuid.uuid4().hex[:12]}"
        self.create(table, entries)
        whole.write.insertInto(table)
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(entries).alias("entries"),
                                   F.lit(time.time_ns()).alias("made")).write.mode("append").parquet(f"{self.path}/layout")
        self.table, self.entries = table, entries


def unseen(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Enters ``docs`` and returns its rows, all columns, whose text the index did not hold before: one for each text,
    that with the largest doc_id (null lowest; of rows that repeat id and text, any one).

    Null text counts as empty. An empty table enters nothing and returns nothing; columns of any name are passed on."""
    rows = numbered(digests(docs))
    load = index.append(rows)
    new = index.log().where((F.col("load") == load) & F.col("fresh")).select("digest", F.col("doc_id").alias("keep_id"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").cast(
        "long").alias("keep_id"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest"))
    names = docs.columns
    chosen = whole.join(new.withColumnsRenamed({"digest": "d", "keep_id": "k"}),
                        (F.col("digest") == F.col("d")) & F.col("keep_id").eqNullSafe(F.col("k")), "left_semi")
    return chosen.groupBy("keep_id", "digest").agg(F.first("whole").alias("whole")).select(
        *[F.col("whole").getField(c).alias(c) for c in names])


def duplicates(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """rows(doc_id, digest, load, row) that the index holds -> doc_id, keep_id, group_size, kept, text_sha256."""
    groups = written(index.groups(), "digest-groups")
    return join_groups(rows, groups, ["digest"], "group_size").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        ((F.col("load") == F.col("top.load")) & (F.col("row") == F.col("top.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, index: DigestIndex, loads: int = 1) -> DataFrame:
    """Enters ``docs`` in ``loads`` loads (rows dealt by a hash of doc_id) and returns for every row doc_id, keep_id,
    group_size, kept, text_sha256 over all that the index holds.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays (null lowest); of rows that repeat id
    and text exactly one. ``keep_id`` is null where no row of the text has an id. An empty table gives no row; other
    columns are ignored."""
    rows = numbered(digests(docs)).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(loads)))
    entered = None
    for part in range(loads):
        own = rows.where(F.col("part") == part)
        own = own.withColumn("load", F.lit(index.append(own)))
        entered = own if entered is None else entered.unionByName(own)
    return duplicates(entered.select("doc_id", "digest", "load", "row"), index)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads: the second meets the index that the first has written."""
    return exact_duplicates(documents(spark, sf_dir), DigestIndex(spark, scratch_path(spark, "digest-index")), loads=2)


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
