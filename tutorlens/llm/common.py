"""Helpers shared by the operators: input columns, tables in the shared folder, byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Unicode white space that separates words in the contracts: space, \t, \n, \v, \f, \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def ids_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty): other columns never meet the operators' own names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache(module, name: str) -> dict:
    """A dictionary that lives as long as the Python worker process (kernels are shipped by value,
    so their own globals do not outlive a task)."""
    return module.__dict__.setdefault(f"_tutorlens_{name}", {})


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The Python values of an Arrow column, a few rows at a time: a batch of long texts never stands in memory twice."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


#: a key that holds over one in so many rows is joined by broadcast: there are fewer than that many such keys
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each key; ``weight``: the number of rows that hold it). Keys of over
    1/HOT_SHARE of all rows, fewer than HOT_SHARE by that definition, are broadcast, so no task meets all rows of one
    key; the other keys are joined by a shuffle. Both inputs are read twice: hand in written tables."""
    total = groups.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HOT_SHARE > total
    hot = F.broadcast(groups.where(heavy))
    rest = rows.join(F.broadcast(groups.where(heavy).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups.where(~heavy), keys))
