"""Row positions inside ordered groups, without putting a group in one task.

A window ``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row
of a key to one task; a key that holds a third of the data then runs alone.
Here rows are range-partitioned on ``(key, order...)`` instead, so a large key
is cut into several contiguous ranges (Spark samples the full sort key).
Inside a range the rows are sorted and ``monotonically_increasing_id`` numbers
them in order (upper bits: range index, lower 33 bits: row index). Each
(key, range) pair is reduced to a few sums, and the ranges of one key are
stitched by shifting with the number of rows of that key in earlier ranges.
Only those small partial rows (one per key and range) are shuffled after the
sort, and the per-key window runs over at most one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def range_numbered(df: DataFrame, sort: list[Column], num_ranges: int | None = None) -> DataFrame:
    """Range-partition on ``sort``, sort inside each range, and number the rows:
    ``_range`` (range index, ascending with the sort) and ``_row`` (position
    inside the range)."""
    return _numbered(df, sort, num_ranges)


def _numbered(df: DataFrame, sort: list[Column], num_ranges: int | None) -> DataFrame:
    ranged = df.repartitionByRange(num_ranges, *sort) if num_ranges else df.repartitionByRange(*sort)
    return (ranged.sortWithinPartitions(*sort)
            .withColumn("_mid", F.monotonically_increasing_id())
            .withColumn("_range", F.shiftright(F.col("_mid"), _ROW_BITS))
            .withColumn("_row", F.col("_mid").bitwiseAND(F.lit(_ROW_MASK))))


def position_sums(df: DataFrame, key: str, order: list[Column], values: dict[str, Column],
                  num_ranges: int | None = None) -> DataFrame:
    """Per ``key``: ``n`` rows and, for each value ``y``: ``{y}_sum``, ``{y}_min``,
    ``{y}_max`` and ``{y}_xsum`` = sum of x*y, where x = 0-based position of
    the row inside its key when rows are sorted by ``order``.

    ``order`` holds sort-order columns (e.g. ``F.col('Fecha').asc_nulls_last()``);
    values are decimals of at most 8 places, so all sums are exact.
    """
    sort = [F.col(key).asc()] + list(order)
    base = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    num = _numbered(base, sort, num_ranges)
    part_aggs = [F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_row0")]
    for k in values:
        v = F.col(f"_v_{k}")
        part_aggs += [F.sum(v).alias(f"_s_{k}"), F.sum(v * F.col("_row").cast("decimal(18,0)")).alias(f"_sr_{k}"),
                      F.min(v).alias(f"_mn_{k}"), F.max(v).alias(f"_mx_{k}")]
    parts = num.groupBy(key, "_range").agg(*part_aggs)
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    shifted = parts.select(
        key, "_n",
        *[c for k in values for c in (
            F.col(f"_s_{k}"), F.col(f"_mn_{k}"), F.col(f"_mx_{k}"),
            # local x = row - row0; global x = local x + rows of this key in earlier ranges
            (F.col(f"_sr_{k}") + (offset - F.col("_row0")).cast("decimal(20,0)") * F.col(f"_s_{k}")).alias(f"_xs_{k}"))])
    out_aggs = [F.sum("_n").alias("n")]
    for k in values:
        out_aggs += [F.sum(f"_s_{k}").alias(f"{k}_sum"), F.min(f"_mn_{k}").alias(f"{k}_min"),
                     F.max(f"_mx_{k}").alias(f"{k}_max"), F.sum(f"_xs_{k}").alias(f"{k}_xsum")]
    return shifted.groupBy(key).agg(*out_aggs)


def dense_index(df: DataFrame, order_col: str, index_col: str = "rank", num_ranges: int | None = None,
                keep: Column | None = None) -> DataFrame:
    """1-based position of each row of ``df`` sorted by ``order_col`` (distinct values expected),
    computed like ``zipWithIndex``: sort by range, count each range, shift by the
    counts of earlier ranges. ``keep`` replaces the sorted value in the result
    (and in what is written to the shared folder).

    The numbered ranges are read twice (counts, then rows), so they are first
    written with a reliable checkpoint to the shared folder: both reads then see
    the same range bounds, and a lost executor cannot renumber them. The
    per-range count table has one row per range, so broadcasting it is safe.
    """
    from ..session import shared_dir

    shared_dir(df.sparkSession)
    num = _numbered(df, [F.col(order_col).asc()], num_ranges)
    if keep is not None:
        num = num.select(keep.alias(order_col), "_mid", "_range", "_row")
    num = num.checkpoint(eager=True)
    counts = num.groupBy("_range").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (num.join(F.broadcast(offsets), "_range")
            .withColumn(index_col, F.col("_off") + F.col("_row") + F.lit(1))
            .drop("_mid", "_range", "_row", "_off"))
