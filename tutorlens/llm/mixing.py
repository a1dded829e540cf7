"""Mixing sources to target weights: capped water-filling and seeded sampling.

Sources share the whole size by weight; a source's target stops at ``max_epochs`` times its own size and
the excess goes to the others by weight until no target is above its cap. With the sources in the order of
cap / weight this is one pass: a source is capped when filling all sources up to its level takes no
more than there is, and the rest share what the capped ones leave.

A source's target is taken as whole repetitions of all its documents plus, for the fraction, a prefix
of its documents in a seeded random order; the document at the end of that prefix is taken in part, so the
words taken equal the rounded target. The order is cut into 4,096 buckets by the leading bits of the seeded
hash: sums per bucket give every bucket's start, and only rows of one bucket are ever ordered together, so a source
with a third of all rows is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, documents, join_groups, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size), one row per source -> source, source_size, target (double).

    Weights go round over the sources in code-point order, null last. Sums are exact decimals."""
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    common = 1
    for w in weights:
        common *= w
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    # cap / weight, times a common multiple of the weights: a whole number
    weighted = weighted.withColumn("cap", dec("source_size") * max_epochs).withColumn(
        "level", F.col("cap") * F.element_at(F.array(*[F.lit(common // w) for w in weights]), (turn + 1).cast("int")))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = weighted.select(
        "source", "source_size", "weight", "cap",
        F.sum(dec("source_size")).over(whole).alias("total"),
        (F.sum("cap").over(upto) - F.col("cap")).alias("cap_before"),
        (F.sum(dec("weight")).over(whole) - F.sum(dec("weight")).over(upto) + F.col("weight")).alias("weight_left"))
    flags = flags.withColumn("capped", F.col("cap_before") * F.col("weight") + F.col("cap") * F.col("weight_left")
                             <= F.col("total") * F.col("weight"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = flags.withColumn("left", F.col("total") - F.coalesce(
        F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))).withColumn(
        "share", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    return rest.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("left").cast("double") / F.col("share").cast("double")).alias("target"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns but maps: rows with equal ids and hashes count as repeated."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def plan_rows(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, tk (hash of all columns), source, size, source_size, target, whole (times that the document is taken whole)
    and extra (words taken besides) for every row.

    A null text has size 0 and is taken 0 times; a null source is a source of its own. Repeated rows are
    taken each for itself; which of several rows with one doc_id comes first is set by their size, then by ``tk``. An empty
    table gives no row; other columns count for ``tk`` alone. Reruns, over any partitions, give the same rows.
    """
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                row_hash(docs).alias("tk"),
                                word_count(F.col("text").cast("string")).alias("size"))
                    .withColumn("place", order).withColumn("bucket", F.substring("place", 1, 3)), "mix-sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    starts = buckets.withColumn("bucket_start", F.sum("bucket_size").over(
        Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size"))
    plan = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "b.source", "b.bucket", "b.bucket_start", "t.source_size", "t.target")
    rows = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (
        F.col("d.bucket") == F.col("p.bucket"))).select("d.doc_id", "d.tk", "d.source", "d.bucket", "d.size", "d.place",
                                                       "p.bucket_start", "p.source_size", "p.target")
    before = F.col("bucket_start") + F.sum("size").over(
        Window.partitionBy("source", "bucket").orderBy("place", "size", "tk").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    extra = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), words - whole * F.col("source_size") - F.col("before")))
    return rows.withColumn("before", before).select(
        "doc_id", "tk", "source", "size", "source_size", "target", whole.alias("whole"), extra.alias("extra"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) for every row; see ``plan_rows``."""
    return plan_rows(docs, weights, max_epochs, seed).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as it is taken. Documents stay whole: the one at the
    end of a source's fraction is taken once more if at least half of it is due. Of rows that repeat all columns each is
    taken for itself; where the fraction ends among them, as many as are due are taken once more."""
    key = ["key", "no_id", "tk"]
    once_more = (F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size"))
    copies = written(plan_rows(docs, weights, max_epochs, seed).groupBy(
        F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("no_id"), "tk").agg(
        F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"), F.sum(once_more.cast("long")).alias("more")), "mix-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("no_id"),
                       row_hash(docs).alias("tk"))
    taken = join_groups(rows, copies, key, "n")
    alike = taken.where("more = 0 or more = n").select("row", (F.col("whole") + (F.col("more") > 0).cast("long")).alias("times"))
    # at most one set of repeated rows for each source: numbered partition by partition
    numbered = written(taken.where("more > 0 and more < n").withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("at", 33)), "mix-repeated")
    parts = numbered.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("own")).withColumn("before", F.coalesce(F.sum("own").over(
        Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*key, "part").orderBy("at"))
    split = numbered.withColumn("place", place).join(parts, [*key, "part"]).select(
        "row", (F.col("whole") + (F.col("before") + F.col("place") <= F.col("more")).cast("long")).alias("times"))
    every = alike.unionByName(split).where("times > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: {docs}: the documents; the same rules in one pass of plain windows
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS place FROM {docs}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM src),
filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(3 * source_size) OVER lv - 3 * source_size AS cap_before,
         sum(w) OVER () - sum(w) OVER lv + w AS weight_left
  FROM weighted WINDOW lv AS (ORDER BY 3 * source_size * (10 // w), source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
flags AS (SELECT *, cap_before * w + 3 * source_size * weight_left <= total * w AS capped FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
    w::DOUBLE * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::DOUBLE
      / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM flags),
placed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS reps FROM placed)
SELECT doc_id, source, size, source_size, target,
       (reps * size + least(size, greatest(0, words - reps * source_size - before)))::BIGINT AS taken FROM whole
"""
OP5_SQL = f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL.format(docs='documents')})"
