"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A k-mer of ``K`` consecutive words is a closed syncmer when the smallest hash among its inner strings of
``S`` words is the first or the last of them. Whether a k-mer is chosen depends on its own words alone, so
equal passages give equal anchors wherever they stand. The query's fingerprint is the whole set of the text's
anchors, sorted as signed numbers, 16 hex digits each; the likeness of two fingerprints is the Jaccard index of these sets. Every anchor
stands beside it with its position. ``fingerprints`` gives the bounded form: the ``SKETCH`` smallest distinct 32-bit
hashes of the anchors, whose likeness is the share of the ``SKETCH`` smallest of their union that both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, ids_and_text

K, S = 5, 2
SKETCH = 128
BUCKET_ROWS = 256
MAX_BUCKETS = 1 << 16
NO_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))


def with_syncmers(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Adds ``out``: an array with the k-mer hash at the position of each closed syncmer, null at others.

    A text of fewer than ``k`` words has one anchor, all its words; a text without words has none."""
    h, inner = f"{out}_h", f"{out}_s"
    df = df.withColumn(h, word_hashes(F.col(text)))
    mers = F.transform(F.col(h), lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + j) for j in range(1, s)]))
    df = df.withColumn(inner, mers)
    span = k - s   # inner strings of a k-mer start at i .. i + span

    def chosen(x, i):
        own = [x, *[F.get(F.col(inner), i + j) for j in range(1, span + 1)]]
        rest = [F.get(F.col(inner), i + j) for j in range(s, k - s + 1, s)]
        rest += [F.get(F.col(h), i + j) for j in range(k - k % s, k)]
        return F.when(F.least(*own) == F.least(own[0], own[-1]), F.xxhash64(x, *rest))

    many = F.transform(F.slice(F.col(inner), 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), chosen)
    return df.withColumn(out, F.when(F.size(h) >= k, many).when(F.size(h) > 0, F.array(F.xxhash64(F.col(h))))
                         .otherwise(F.array().cast("array<long>"))).drop(h, inner)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, s: int = S, sketch: int = SKETCH) -> DataFrame:
    """Adds ``out``: the sorted array of the smallest distinct 32-bit anchor hashes of the text; ``out``_at: the anchors
    at their positions (see ``with_syncmers``); ``out``_set: the distinct anchors."""
    df = with_syncmers(df, text, f"{out}_at", k, s)
    df = df.withColumn(f"{out}_set", F.array_distinct(F.array_compact(F.col(f"{out}_at"))))
    short = F.transform(F.col(f"{out}_set"), lambda x: F.shiftrightunsigned(x, 32))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(short)), 1, sketch))


def placed_anchors(at: Column) -> Column:
    """(position, anchor) of every anchor, by position."""
    return F.array_compact(F.transform(at, lambda x, i: F.when(
        x.isNotNull(), F.struct(i.alias("position"), x.alias("anchor")))))


def hex_digits(fingerprint: Column, digits: int = 8) -> Column:
    """So many lower-case hex digits per anchor hash."""
    return F.lower(F.concat_ws("", F.transform(fingerprint, lambda x: F.lpad(F.hex(x), digits, "0"))))


def likeness(a: Column, b: Column, sketch: int = SKETCH) -> Column:
    """0 to 1; two fingerprints without anchors are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, sketch)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def set_likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two arrays of distinct anchors, 0 to 1; two without anchors are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def anchors(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, position (of the k-mer's first word), anchor (64-bit hash): one row per closed syncmer, for
    positional matching. Null and empty texts have none."""
    return with_syncmers(ids_and_text(docs), "text", "a", k, s).select(
        "doc_id", F.posexplode_outer("a").alias("position", "anchor")).where("anchor is not null")


def in_id_order(docs: DataFrame, bucket_rows: int = BUCKET_ROWS):
    """docs(doc_id, text) with kind and bucket, and a window in which the row after a row of kind 0 is the next
    document by descending doc_id (after the last: the first).

    Rows with one doc_id are ordered by text, null ids come last. The ids are cut into buckets at actual
    ids (approximate quantiles), so each bucket's successor is known to be a row at a bound: those rows are copied
    to the bucket above (kind 1), the first rows to the lowest bucket (kind 2), and every bucket is ordered for itself.
    """
    keyed = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    rows, top = keyed.agg(F.count(F.lit(1)), F.max("id")).first()
    buckets = max(1, min(MAX_BUCKETS, rows // bucket_rows))
    bounds: list[int] = []
    if buckets > 1:
        quantiles = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        bounds = sorted(set(keyed.agg(F.percentile_approx("id", quantiles, max(10_000, 4 * buckets))).first()[0]) - {top})
    # two steps of at most 256 comparisons: the block of bounds, then the place in it
    step = max(1, int(len(bounds) ** 0.5))
    every = long_array(bounds)
    block = F.size(F.filter(long_array(bounds[step - 1::step]), lambda b: b < F.col("id")))
    at = block * step + F.size(F.filter(F.slice(every, block * step + 1, step), lambda b: b < F.col("id")))
    copies = F.array(F.struct(F.lit(0).alias("kind"), F.col("at").alias("bucket")),
                     F.when(F.get(every, F.col("at")) == F.col("id"),
                            F.struct(F.lit(1).alias("kind"), (F.col("at") + 1).alias("bucket"))),
                     F.when(F.col("id") == F.lit(top), F.struct(F.lit(2).alias("kind"), F.lit(0).alias("bucket"))))
    placed = keyed.withColumn("at", at).select("doc_id", "text", "id", F.explode(F.array_compact(copies)).alias("c"))
    order = Window.partitionBy("bucket").orderBy(F.col("kind") == 2, F.col("id").desc(), "text", "kind")
    return placed.select("doc_id", "text", "id", "c.kind", "c.bucket"), order


def long_array(values: list[int]) -> Column:
    return F.expr(f"CAST(array({', '.join(f'{v}L' for v in values)}) AS array<bigint>)")


def fingerprinted(docs: DataFrame, k: int, s: int, sketch: int, bucket_rows: int) -> DataFrame:
    """Own, edited and following text's prints (columns own.., changed.., following..) with doc_id, n_chars and edited."""
    rows, order = in_id_order(ids_and_text(docs), bucket_rows)
    rows = with_fingerprint(rows.withColumn("next_text", F.lead("text").over(order)), "text", "own", k, s, sketch)
    df = rows.withColumn("following", F.lead("own").over(order)).withColumn(
        "following_set", F.lead("own_set").over(order)).where("kind = 0")
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
                                          F.substring(F.col("next_text"), F.lit(1), half)))
    return with_fingerprint(df, "edited", "changed", k, s, sketch)


def text_columns() -> list[Column]:
    return [F.col("doc_id"), F.col("n_chars"), F.sha2("edited", 256).alias("edited_sha256")]


def fingerprints(docs: DataFrame, k: int = K, s: int = S, sketch: int = SKETCH, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, from sketches alone.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document. Null text: empty. Of rows with equal doc_id and text each has a row of its own. A table of one row is its
    own next document. An empty table gives no row; extra columns are ignored.
    """
    df = fingerprinted(docs, k, s, sketch, bucket_rows)
    return df.select(*text_columns(), hex_digits(F.col("own")).alias("fingerprint"),
                     hex_digits(F.col("changed")).alias("edited_fingerprint"),
                     likeness(F.col("own"), F.col("changed"), sketch).alias("near_edited"),
                     likeness(F.col("own"), F.col("following"), sketch).alias("near_next"))


def whole_fingerprints(docs: DataFrame, k: int = K, s: int = S, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``fingerprints``, but fingerprint and edited_fingerprint are the whole sorted sets of 64-bit anchors, 16 hex
    digits each (no words: empty), near_edited and near_next the Jaccard indexes of these sets; further anchors
    and edited_anchors: (position, anchor) of every anchor of the text and of the edited text, by position."""
    df = fingerprinted(docs, k, s, SKETCH, bucket_rows)
    return df.select(*text_columns(), hex_digits(F.sort_array("own_set"), 16).alias("fingerprint"),
                     hex_digits(F.sort_array("changed_set"), 16).alias("edited_fingerprint"),
                     set_likeness(F.col("own_set"), F.col("changed_set")).alias("near_edited"),
                     set_likeness(F.col("own_set"), F.col("following_set")).alias("near_next"),
                     placed_anchors(F.col("own_at")).alias("anchors"), placed_anchors(F.col("changed_at")).alias("edited_anchors"))


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_fingerprints(documents(spark, sf_dir))
