"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprints: 64 bits over word shingles (see ``fingerprints``). Two documents are linked when
their fingerprints differ in at most ``radius`` bits; the result is the connected component.

Candidates come from a covering family: every bit position i gets a non-zero vector m(i) of
radius+1 bits, and table v (each of the 2**(radius+1)-1 non-zero vectors) keys a fingerprint by
its bits at the positions with odd parity of m(i) & v. The at most ``radius`` positions in which
a pair differs span less than the whole vector space, so some v is orthogonal to all of them and the pair
has the same key in that table: no pair within the radius is missed.

A bucket with more than ``bucket_limit`` distinct fingerprints (found by a partially aggregated count) is
not compared as a whole: its members are keyed again by a second covering family, whose masks are joined
with the first, and so on. Each level keeps the guarantee, leaves about half as many free bits, and
ends at the latest when a key holds the whole fingerprint. Inside a bucket only a spanning forest of the links
is emitted, never all pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ids_and_text, written
from .graph import connected_components

SHINGLE_WORDS = 3
RADIUS = 3
HASH_SEED = 42
BUCKET_LIMIT = 512


def simhash(text: str, words: int = SHINGLE_WORDS) -> int:
    """A-Z lower-cased, words split at ASCII white space, shingles of ``words`` words joined by a space
    (repeats count; a shorter text is one shingle; no word: 0). Bit b is set if it is set in over half
    of the shingles' XXH64."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: only ASCII letters and white space
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begin = np.concatenate(([0], ends[:n - 1])).tolist()
    stop = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(begin[at:at + (1 << 16)], stop[at:at + (1 << 16)])],
                     "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp: the SimHash as a signed 64-bit value (null text: empty), tk: a 64-bit hash of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhash(t, words) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "tk": batch.column(1), "fp": pa.array(values.view(np.int64))})

    return ids_and_text(docs).select("doc_id", F.xxhash64("text").alias("tk"), "text").mapInArrow(
        run, "doc_id long, tk long, fp long")


def covering_masks(radius: int = RADIUS, level: int = 0, bits: int = 64) -> list[int]:
    """The masks of one covering family; each level shuffles the positions anew."""
    vectors = (1 << (radius + 1)) - 1
    order = list(range(bits))
    random.Random(1000 + level).shuffle(order)
    own = [1 + at % vectors for at in order]
    return [sum(1 << i for i in range(bits) if (own[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links values at ``radius`` or fewer differing bits."""
    rest, out = values, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out.extend((int(x), int(y)) for y in found)
                frontier.extend(found)
                rest = rest[~near]
    return out


def links_in_buckets(members: DataFrame, radius: int) -> DataFrame:
    """members(path, key, fp) -> links(a, b); rows of a bucket are neighbours in the sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from forest([h[:cut] for h in held])
            held = [h[cut:] for h in held]
        yield from forest(held)

    def forest(cols):
        path, key, fp = cols
        if not len(fp):
            return
        edge = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        out = [x for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)]) if b - a > 1
               for x in spanning_links(fp[a:b].view(np.uint64), radius)]
        if out:
            pairs = np.array(out, np.uint64).view(np.int64)
            yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return members.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(
        run, "a long, b long")


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes(fp)`` whose connected components are those of all
    pairs within ``radius``."""
    spark = nodes.sparkSession
    rows = nodes.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"))
    links, level = None, 0
    while True:
        masks = covering_masks(radius, level)
        keyed = rows.select("fp", F.explode(F.array(*[
            F.struct((F.col("path") * (len(masks) + 1) + t).alias("path"),
                     F.col("mask").bitwiseOR(F.lit(signed(m))).alias("mask")) for t, m in enumerate(masks, 1)])).alias("k"))
        keyed = keyed.select("fp", "k.path", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))
        # the path names the masks from the top, the key holds their bits: equal for members of one bucket at all levels
        size = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = written(keyed.join(size, ["path", "key"]), "buckets")
        found = links_in_buckets(members.where(F.col("n") <= bucket_limit), radius)
        links = found if links is None else links.unionByName(found)
        rows = members.where(F.col("n") > bucket_limit).select("fp", "path", "mask")
        level += 1
        if rows.isEmpty():
            return links


def rooted(prints: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """prints(doc_id, fp, ...) -> fp, first_doc (its smallest doc_id), root of its component: one row per fingerprint."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-nodes")
    roots = connected_components(near_links(nodes, radius, bucket_limit), "simhash-links")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                       bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id
    join components but never name one, unless no row of the component has an id (then it is null).
    Repeated rows give repeated results. An empty table gives no row; extra columns are ignored.
    """
    prints = written(fingerprints(docs, words), "simhash")
    owned = rooted(prints, radius, bucket_limit)
    least = owned.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    labels = owned.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS,
                bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The rows of docs, all columns, one for each component: the one with the smallest doc_id (null last; then the
    smallest text hash; of rows that repeat both, any one)."""
    prints = written(fingerprints(docs, words), "simhash")
    owned = rooted(prints, radius, bucket_limit).select("fp", "root")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("keep_id"), "tk")
    # smallest key of a fingerprint first: no copies meet in the join
    first = prints.groupBy("fp").agg(F.min(key).alias("key")).join(owned, "fp").groupBy("root").agg(
        F.min("key").alias("key")).select("key.*")
    again = prints.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key.*", "rows")
    chosen = first.join(again, ["keep_id", "no_id", "tk"], "left").withColumn("rows", F.coalesce("rows", F.lit(1)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("keep_id"),
                       F.col("doc_id").isNull().alias("no_id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tk"))
    kept = rows.join(chosen, ["keep_id", "no_id", "tk"])
    single = kept.where("rows = 1").select("row")
    repeated = kept.where("rows > 1").dropDuplicates(["keep_id", "no_id", "tk"]).select("row")
    return single.unionByName(repeated).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
