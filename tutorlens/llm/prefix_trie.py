"""The trie of conversation prefixes, by ROLLUP over positional turn-id columns.

1. Turns. Each turn's role and text become one turn id (128 bits of SHA-256, then the text's length in code points); the text
   goes no further. Turns are numbered in (turn, role, id) order by a range sort whose ranges are stitched with the counts
   of a conversation's earlier ranges, so one conversation may hold any share of the rows.
2. Blocks. A conversation is cut into blocks of ``WIDTH`` turns: one row a block with the columns ``t1 .. tWIDTH``, and
   the key of the trie node at which the block begins. The key of a node is the depth and the XOR of 128-bit hashes of
   its (position, turn id) pairs, which a running XOR over the blocks gives. All blocks of all lengths are then in one table,
   and ``GROUP BY block, key, ROLLUP (t1 .. tWIDTH)`` aggregates every prefix of every conversation at once; the depth comes
   from ``grouping_id``. A shorter conversation has nulls in its last columns; the levels beyond its end are left out.
3. Subtree sums. Each node counts for the smallest conversation that goes through it. These are put into a second ROLLUP:
   the sum over the members of a node is the sum over its subtree and over those nodes above that count for
   the same smallest member, which a running sum along this conversation takes off again.
4. A conversation's id goes to the node where it ends; ids are sorted by ranges and joined to strings there, and a
   node's strings are hashed one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_groups, written

WIDTH = 8              # turns a block
PREFIX_EVERY = 100     # conversations share the beginning of the conversation whose id is the last multiple of this
PREFIX_TURNS = 6       # ... its first crc32(id) % PREFIX_TURNS turns
SPAN = 1024            # rows that one window of a running aggregate holds
JOINED = 1 << 16       # characters of joined ids in one row
NODE = ["depth", "k1", "k2"]


# --- turns ---------------------------------------------------------------------------------------------------------

def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, tid; null role and text: empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.concat(F.substring(digest, 1, 32), F.lit(":"), F.char_length(text).cast("string")).alias("tid"))


def code_points(tid: Column) -> Column:
    return F.substring(tid, 34, 20).cast("long")


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), tid: turns by (turn, null first; role; tid)."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tid")]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = written(ranged.select("conv_id", "tid", F.shiftright("at", 33).alias("part"), "at"), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("conv_id", "part", "low", "before")
    return with_starts(rows, first).select("conv_id", (F.col("at") - F.col("low") + F.col("before") + 1).alias("pos"), "tid")


def with_starts(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows joined with first on (conv_id, part). The first and last conversation of a range alone can lie in several
    ranges: their entries, at most two for each range, are broadcast; the others have no more rows than a range."""
    first = written(first, "turn-ranges")
    spans = first.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    several = F.broadcast(first.join(spans, "conv_id", "left_semi"))
    alone = rows.join(F.broadcast(spans), "conv_id", "left_anti").join(first, ["conv_id", "part"])
    return rows.join(several, ["conv_id", "part"]).unionByName(alone)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, pos, tid) -> the rebuilt conversations in the same form, and all ids: (conv_id, taken), where
    taken is the number of turns that come from the conversation that lends its beginning."""
    ids = turns.select("conv_id").distinct().select(
        "conv_id", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(PREFIX_TURNS)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % PREFIX_EVERY).alias("base"))
    lent = turns.where((F.col("conv_id") % PREFIX_EVERY == 0) & (F.col("pos") < PREFIX_TURNS)).groupBy(
        F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("begin"))
    begin = F.coalesce("begin", F.array().cast("array<struct<pos:bigint,tid:string>>"))
    ids = written(ids.join(lent, "base", "left").select(
        "conv_id", "h", F.slice(begin, F.lit(1), F.col("h").cast("int")).alias("begin"))
        .withColumn("taken", F.size("begin")), "conversations")
    begins = ids.select("conv_id", F.inline("begin"))
    weights = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    own = join_groups(turns, written(ids.join(weights, "conv_id").select("conv_id", "h", "taken", "turns"), "conversation-sizes"),
                      ["conv_id"], "turns").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid")
    return begins.unionByName(own), ids.select("conv_id", "taken")


# --- blocks --------------------------------------------------------------------------------------------------------

def running(df: DataFrame, key: str, order: str, values: dict[str, Column], combine) -> DataFrame:
    """df with, for each value, its aggregate (``combine``; null: none) over the rows of the key with a smaller ``order``, a
    number from 0 that is dense enough to cut the rows into spans of SPAN: windows inside a span, then one over the spans."""
    df = df.withColumn("span", F.floor(F.col(order) / SPAN))
    inside = Window.partitionBy(key, "span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = df.groupBy(key, "span").agg(*[combine(v).alias(f"{n}_span") for n, v in values.items()]).select(
        key, "span", *[combine(f"{n}_span").over(above).alias(f"{n}_above") for n in values]).where("span > 0")
    return df.select("*", *[combine(v).over(inside).alias(f"{n}_inside") for n, v in values.items()]).join(
        spans, [key, "span"], "left")


def link(pos: Column, tid: Column, seed: int) -> Column:
    """Half of the hash of a (position, turn id) pair; 0 where there is no turn."""
    return F.coalesce(F.when(tid.isNotNull(), F.xxhash64(F.lit(seed), pos.cast("long"), tid)), F.lit(0).cast("long"))


def blocks(turns: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """One row for each block of each conversation: conv_id, block, k1, k2 (key of the node where it begins), t1 ..
    t<width>, filled (turns in it). A turnless conversation has an empty block."""
    place = F.pmod(F.col("pos") - 1, F.lit(width))
    cut = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / width).alias("block")).agg(
        *[F.max(F.when(place == i, F.col("tid"))).alias(f"t{i + 1}") for i in range(width)],
        F.count(F.lit(1)).alias("filled"),
        F.bit_xor(link(F.col("pos"), F.col("tid"), 1)).alias("own1"),
        F.bit_xor(link(F.col("pos"), F.col("tid"), 2)).alias("own2"))
    empty = ids.join(cut.where("block = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("string").alias(f"t{i + 1}") for i in range(width)],
        F.lit(0).cast("long").alias("filled"), F.lit(0).cast("long").alias("own1"), F.lit(0).cast("long").alias("own2"))
    zero = F.lit(0).cast("long")
    keyed = running(written(cut, "blocks"), "conv_id", "block", {"k1": F.col("own1"), "k2": F.col("own2")}, F.bit_xor)
    keyed = keyed.select("conv_id", "block", *[f"t{i + 1}" for i in range(width)], "filled", "own1", "own2", *[
        F.coalesce(f"{k}_inside", zero).bitwiseXOR(F.coalesce(f"{k}_above", zero)).alias(k) for k in ("k1", "k2")])
    empty = empty.withColumns({"k1": zero, "k2": zero})
    return keyed.unionByName(empty)


def rolled_up(rows: DataFrame, width: int, aggregates: list[Column]) -> DataFrame:
    """Every prefix in rows (blocks with further columns) with the aggregates over its members: depth, k1, k2, p1, p2 (key
    of its parent), points (code points of its last text), and the aggregates."""
    turns = [f"t{i + 1}" for i in range(width)]
    grouped = rows.sparkSession.sql(
        f"SELECT block, k1, k2, {', '.join(turns)}, grouping_id() AS gid, {', '.join(aggregates)} "
        f"FROM {{rows}} GROUP BY block, k1, k2, ROLLUP ({', '.join(turns)})", rows=rows)
    level = F.lit(width) - F.bit_count(F.col("gid"))
    # a level beyond the end of a conversation groups what ends there, and the top of a later block is the end of the one before
    last = F.element_at(F.array(F.lit(""), *turns), (level + 1).cast("int"))
    grouped = grouped.withColumn("level", level).withColumn("last", last).where(
        "last is not null and (level > 0 or block = 0)")
    first = F.col("block") * width
    keys = []
    for s in (1, 2):
        links = [link(first + i + 1, F.col(t), s) for i, t in enumerate(turns)]
        whole = F.col(f"k{s}")
        for x in links:       # columns below the level are null and give 0
            whole = whole.bitwiseXOR(x)
        own = F.when(F.col("level") > 0, link(first + F.col("level"), F.col("last"), s)).otherwise(F.lit(0).cast("long"))
        keys += [whole.alias(f"n{s}"), own.alias(f"o{s}")]
    return grouped.select("*", *keys).select(
        (first + F.col("level")).alias("depth"), F.col("n1").alias("k1"), F.col("n2").alias("k2"),
        F.col("n1").bitwiseXOR(F.col("o1")).alias("p1"), F.col("n2").bitwiseXOR(F.col("o2")).alias("p2"),
        F.when(F.col("level") > 0, code_points(F.col("last"))).otherwise(F.lit(0)).alias("points"),
        *[a.rpartition(" AS ")[2] for a in aggregates])


# --- ends ----------------------------------------------------------------------------------------------------------

def digest_of_ids(ends: DataFrame) -> DataFrame:
    """ends(depth, k1, k2, conv_id) -> depth, k1, k2, ends_sha256. Ids are sorted by ranges of (node, id), joined to strings of
    about JOINED characters there, and a node's strings are hashed in order: a node with any number of ids is read as a stream."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []
        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != node or size >= JOINED):
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                    if len(out) >= 10_000 or len(out[-1][-1]) >= JOINED:
                        yield strings(out)
                        out = []
                node = key
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield strings(out)

    def strings(rows):
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip((*NODE, "conv_id", "ids"), zip(*rows), kinds)})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
                if key == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield digests(out)
                out = []
        if node:
            yield digests([(*node, state.hexdigest())])

    def digests(rows):
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.record_batch({n: pa.array(c, k) for n, c, k in zip((*NODE, "ends_sha256"), zip(*rows), kinds)})

    order = [*NODE, "conv_id"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        join, "depth long, k1 long, k2 long, conv_id long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(
        hashed, "depth long, k1 long, k2 long, ends_sha256 string")


# --- the operator ----------------------------------------------------------------------------------------------------

def prefix_trie(turns: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """turns(conv_id, pos from 1 without gaps, tid) and ids(conv_id), all conversations, turnless ones too -> one row
    for each distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and k1, k2 (the node's key at its depth). Without conversations there is no row."""
    table = written(blocks(turns, ids.select("conv_id"), width), "trie-blocks")
    zero = F.lit(0).cast("long")
    lengths = table.groupBy("conv_id").agg(
        F.sum("filled").alias("length"), F.bit_xor("own1").alias("e1"), F.bit_xor("own2").alias("e2"))
    lengths = written(lengths, "trie-lengths")
    members = ["count(1) AS n_convs", "min(conv_id) AS conv_id", "max(conv_length) AS longest"]
    sized = written(with_totals(table, lengths.select("conv_id", F.col("length").alias("conv_length"))), "trie-rows")
    first = written(rolled_up(sized, width, members), "trie-nodes")
    saved = (F.col("n_convs") - 1) * F.col("points")
    leaf = F.col("longest") == F.col("depth")
    totals = first.groupBy("conv_id").agg(F.sum(saved).alias("saved"), F.sum(leaf.cast("long")).alias("leaves"))
    second = written(rolled_up(with_totals(sized, totals), width, [
        *members, "sum(coalesce(saved, 0)) AS saved_below", "sum(coalesce(leaves, 0)) AS n_leaves"]), "trie-sums")
    children = second.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"),
                                                F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = second.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # the nodes above that count for the same conversation
    nodes = running(nodes, "conv_id", "depth", {"saved": saved}, F.sum).withColumn(
        "saved_tokens", F.col("saved_below") - F.coalesce("saved_inside", zero) - F.coalesce("saved_above", zero))
    ends = digest_of_ids(lengths.select(F.col("length").alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id"))
    nodes = written(nodes.join(ends, NODE, "left").select(
        *NODE, "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")), "trie")
    parents = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                                                   F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = nodes.where("depth > 0").withColumn("up", F.col("depth") - 1).withColumnRenamed("n_children", "own_children")
    below = join_groups(below, parents, ["up", "p1", "p2"], "n_children").drop("n_children").withColumnRenamed(
        "own_children", "n_children")
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "k1", "k2"]
    return below.select(*names).unionByName(top.select(*names))


def with_totals(table: DataFrame, totals: DataFrame) -> DataFrame:
    """table with the columns of totals (one row a conversation, at most) at each block of the conversation."""
    size = table.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own_blocks"))
    return join_groups(table, written(size.join(totals, "conv_id", "left"), "trie-totals"), ["conv_id"], "own_blocks").drop(
        "own_blocks")


def conversation_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """The prefix trie of the rebuilt conversations: the first crc32(conv_id) % 6 turns of conversation
    conv_id - conv_id % 100 (all if fewer, none if absent), then the conversation's own turns after that many.

    Turns are ordered by turn, null first; rows with the same turn by role, then by turn id. Null role and text are empty
    strings. Rows with a null conv_id belong to no conversation and take no part. Rows that repeat count as turns of their
    own. An empty table gives no row; other columns are ignored."""
    turns = written(in_order(turn_ids(conversations)), "turn-order")
    return prefix_trie(*rebuilt(turns), width)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = conversation_trie(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))
    return trie.drop("k1", "k2")


OP11_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
           substr(sha256(length(role) || ':' || role || text), 1, 32) || ':' || length(text)) AS pos,
         length(role) || ':' || role || text AS said, length(text) AS points
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(conv_id::VARCHAR, ''), lambda ch: list_concat([ascii(ch)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
           lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, (a & 1) * 3988292384) ELSE xor(a, b) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.said, t.points FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.said, t.points FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
p AS (
  SELECT c.conv_id, coalesce(x.said, []) AS said, coalesce(x.points, []) AS points
  FROM c LEFT JOIN (SELECT conv_id, list(said ORDER BY own, pos) AS said, list(points ORDER BY own, pos) AS points
                    FROM r GROUP BY conv_id) x ON x.conv_id = c.conv_id),
m AS (
  SELECT conv_id, said[1:depth] AS prefix, depth, len(said) AS turns, CASE WHEN depth = 0 THEN 0 ELSE points[depth] END AS points
  FROM (SELECT *, unnest(range(0, len(said) + 1)) AS depth FROM p)),
n AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(points) AS saved,
         (max(turns) = depth)::INT AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM m GROUP BY depth, prefix),
below AS (
  SELECT up, prefix[1:up] AS prefix, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves,
         count(*) FILTER (WHERE depth = up + 1) AS n_children
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM n) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM n JOIN below b ON b.up = n.depth AND b.prefix = n.prefix
LEFT JOIN n u ON u.depth = n.depth - 1 AND u.prefix = n.prefix[1:n.depth - 1]
"""
