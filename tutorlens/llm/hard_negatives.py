"""Hard negatives by a GNAT-style multiway hyperplane tree.

1. Tree. Split points come from a sample of distinct vectors (about ``SAMPLE_ROWS``, chosen by hash; the bound of what is
   broadcast). A node has up to ``FANOUT`` split points, far from each other; a vector goes to the child of the
   nearest one. Every row is indexed. Each split point stores, for every sibling subtree, the range of its distances
   to the vectors there, and each subtree the range of its squared lengths: minima and maxima over all rows.
2. Search. A window of inner products (low, high) is a window of distances, because
   ``|q - x|^2 = |q|^2 + |x|^2 - 2 q.x`` and the lengths in a subtree are known: an annulus around the query. By the
   triangle inequality a split point at distance d from the query, with the range (m, M) to a sibling, leaves
   distances of max(d - M, m - d) to d + M there; the sibling is dropped if this misses the annulus. What is left are
   leaves, which are scored exactly, in integers.
3. Positives: the best of one piece of the anchor's own leaf give a lower bound, with which the tree is searched. Negatives: the tree is
   searched with one window for each positive.

Leaves are dealt into pieces of about ``PIECE_ROWS`` rows, so equal vectors, which no split point can tell apart, do not
meet in one task; a task holds one piece and streams its queries past.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE_ROWS = 8192
FANOUT = 16
LEAF_ROWS = 1024
PIECE_ROWS = 4096
STEP = 256             # queries scored together against a piece
LIMIT = 1 << 24        # of a scaled component, so that inner products fit 64 bits
LAST = (1 << 63) - 1
SLACK = 1e-6           # of distances, relative: floating point never drops a subtree that just touches the window

ROW = "leaf int, rid long, vec_id long, label long, vec array<int>"
RANGE = "node int, split int, child int, low double, high double, short double, long double"
REQUEST = "leaf int, piece int, kind int, rid long, vec_id long, label long, vec array<int>, lows array<long>, highs array<long>"
FOUND = "rid long, place int, score long, vec_id long, other long"


# --- vectors ---------------------------------------------------------------------------------------------------------

def scaled_rows(embeddings: DataFrame, label: Column) -> DataFrame:
    """rid (unique), vec_id, label, vec: components times 256, rounded down, kept within +-LIMIT. Rows with a null label
    or vector, or a null or non-finite component, are left out."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(256 * x.cast("double"), F.lit(float(LIMIT))),
                                                                F.lit(float(-LIMIT)))).cast("int"))
    return written(embeddings.where("label is not null and embedding is not null").where(whole).select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), vec.alias("vec")), "vectors")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(size) * dim:
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int32)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, as integers."""
    top = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def squares(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.float64) ** 2).sum(axis=1)


def distances(a: np.ndarray, points: np.ndarray) -> np.ndarray:
    a, points = a.astype(np.float64), points.astype(np.float64)
    return np.sqrt(np.maximum(squares(a)[:, None] + squares(points)[None, :] - 2 * (a @ points.T), 0))


# --- tree ------------------------------------------------------------------------------------------------------------

@dataclass
class Node:
    """points: the split points. children: below each a node's number, or -1 - leaf. With ranges: low[i, j], high[i, j] are the least and
    largest distance of split point i to the rows below child j, short[j], long[j] the range of their squared lengths."""

    points: np.ndarray
    children: list[int] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    short: np.ndarray | None = None
    long: np.ndarray | None = None


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Split points: each the one farthest from those chosen before (the first: farthest from the mean)."""
    away = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(away.argmax())]
    near = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def build(sample: np.ndarray, rows: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> tuple[list[Node], int]:
    """The nodes (the first is the root) and the number of leaves, for so many rows distributed like the sample."""
    nodes: list[Node] = []
    leaves = 0

    def grow(own: np.ndarray) -> int:
        nonlocal leaves
        expected = rows * len(own) / max(1, len(sample))
        wanted = min(fanout, int(np.ceil(expected / leaf_rows)))
        points = far_apart(own, wanted) if wanted > 1 and len(own) > wanted else own[:0]
        if len(points) < 2:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append(Node(points))
        nearest = distances(own, points).argmin(axis=1)
        nodes[at].children = [grow(own[nearest == j]) for j in range(len(points))]
        return at

    grow(sample)
    return nodes, leaves


def descend(nodes: list[Node], x: np.ndarray, visit=None) -> np.ndarray:
    """The leaf of each row of x; visit(node number, distances, child of each row, rows) at every node."""
    leaf = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        at, own = todo.pop()
        away = distances(x[own], nodes[at].points)
        nearest = away.argmin(axis=1)
        if visit:
            visit(at, away, nearest, own)
        for j, child in enumerate(nodes[at].children):
            below = own[nearest == j]
            if not len(below):
                continue
            if child < 0:
                leaf[below] = -1 - child
            else:
                todo.append((child, below))
    return leaf


def index_rows(rows: DataFrame, nodes, dim: int) -> DataFrame:
    """rows with their leaf, and for every partition the ranges it has seen (rows with ``node``)."""
    tree = rows.sparkSession.sparkContext.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = tree.value
        ranges: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = matrix(batch.column(3), dim)
            length = squares(x)

            def visit(at, away, nearest, own):
                k = away.shape[1]
                low, high, short, long = ranges.setdefault(at, [np.full((k, k), np.inf), np.full((k, k), -np.inf),
                                                                np.full(k, np.inf), np.full(k, -np.inf)])
                for j in np.unique(nearest).tolist():
                    of = nearest == j
                    low[:, j] = np.minimum(low[:, j], away[of].min(axis=0))
                    high[:, j] = np.maximum(high[:, j], away[of].max(axis=0))
                    short[j] = min(short[j], length[own[of]].min())
                    long[j] = max(long[j], length[own[of]].max())

            leaf = descend(nodes, x, visit)
            yield as_batch({"leaf": pa.array(leaf), **{n: batch.column(n) for n in ("rid", "vec_id", "label", "vec")}}, batch.num_rows)
        out = [(at, i, j, low[i, j], high[i, j], short[j], long[j]) for at, (low, high, short, long) in ranges.items()
               for i in range(len(short)) for j in range(len(short)) if short[j] <= long[j]]
        if out:
            kinds = [pa.int32()] * 3 + [pa.float64()] * 4
            yield as_batch({c.split()[0]: pa.array(v, k) for c, v, k in zip(RANGE.split(", "), zip(*out), kinds)}, len(out))

    kinds = {"leaf": pa.int32(), "rid": pa.int64(), "vec_id": pa.int64(), "label": pa.int64(), "vec": pa.list_(pa.int32()),
             **{n: pa.int32() for n in ("node", "split", "child")}, **{n: pa.float64() for n in ("low", "high", "short", "long")}}

    def as_batch(columns, count):
        return pa.record_batch({n: columns[n] if n in columns else pa.nulls(count, k) for n, k in kinds.items()})

    return written(rows.select("rid", "vec_id", "label", "vec").mapInArrow(run, f"{ROW}, {RANGE}"), "vector-index")


@dataclass
class Index:
    """rows(leaf, piece, rid, vec_id, label, vec), the nodes with their ranges, and the number of pieces of each leaf."""

    rows: DataFrame
    nodes: list[Node]
    pieces: np.ndarray
    dim: int


def fit_index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS,
              piece_rows: int = PIECE_ROWS) -> Index:
    count, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    share = min(1.0, sample_rows / max(1, count))
    drawn = rows.where(F.pmod(F.xxhash64("vec", F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("vec").distinct()
    drawn = sorted(tuple(r[0]) for r in drawn.collect())
    sample = np.array([[*v, *[0] * (dim - len(v))] for v in drawn], np.int32).reshape(len(drawn), dim)
    nodes, leaves = build(sample, count, fanout, leaf_rows)
    indexed = index_rows(rows, nodes, dim)
    for n in nodes:
        k = len(n.points)
        n.low, n.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        n.short, n.long = np.full(k, np.inf), np.full(k, -np.inf)
    seen = indexed.where("node is not null").groupBy("node", "split", "child").agg(
        F.min("low"), F.max("high"), F.min("short"), F.max("long"))
    for at, i, j, low, high, short, long in seen.collect():      # at most FANOUT for each split point
        n = nodes[at]
        n.low[i, j], n.high[i, j], n.short[j], n.long[j] = low, high, short, long
    indexed = indexed.where("node is null")
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("pieces")).collect()  # one row a leaf
    pieces = np.zeros(max(1, leaves), np.int64)
    for r in sizes:
        pieces[r["leaf"]] = r["pieces"]
    per_leaf = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in sizes], "leaf int, pieces int"))
    return Index(indexed.join(per_leaf, "leaf").select(
        "leaf", F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("int").alias("piece"), "rid", "vec_id", "label", "vec"),
        nodes, pieces, dim)


# --- search ------------------------------------------------------------------------------------------------------------

def reachable(nodes: list[Node], q: np.ndarray, windows: list[list[tuple[int, int]]]) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, which rows of q have to look there): no vector of any other leaf has an inner product in a window."""
    most = max((len(w) for w in windows), default=0)
    low = np.array([[a for a, _ in w] + [np.inf] * (most - len(w)) for w in windows], np.float64).reshape(len(q), most)
    high = np.array([[b for _, b in w] + [-np.inf] * (most - len(w)) for w in windows], np.float64).reshape(len(q), most)
    length = squares(q)
    todo = [(0, np.arange(len(q)))] if nodes else []
    if not nodes:
        yield 0, np.flatnonzero((low <= high).any(axis=1))
    while todo:
        at, own = todo.pop()
        node = nodes[at]
        away = distances(q[own], node.points)
        for j, child in enumerate(node.children):
            if node.short[j] > node.long[j]:      # no row there
                continue
            nearest = np.maximum(away - node.high[:, j], node.low[:, j] - away).max(axis=1).clip(0)
            farthest = (away + node.high[:, j]).min(axis=1)
            size = length[own] + node.long[j]
            slack = SLACK * (size + 1)
            inner = (length[own] + node.short[j])[:, None] - 2 * high[own]       # squared distances of the window
            outer = size[:, None] - 2 * low[own]
            touch = (nearest[:, None] ** 2 <= outer + slack[:, None]) & (farthest[:, None] ** 2 + slack[:, None] >= inner)
            below = own[(touch & (low[own] <= high[own])).any(axis=1)]
            if not len(below):
                continue
            if child < 0:
                yield -1 - child, below
            else:
                todo.append((child, below))


def requests(queries: DataFrame, index: Index, home: bool) -> DataFrame:
    """queries(rid, vec_id, label, vec, lows, highs) -> one row for each piece that a query has to look at. ``home``: only
    one piece of the leaf into which the query's own vector falls."""
    tree = queries.sparkSession.sparkContext.broadcast((index.nodes, index.pieces))
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, pieces = tree.value
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                yield from step(nodes, pieces, batch.slice(start, STEP))

    def step(nodes, pieces, batch):
        q = matrix(batch.column("vec"), dim)
        if home:
            leaf = descend(nodes, q)
            yield out(batch, leaf, np.arange(len(q)) % np.maximum(pieces[leaf], 1))
            return
        windows = [list(zip(a, b)) for a, b in zip(batch.column("lows").to_pylist(), batch.column("highs").to_pylist())]
        for leaf, own in reachable(nodes, q, windows):
            for piece in range(pieces[leaf]):
                yield out(batch.take(pa.array(own)), np.full(len(own), leaf), np.full(len(own), piece))

    def out(batch, leaf, piece):
        count = batch.num_rows
        return pa.record_batch({"leaf": pa.array(leaf, pa.int32()), "piece": pa.array(piece, pa.int32()),
                                "kind": pa.array(np.ones(count), pa.int32()),
                                **{n: batch.column(n) for n in ("rid", "vec_id", "label", "vec", "lows", "highs")}})

    return queries.select("rid", "vec_id", "label", "vec", "lows", "highs").mapInArrow(run, REQUEST)


def search(queries: DataFrame, index: Index, same_label: bool, best: int, home: bool = False) -> DataFrame:
    """For each query and each of its windows (place in lows and highs) the ``best`` rows of each piece that has to be looked at, of the
    query's label or of other labels, without the query's own row: rid (the query's), place, score, vec_id, other (the row's rid)."""
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, piece = None, [], None
        for batch in batches:
            where = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(where)), cuts):
                if not len(part):
                    continue
                *at, kind = where[part[0]].tolist()
                if at != key:
                    key, held, piece = at, [], None
                own = batch.slice(int(part[0]), len(part))
                if kind == 0:
                    held.append(own)
                elif held:
                    piece = piece or Piece(held, dim)
                    for start in range(0, own.num_rows, STEP):
                        yield from piece.best(own.slice(start, STEP), same_label, best)

    data = index.rows.select("leaf", "piece", F.lit(0).alias("kind"), "rid", "vec_id", "label", "vec",
                             F.lit(None).cast("array<long>").alias("lows"), F.lit(None).cast("array<long>").alias("highs"))
    return data.unionByName(requests(queries, index, home)).repartition("leaf", "piece").sortWithinPartitions(
        "leaf", "piece", "kind").mapInArrow(run, FOUND)


class Piece:
    """The rows of one piece of a leaf."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        self.dim = dim
        self.x = np.concatenate([matrix(b.column("vec"), dim) for b in batches])
        self.rid, self.label = (np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in batches]) for n in ("rid", "label"))
        self.id = np.concatenate([b.column("vec_id").fill_null(LAST).to_numpy(zero_copy_only=False) for b in batches])
        self.no_id = np.concatenate([b.column("vec_id").is_null().to_numpy(zero_copy_only=False) for b in batches])

    def best(self, queries: pa.RecordBatch, same_label: bool, best: int) -> Iterator[pa.RecordBatch]:
        scores = products(matrix(queries.column("vec"), self.dim), self.x)
        out = []
        for s, rid, label, lows, highs in zip(scores, *(queries.column(n).to_pylist() for n in ("rid", "label", "lows", "highs"))):
            fit = np.flatnonzero(((self.label == label) == same_label) & (self.rid != rid) & (s >= min(lows)) & (s <= max(highs)))
            if not len(fit):
                continue
            for place, (low, high) in enumerate(zip(lows, highs)):
                own = fit[(s[fit] >= low) & (s[fit] <= high)]
                if len(own) > best:
                    own = own[s[own] >= -np.partition(-s[own], best - 1)[best - 1]]
                own = own[np.lexsort((self.rid[own], self.id[own], self.no_id[own], -s[own]))[:best]]
                out += [(rid, place, int(s[i]), None if self.no_id[i] else int(self.id[i]), int(self.rid[i])) for i in own.tolist()]
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch({c.split()[0]: pa.array(v, k) for c, v, k in zip(FOUND.split(", "), zip(*out), kinds)})


def ranked(found: DataFrame, best: int) -> DataFrame:
    """The best of all pieces, with ``rank`` from 1."""
    order = Window.partitionBy("rid", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def window(low: Column, high: Column) -> list[Column]:
    return [F.array(low).alias("lows"), F.array(high).alias("highs")]


def hard_negatives(rows: DataFrame, index: Index, anchors: DataFrame, positives: int = 5, negatives: int = 5,
                   lowest: int = 80, highest: int = 100) -> DataFrame:
    """rows(rid, vec_id, label, vec) in the index; anchors: some of these rows. For each anchor its ``positives`` best other rows of
    the same label, and for each of them the ``negatives`` best rows of other labels whose score is from ``lowest`` to ``highest``
    per cent of the positive's (none if that is negative). anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    least, most = F.lit(-LAST), F.lit(LAST)
    near = ranked(search(anchors.select("*", *window(least, most)), index, True, positives, home=True), positives)
    floor = near.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    asked = anchors.join(floor, "rid", "left").withColumn(
        "floor", F.when(F.col("n") >= positives, F.col("floor")).otherwise(least))
    chosen = written(ranked(search(asked.select(*anchors.columns, *window(F.col("floor"), most)), index, True, positives),
                            positives), "positives")
    # ceil(lowest * score / 100), for the scores of 0 or more that alone have a window
    wanted = chosen.where("score >= 0").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.expr(f"(score * {lowest} + 99) div 100").alias("low"), F.expr(f"score * {highest} div 100").alias("high")))).alias("w"))
    asked = anchors.join(wanted, "rid").select(*anchors.columns, F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = ranked(search(asked, index, False, negatives), negatives)
    # windows stand in the order of the positives' ranks, from 1 without gaps: scores only fall
    pairs = chosen.select("rid", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
                          F.col("score").alias("positive_score")).join(
        anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return found.join(pairs, ["rid", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(embeddings: DataFrame, **sizes) -> DataFrame:
    """Hard negatives of all rows whose vec_id is divisible by 100.

    Where vec_id is divisible by 7, the label first becomes (label + 1) % 10. Rows with a null label, vector or
    component, or a component that is not finite, take no part. Shorter vectors end in zeros; scaled components stay within +-2^24. Rows with a null vec_id
    are found (last among ties) but are no anchors; rows that repeat a vec_id are rows of their own, each an anchor if the
    id is. An empty table gives no row; other columns are ignored."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = scaled_rows(embeddings.select("vec_id", "embedding", "label"), label)
    index = fit_index(rows, **sizes)
    return hard_negatives(rows, index, rows.where("vec_id % 100 = 0"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label AS own, e.vec_id, e.rid AS other, e.label,
         list_inner_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON e.rid <> a.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND s.label <> p.own AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
