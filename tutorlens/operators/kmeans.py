"""K-Means with restarts as a few aggregates, and the exact silhouette.

Vectors are z-scores on a grid of 1/SCALE, so that all sums are sums of whole numbers and do not depend on partitions or
their order. Equal vectors are one row with a weight. All runs (each number of clusters, each restart) move together: a pass takes each
row once for each run, with the run's centres from a literal, and one partially aggregated ``groupBy(run, cluster)`` returns
what the new centres need. Runs that have converged take no further part.

Seeding is k-means++: the next centre of a run is drawn with a probability in proportion to weight x squared distance. The draw is
an exponential race, the row with the least ``-ln(u) / (w * d2)``, with u from a hash of (seed, restart, step, row): one
aggregate for all runs, and the same draw on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1_000_000
BLOCK_ROWS = 2048      # vectors that a step of the silhouette measures against as many others
TILES = 16             # tiles of the silhouette, more only where one would hold over TILE_ROWS vectors
TILE_ROWS = 1 << 16
UNIT = 1_000_000_000   # silhouettes of vectors are added up in whole numbers of 1/UNIT
FAR = 1e300


@dataclass
class Fit:
    centres: list[list[float]]   # on the grid
    cost: float                  # sum of squared z-distances


def grid(scaled: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and x0, x1, ...: the z-scores on the grid, a missing one as 0. Written to the shared folder."""
    from ..session import scratch_path
    spark, path = scaled.sparkSession, scratch_path(scaled.sparkSession, "ml-vectors")
    out = scaled.select(*keep, *[F.coalesce(F.rint(F.col(c) * SCALE), F.lit(0.0)).cast("long").alias(f"x{i}")
                                 for i, c in enumerate(cols)])
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def distinct_points(vec: DataFrame, key: str, dim: int) -> DataFrame:
    """One row for each vector: x0.., w (rows that have it), id (the smallest key), vid (a number). Written."""
    from ..session import scratch_path
    spark, path = vec.sparkSession, scratch_path(vec.sparkSession, "ml-points")
    out = vec.groupBy(*[f"x{i}" for i in range(dim)]).agg(
        F.count(F.lit(1)).alias("w"), F.min(F.col(key).cast("string")).alias("id")).withColumn("vid", F.monotonically_increasing_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def distances(centres: Column, dim: int, width: int) -> Column:
    """Squared distances to ``width`` centres, whose coordinates stand one after the other; FAR where there is none."""
    def to(j: int) -> Column:
        out = None
        for i in range(dim):
            d = F.col(f"x{i}").cast("double") - centres[j * dim + i]
            out = d * d if out is None else out + d * d
        return F.coalesce(out, F.lit(FAR))

    return F.array(*[to(j) for j in range(width)])


def nearest_of(d: Column) -> Column:
    """The number of the least distance, the first of equal ones."""
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def flat(centres: list[list[float]], width: int, dim: int) -> str:
    own = [repr(float(x)) + "D" for c in centres for x in c]
    return f"array({', '.join([*own, *['CAST(NULL AS DOUBLE)'] * (width * dim - len(own))])})"


def nearest(centres: list[list[float]], dim: int) -> Column:
    return nearest_of(distances(F.expr(flat(centres, len(centres), dim)), dim, len(centres)))


def with_runs(points: DataFrame, centres: dict[int, list[list[float]]], dim: int, width: int) -> DataFrame:
    """points, once for each run, with the squared distances d to its centres. The centres are one array literal: the plan and
    its code stay the same from pass to pass."""
    runs = ", ".join(f"named_struct('run', {run}, 'c', {flat(own, width, dim)})" for run, own in centres.items())
    columns = ["w", "id", *[f"x{i}" for i in range(dim)]]
    return points.select(*columns, F.expr(f"inline(array({runs}))")).select(
        "run", *columns, distances(F.col("c"), dim, width).alias("d"))


def seed(points: DataFrame, dim: int, runs: dict[int, tuple[int, int]], random_state: int) -> dict[int, list[list[float]]]:
    """First centres of each run (its k, its restart) by k-means++; fewer than k where there are fewer vectors."""
    centres: dict[int, list[list[float]]] = {run: [] for run in runs}
    width = max(k for k, _ in runs.values())
    restart = F.element_at(F.lit([r for _, r in runs.values()]).cast("array<int>"), F.col("run") + 1)
    for step in range(width):
        open_runs = {run: own for run, own in centres.items() if len(own) == step and step < runs[run][0]}
        if not open_runs:
            break
        rows = with_runs(points, open_runs, dim, width)
        away = F.array_min("d")
        draw = F.md5(F.concat_ws(":", F.lit(str(random_state)), restart.cast("string"), F.lit(str(step)), F.col("id")).cast("binary"))
        u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        weight = F.col("w").cast("double") * (away if step else F.lit(1.0))
        race = (-F.log(u)) / weight
        won = rows.where(weight > 0).groupBy("run").agg(F.min(F.struct(
            race.alias("race"), "id", *[f"x{i}" for i in range(dim)])).alias("won")).collect()
        for r in won:
            centres[r["run"]].append([float(r["won"][f"x{i}"]) for i in range(dim)])
    return centres


def move(points: DataFrame, dim: int, centres: dict[int, list[list[float]]], max_iter: int, tol: float) -> dict[int, list[list[float]]]:
    """Lloyd's steps of all runs until each has moved by at most ``tol`` (squared, in z units) or ``max_iter`` steps are done. A centre
    that no row is nearest to stays where it is."""
    centres, active = dict(centres), set(centres)
    width = max(map(len, centres.values()))
    for _ in range(max_iter):
        if not active:
            break
        rows = with_runs(points, {run: centres[run] for run in sorted(active)}, dim, width)
        sums = rows.groupBy("run", nearest_of(F.col("d")).alias("cluster")).agg(
            F.sum("w").alias("n"), *[F.sum((F.col("w") * F.col(f"x{i}")).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)])
        new = {run: list(centres[run]) for run in active}
        for r in sums.collect():      # one row for each run and cluster
            new[r["run"]][r["cluster"]] = [float(r[f"s{i}"]) / float(r["n"]) for i in range(dim)]
        for run, own in new.items():
            shift = 0.0
            for a, b in zip(own, centres[run]):
                for x, y in zip(a, b):
                    shift += (x - y) * (x - y)
            centres[run] = own
            if shift <= tol * SCALE * SCALE:
                active.discard(run)
    return centres


def fit_best(points: DataFrame, dim: int, ks: list[int], random_state: int, n_init: int = 10, max_iter: int = 300,
             tol: float = 1e-4) -> dict[int, Fit]:
    """For each k the best of ``n_init`` restarts: least cost, then the lowest number."""
    runs = dict(enumerate((k, r) for k in ks for r in range(n_init)))
    centres = move(points, dim, seed(points, dim, runs, random_state), max_iter, tol)
    width = max(map(len, centres.values()))
    rows = with_runs(points, centres, dim, width)
    cost = {r["run"]: r["cost"] for r in rows.groupBy("run").agg(F.sum(
        (F.floor(F.array_min("d")).cast("decimal(19,0)") * F.col("w")).cast("decimal(38,0)")).alias("cost")).collect()}
    best = {}
    for k in ks:
        run = min((run for run, (own, _) in runs.items() if own == k), key=lambda run: (cost[run], run))
        best[k] = Fit(centres[run], float(cost[run]) / SCALE / SCALE)
    return best


# --- silhouette ----------------------------------------------------------------------------------------------------------

PAIR = "vid long, fit int, cluster int, far long, far_sq long"


def tiles(n: int) -> int:
    return max(1, min(TILES, -(-n // BLOCK_ROWS)), -(-n // TILE_ROWS))


def distance_sums(points: DataFrame, dim: int, sizes: list[int]) -> DataFrame:
    """points(vid, w, x0.., labels: array, one label for each fit) -> vid, fit, cluster, and the sums of the distances (far: 1/SCALE
    z units, each rounded; far_sq: squared ones) from the vector to all rows of the cluster.

    Vectors are dealt into TILES tiles (fewer of about BLOCK_ROWS vectors, more of about TILE_ROWS); each pair of tiles is a
    task's work, done once for both sides in steps of BLOCK_ROWS. A task adds up its steps and returns one sum for each
    vector, fit and cluster, so a vector is sent, and its sums come back, once for each tile and not once for each block."""
    blocks = tiles(points.count())
    own = F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int")
    paired = points.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "vid", "w",
        F.array(*[f"x{i}" for i in range(dim)]).alias("x"), "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(at)), cuts):
                if not len(part):
                    continue
                if key != at[part[0]].tolist():
                    yield from pair(held)
                    key, held = at[part[0]].tolist(), []
                held.append(batch.slice(int(part[0]), len(part)))
        yield from pair(held)

    def pair(held):
        if not held:
            return
        rows = pa.Table.from_batches(held)
        block = rows["block"].to_numpy()
        p, q = rows["p"][0].as_py(), rows["q"][0].as_py()
        vid, w = rows["vid"].to_numpy(), rows["w"].to_numpy().astype(np.float64)
        x = np.array(rows["x"].combine_chunks().flatten(), np.float64).reshape(len(vid), dim)
        labels = np.array(rows["labels"].combine_chunks().flatten()).reshape(len(vid), len(sizes))
        member = np.concatenate([(labels[:, [fit]] == np.arange(k)) * w[:, None] for fit, k in enumerate(sizes)], axis=1)
        a, b = np.flatnonzero(block == p), np.flatnonzero(block == q)
        far, far_sq = np.zeros((2, len(vid), member.shape[1]), np.int64)
        for left in steps(a):
            for right in steps(b):
                square = np.maximum((x[left] ** 2).sum(axis=1)[:, None] + (x[right] ** 2).sum(axis=1)[None, :] - 2 * (x[left] @ x[right].T), 0)
                # whole numbers below 2^53 a step, so floating-point products are exact
                for total, d in ((far, np.rint(np.sqrt(square))), (far_sq, np.rint(square / SCALE))):
                    total[left] += (d @ member[right]).astype(np.int64)
                    if p != q:
                        total[right] += (d.T @ member[left]).astype(np.int64)
        fit = np.repeat(np.arange(len(sizes)), sizes)
        cluster = np.concatenate([np.arange(k) for k in sizes])
        for own in steps(np.arange(len(vid))):
            yield pa.record_batch({
                "vid": pa.array(np.repeat(vid[own], len(fit))), "fit": pa.array(np.tile(fit, len(own)), pa.int32()),
                "cluster": pa.array(np.tile(cluster, len(own)), pa.int32()),
                "far": pa.array(far[own].ravel()), "far_sq": pa.array(far_sq[own].ravel())})

    def steps(at: np.ndarray) -> list[np.ndarray]:
        return [at[lo:lo + BLOCK_ROWS] for lo in range(0, len(at), BLOCK_ROWS)]

    return paired.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(run, PAIR).groupBy("vid", "fit", "cluster").agg(
        F.sum(F.col("far").cast("decimal(38,0)")).alias("far"), F.sum(F.col("far_sq").cast("decimal(38,0)")).alias("far_sq"))


def labels_of(points: DataFrame, dim: int, fits: list[Fit]) -> DataFrame:
    """points with labels, an array of the nearest centre under each fit. Written: three steps read it, and each distance is one
    column of one projection (in one expression they made a method too large to compile)."""
    from ..session import scratch_path
    spark, path = points.sparkSession, scratch_path(points.sparkSession, "ml-labels")
    columns = ["vid", "w", *[f"x{i}" for i in range(dim)]]
    far = [distances(F.expr(flat(f.centres, len(f.centres), dim)), dim, len(f.centres)).alias(f"d{i}") for i, f in enumerate(fits)]
    out = points.select(*columns, *far).select(*columns, F.array(*[nearest_of(F.col(f"d{i}")) for i in range(len(fits))]).alias("labels"))
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def silhouettes(points: DataFrame, dim: int, fits: list[Fit]) -> list[tuple[float, float]]:
    """Mean silhouette of each fit over all rows, with Euclidean and with squared Euclidean distances. A row alone in its cluster has 0.
    Exact: every pair of distinct vectors is measured, so the work grows with the square of their number."""
    sizes = [len(f.centres) for f in fits]
    labelled = labels_of(points, dim, fits)
    own = labelled.select("vid", "w", F.posexplode("labels").alias("fit", "label"))
    count: dict[tuple[int, int], int] = {(r["fit"], r["label"]): r["n"] for r in own.groupBy("fit", "label").agg(
        F.sum("w").alias("n")).collect()}
    table = points.sparkSession.createDataFrame([(f, c, n) for (f, c), n in count.items()], "fit int, cluster int, n long")
    rows = distance_sums(labelled, dim, sizes).join(F.broadcast(table), ["fit", "cluster"]).join(own, ["vid", "fit"])
    inside = F.col("cluster") == F.col("label")

    def mean(far: str, n: Column) -> Column:
        return F.try_divide(F.col(far).cast("double"), n.cast("double"))

    sides = rows.groupBy("vid", "fit").agg(
        F.first("w").alias("w"), F.max(F.when(inside, F.col("n"))).alias("n"),
        *[F.max(F.when(inside, mean(f, F.col("n") - 1))).alias(f"a_{f}") for f in ("far", "far_sq")],
        *[F.min(F.when(~inside, mean(f, F.col("n")))).alias(f"b_{f}") for f in ("far", "far_sq")])
    score = [F.when((F.col("n") > 1) & (F.greatest(f"a_{f}", f"b_{f}") > 0), F.rint(
        (F.col(f"b_{f}") - F.col(f"a_{f}")) / F.greatest(f"a_{f}", f"b_{f}") * UNIT)).otherwise(F.lit(0.0)).cast("long") for f in ("far", "far_sq")]
    total = {r["fit"]: r for r in sides.groupBy("fit").agg(
        F.sum("w").alias("n"), *[F.sum((F.col("w") * s).cast("decimal(38,0)")).alias(f"s{i}") for i, s in enumerate(score)]).collect()}
    return [tuple(float(total[i][f"s{j}"]) / UNIT / float(total[i]["n"]) for j in (0, 1)) for i in range(len(fits))]
