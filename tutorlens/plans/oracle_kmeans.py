"""DuckDB SQL that replays the clustering: seeding, Lloyd's steps (a recursive table of centres), labels, silhouettes."""

from __future__ import annotations

DIM, SCALE, UNIT, SEED, N_INIT, TOL, MAX_ITER, FAR = 5, 1_000_000, 1_000_000_000, 42, 10, 1e-4, 300, "1e300::DOUBLE"


def distance(j: int) -> str:
    """Of a point's x0.. to the centre columns c<j>_0..; FAR if there is none."""
    return "COALESCE(" + " + ".join(f"(x{i}::DOUBLE - c{j}_{i}) * (x{i}::DOUBLE - c{j}_{i})" for i in range(DIM)) + f", {FAR})"


def least(width: int) -> str:
    return "least(" + ", ".join(f"d{j}" for j in range(width)) + ")"


def nearest(width: int) -> str:
    return "CASE " + " ".join(f"WHEN d{j} <= {least(width)} THEN {j}" for j in range(width)) + " END"


def centre_columns(js) -> list[str]:
    return [f"c{j}_{i}" for j in js for i in range(DIM)]


def clustering(scaled_sql: str, cols, ks: list[int]) -> list[tuple[str, str]]:
    """The tables v (students on the grid), points, fits (k, cost and centres of the best restart), and labels (k, IDEstudiante,
    Cluster) for these numbers of clusters. ``scaled_sql``: IDEstudiante and the z-scores."""
    width = max(ks)
    xs = ", ".join(f"x{i}" for i in range(DIM))
    distances = ", ".join(f"{distance(j)} AS d{j}" for j in range(width))
    parts = [
        ("v", "SELECT IDEstudiante, " + ", ".join(
            f"CAST(round_even({c} * {SCALE}.0::DOUBLE, 0) AS BIGINT) AS x{i}" for i, c in enumerate(cols)) + f" FROM ({scaled_sql})"),
        ("points", f"SELECT {xs}, count(*) AS w, min(IDEstudiante) AS id FROM v GROUP BY ALL"),
        ("runs", "SELECT row_number() OVER () - 1 AS run, * FROM (VALUES " + ", ".join(
            f"({k}, {r})" for k in ks for r in range(N_INIT)) + ") AS t(k, r)"),
        ("seed0", "SELECT run, k, r, " + ", ".join(f"NULL::DOUBLE AS {c}" for c in centre_columns(range(width))) + " FROM runs"),
    ]
    for step in range(width):
        weight = f"(w::DOUBLE * {least(width) if step else '1.0::DOUBLE'})"
        u = (f"((('0x' || substr(md5(concat_ws(':', '{SEED}', r::VARCHAR, '{step}', id)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)"
             f" / 4503599627370496.0::DOUBLE)")
        others = ", ".join(["run, k, r", *centre_columns(j for j in range(width) if j != step)])
        parts.append((f"seed{step + 1}", f"""
SELECT {others}, {', '.join(f'x{i}::DOUBLE AS c{step}_{i}' for i in range(DIM))}
FROM (SELECT *, {weight} AS share, (-ln({u})) / {weight} AS race FROM (
  SELECT s.*, p.*, {distances} FROM seed{step} s, points p WHERE k > {step})) WHERE share > 0
QUALIFY row_number() OVER (PARTITION BY run ORDER BY race, id) = 1
UNION ALL BY NAME SELECT * FROM seed{step} WHERE k <= {step}"""))
    centres = centre_columns(range(width))
    news = ", ".join(
        f"COALESCE((sum(w * x{i}) FILTER (j = {j}))::DOUBLE / (sum(w) FILTER (j = {j}))::DOUBLE, any_value(c{j}_{i})) AS n{j}_{i}"
        for j in range(width) for i in range(DIM))
    shift = " + ".join(f"COALESCE((n{c[1:]} - {c}) * (n{c[1:]} - {c}), 0.0::DOUBLE)" for c in centres)
    parts += [
        ("lloyd", f"""
SELECT run, k, 0 AS t, {FAR} AS shift, {', '.join(centres)} FROM seed{width}
UNION ALL
SELECT run, k, t + 1, {shift}, {', '.join('n' + c[1:] for c in centres)} FROM (
  SELECT run, k, t, {', '.join(f'any_value({c}) AS {c}' for c in centres)}, {news}
  FROM (SELECT *, {nearest(width)} AS j FROM (
    SELECT l.*, p.*, {distances} FROM lloyd l, points p WHERE l.shift > {TOL * SCALE * SCALE} AND l.t < {MAX_ITER}))
  GROUP BY run, k, t)"""),
        ("fits", f"""
SELECT k, cost::DOUBLE / {SCALE}.0::DOUBLE / {SCALE}.0::DOUBLE AS coste, {', '.join(centres)} FROM (
  SELECT run, k, sum(CAST(floor({least(width)}) AS HUGEINT) * w) AS cost, {', '.join(f'any_value({c}) AS {c}' for c in centres)}
  FROM (SELECT l.*, p.*, {distances} FROM (
    SELECT * FROM lloyd QUALIFY row_number() OVER (PARTITION BY run ORDER BY t DESC) = 1) l, points p) GROUP BY run, k)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, run) = 1"""),
        ("labels", f"SELECT k, IDEstudiante, CAST({nearest(width)} AS INTEGER) AS Cluster FROM (SELECT *, {distances} FROM fits, v)"),
    ]
    return parts


def silhouettes(ks: list[int]) -> list[tuple[str, str]]:
    """The table silhouettes (k, silhouette, silhouette_sq)."""
    width = max(ks)
    distances = ", ".join(f"{distance(j)} AS d{j}" for j in range(width))
    square = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(DIM))
    score = "CASE WHEN n > 1 AND greatest(a{0}, b{0}) > 0 THEN CAST(round_even((b{0} - a{0}) / greatest(a{0}, b{0}) * " \
            f"{UNIT}.0::DOUBLE, 0) AS BIGINT) ELSE 0 END"
    return [
        ("marked", f"SELECT k, id, w, {', '.join(f'x{i}' for i in range(DIM))}, {nearest(width)} AS c FROM (SELECT *, {distances} FROM fits, points)"),
        ("sizes", "SELECT k, c, sum(w)::BIGINT AS n FROM marked GROUP BY k, c"),
        ("far", f"""
SELECT k, id, w, own, other, sum(bw * CAST(round_even(sqrt(sq), 0) AS HUGEINT))::DOUBLE AS f1,
       sum(bw * CAST(round_even(sq / {SCALE}.0::DOUBLE, 0) AS HUGEINT))::DOUBLE AS f2
FROM (SELECT a.k, a.id, a.w, a.c AS own, b.c AS other, b.w AS bw, ({square})::DOUBLE AS sq FROM marked a JOIN marked b ON a.k = b.k)
GROUP BY k, id, w, own, other"""),
        ("sides", """
SELECT f.k, f.id, f.w, max(s.n) FILTER (own = other) AS n,
       max(f1 / NULLIF(s.n - 1, 0)::DOUBLE) FILTER (own = other) AS a1, min(f1 / s.n::DOUBLE) FILTER (own <> other) AS b1,
       max(f2 / NULLIF(s.n - 1, 0)::DOUBLE) FILTER (own = other) AS a2, min(f2 / s.n::DOUBLE) FILTER (own <> other) AS b2
FROM far f JOIN sizes s ON f.k = s.k AND f.other = s.c GROUP BY f.k, f.id, f.w"""),
        ("silhouettes", f"""
SELECT k, sum(w * ({score.format(1)}))::DOUBLE / {UNIT}.0::DOUBLE / sum(w)::DOUBLE AS silhouette,
       sum(w * ({score.format(2)}))::DOUBLE / {UNIT}.0::DOUBLE / sum(w)::DOUBLE AS silhouette_sq FROM sides GROUP BY k"""),
    ]
