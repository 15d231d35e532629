"""SQL forms of the solvers over the two-dimensional view p (id, x0, x1), by common table expressions.

Each function returns expressions to put after WITH RECURSIVE; the last name of each is in its docstring.
Draws are races on the same hash uniforms as in functions.columns, ties by id.
"""

from __future__ import annotations

import math


def u(salt: str, key: str = "id", seed: int = 42) -> str:
    """The hash uniform; `salt` is an SQL text expression."""
    return f"((('0x' || substr(md5('{seed}:' || {salt} || ':' || {key}), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)"


def gap(a: str, b: str) -> str:
    return f"({a}.x0 - {b}.x0) * ({a}.x0 - {b}.x0) + ({a}.x1 - {b}.x1) * ({a}.x1 - {b}.x1)"


def uniform_seeds(view: str, k: int, out: str) -> list[str]:
    """out (run, cluster, x0, x1)."""
    return [f"{out} AS MATERIALIZED (SELECT 0 AS run, row_number() OVER (ORDER BY {u(chr(39) + 'uar' + chr(39))}, id) - 1 AS cluster, x0, x1 FROM {view} QUALIFY cluster < {k})"]


def d2_seeds(view: str, k: int, out: str, seeds=(42,)) -> list[str]:
    """out (run, cluster, x0, x1): one run a seed."""
    parts = []
    for r, seed in enumerate(seeds):
        parts.append(f"{out}_{r}_0 AS MATERIALIZED (SELECT x0, x1 FROM {view} ORDER BY {u(chr(39) + 'd2-0' + chr(39), seed=seed)}, id LIMIT 1)")
        parts.append(f"{out}m_{r}_0 AS MATERIALIZED (SELECT a.id, a.x0, a.x1, {gap('a', 'c')} AS d2 FROM {view} a, {out}_{r}_0 c)")
        for i in range(1, k):
            race = f"-ln({u(f'{chr(39)}d2-{i}{chr(39)}', seed=seed)}) / d2"
            parts.append(f"{out}_{r}_{i} AS MATERIALIZED (SELECT x0, x1 FROM {out}m_{r}_{i - 1} WHERE d2 > 0 ORDER BY {race}, id LIMIT 1)")
            parts.append(f"{out}m_{r}_{i} AS MATERIALIZED (SELECT a.id, a.x0, a.x1, least(a.d2, {gap('a', 'c')}) AS d2 FROM {out}m_{r}_{i - 1} a, {out}_{r}_{i} c)")
    every = " UNION ALL ".join(f"SELECT {r} AS run, {i} AS cluster, x0, x1 FROM {out}_{r}_{i}" for r in range(len(seeds)) for i in range(k))
    return [*parts, f"{out} AS MATERIALIZED ({every})"]


def lloyd(view: str, seeds: str, out: str, rounds: int = 100, tol: float = 1e-4, weight: str = "1", floor: float = 0.0, trim: int = 0) -> list[str]:
    """out (run, cluster, x0, x1, cost) after the last round.

    Plain: stops when the cost changes by less than tol of the last one, empty clusters go to the origin.
    With trim: the `trim` farthest points are left out, it stops when the cost is no lower, empty clusters stay.
    """
    near = f"SELECT l.run, a.id, a.x0, a.x1, {weight} AS w, l.cluster, {gap('a', 'l')} AS d2 FROM {view} a, l{out} l QUALIFY row_number() OVER (PARTITION BY l.run, a.id ORDER BY d2, l.cluster) = 1"
    kept = f"SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY run ORDER BY d2 DESC, id) > {trim}" if trim else "SELECT * FROM n"
    stop = "c.cost >= l.last" if trim else f"abs(l.last - c.cost) < {tol!r} * greatest(l.last, {floor!r})"
    new = lambda j: f"CASE WHEN coalesce({stop}, false) THEN l.x{j} ELSE coalesce(m.m{j}, {'l.x' + str(j) if trim else '0'}) END"
    step = (
        f"WITH n AS ({near}), a AS ({kept}), c AS (SELECT run, sum(w * d2) AS cost FROM a GROUP BY run), m AS (SELECT run, cluster, sum(w * x0) / sum(w) AS m0, sum(w * x1) / sum(w) AS m1 FROM a GROUP BY run, cluster)"
        f" SELECT l.t + 1, l.run, l.cluster, {new(0)}, {new(1)}, c.cost, coalesce({stop}, false) FROM l{out} l JOIN c USING (run) LEFT JOIN m ON m.run = l.run AND m.cluster = l.cluster WHERE NOT l.done AND l.t < {rounds}"
    )
    return [
        f"l{out}(t, run, cluster, x0, x1, last, done) AS (SELECT 0, run, cluster, x0, x1, NULL::DOUBLE, false FROM {seeds} UNION ALL ({step}))",
        f"{out} AS MATERIALIZED (SELECT run, cluster, x0, x1, last AS cost FROM l{out} QUALIFY row_number() OVER (PARTITION BY run, cluster ORDER BY t DESC) = 1)",
    ]


def finish(centres: str, z: int) -> str:
    """The select of every solver: all points to their centres, the z farthest aside."""
    return (
        f" SELECT id, cluster::INTEGER AS cluster, round(d2, 4) AS d2, row_number() OVER (ORDER BY d2 DESC, id) <= {z} AS is_outlier FROM ("
        f"SELECT a.id, c.cluster, {gap('a', 'c')} AS d2 FROM p a, {centres} c QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d2, c.cluster) = 1)"
    )


def query(view_sql: str, parts: list[str], centres: str, z: int) -> str:
    return f"WITH RECURSIVE {', '.join([view_sql, *parts])}{finish(centres, z)}"


def detected(z: int, score: str) -> list[str]:
    """rest (id, x0, x1): the points without the z of largest score over their ranked neighbours k (id, rank, d)."""
    return [
        f"nd AS (SELECT a.id, b.id AS j, {gap('a', 'b')} AS d2, sqrt(d2) AS d FROM p a JOIN p b ON a.id <> b.id)",
        "nk AS MATERIALIZED (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d2, j) AS rank FROM nd)",
        f"gone AS MATERIALIZED ({score} ORDER BY score DESC, id LIMIT {z})",
        "rest AS MATERIALIZED (SELECT id, x0, x1 FROM p ANTI JOIN gone USING (id))",
    ]


def heavy_balls(z: int, k: int, guesses) -> list[str]:
    """rest: the points near a heavy one, at the first guess that leaves few enough others."""
    rows = ", ".join(f"({t}, {4 * g / z!r}::DOUBLE)" for t, g in enumerate(guesses))
    return [
        f"g(t, r2) AS (VALUES {rows})",
        f"bd AS MATERIALIZED (SELECT a.id, b.id AS j, {gap('a', 'b')} AS d2 FROM p a, p b)",
        f"hv AS MATERIALIZED (SELECT t, r2, id FROM bd, g WHERE d2 <= r2 GROUP BY t, r2, id HAVING count(*) >= {2 * z})",
        "nr AS MATERIALIZED (SELECT DISTINCT t, bd.j AS id FROM hv JOIN bd ON bd.id = hv.id AND d2 <= r2)",
        f"ok AS MATERIALIZED (SELECT min(t) AS t FROM (SELECT g.t, (SELECT count(*) FROM p) - count(nr.id) AS m, (SELECT count(*) FROM p) AS n FROM g LEFT JOIN nr USING (t) GROUP BY g.t) WHERE m < n AND m <= {(3 * k + 2) * z})",
        "rest AS MATERIALIZED (SELECT id, x0, x1 FROM p WHERE id IN (SELECT id FROM nr WHERE t = (SELECT t FROM ok)) OR (SELECT t FROM ok) IS NULL)",
    ]


def capped_rounds(z: int, k: int, eps: float, beta: float, draws: int = 5) -> list[str]:
    """cand (id, x0, x1, cluster): the candidates of fast sampling, numbered by id."""
    parts = [
        f"f0 AS MATERIALIZED (SELECT id, x0, x1 FROM p ORDER BY {u(chr(39) + 'fast' + chr(39))}, id LIMIT 1)",
        f"s0 AS MATERIALIZED (SELECT a.id, a.x0, a.x1, {gap('a', 'c')} AS d2 FROM p a, f0 c)",
    ]
    rounds = max(1, int(beta * k / eps))
    for t in range(rounds):
        cap = f"(SELECT min(d2) FROM (SELECT d2 FROM s{t} ORDER BY d2 DESC LIMIT {z}))"
        parts.append(f"w{t} AS MATERIALIZED (SELECT id, x0, x1, least(d2, {cap}) AS w FROM s{t})")
        one = lambda i, t=t: f"SELECT * FROM (SELECT id, x0, x1 FROM w{t} WHERE w > 0 ORDER BY -ln({u(f'{chr(39)}fast-{t}-{i}{chr(39)}')}) / w, id LIMIT 1)"
        parts.append(f"f{t + 1} AS MATERIALIZED ({' UNION '.join(one(i) for i in range(draws))})")
        parts.append(f"s{t + 1} AS MATERIALIZED (SELECT a.id, any_value(a.x0) AS x0, any_value(a.x1) AS x1, least(any_value(a.d2), min({gap('a', 'c')})) AS d2 FROM s{t} a, f{t + 1} c GROUP BY a.id)")
    every = " UNION ".join(f"SELECT * FROM f{t}" for t in range(rounds + 1))
    return [*parts, f"cand AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) - 1 AS cluster FROM ({every}))"]


def mixed_rounds(k: int, delta: float) -> list[str]:
    """cand: the candidates of robust oversampling, numbered by id."""
    m, parts = max(1, int(1 / delta)), []
    for t in range(k):
        if t:
            parts.append(f"s{t} AS MATERIALIZED (SELECT a.id, any_value(a.x0) AS x0, any_value(a.x1) AS x1, min({gap('a', 'c')}) AS d2 FROM p a, t{t - 1} c GROUP BY a.id)")
            weight, view = f"(d2 / (2.0::DOUBLE * (SELECT sum(d2) FROM s{t})) + 0.5::DOUBLE / (SELECT count(*) FROM p))", f"s{t}"
        else:
            weight, view = "1.0::DOUBLE", "p"
        one = lambda i, t=t, weight=weight, view=view: f"SELECT * FROM (SELECT id, x0, x1 FROM {view} ORDER BY -ln({u(f'{chr(39)}mixed-{t}-{i}{chr(39)}')}) / {weight}, id LIMIT 1)"
        new = " UNION ".join(one(i) for i in range(m))
        parts.append(f"t{t} AS MATERIALIZED ({new}{f' UNION SELECT * FROM t{t - 1}' if t else ''})")
    return [*parts, f"cand AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) - 1 AS cluster FROM t{k - 1})"]


def weighed(far: int) -> list[str]:
    """near: every point with its candidate and whether it is among the `far` farthest; wc: candidates with weight w."""
    return [
        f"near0 AS MATERIALIZED (SELECT a.id, c.cluster, {gap('a', 'c')} AS d2 FROM p a, cand c QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY d2, c.cluster) = 1)",
        f"near AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY d2 DESC, id) AS place, place <= {far} AS far FROM near0)",
        "wc AS MATERIALIZED (SELECT cand.*, greatest(coalesce(n, 0), 1)::DOUBLE AS w FROM cand LEFT JOIN (SELECT cluster, count(*) AS n FROM near WHERE NOT far GROUP BY cluster) USING (cluster))",
    ]


def candidate_seeds(k: int, out: str) -> list[str]:
    """out (run, cluster, x0, x1): weighted seeds among the candidates."""
    parts = [f"{out}_0 AS MATERIALIZED (SELECT id, x0, x1 FROM wc ORDER BY -ln({u(chr(39) + 'seeds-0' + chr(39))}) / w, id LIMIT 1)", f"{out}m_0 AS MATERIALIZED (SELECT a.*, {gap('a', 'c')} AS d2 FROM wc a, {out}_0 c)"]
    for i in range(1, k):
        parts.append(f"{out}_{i} AS MATERIALIZED (SELECT id, x0, x1 FROM {out}m_{i - 1} WHERE d2 > 0 ORDER BY -ln({u(f'{chr(39)}seeds-{i}{chr(39)}')}) / (w * d2), id LIMIT 1)")
        parts.append(f"{out}m_{i} AS MATERIALIZED (SELECT a.* REPLACE (least(a.d2, {gap('a', 'c')}) AS d2) FROM {out}m_{i - 1} a, {out}_{i} c)")
    every = " UNION ALL ".join(f"SELECT 0 AS run, {i} AS cluster, x0, x1 FROM {out}_{i}" for i in range(k))
    return [*parts, f"{out} AS MATERIALIZED ({every})"]


def candidate_lloyd(k: int) -> list[str]:
    """fin: weighted seeds and weighted Lloyd on the candidates."""
    return [*candidate_seeds(k, "ws"), *lloyd("wc", "ws", "fin", 30, 1e-4, "a.w", 1e-10)]


def reduction(z: int, k: int, eps: float, guesses) -> list[str]:
    """fin: of the centres of every recall round, those of least trimmed cost."""
    step, n_rounds, all_far = max(1, math.ceil(eps / 2 * z / 2)), max(1, math.ceil(2 * (1 + eps) / (eps / 2))), math.ceil((1 + eps) * z)
    g = ", ".join(f"({j}, {x!r}::DOUBLE)" for j, x in enumerate(guesses))
    salt = lambda i: f"'reduce-' || t || '-' || g || '-{i}'"
    pick = lambda view, p, i: f"SELECT t, g, id, x0, x1 FROM {view} WHERE {p} > 0 QUALIFY row_number() OVER (PARTITION BY t, g ORDER BY -ln({u(salt(i))}) / ({p}), id) = 1"
    parts = [
        f"rounds AS MATERIALIZED (SELECT t, greatest((SELECT count(*) FROM near WHERE far) - (t + 1) * {step}, 0) AS rest_far FROM (SELECT unnest(range({n_rounds})) AS t) WHERE (SELECT count(*) FROM near WHERE far) - t * {step} > 0)",
        "back AS MATERIALIZED (SELECT cluster, row_number() OVER (ORDER BY d2, id) - 1 AS r FROM near WHERE far)",
        f"rw AS MATERIALIZED (SELECT t, rest_far, cand.id, cand.x0, cand.x1, cand.cluster, greatest((SELECT count(*) FROM near WHERE NOT far AND near.cluster = cand.cluster) + (SELECT count(*) FROM back WHERE back.cluster = cand.cluster AND r < (t + 1) * {step}), 1)::DOUBLE AS w FROM rounds, cand)",
        f"gs(g, guess) AS (VALUES {g})",
        f"rg AS MATERIALIZED (SELECT rw.*, g, guess / greatest({all_far} - rest_far, 1) AS cap FROM rw, gs)",
        f"r0 AS MATERIALIZED ({pick('rg', 'w', 0)})",
        f"rm0 AS MATERIALIZED (SELECT a.*, {gap('a', 'c')} AS d2 FROM rg a JOIN r0 c USING (t, g))",
    ]
    for i in range(1, k):
        parts.append(f"r{i} AS MATERIALIZED ({pick(f'rm{i - 1}', 'w * least(d2, cap)', i)})")
        parts.append(f"rm{i} AS MATERIALIZED (SELECT a.* REPLACE (least(a.d2, {gap('a', 'c')}) AS d2) FROM rm{i - 1} a JOIN r{i} c USING (t, g))")
    seeds = " UNION ALL ".join(f"SELECT t, g, {i} AS cluster, x0, x1 FROM r{i}" for i in range(k))
    return [
        *parts,
        f"bg AS MATERIALIZED (SELECT t, g FROM (SELECT t, g, sum(w * d2) AS cost FROM rm{k - 1} GROUP BY t, g) QUALIFY row_number() OVER (PARTITION BY t ORDER BY cost, g) = 1)",
        f"rs AS MATERIALIZED (SELECT t AS run, cluster, x0, x1 FROM ({seeds}) JOIN bg USING (t, g))",
        f"rn AS MATERIALIZED (SELECT c.run, c.cluster, a.x0, a.x1, a.w, {gap('a', 'c')} AS d2 FROM rw a JOIN rs c ON a.t = c.run QUALIFY row_number() OVER (PARTITION BY c.run, a.id ORDER BY d2, c.cluster) = 1)",
        "rc AS MATERIALIZED (SELECT rs.run, rs.cluster, coalesce(sum(rn.w * rn.x0) / sum(rn.w), 0) AS x0, coalesce(sum(rn.w * rn.x1) / sum(rn.w), 0) AS x1 FROM rs LEFT JOIN rn ON rn.run = rs.run AND rn.cluster = rs.cluster GROUP BY ALL)",
        f"ra AS MATERIALIZED (SELECT c.run, a.id, min({gap('a', 'c')}) AS d2 FROM p a, rc c GROUP BY c.run, a.id)",
        f"rb AS MATERIALIZED (SELECT run FROM (SELECT run, sum(d2) AS cost FROM (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY run ORDER BY d2 DESC, id) > {all_far}) GROUP BY run) ORDER BY cost, run LIMIT 1)",
        "fin AS MATERIALIZED (SELECT run, cluster, x0, x1 FROM rc WHERE run = (SELECT run FROM rb))",
    ]
