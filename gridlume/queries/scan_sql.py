"""SQL of scans over frames of vectors: taps, normal equations, banded L D L' and both substitutions as recursive queries."""

from __future__ import annotations

from ..functions.kernels import SPLINES

EPSILON = "2.220446049250313e-16::DOUBLE"


def _weight(reach: int) -> str:
    """The weight of kernel (id, b, cc, taps) at distance x."""
    sinc = lambda x: f"CASE WHEN x = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END"
    near = "((12 - 9 * b - 6 * cc) * x * x * x + (12 * b + 6 * cc - 18) * x * x + 6 - 2 * b) / 6"
    far = "((0 - b - 6 * cc) * x * x * x + (6 * b + 30 * cc) * x * x - (12 * b + 48 * cc) * x + 8 * b + 24 * cc) / 6"
    out = f"CASE id WHEN 'bilinear' THEN greatest(1 - x, 0) WHEN 'bicubic' THEN CASE WHEN x < 1 THEN {near} WHEN x < 2 THEN {far} ELSE 0 END WHEN 'lanczos' THEN CASE WHEN x < taps THEN ({sinc('x')}) * ({sinc('x / taps')}) ELSE 0 END"
    for name, (denominator, parts) in SPLINES.items():
        units = " ".join(f"WHEN x < {u + 1} THEN ({a} + {b} * (x - {u}) + {c} * (x - {u}) ^ 2 + {d} * (x - {u}) ^ 3) / {denominator}" for u, (a, b, c, d) in enumerate(parts))
        out += f" WHEN '{name}' THEN CASE {units} ELSE 0 END"
    return f"CAST({out} END AS DOUBLE)"


def _matrix(x: str, reach: int, s: str, n: str, active: str, shift: str) -> str:
    """{x}q: the distinct requests; {x}a: their matrices (k, i, j, w); {x}f: the factors (k, n, j, d, l1, ...) of A'A."""
    h = 2 * reach - 1
    key = f"{s} AS s, {n} AS n, CAST({active} AS DOUBLE) AS active, CAST({shift} AS DOUBLE) AS shift, id, b, cc, taps"
    names = ["k", "n", "j", "d", *(f"l{q}" for q in range(1, h + 1)), *(f"e{m}" for m in range(1, h)), *(f"p{m}_{q}" for m in range(1, h - 1) for q in range(1, h - m))]
    pivot = lambda m: "z.d" if m == 1 else f"z.e{m - 1}"  # noqa: E731  of row j - m
    lower = lambda m, q: f"z.l{q}" if m == 1 else f"z.p{m - 1}_{q}"  # noqa: E731  of row j - m and column j - m - q
    upper = [f"(c.a{q} - ({' + '.join([f'u{r} * {lower(q, r - q)}' for r in range(q + 1, h + 1)] or ['0'])})) AS u{q}" for q in range(h, 0, -1)]
    ratios = [f"u{q} / {pivot(q)} AS r{q}" for q in range(1, h + 1)]
    order = [*upper, *ratios]
    step = ", ".join(order)
    kept = [f"r{q}" for q in range(1, h + 1)]
    kept += [pivot(m).replace("z.", "z_") for m in range(1, h)]
    kept += [lower(m, q).replace("z.", "z_") for m in range(1, h - 1) for q in range(1, h - m)]
    carried = sorted({v for v in kept if v.startswith("z_")})
    bands = ", ".join(f"coalesce(sum(u.w * v.w) FILTER (u.j - v.j = {q}), 0) AS a{q}" for q in range(h + 1))
    zeros = ["0.0::DOUBLE"] * h + ["1.0::DOUBLE"] * (h - 1) + ["0.0::DOUBLE"] * (len(names) - 4 - h - (h - 1))
    return f"""{x}q AS (SELECT *, row_number() OVER () AS k FROM (SELECT DISTINCT {key} FROM ok)),
 {x}t AS (SELECT k, n, i, p, CASE WHEN p - {reach} < 0 THEN floor(p - {reach} + 0.5) ELSE floor(p - {reach} + 0.49999999999999994::DOUBLE) END + 0.5 + t AS ctr, id, b, cc, taps FROM (SELECT q.*, i, t, (i + 0.5::DOUBLE) / (s / active) + shift AS p FROM {x}q q, range(96) r(i), range({2 * reach}) u(t) WHERE i < s)),
 {x}w AS (SELECT k, i, greatest(0, least(n - 1, floor(CASE WHEN ctr < 0 THEN -ctr WHEN ctr >= n THEN least(2 * n - ctr, n - 0.5) ELSE ctr END)))::INTEGER AS j, {_weight(reach)} AS w FROM (SELECT *, abs(ctr - p) AS x FROM {x}t)),
 {x}a AS (SELECT k, i, j, sum(w) / any_value(tot) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY k, i) AS tot FROM {x}w) GROUP BY k, i, j),
 {x}b AS (SELECT u.k, u.j, {bands} FROM {x}a u JOIN {x}a v ON u.k = v.k AND u.i = v.i AND v.j BETWEEN u.j - {h} AND u.j GROUP BY 1, 2),
 {x}f({', '.join(names)}) AS (SELECT c.k, q.n, 0, a0 + {EPSILON}, {', '.join(zeros)} FROM {x}b c JOIN {x}q q ON q.k = c.k WHERE c.j = 0
  UNION ALL SELECT k, n, j, a0 + {EPSILON} - ({' + '.join(f'u{q} * r{q}' for q in range(1, h + 1))}), {', '.join(kept)} FROM (SELECT z.k, z.n, c.j, c.a0, {step}, {', '.join(f'{v.replace("z_", "z.")} AS {v}' for v in carried)} FROM {x}f z JOIN {x}b c ON c.k = z.k AND c.j = z.j + 1)),
 {x}u AS (SELECT k, n, j, d, {', '.join(f'l{q}' for q in range(1, h + 1))}, {', '.join(f'coalesce(lead(l{q}, {q}) OVER (PARTITION BY k ORDER BY j), 0) AS g{q}' for q in range(1, h + 1))} FROM {x}f)"""


def _solve(x: str, reach: int, rhs: str) -> str:
    """{x}v: (f, c, j, v) of the right sides ``rhs`` (f, c, k, j, r), whose r and v are lists: one entry for each line."""
    h = 2 * reach - 1
    past = ", ".join(f"y{q}" for q in range(1, h))
    zero = "list_transform(r.r, lambda e: 0.0::DOUBLE)"
    value = lambda first, factor: f"list_transform(range(1, len(r.r) + 1), lambda e: {first}" + "".join(f" - {factor}{q} * z.{'y' if q == 1 else f'y{q - 1}'}[e]" for q in range(1, h + 1)) + ")"
    shift = ", ".join(f"z.{'y' if q == 1 else f'y{q - 1}'}" for q in range(1, h))
    return f"""{x}r AS ({rhs}),
 {x}y(f, c, k, n, j, y, {past}) AS (SELECT r.f, r.c, r.k, u.n, 0, r.r, {', '.join([zero] * (h - 1))} FROM {x}r r JOIN {x}u u ON u.k = r.k AND u.j = 0 WHERE r.j = 0
  UNION ALL SELECT z.f, z.c, z.k, z.n, r.j, {value('r.r[e]', 'u.l')}, {shift} FROM {x}y z JOIN {x}r r ON r.f = z.f AND r.c = z.c AND r.j = z.j + 1 JOIN {x}u u ON u.k = z.k AND u.j = z.j + 1),
 {x}s AS (SELECT f, c, k, n, j, y AS r FROM {x}y),
 {x}z(f, c, k, j, y, {past}) AS (SELECT r.f, r.c, r.k, r.j, list_transform(r.r, lambda e: e / u.d), {', '.join([zero] * (h - 1))} FROM {x}s r JOIN {x}u u ON u.k = r.k AND u.j = r.j WHERE r.j = r.n - 1
  UNION ALL SELECT z.f, z.c, z.k, r.j, {value('r.r[e] / u.d', 'u.g')}, {shift} FROM {x}z z JOIN {x}s r ON r.f = z.f AND r.c = z.c AND r.j = z.j - 1 JOIN {x}u u ON u.k = z.k AND u.j = z.j - 1),
 {x}v AS (SELECT f, c, j, y AS v FROM {x}z)"""


def _key(x: str, s: str, n: str, active: str, shift: str) -> str:
    same = " AND ".join(f"q.{c} IS NOT DISTINCT FROM ok.{c}" for c in ("id", "b", "cc", "taps"))
    return f"{x}k AS (SELECT ok.f, ok.c, q.k FROM ok JOIN {x}q q ON q.s = ok.{s} AND q.n = ok.{n} AND q.active = ok.{active} AND q.shift = ok.{shift} AND {same})"


def scan(works: str, reach: int, sides: str, lines: int, crop: int, result: str) -> str:
    """``result`` over found(f, c, error), error null where a canvas isn't smaller than the frame.

    ``works`` selects (c, id, b, cc, taps, nw, aw, lw, nh, ah, th) from fr(f, w, h): each frame's
    candidates with canvas, active length and offset of both axes.
    """
    fits = " AND ".join({"w": "nw BETWEEN 2 AND w - 1", "h": "nh BETWEEN 2 AND h - 1"}[s] for s in sides)
    wide, tall = ("w", "nw", "aw", "lw"), ("h", "nh", "ah", "th")
    parts = [
        f"px AS (SELECT vec_id // {lines} AS f, vec_id % {lines} AS y, unnest(range(64)) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
        f"fr AS (SELECT vec_id // {lines} AS f, 64 AS w, count(*) AS h FROM embeddings GROUP BY 1)",
        f"wk AS ({works})",
        f"ok AS (SELECT * FROM wk WHERE {fits})",
    ]
    for s, columns in (("w", wide), ("h", tall)):
        if s in sides:
            parts += [_matrix(f"{s}_", reach, *columns), _key(f"{s}_", *columns)]
    rhs = lambda x, at, along, table: f"SELECT f, c, k, j, list(r ORDER BY line) AS r FROM (SELECT o.f, o.c, o.k, a.j, t.{along} AS line, sum(a.w * t.v) AS r FROM {x}k o JOIN {x}a a ON a.k = o.k JOIN {table} t ON {at} AND t.f = o.f GROUP BY ALL) GROUP BY ALL"
    again = lambda x, table, keep: f"SELECT t.f, t.c, a.i, t.{keep}, sum(a.w * t.v) AS v FROM {table} t JOIN {x}k o ON o.f = t.f AND o.c = t.c JOIN {x}a a ON a.k = o.k AND a.j = t.j GROUP BY ALL"
    each = lambda x, name: f"SELECT f, c, j, unnest(range(len(v))) AS {name}, unnest(v) AS v FROM {x}v"
    if sides == "hw":
        parts += [_solve("w_", reach, rhs("w_", "t.x = a.i", "y", "px")), f"wn AS ({each('w_', 'y')})"]
        parts += [_solve("h_", reach, rhs("h_", "t.y = a.i AND t.c = o.c", "j", "wn")), f"hn AS ({each('h_', 'jw')})", f"hm AS ({again('h_', 'hn', 'jw')})"]
        parts += ["wi AS (SELECT f, c, i AS y, jw AS j, v FROM hm)", f"made AS (SELECT f, c, y, i AS x, v FROM ({again('w_', 'wi', 'y')}))"]
    elif sides == "h":
        parts += [_solve("h_", reach, rhs("h_", "t.y = a.i", "x", "px")), f"hn AS ({each('h_', 'x')})", f"made AS (SELECT f, c, i AS y, x, v FROM ({again('h_', 'hn', 'x')}))"]
    else:
        parts += [_solve("w_", reach, rhs("w_", "t.x = a.i", "y", "px")), f"wn AS ({each('w_', 'y')})", f"made AS (SELECT f, c, y, i AS x, v FROM ({again('w_', 'wn', 'y')}))"]
    parts += [
        f"err AS (SELECT m.f, m.c, avg(abs(p.v - m.v)) AS error FROM made m JOIN px p ON p.f = m.f AND p.x = m.x AND p.y = m.y JOIN fr ON fr.f = m.f WHERE m.x BETWEEN {crop} AND w - {crop + 1} AND m.y BETWEEN {crop} AND h - {crop + 1} GROUP BY 1, 2)",
        "found AS (SELECT wk.*, error FROM wk LEFT JOIN err ON err.f = wk.f AND err.c = wk.c)",
    ]
    return "WITH RECURSIVE " + ",\n ".join(parts) + "\n " + result
