"""The decay fits of `operators.fit` as DuckDB SQL: the same grids and rounds, as joins and grouped sums instead of expressions over a row."""

from __future__ import annotations

import math

from wanescope.operators.fit import DIGITS, DIGITS_2, FLAT, GRID, GRID_2, LOGISTIC, ROUNDS, ROUNDS_2, SIDE, SIDE_2, STRETCHED, TOOLKIT, Box, Shape

Number = "CAST({!r} AS DOUBLE)".format


def _joined(by: str, extra: str = "") -> str:
    return f"USING ({by}{extra})"


def _sums(source: str, by: str, name: str, least: int) -> str:
    """CTEs {name}p (a row for each time) and {name}t (a row for each series)."""
    return f"""{name}p AS MATERIALIZED (SELECT {by}, t, CAST(count(*) AS DOUBLE) AS w, sum(v) AS s, var_pop(v) * count(*) AS m2, max(v) AS hi, min(v) AS lo FROM {source} WHERE t IS NOT NULL AND v IS NOT NULL GROUP BY {by}, t),
    {name}u AS (SELECT {by}, sum(w) AS n, sum(s) / sum(w) AS my, max(hi) AS top, min(lo) AS bottom, min(t) AS first_t, max(t) AS last_t FROM {name}p GROUP BY {by} HAVING sum(w) >= {least}),
    {name}t AS MATERIALIZED (SELECT {by}, n, my, top, bottom, first_t, last_t, sum(m2 + w * (s / w - my) * (s / w - my)) / n AS vy FROM {name}p JOIN {name}u {_joined(by)} GROUP BY {by}, n, my, top, bottom, first_t, last_t)"""


def _solved(cells: str, by: str, curve: str, name: str, a_top: str | None, c_top: str | None, two_points: bool) -> str:
    """SELECT of each cell (by, i, p, q, edge) with its least squares f in the box."""
    top = lambda v, most: f"greatest({v}, 0)" if most is None else f"least(greatest({v}, 0), {most})"
    edge = lambda a, c: f"{{'rss': n * (vy - 2 * ({a}) * cxy + ({a}) * ({a}) * vx + (my - ({a}) * mx - ({c})) * (my - ({a}) * mx - ({c}))), 'a': CAST({a} AS DOUBLE), 'c': CAST({c} AS DOUBLE)}}"
    through = lambda c: "coalesce(" + top(f"(cxy + mx * (my - {c})) / nullif(vx + mx * mx, 0)", a_top) + ", 0)"
    edges = [edge("0", top("my", c_top)), edge(through("0"), "0")]
    edges += [] if a_top is None else [edge(a_top, top(f"my - {a_top} * mx", c_top))]
    edges += [] if c_top is None else [edge(through(c_top), c_top)]
    inside = "fa >= 0 AND fc >= 0" + (f" AND fa <= {a_top}" if a_top else "") + (f" AND fc <= {c_top}" if c_top else "")
    solved = f"CASE WHEN coalesce({inside}, false) THEN {{'rss': n * (vy - fa * cxy), 'a': fa, 'c': fc}} ELSE list_sort([{', '.join(edges)}])[1] END"
    if two_points:
        x, xx = "(sx + n * x0)", "(sxx + x0 * (2 * sx + n * x0))"
        a = "coalesce(" + top(f"(sxy + my * {x}) / nullif({xx}, 0)", a_top) + ", 0)"
        solved = f"CASE WHEN n > 2 THEN {solved} ELSE {{'rss': n * (vy + my * my) - 2 * {a} * (sxy + my * {x}) + {a} * {a} * {xx}, 'a': {a}, 'c': CAST(0 AS DOUBLE)}} END"
    return f"""SELECT {by}, p, q, edge, n * vy AS whole, {solved} AS f FROM (SELECT *, my - fa * mx AS fc FROM (SELECT *, CASE WHEN vx > {Number(FLAT)} * sxx / n THEN cxy / vx END AS fa FROM
    (SELECT *, sx / n + x0 AS mx, sxx / n - sx / n * (sx / n) AS vx, sxy / n AS cxy FROM (SELECT {by}, i, p, q, edge, n, my, vy, top, max(x0) AS x0, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum((s - w * my) * x) AS sxy
    FROM (SELECT *, {curve.replace('{t}', 't')} - {curve.replace('{t}', 'first_t')} AS x, {curve.replace('{t}', 'first_t')} AS x0 FROM {cells} JOIN {name}t {_joined(by)} JOIN {name}p {_joined(by)}) GROUP BY {by}, i, p, q, edge, n, my, vy, top))))"""


def _best(select: str, by: str, digits: float = DIGITS) -> str:
    return f"SELECT * FROM (SELECT * EXCLUDE (whole), row_number() OVER (PARTITION BY {by} ORDER BY coalesce(floor(f.rss / nullif(whole, 0) * {Number(digits)} + 0.5), 0), p, q, edge) AS rn FROM ({select})) WHERE rn = 1"


def _tops(box: Box) -> tuple[str | None, str | None]:
    top = lambda times: None if times is None else f"greatest(top * {Number(times)} + {Number(box.slack)}, 0)"
    return top(box.amplitude), top(box.floor)


def fit_sql(source: str, by: str, box: Box = TOOLKIT, name: str = "z", best: str = "best") -> str:
    """CTE `best` (by, n, rate, amp, flr, rss, h) of the bounded exponential over source (by, t, v), after the CTEs that it needs."""
    low, top = math.log(box.low), math.log(box.top)
    curve = "exp(-exp(p) * {t})"
    ask = lambda cells: _best(_solved(cells, by, curve, name, *_tops(box), box.two_points), by)
    out = [_sums(source, by, name, 2 if box.two_points else box.least)]
    cells = f"(SELECT {by}, i, {Number(low)} + i * {Number((top - low) / GRID)} AS p, CAST(0 AS DOUBLE) AS q, 0 AS edge FROM {name}t, range({GRID + 1}) AS r(i))"
    out.append(f"{name}0 AS MATERIALIZED ({ask(cells)})")
    for k in range(1, ROUNDS + 1):
        step = f"{Number((top - low) / GRID)} / pow({Number(float(SIDE))}, {k})"
        cells = f"(SELECT {by}, i, least(greatest(p + i * ({step}), {Number(low)}), {Number(top)}) AS p, q, edge FROM {name}{k - 1}, range({-SIDE}, {SIDE + 1}) AS r(i))"
        out.append(f"{name}{k} AS MATERIALIZED ({ask(cells)})")
    out.append(f"{best} AS MATERIALIZED (SELECT {by}, CAST(n AS BIGINT) AS n, exp(p) AS rate, f.a AS amp, f.c AS flr, greatest(f.rss, 0) AS rss, CASE WHEN f.a > 0 AND exp(p) >= {Number(box.reject)} AND top > bottom THEN ln(2) / exp(p) END AS h FROM {name}{ROUNDS} JOIN {name}t {_joined(by)})")
    return ",\n".join(out)


def _two_sql(shape: Shape, by: str, name: str, a_top: str | None, c_top: str | None, rounds: int) -> list[str]:
    """CTEs {name}{shape}0 ... with the best cells of a shape of two parameters, over the sums that fit_sql named {name}."""
    low, top = math.log(shape.low), math.log(shape.top)
    scale = "greatest(last_t, 1)" if shape.by_time else "1"
    q_low, q_top = f"({Number(shape.q_low)} * {scale})", f"({Number(shape.q_top)} * {scale})"
    curve = "exp(-pow(exp(p) * {t}, q))" if shape.name == "stretched" else "(1 / (1 + exp(least(greatest(exp(p) * ({t} - q), -500), 500))))"
    own, n = f"{name}_{shape.name}_", GRID_2[0]
    dp, dq = Number((top - low) / (n - 1)), f"(({q_top} - {q_low}) / {GRID_2[1] - 1})"
    ask = lambda cells: _best(_solved(cells, by, curve, name, a_top, c_top, False), by, DIGITS_2)
    cells = f"(SELECT {by}, i, {Number(low)} + (i % {n}) * {dp} AS p, {q_low} + (i // {n}) * {dq} AS q, 0 AS edge FROM {name}t, range({n * GRID_2[1]}) AS r(i))"
    out = [f"{own}0 AS MATERIALIZED (SELECT b.*, {dp} AS dp, {dq} AS dq FROM ({ask(cells)}) b JOIN {name}t {_joined(by)})"]
    wide = 2 * SIDE_2 + 1
    for k in range(1, rounds + 1):
        cells = f"""(SELECT {by}, i, least(greatest(p + (i % {wide} - {SIDE_2}) * dp / {SIDE_2}, {Number(low)}), {Number(top)}) AS p, least(greatest(q + (i // {wide} - {SIDE_2}) * dq / {SIDE_2}, {q_low}), {q_top}) AS q,
        CASE WHEN greatest(abs(i % {wide} - {SIDE_2}), abs(i // {wide} - {SIDE_2})) = {SIDE_2} THEN 1 ELSE 0 END AS edge FROM {own}{k - 1} JOIN {name}t {_joined(by)}, range({wide * wide}) AS r(i))"""
        half = f"CASE WHEN b.edge = 1 THEN 1.0 ELSE {Number(2 / SIDE_2)} END"
        out.append(f"{own}{k} AS MATERIALIZED (SELECT b.*, o.dp * {half} AS dp, o.dq * {half} AS dq FROM ({ask(cells)}) b JOIN {own}{k - 1} o {_joined(by)})")
    return out


def three_sql(source: str, by: str, constant: bool = True, least: int = 4, name: str = "z", rounds: int = ROUNDS_2) -> str:
    """CTE `shapes` (by, n, shape, rate, q, amp, flr, rss, aic, bic, delta_aic, h) of the unbounded three shapes."""
    box = Box(low=1e-4, top=1.0, amplitude=None, floor=None, slack=0.0, least=least)
    out = [fit_sql(source, by, box, name)]
    parts = [f"SELECT {by}, n, 'exponential' AS shape, 3 AS k, rate, CAST(NULL AS DOUBLE) AS q, amp, flr, rss, ln(2) / rate AS h FROM best"]
    for shape in (STRETCHED, LOGISTIC):
        out += _two_sql(shape, by, name, None, None, rounds)
        half = "pow(ln(2), 1 / q) / exp(p)" if shape.name == "stretched" else "q"
        parts.append(f"SELECT {by}, CAST(n AS BIGINT) AS n, '{shape.name}' AS shape, 4 AS k, exp(p) AS rate, q, f.a AS amp, f.c AS flr, greatest(f.rss, 0) AS rss, {half} AS h FROM {name}_{shape.name}_{rounds} JOIN {name}t {_joined(by)}")
    base = "n * ln(greatest(rss, 1e-12) / n)" + (f" + n * {Number(math.log(2 * math.pi) + 1)}" if constant else "")
    out.append(f"every AS (SELECT *, {base} + 2 * k AS aic, {base} + k * ln(n) AS bic FROM ({' UNION ALL '.join(parts)}))")
    out.append(f"shapes AS (SELECT *, aic - min(aic) OVER (PARTITION BY {by}) AS delta_aic FROM every)")
    return ",\n".join(out)
