"""Decay fits of a series (keys, t_months, value).

For a fixed curve x(t) every shape A x(t) + C is linear in amplitude and floor, so a fit is a search over the curve's one or two parameters
with least squares in a box inside. A series is first summed by its distinct times (their number is the calendar's, not the table's), and
one row holds these sums. With one parameter the search is an expression over that row: a geometric grid, then rounds that zoom in on the best
cell. With two, each round's cells are rows that are summed as they are made. All series are searched at once on the JVM, and the same
steps in SQL give the same numbers. `refined` and `fit_shapes` are the plain versions
in numpy that tests hold them against.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wanescope.functions.expressions import let
from wanescope.operators.stats import safe_slope
from wanescope.shared import released, written

LN2 = math.log(2.0)


@dataclass(frozen=True)
class Box:
    """Bounds of a fit: the rate, amplitude and floor as multiples of the largest value (None: unbounded) and a little more; the least
    number of points; the rate from which a half-life is given. two_points: a series of two is fitted with no floor."""

    low: float = 1e-6
    top: float = 2.0
    amplitude: float | None = 10.0
    floor: float | None = 1.0
    slack: float = 1e-6
    least: int = 3
    reject: float = 1e-5
    two_points: bool = False


#: The command line's fit; the bootstraps' and the panel's; the validation's; gaps to a ceiling; forecasts.
TOOLKIT = Box()
PANEL = Box(top=1.0, amplitude=3.0, slack=1e-9)
VALIDATION = Box(low=1e-5, top=1.0, reject=1e-4)
GAP = Box(top=1.0, amplitude=5.0, least=4, reject=0.0)
FORECAST = Box(top=1.0, amplitude=5.0, two_points=True)

#: One parameter: intervals of the first grid, rounds, and points on either side of the best one, each round's step a part of the last.
GRID, ROUNDS, SIDE = 96, 6, 4
#: Two parameters: points of the first grid, rounds, points on either side; after a round whose best point isn't at its edge the next
#: one spans two of its cells to either side.
GRID_2, ROUNDS_2, SIDE_2 = (20, 10), 9, 4


def summed(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, spread, top, bottom, first_t, last_t, points): what a fit needs of each series; points hold time, count and sum of the values' distances from the mean."""
    at = series.dropna(subset=["t_months", "value"]).groupBy(*by, F.col("t_months").cast("double").alias("_t"))
    at = at.agg(F.count("*").cast("double").alias("w"), F.sum("value").alias("s"), (F.var_pop("value") * F.count("*")).alias("m2"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    # the search is much work on few bytes, so the rows are dealt out by their number, not coalesced by their size
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = at.repartition(parts, *by).groupBy(*by).agg(
        F.sum("w").alias("n"), (F.sum("s") / F.sum("w")).alias("mean"), F.max("hi").alias("top"), F.min("lo").alias("bottom"), F.min("_t").alias("first_t"), F.max("_t").alias("last_t"),
        F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), "w", "s", "m2"))).alias("points"),
    )
    off = lambda d: d["s"] / d["w"] - F.col("mean")
    row = row.withColumn("spread", F.aggregate("points", F.lit(0.0), lambda z, d: z + d["m2"] + d["w"] * off(d) * off(d)) / F.col("n"))
    return row.withColumn("points", F.transform("points", lambda d: F.struct(d["t"].alias("t"), d["w"].alias("w"), (d["s"] - d["w"] * F.col("mean")).alias("y"))))


def _sums(x: Callable[[Column], Column]) -> Column:
    """struct(x0, x, xx, xy) of a curve over a `summed` row: its first value, and sums of its distances from that, which keep all digits where the
    curve hardly falls and where it has all but vanished."""
    none = [F.lit(0.0).alias(c) for c in ("x", "xx", "xy")]

    def from_first(x0: Column) -> Column:
        # the curve is written three times: computing it again costs less than a row to keep it in
        z = lambda d: x(d["t"]) - x0
        sums = F.aggregate("points", F.struct(*none), lambda a, d: F.struct((a["x"] + d["w"] * z(d)).alias("x"), (a["xx"] + d["w"] * z(d) * z(d)).alias("xx"), (a["xy"] + d["y"] * z(d)).alias("xy")))
        return let(sums, lambda a: F.struct(x0.alias("x0"), *[a[c].alias(c) for c in ("x", "xx", "xy")]))

    return let(x(F.col("first_t")), from_first)


Values = dict[str, Column]
#: A curve whose variance is a smaller share of its mean square distance from its first value is as good as constant: its slope would be rounding noise.
FLAT = 1e-10


def _within(v: Column, top: Column | None) -> Column:
    return F.greatest(v, F.lit(0.0)) if top is None else F.least(F.greatest(v, F.lit(0.0)), top)


def _box_steps(a_top: Column | None, c_top: Column | None) -> list[Callable[[Values], Values]]:
    """Least squares of a x(t) + c with 0 <= a <= a_top, 0 <= c <= c_top, from a series' n, mean and spread and the curve's sums: each
    step makes values of the earlier ones, the last one f, a struct(rss, a, c). The free line where it lies in the box, else its best edge."""
    n, my, vy, zero = F.col("n"), F.col("mean"), F.col("spread"), F.lit(0.0)

    def moments(v: Values) -> Values:
        return {"mx": v["x"] / n + v["x0"], "vx": v["xx"] / n - v["x"] / n * (v["x"] / n), "cxy": v["xy"] / n}

    def line(v: Values) -> Values:
        square = F.nullif(v["vx"] + v["mx"] * v["mx"], zero)
        through = lambda c: F.coalesce(_within((v["cxy"] + v["mx"] * (my - c)) / square, a_top), zero)
        out = {"slope": F.when(v["vx"] > FLAT * v["xx"] / n, v["cxy"] / v["vx"]), "a_low": through(zero)}
        return out if c_top is None else out | {"a_high": through(c_top)}

    def fits(v: Values) -> Values:
        def edge(a: Column, c: Column) -> Column:
            rest = my - a * v["mx"] - c
            return F.struct((n * (vy - 2 * a * v["cxy"] + a * a * v["vx"] + rest * rest)).alias("rss"), a.alias("a"), c.alias("c"))

        free, rest = v["slope"], my - v["slope"] * v["mx"]
        inside = (free >= 0) & (rest >= 0)
        for value, top in ((free, a_top), (rest, c_top)):
            inside = inside if top is None else inside & (value <= top)
        edges = [edge(zero, _within(my, c_top)), edge(v["a_low"], zero)]
        edges += [] if a_top is None else [edge(a_top, _within(my - a_top * v["mx"], c_top))]
        edges += [] if c_top is None else [edge(v["a_high"], c_top)]
        whole = F.struct((n * (vy - free * v["cxy"])).alias("rss"), free.alias("a"), rest.alias("c"))
        return {"f": F.when(F.coalesce(inside, F.lit(False)), whole).otherwise(F.array_min(F.array(*edges)))}

    return [moments, line, fits]


def _bottomless(v: Values, a_top: Column | None) -> Column:
    """struct(rss, a, c) of a line with no floor."""
    n, my, vy = F.col("n"), F.col("mean"), F.col("spread")
    x, xx = v["x"] + n * v["x0"], v["xx"] + v["x0"] * (2 * v["x"] + n * v["x0"])
    xy = v["xy"] + my * x
    a = F.coalesce(_within(xy / F.nullif(xx, F.lit(0.0)), a_top), F.lit(0.0))
    return F.struct((n * (vy + my * my) - 2 * a * xy + a * a * xx).alias("rss"), a.alias("a"), F.lit(0.0).alias("c"))


def _boxed(sums: Column, a_top: Column | None, c_top: Column | None, keep_floor: bool | Column = True) -> Column:
    """The steps' f within one expression, each step's values bound once."""

    def after(steps: list, v: Values) -> Column:
        new = steps[0](v)
        return new["f"] if "f" in new else let(F.struct(*[c.alias(k) for k, c in new.items()]), lambda z: after(steps[1:], v | {k: z[k] for k in new}))

    def solved(s: Column) -> Column:
        v = {k: s[k] for k in ("x0", "x", "xx", "xy")}
        floored = after(_box_steps(a_top, c_top), v)
        return floored if keep_floor is True else F.when(keep_floor, floored).otherwise(_bottomless(v, a_top))

    return let(sums, solved)


#: Digits of the error, as a share of the values' spread, that tell cells apart: with two parameters ridges of equal error are common.
DIGITS, DIGITS_2 = 1e13, 1e9


def _cell(p: Column, q: Column, fit: Column, at_edge: Column, digits: float) -> Column:
    """A tried cell; the least of several is the one of the least error, to these digits, then of the smallest p and q."""
    key = F.coalesce(F.floor(fit["rss"] / F.nullif(F.col("n") * F.col("spread"), F.lit(0.0)) * digits + 0.5), F.lit(0).cast("long"))
    return F.struct(key.alias("key"), p.alias("p"), q.alias("q"), at_edge.alias("edge"), fit["rss"].alias("rss"), fit["a"].alias("a"), fit["c"].alias("c"))


def decay_fit(series: DataFrame, by: list[str], box: Box = TOOLKIT) -> DataFrame:
    """(by, n, rate, amplitude, floor, rss, halflife): A exp(-rate t) + C of the least squared error within the box, the smallest such rate;
    one row for each series of box.least points or more. halflife is null where nothing decays, all values are equal, or the rate is
    below box.reject."""
    low, top = math.log(box.low), math.log(box.top)
    a_top = None if box.amplitude is None else F.greatest(F.col("top") * box.amplitude + box.slack, F.lit(0.0))
    c_top = None if box.floor is None else F.greatest(F.col("top") * box.floor + box.slack, F.lit(0.0))
    keep = F.col("n") > 2 if box.two_points else True
    none = F.lit(0.0)

    def tried(p: Column) -> Column:
        return let(p, lambda v: let(F.exp(v), lambda r: let(_boxed(_sums(lambda t: F.exp(-r * t)), a_top, c_top, keep), lambda f: _cell(v, none, f, F.lit(0), DIGITS))))

    grid = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: tried(F.lit(low) + i * F.lit((top - low) / GRID)))

    def zoom(best: Column, k: Column) -> Column:
        step = F.lit((top - low) / GRID) / F.pow(F.lit(float(SIDE)), k)
        near = F.sequence(F.lit(-SIDE), F.lit(SIDE))
        return F.array_min(F.transform(near, lambda j: tried(F.least(F.greatest(best["p"] + j * step, F.lit(low)), F.lit(top)))))

    rows = summed(series, by).where(F.col("n") >= (2 if box.two_points else box.least))
    fit = found(rows, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.array_min(grid), zoom), by)
    rate = F.exp("fit.p")
    decays = (F.col("fit.a") > 0) & (rate >= box.reject) & (F.col("top") > F.col("bottom"))
    return fit.select(*by, F.col("n").cast("long").alias("n"), rate.alias("rate"), F.col("fit.a").alias("amplitude"), F.col("fit.c").alias("floor"), F.greatest("fit.rss", F.lit(0.0)).alias("rss"), F.when(decays, F.lit(LN2) / rate).alias("halflife"))


def found(rows: DataFrame, fit: Column, by: list[str]) -> DataFrame:
    """(by, n, top, bottom, fit) with the search run once a row: a generator's output is where the optimiser can't push conditions on it
    below, which would run the search again for each."""
    return rows.select(*by, "n", "top", "bottom", F.explode(F.array(fit)).alias("fit"))


@dataclass(frozen=True)
class Shape:
    """A curve x(t; rate, q) with the first grid's rate and the second parameter's bounds, the latter as multiples of the last time or not."""

    name: str
    parameters: int
    low: float
    top: float
    q_low: float
    q_top: float
    by_time: bool

    def curve(self, t: Column, rate: Column, q: Column) -> Column:
        if self.name == "stretched":
            return F.exp(-F.pow(rate * t, q))
        return 1 / (1 + F.exp(F.least(F.greatest(rate * (t - q), F.lit(-500.0)), F.lit(500.0))))


STRETCHED = Shape("stretched", 4, 1e-3, 1.0, 0.1, 3.0, False)
LOGISTIC = Shape("logistic", 4, 1e-2, 1.0, 0.0, 2.0, True)


#: Columns of a search's row: of its series, and of the shape that it tries.
_WHOLE, _BOUNDS = ["n", "mean", "spread", "top", "first_t"], ["low", "high", "q_low", "q_high", "dp", "dq"]


def _by_shape(rows: DataFrame, shapes: tuple[Shape, ...]) -> DataFrame:
    """Stored `summed` rows with an id, once for each shape: the bounds of p (the rate's logarithm) and q, and the first grid's steps."""
    scale = F.greatest(F.col("last_t"), F.lit(1.0))

    def bounds(i: int, s: Shape) -> Column:
        low, high, times = math.log(s.low), math.log(s.top), scale if s.by_time else F.lit(1.0)
        values = {"low": F.lit(low), "high": F.lit(high), "q_low": F.lit(s.q_low) * times, "q_high": F.lit(s.q_top) * times, "dp": F.lit((high - low) / (GRID_2[0] - 1)), "dq": (F.lit(s.q_top) * times - F.lit(s.q_low) * times) / (GRID_2[1] - 1)}
        return F.struct(F.lit(i).alias("shape"), *[v.alias(k) for k, v in values.items()])

    return rows.select("id", *_WHOLE, "points", F.inline(F.array(*[bounds(i, s) for i, s in enumerate(shapes)])))


def _two(rows: DataFrame, shapes: tuple[Shape, ...], a_top: Column | None, c_top: Column | None, rounds: int) -> DataFrame:
    """(id, shape, cell): the best cell of each shape with two parameters for every stored `summed` row with an id. A round tries cells around
    the last one's best; cells by points are rows that are summed as they are made."""
    parts, n_p, wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), GRID_2[0], 2 * SIDE_2 + 1
    cell = lambda p, q, edge: F.struct(p.alias("p"), q.alias("q"), edge.alias("edge"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n_p * GRID_2[1] - 1)), lambda i: cell(F.col("low") + (i % n_p) * F.col("dp"), F.col("q_low") + F.floor(i / n_p) * F.col("dq"), F.lit(0)))

    def near(i: Column) -> Column:
        j, k = i % wide - SIDE_2, F.floor(i / wide).cast("int") - SIDE_2
        p = F.least(F.greatest(F.col("best.p") + j * F.col("dp") / SIDE_2, F.col("low")), F.col("high"))
        q = F.least(F.greatest(F.col("best.q") + k * F.col("dq") / SIDE_2, F.col("q_low")), F.col("q_high"))
        return cell(p, q, F.when(F.greatest(F.abs(j), F.abs(k)) == SIDE_2, 1).otherwise(0))

    around = F.transform(F.sequence(F.lit(0), F.lit(wide * wide - 1)), near)

    def curve(t: str) -> Column:
        out = shapes[-1].curve(F.col(t), F.exp("now.p"), F.col("now.q"))
        for i, s in enumerate(shapes[:-1]):
            out = F.when(F.col("shape") == i, s.curve(F.col(t), F.exp("now.p"), F.col("now.q"))).otherwise(out)
        return out

    kept = _BOUNDS
    state = _by_shape(rows, shapes)
    for r in range(rounds + 1):
        # one place for all of a series: its cells and their best are grouped without another shuffle
        each = state.repartition(parts, "id").select("id", "shape", *_WHOLE, *kept, "points", F.posexplode(grid if r == 0 else around).alias("i", "now"))
        each = each.select("id", "shape", "i", *_WHOLE, *kept, "now", F.inline("points")).select("id", "shape", "i", *_WHOLE, *kept, "now.p", "now.q", "now.edge", "w", "y", curve("first_t").alias("x0"), curve("t").alias("at")).withColumn("x", F.col("at") - F.col("x0"))
        sums = [F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("x")).alias("xy")]
        of = each.groupBy("id", "shape", "i").agg(*sums, *[F.max(c).alias(c) for c in (*_WHOLE, *kept, "p", "q", "edge", "x0")])
        for step in _box_steps(a_top, c_top):
            of = of.withColumns(step({c: F.col(c) for c in of.columns}))
        best = of.select("id", "shape", *kept, _cell(F.col("p"), F.col("q"), F.col("f"), F.col("edge"), DIGITS_2).alias("best")).groupBy("id", "shape").agg(F.min("best").alias("best"), *[F.max(c).alias(c) for c in kept])
        part = F.when((F.col("best.edge") == 1) | F.lit(r == 0), 1.0).otherwise(2 / SIDE_2)
        found_now = written(best.withColumns({"dp": F.col("dp") * part, "dq": F.col("dq") * part}))
        if r:
            released(last)
        last, state = found_now, rows.select("id", *_WHOLE, "points").join(found_now, "id")
    return last.select("id", "shape", F.col("best").alias("cell"))


def three_shapes(series: DataFrame, by: list[str], constant: bool = True, least: int = 4, bounded: bool = False, rounds: int = ROUNDS_2) -> DataFrame:
    """(by, n, shape, rate, q, amplitude, floor, rss, aic, bic, delta_aic, halflife): exponential, stretched (q: its exponent) and logistic decay
    (q: its middle), a row each. constant: AIC with the constants of the Gaussian likelihood. bounded: amplitude up to 3 times the largest
    value and floor up to it, logistic rates up to 2, as the model selection has it; else unbounded. Series below `least` points are left out. rounds: each halves
    the last step, a third of the rate's logarithm at first, so nine leave less than a thousandth."""
    top = F.greatest(F.col("top"), F.lit(0.0))
    a_top, c_top = (3 * top, top) if bounded else (None, None)
    box = Box(low=1e-6 if bounded else 1e-4, top=1.0, amplitude=3.0 if bounded else None, floor=1.0 if bounded else None, slack=0.0, least=least)
    logistic = Shape("logistic", 4, 1e-2, 2.0, 0.0, 2.0, True) if bounded else LOGISTIC
    series = written(series.select(*by, "t_months", "value"))
    rows = written(summed(series, by).where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    out = decay_fit(series, by, box).select(*by, "n", F.lit("exponential").alias("shape"), F.lit(3).alias("_k"), "rate", F.lit(None).cast("double").alias("q"), "amplitude", "floor", "rss")
    shapes = (STRETCHED, logistic)
    best = rows.select(*by, "id", F.col("n").cast("long").alias("n")).join(_two(rows, shapes, a_top, c_top, rounds).withColumnRenamed("shape", "at"), "id")
    name = F.element_at(F.array(*[F.lit(s.name) for s in shapes]), F.col("at") + 1)
    out = out.unionByName(best.select(*by, "n", name.alias("shape"), F.lit(STRETCHED.parameters).alias("_k"), F.exp("cell.p").alias("rate"), F.col("cell.q").alias("q"), F.col("cell.a").alias("amplitude"), F.col("cell.c").alias("floor"), F.greatest("cell.rss", F.lit(0.0)).alias("rss")))
    aic, bic = information_of(F.col("rss"), F.col("n"), F.col("_k"), constant)
    out = out.withColumns({"aic": aic, "bic": bic})
    half = F.when(F.col("shape") == "stretched", halflife_of("stretched", F.col("rate"), F.col("q"))).when(F.col("shape") == "logistic", F.col("q")).otherwise(halflife_of("exponential", F.col("rate")))
    out = out.withColumn("delta_aic", F.col("aic") - F.min("aic").over(Window.partitionBy(*by)))  # three rows a series
    return out.select(*by, "n", "shape", "rate", "q", "amplitude", "floor", "rss", "aic", "bic", "delta_aic", half.alias("halflife"))


def information_of(rss: Column, n: Column, k: Column, constant: bool = True) -> tuple[Column, Column]:
    """AIC and BIC of a least-squares fit with k parameters, as expressions."""
    base = n * F.log(F.greatest(rss, F.lit(1e-12)) / n)
    base = base + n * (math.log(2 * math.pi) + 1) if constant else base
    return base + 2 * k, base + k * F.log(n)


def trend(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, slope): the gate that decaying series pass."""
    return series.groupBy(*by).agg(safe_slope(F.col("value"), F.col("t_months")).alias("slope"))


def loglinear_halflife(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, halflife) by a line through ln(value - floor), floor 0.9 of the least value; null where it doesn't fall."""
    low = F.greatest(F.lit(0.0), 0.9 * F.min("value").over(Window.partitionBy(*by)))
    y = series.withColumn("y", F.log(F.greatest(F.col("value") - low, F.lit(1e-9))))
    out = y.groupBy(*by).agg(F.count("*").alias("n"), safe_slope(F.col("y"), F.col("t_months")).alias("b"))
    return out.select(*by, "n", F.when(F.col("b") < 0, F.lit(LN2) / -F.col("b")).alias("halflife"))


def panel_halflife(series: DataFrame, by: list[str], limit: float = 200.0) -> DataFrame:
    """The bounded fit where the trend falls and the half-life is below the limit, else the log-linear one below the limit, else null."""
    grid = decay_fit(series, by, PANEL).select(*by, F.col("halflife").alias("h1")).join(trend(series, by), by)
    both = loglinear_halflife(series, by).select(*by, F.col("halflife").alias("h2")).join(grid, by, "left")
    first = F.when((F.col("slope") < 0) & (F.col("h1") < limit), F.col("h1"))
    return both.select(*by, F.coalesce(first, F.when(F.col("h2") < limit, F.col("h2"))).alias("halflife"))


def leave_one_out(series: DataFrame, by: list[str]) -> DataFrame:
    """The series once without each of its quarters: adds `dropped`. Rows grow with the square of a series' few quarters."""
    drops = series.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("q").alias("dropped")).distinct()
    on = F.col("q") != F.col("dropped")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return series.join(drops, on).drop(*[f"_{c}" for c in by])


def loqo(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_fits, low, high, median): half-lives over the series that lack one quarter."""
    fits = panel_halflife(leave_one_out(series, by), [*by, "dropped"]).where("halflife is not null")
    return fits.groupBy(*by).agg(F.count("*").alias("n_fits"), F.min("halflife").alias("low"), F.max("halflife").alias("high"), F.percentile("halflife", F.lit(0.5)).alias("median"))


def label_stability(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, n_fits, stability): the share of the series without one quarter whose label is that of the whole series; without a
    half-life the label is the one for nulls. Labels by `power.decay_label`."""
    from wanescope.operators.power import decay_label

    whole = series.withColumn("dropped", F.lit(-1).cast(dict(series.dtypes)["q"]))  # quarters count from year 0
    every = leave_one_out(series, by).unionByName(whole)
    keys = [*by, "dropped"]
    fits = every.select(*keys).distinct().join(panel_halflife(every, keys), keys, "left").withColumn("label", decay_label(F.col("halflife")))
    main = fits.where("dropped = -1").select(*by, F.col("label").alias("main"))
    same = fits.where("dropped <> -1").join(main, by)
    out = same.groupBy(*by).agg(F.max("main").alias("label"), F.count("*").alias("n_fits"), F.avg(F.when(F.col("label") == F.col("main"), 1.0).otherwise(0.0)).alias("stability"))
    return out


def halflife_sweep(sweep: DataFrame) -> DataFrame:
    """(benchmark, n_fits, low, high, ratio) of panel half-lives over the shares k of a sweep."""
    fits = panel_halflife(sweep, ["benchmark", "k"]).where("halflife is not null")
    return fits.groupBy("benchmark").agg(F.count("*").alias("n_fits"), F.min("halflife").alias("low"), F.max("halflife").alias("high")).withColumn("ratio", F.col("high") / F.col("low"))


def forecast(series: DataFrame, by: list[str], train_share: float = 0.7) -> DataFrame:
    """(by, n_test, mape, mae): fit the first int(share n) quarters (two of them without a floor), predict the rest."""
    w = Window.partitionBy(*by)
    rows = series.withColumns({"rn": F.row_number().over(w.orderBy("t_months")), "all": F.count("*").over(w)}).withColumn("train", F.col("rn") <= F.floor(F.col("all") * F.lit(train_share)))
    fits = decay_fit(rows.where("train"), by, FORECAST)
    test = rows.where(~F.col("train")).join(fits.select(*by, "rate", "amplitude", "floor"), by)
    err = F.abs(F.col("amplitude") * F.exp(-F.col("rate") * F.col("t_months")) + F.col("floor") - F.col("value"))
    return test.groupBy(*by).agg(F.count("*").alias("n_test"), F.avg(err / F.greatest(F.col("value"), F.lit(1e-6))).alias("mape"), F.avg(err).alias("mae"))


def net_change(series: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, last, change, decaying): last value against the first."""
    out = series.groupBy(*by).agg(F.min_by("value", "t_months").alias("first"), F.max_by("value", "t_months").alias("last"))
    return out.withColumn("change", (F.col("last") - F.col("first")) / F.nullif(F.col("first"), F.lit(0.0))).withColumn("decaying", F.col("last") < F.col("first"))


def halflife_of(shape: str, rate: Column, beta: Column | None = None, middle: Column | None = None) -> Column:
    if shape == "stretched":
        return F.pow(F.lit(LN2), 1 / beta) / rate
    return middle if shape == "logistic" else F.lit(LN2) / rate


def information(rss: float, n: int, k: int, constant: bool = True) -> tuple[float, float]:
    """AIC and BIC of a least-squares fit with k parameters."""
    s = max(rss, 1e-12) / n
    base = n * math.log(s) + (n * (math.log(2 * math.pi) + 1) if constant else 0)
    return base + 2 * k, base + k * math.log(n)


def _linear(x: np.ndarray, v: np.ndarray, a_top: float = np.inf, c_top: float = np.inf) -> tuple[float, float, float]:
    """Amplitude and floor in their bounds, and the squared error."""
    mx, my = x.mean(), v.mean()
    vx = ((x - mx) ** 2).sum()
    a = ((x - mx) * (v - my)).sum() / vx if vx else 0.0
    tries = [(a, my - a * mx)] + [(float(x @ (v - c) / (x @ x)) if x @ x else 0.0, c) for c in (0.0, c_top) if np.isfinite(c)] + [(b, float((v - b * x).mean())) for b in (0.0, a_top) if np.isfinite(b)]
    inside = [(min(max(b, 0.0), a_top), min(max(c, 0.0), c_top)) for b, c in tries]
    return min(((*p, float(((v - p[0] * x - p[1]) ** 2).sum())) for p in inside), key=lambda p: p[2])


def _golden(f, lo: float, hi: float, steps: int = 80) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def fit_exponential(t: np.ndarray, v: np.ndarray, rate_top: float = 2.0, rate_low: float = 1e-6, a_times: float = 10.0, c_times: float = 1.0) -> dict | None:
    """Bounded A exp(-rate t) + C; null for under 3 points, equal values or no decay. Half-life ln 2 / rate."""
    t, v = np.asarray(t, float), np.asarray(v, float)
    if len(v) < 3 or np.allclose(v, v[0]):
        return None
    a_top, c_top = a_times * v.max() + 1e-6, c_times * v.max() + 1e-6 if np.isfinite(c_times) else np.inf
    rss = lambda r: _linear(np.exp(-r * t), v, a_top, c_top)[2]
    grid = np.geomspace(max(rate_low, 1e-6), rate_top, 400)
    best = int(np.argmin([rss(r) for r in grid]))
    rate = _golden(rss, grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)])
    a, c, err = _linear(np.exp(-rate * t), v, a_top, c_top)
    if rate < 1e-5 or a <= 0:
        return None
    return {"shape": "exponential", "params": [a, rate, c], "rss": err, "halflife": LN2 / rate}


def fit_shapes(t: np.ndarray, v: np.ndarray, constant: bool = True) -> list[dict]:
    """Exponential, stretched and logistic decay by grids refined twice around their best cell, with AIC and BIC, best AIC first."""
    t, v = np.asarray(t, float), np.asarray(v, float)
    span = max(t.max(), 1.0)
    one = [(r, None) for r in np.geomspace(1e-3, 1.0, 120)]
    cells = {
        "exponential": (lambda p: np.exp(-p[0] * t), one, 3),
        "stretched": (lambda p: np.exp(-((p[0] * t) ** p[1])), [(r, b) for r in np.geomspace(1e-3, 1.0, 60) for b in np.linspace(0.2, 3.0, 29)], 4),
        "logistic": (lambda p: 1 / (1 + np.exp(np.clip(p[0] * (t - p[1]), -500, 500))), [(r, m) for r in np.geomspace(1e-2, 2.0, 40) for m in np.linspace(0, 2 * span, 61)], 4),
    }
    out = []
    for shape, (curve, grid, k) in cells.items():
        width = [1.2, 0.15 if shape == "stretched" else span / 25]
        best = min(grid, key=lambda p: _linear(curve(p), v)[2])
        for _ in range(12):
            near = [(best[0] * width[0] ** i, None if best[1] is None else best[1] + width[1] * j) for i in np.linspace(-1, 1, 7) for j in (np.linspace(-1, 1, 7) if best[1] is not None else [0])]
            near = [p for p in near if 0 < p[0] <= 2 and (p[1] is None or (p[1] > 0.05 if shape == "stretched" else p[1] >= 0))]
            best = min([best, *near], key=lambda p: _linear(curve(p), v)[2])
            width = [1 + (width[0] - 1) / 2, width[1] / 2]
        a, c, rss = _linear(curve(best), v)
        half = {"exponential": LN2 / best[0], "logistic": best[1]}.get(shape) if shape != "stretched" else LN2 ** (1 / best[1]) / best[0]
        aic, bic = information(rss, len(v), k, constant)
        out.append({"shape": shape, "params": [a, c, *[p for p in best if p is not None]], "rss": rss, "aic": aic, "bic": bic, "halflife": half})
    out.sort(key=lambda d: d["aic"])
    for d in out:
        d["delta_aic"] = d["aic"] - out[0]["aic"]
    return out


def shape_fits(series: DataFrame, by: list[str], min_points: int = 4) -> DataFrame:
    """(by, shape, params, rss, aic, bic, delta_aic, halflife): the three shapes for every series."""
    names = ["shape", "params", "rss", "aic", "bic", "delta_aic", "halflife"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("t_months")
        found = fit_shapes(p.t_months.to_numpy(), p.value.to_numpy()) if len(p) >= min_points else []
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], *[d[n] for n in names]] for d in found], columns=[*by, *names])

    kinds = dict(series.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "shape string, params array<double>, rss double, aic double, bic double, delta_aic double, halflife double"])
    return series.dropna(subset=["t_months", "value"]).groupBy(*by).applyInPandas(one, schema)


def refined(series: DataFrame, by: list[str], **bounds: float) -> DataFrame:
    """(by, amplitude, rate, floor, rss, halflife): the bounded exponential fit, refined between grid cells."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("t_months")
        d = fit_exponential(p.t_months.to_numpy(), p.value.to_numpy(), **bounds)
        row = [*d["params"], d["rss"], d["halflife"]] if d else [None] * 5
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], *row]], columns=[*by, "amplitude", "rate", "floor", "rss", "halflife"])

    kinds = dict(series.dtypes)
    return series.dropna(subset=["t_months", "value"]).groupBy(*by).applyInPandas(one, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "amplitude double, rate double, floor double, rss double, halflife double"]))
