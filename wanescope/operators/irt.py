"""Item response models over response matrices: Rasch and two-parameter fits by benchmark and epoch, differences, equating and drift.

A Rasch fit knows an item by the models that answered it and how many were right: items alike in both are one class with a count, so a
million items of a complete benchmark are as many classes as it has models, and one more. Classes are summed in Spark; a group whose classes
are few is solved in one small task, and beyond a bound on their cells all groups are solved by rounds of joins and keyed sums.
Two-parameter fits have no such classes: a group up to the bound is a matrix of models by items in one task, beyond it the same steps are
rounds of joins and keyed sums. Equating sums characteristic curves over items, so its steps see 61 points a group. The rest is frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.operators.ranking import with_values
from wanescope.shared import released, written

CLIP = 30.0


def prob_2pl(theta: Column, a: Column, b: Column) -> Column:
    z = a * (theta - b)
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))))


def empirical_difficulty(acc: Column, eps: float = 1e-3) -> Column:
    p = F.greatest(F.least(acc, F.lit(1 - eps)), F.lit(eps))
    return -F.log(p / (1 - p))


def nll_2pl(responses: DataFrame, items: DataFrame, abilities: DataFrame) -> DataFrame:
    """One row (nll): penalised negative log-likelihood given parameters; theta standard normal, ln a with variance 0.25."""
    p = prob_2pl(F.col("theta"), F.col("a"), F.col("b"))
    seen = responses.where("correct is not null").join(items.select("item", "a", "b"), "item").join(abilities.select("model", "theta"), "model")
    fit = seen.agg((-F.sum(F.when(F.col("correct") == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("fit"))
    prior = abilities.agg((F.sum(F.col("theta") * F.col("theta")) / 2).alias("pt")).join(items.agg((F.sum(F.log("a") * F.log("a")) / 0.5).alias("pa")), F.lit(True))
    return fit.join(prior, F.lit(True)).select((F.col("fit") + F.col("pt") + F.col("pa")).alias("nll"))


def fit_rasch(x: np.ndarray, prior_b_var: float = 4.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Abilities and difficulties at the unique maximum of the posterior: theta ~ N(0, 1), b ~ N(0, prior_b_var); nan is not answered."""
    seen, y = ~np.isnan(x), np.nan_to_num(x)
    m, n = x.shape
    theta, b = np.zeros(m), np.zeros(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(theta[:, None] - b[None], -CLIP, CLIP)))
        w = p * (1 - p) * seen
        g = np.concatenate((((y - p) * seen).sum(1) - theta, -((y - p) * seen).sum(0) - b / prior_b_var))
        d1, d2 = w.sum(1) + 1, w.sum(0) + 1 / prior_b_var
        # Newton: eliminate the items, whose block is diagonal
        schur = np.diag(d1) - (w / d2) @ w.T
        dt = np.linalg.solve(schur, g[:m] + (w / d2) @ g[m:])
        db = (g[m:] + w.T @ dt) / d2
        theta, b = theta + dt, b + db
        if max(np.abs(dt).max(), np.abs(db).max()) < 1e-10:
            break
    return theta, b


def fit_rasch_classes(seen: np.ndarray, right: np.ndarray, class_right: np.ndarray, count: np.ndarray, prior_b_var: float = 4.0, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """fit_rasch from sums. seen: models by classes, whether a model answered the class's items; right: right answers of each model;
    class_right: of each of a class's items; count: items of a class."""
    m = len(right)
    theta, b = np.zeros(m), np.zeros(len(count))
    for _ in range(steps):
        p = seen / (1 + np.exp(-np.clip(theta[:, None] - b[None], -CLIP, CLIP)))
        w = p * (1 - p)
        g_theta = right - p @ count - theta
        g_b = -(class_right - p.sum(0)) - b / prior_b_var
        d1, d2 = w @ count + 1, w.sum(0) + 1 / prior_b_var
        part = w / d2 * count
        dt = np.linalg.solve(np.diag(d1) - part @ w.T, g_theta + part @ g_b)
        db = (g_b + w.T @ dt) / d2
        theta, b = theta + dt, b + db
        if max(np.abs(dt).max(), np.abs(db).max()) < 1e-10:
            break
    return theta, b


def fit_2pl(x: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, theta) by alternating projected Newton steps; a in [0.1, 5], b and theta in [-4, 4]; theta standard normal, ln a ~ N(0, 0.25)."""
    seen, y = ~np.isnan(x), np.nan_to_num(x)
    acc = np.clip(np.where(seen.sum(0) > 0, y.sum(0) / np.maximum(seen.sum(0), 1), 0.5), 0.01, 0.99)
    a, b = np.ones(x.shape[1]), np.clip(-np.log(acc / (1 - acc)), -4, 4)
    theta = np.zeros(x.shape[0])
    for _ in range(steps):
        before = np.concatenate((a, b, theta))
        for part in "tba":
            d = theta[:, None] - b[None]
            p = 1 / (1 + np.exp(-np.clip(a * d, -CLIP, CLIP)))
            e, w = (y - p) * seen, p * (1 - p) * seen
            if part == "t":
                theta = np.clip(theta + ((e * a).sum(1) - theta) / ((w * a**2).sum(1) + 1), -4, 4)
            elif part == "b":
                b = np.clip(b - np.clip((e * a).sum(0) / ((w * a**2).sum(0) + 1e-2), -0.5, 0.5), -4, 4)
            else:
                g = (e * d).sum(0) - np.log(a) / (0.25 * a)
                h = (w * d**2).sum(0) + np.maximum(1 - np.log(a), 0.1) / (0.25 * a**2)
                a = np.clip(a + np.clip(g / h, -0.25, 0.25), 0.1, 5.0)
        if np.abs(np.concatenate((a, b, theta)) - before).max() < 1e-7:
            break
    return a, b, theta


def _matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot_table(index="model", columns="item", values="correct", aggfunc="max").astype(float)


#: Cells (models by classes) up to which a group is solved in one task; a matrix of doubles of that size is 16 MB.
MOST_CELLS = 2_000_000


def item_classes(responses: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stored tables of (by, item, class) and of cells (by, class, model, class_right, count): the models that answered a class's items, how
    many of them were right on each, and how many items there are. Two items are of one class where both agree: the sets of models are told
    by their number and two sums of hashes."""
    rows = responses.where("correct is not null").groupBy(*by, "model", "item").agg(F.max("correct").cast("double").alias("correct"))
    hashes = [F.sum(F.xxhash64(F.lit(k), "model").cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    items = written(rows.groupBy(*by, "item").agg(F.sum("correct").alias("class_right"), F.concat_ws(":", *hashes, F.count("*").cast("string"), F.sum("correct").cast("string")).alias("class")))
    classes = items.groupBy(*by, "class", "class_right").agg(F.count("*").cast("double").alias("count"), F.min("item").alias("item"))
    cells = written(rows.join(classes, [*by, "item"]).select(*by, "class", "model", "class_right", "count"))
    return items.select(*by, "item", "class"), cells


def model_totals(responses: DataFrame, by: list[str]) -> DataFrame:
    rows = responses.where("correct is not null").groupBy(*by, "model", "item").agg(F.max("correct").cast("double").alias("correct"))
    return rows.groupBy(*by, "model").agg(F.sum("correct").alias("right"))


def _solved_alone(cells: DataFrame, totals: DataFrame, by: list[str], prior_b_var: float) -> DataFrame:
    """(by, class, b), a group's classes in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        models, at = np.unique(pdf["model"].astype(str), return_inverse=True)
        classes, k = np.unique(pdf["class"], return_inverse=True)
        seen, right, per, count = np.zeros((len(models), len(classes))), np.zeros(len(models)), np.zeros(len(classes)), np.zeros(len(classes))
        seen[at, k], right[at], per[k], count[k] = 1, pdf["right"], pdf["class_right"], pdf["count"]
        b = fit_rasch_classes(seen, right, per, count, prior_b_var)[1]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(b) for c in by}, "class": classes, "b": b})

    kinds = dict(cells.dtypes)
    return cells.join(totals, [*by, "model"]).groupBy(*by).applyInPandas(one, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "class string, b double"]))


def _solved_in_rounds(cells: DataFrame, totals: DataFrame, by: list[str], prior_b_var: float, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """(by, class, b): Newton steps of all abilities, then of all difficulties, then the shift of both that the priors alone decide, which
    plain alternation would approach slowly. Rows are joined and summed by key; nothing is gathered but the largest step."""
    p = 1 / (1 + F.exp(-F.greatest(F.least(F.col("theta") - F.col("b"), F.lit(CLIP)), F.lit(-CLIP))))
    models = written(totals.withColumn("theta", F.lit(0.0)))
    items = written(cells.groupBy(*by, "class").agg(F.max("class_right").alias("class_right"), F.max("count").alias("count")).withColumn("b", F.lit(0.0)))
    pairs = cells.select(*by, "class", "model")
    for _ in range(rounds):
        each = pairs.join(models.select(*by, "model", "theta"), [*by, "model"]).join(items.select(*by, "class", "b", "count"), [*by, "class"]).withColumn("p", p)
        sums = each.groupBy(*by, "model").agg(F.sum(F.col("count") * F.col("p")).alias("e"), F.sum(F.col("count") * F.col("p") * (1 - F.col("p"))).alias("w"))
        abler = written(models.join(sums, [*by, "model"]).select(*by, "model", "right", (F.col("theta") + (F.col("right") - F.col("e") - F.col("theta")) / (F.col("w") + 1)).alias("theta")))
        each = pairs.join(abler.select(*by, "model", "theta"), [*by, "model"]).join(items.select(*by, "class", "b"), [*by, "class"]).withColumn("p", p)
        sums = each.groupBy(*by, "class").agg(F.sum("p").alias("e"), F.sum(F.col("p") * (1 - F.col("p"))).alias("w"))
        harder = items.join(sums, [*by, "class"]).select(*by, "class", "class_right", "count", F.col("b").alias("was"), (F.col("b") + (F.col("e") - F.col("class_right") - F.col("b") / prior_b_var) / (F.col("w") + 1 / prior_b_var)).alias("b"))
        harder = written(harder)
        part = abler.select(*by, F.col("theta").alias("pull"), F.lit(1.0).alias("hold")).unionByName(harder.select(*by, (F.col("count") * F.col("b") / prior_b_var).alias("pull"), (F.col("count") / prior_b_var).alias("hold")))
        shift = part.groupBy(*by).agg((-F.sum("pull") / F.sum("hold")).alias("shift"))
        moved = written(harder.join(shift, by).select(*by, "class", "class_right", "count", (F.col("b") + F.col("shift")).alias("b"), F.abs(F.col("b") + F.col("shift") - F.col("was")).alias("step")))
        now = written(abler.join(shift, by).select(*by, "model", "right", (F.col("theta") + F.col("shift")).alias("theta")))
        step = moved.agg(F.max("step")).first()[0]
        released(models, items, abler, harder)
        models, items = now, moved.drop("step")
        items._written_to = moved._written_to
        if step is None or step < tolerance:
            break
    return items.select(*by, "class", "b")


def rasch(responses: DataFrame, by: list[str], prior_b_var: float = 4.0, most_cells: int = MOST_CELLS) -> DataFrame:
    """(by, item, b, n_models): Rasch difficulties at the maximum of the posterior, abilities N(0, 1), difficulties N(0, prior_b_var)."""
    responses = responses.select(*by, "model", "item", "correct")
    items, cells = item_classes(responses, by)
    totals = written(model_totals(responses, by))
    largest = cells.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    solve = _solved_alone if largest <= most_cells else _solved_in_rounds
    sizes = totals.groupBy(*by).agg(F.count("*").alias("n_models"))
    return items.join(solve(cells, totals, by, prior_b_var), [*by, "class"]).join(sizes, by).select(*by, "item", "b", "n_models")


def _two_pl_alone(cells: DataFrame, by: list[str], steps: int) -> DataFrame:
    """(by, item, a, b), a group's matrix in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf)
        a, b, _ = fit_2pl(m.to_numpy(), steps)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(b) for c in by}, "item": list(m.columns), "a": a, "b": b})

    kinds = dict(cells.dtypes)
    return cells.groupBy(*by).applyInPandas(one, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"item {kinds['item']}, a double, b double"]))


def _two_pl_in_rounds(cells: DataFrame, by: list[str], steps: int, tolerance: float = 1e-7) -> DataFrame:
    """(by, item, a, b) by the steps of fit_2pl: all abilities, then all difficulties, then all discriminations, each a keyed sum over the
    cells. A round writes abilities and items; the driver gets the largest change. Groups that have converged take no more part."""
    bound = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    a, b, theta, y = (F.col(c) for c in ("a", "b", "theta", "correct"))
    p = prob_2pl(theta, a, b)
    w = p * (1 - p)
    model, item = [*by, "model"], [*by, "item"]
    acc = bound(F.avg("correct"), 0.01, 0.99)
    items = written(cells.groupBy(*item).agg(bound(-F.log(acc / (1 - acc)), -4.0, 4.0).alias("b")).withColumn("a", F.lit(1.0)))
    models = written(cells.groupBy(*model).agg(F.lit(0.0).alias("theta")))
    done = []
    for _ in range(steps):
        live = with_values(cells, items.groupBy(*by).agg(F.count("*").alias("_n")), by).drop("_n") if done else cells
        sums = with_values(with_values(live, items, item), models, model).groupBy(*model).agg(F.sum((y - p) * a).alias("g"), F.sum(w * a * a).alias("h"))
        abler = written(with_values(models, sums, model).select(*model, bound(theta + (F.col("g") - theta) / (F.col("h") + 1), -4.0, 4.0).alias("theta"), theta.alias("was")))
        seen = with_values(live, abler.drop("was"), model)
        sums = with_values(seen, items, item).groupBy(*item).agg(F.sum((y - p) * a).alias("g"), F.sum(w * a * a).alias("h"))
        moved = bound(b - bound(F.col("g") / (F.col("h") + 1e-2), -0.5, 0.5), -4.0, 4.0)
        harder = with_values(items, sums, item).select(*item, a, moved.alias("b"), b.alias("b_was"))
        sums = with_values(seen, harder, item).groupBy(*item).agg(F.sum((y - p) * (theta - b)).alias("g"), F.sum(w * (theta - b) * (theta - b)).alias("h"))
        step = (F.col("g") - F.log(a) / (0.25 * a)) / (F.col("h") + F.greatest(1 - F.log(a), F.lit(0.1)) / (0.25 * a * a))
        change = F.greatest(F.abs(b - F.col("b_was")), F.abs(F.col("a_new") - a))
        sharper = with_values(harder, sums, item).withColumn("a_new", bound(a + bound(step, -0.25, 0.25), 0.1, 5.0))
        sharper = written(sharper.select(*item, F.col("a_new").alias("a"), "b", change.alias("change")))
        changes = sharper.select(*by, "change").unionByName(abler.select(*by, F.abs(theta - F.col("was")).alias("change"))).groupBy(*by).agg(F.max("change").alias("most"))
        told = with_values(sharper.drop("change"), changes, by)
        ended = written(told.where(F.col("most") < tolerance).drop("most"))
        left = written(told.where(F.col("most") >= tolerance).drop("most"))
        released(items, models, sharper)
        items, models = left, abler
        if ended.isEmpty():
            released(ended)
        else:
            done.append(ended)
        if left.isEmpty():
            break
    for more in done:
        items = items.unionByName(more)
    return items.select(*item, "a", "b")


def two_pl(responses: DataFrame, by: list[str], min_models: int = 3, most_cells: int = MOST_CELLS, steps: int = 500) -> DataFrame:
    """(by, item, a, b) for groups with enough models. Of repeats the best answer counts; rows without a model, an item or an answer are left out."""
    rows = responses.select(*by, "model", "item", "correct").dropna(subset=["model", "item", "correct"])
    cells = rows.groupBy(*by, "model", "item").agg(F.max("correct").cast("double").alias("correct"))
    cells = written(cells.withColumn("model", F.col("model").cast("string")))
    n_models = cells.groupBy(*by, "model").agg(F.lit(1)).groupBy(*by).agg(F.count("*").alias("n_models"))
    n_items = cells.groupBy(*by, "item").agg(F.lit(1)).groupBy(*by).agg(F.count("*").alias("n_items"))
    sizes = written(with_values(n_models.where(F.col("n_models") >= min_models), n_items, by))
    largest = sizes.agg(F.max(F.col("n_models") * F.col("n_items"))).first()[0] or 0
    enough = with_values(cells, sizes.select(*by, "n_models"), by).drop("n_models")
    return _two_pl_alone(enough, by, steps) if largest <= most_cells else _two_pl_in_rounds(enough, by, steps)


def model_windows(responses: DataFrame, dim: DataFrame, size: int = 2) -> DataFrame:
    """responses with `window`: each model is in the windows of `size` consecutive models of dim's order that hold it."""
    last = dim.count() - size  # a short list of models
    rows = responses.join(dim.select("model", "ord"), "model")
    starts = F.sequence(F.greatest(F.lit(0), F.col("ord") - size + 1), F.least(F.col("ord"), F.lit(last)))
    return rows.withColumn("window", F.explode(starts)).drop("ord")


def delta_b(responses: DataFrame) -> DataFrame:
    """(benchmark, item, b_orig, b_pert, delta): difficulty of an item as perturbed less as written."""
    fits = rasch(responses, ["benchmark", "version"])
    side = lambda v, n: fits.where(F.col("version") == v).select("benchmark", "item", F.col("b").alias(n))
    return side("orig", "b_orig").join(side("pert", "b_pert"), ["benchmark", "item"]).withColumn("delta", F.col("b_pert") - F.col("b_orig"))


def delta_summary(delta: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    return delta.groupBy("benchmark").agg(F.count("*").alias("n_items"), F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta"), count(F.col("delta") < -1).alias("below"), count(F.col("delta") > 1).alias("above"), F.avg(F.when(F.col("delta") < -0.5, 1.0).otherwise(0.0)).alias("easier"))


def equating(a_ref: np.ndarray, b_ref: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Scale A and shift B of the Stocking-Lord criterion (test characteristic curves alike on -3..3), by Gauss-Newton."""
    grid = np.linspace(-3, 3, 61)[:, None]
    curve = lambda aa, bb: (1 / (1 + np.exp(-np.clip(aa * (grid - bb), -CLIP, CLIP)))).sum(1)
    target, x = curve(a_ref, b_ref), np.array([1.0, 0.0])
    error = lambda p: curve(a / p[0], p[0] * b + p[1]) - target
    for _ in range(50):
        e = error(x)
        j = np.column_stack([(error(x + h) - e) / 1e-5 for h in np.eye(2) * 1e-5])
        step, size = np.linalg.lstsq(j, -e, rcond=None)[0], 1.0
        while size > 1e-6 and (x[0] + size * step[0] <= 0.05 or (error(x + size * step) ** 2).sum() > (e**2).sum()):
            size /= 2
        x = x + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(x[0]), float(x[1])


#: Abilities at which characteristic curves are compared.
POINTS = [-3 + i / 10 for i in range(61)]


def equating_constants(both: DataFrame, by: list[str], steps: int = 60) -> DataFrame:
    """(by, scale, shift) of the Stocking-Lord criterion from (by, a, b, a0, b0), an item's parameters on two scales: Gauss-Newton with step
    halving. A step sums both curves and their derivatives over items, at each of 61 points; what is left of a group is one row."""
    scale, shift, t = F.col("scale"), F.col("shift"), F.col("_t")
    state = written(both.select(*by).distinct().withColumns({"scale": F.lit(1.0), "shift": F.lit(0.0), "s0": F.lit(1.0), "h0": F.lit(0.0), "ds": F.lit(0.0), "dh": F.lit(0.0), "size": F.lit(1.0), "least": F.lit(float("inf")), "open": F.lit(True)}))
    logistic = lambda z: 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))))
    at = (t - shift) / scale  # the new curve at t is the old one here
    p = logistic(F.col("a") * (at - F.col("b")))
    slope = F.when(F.abs(F.col("a") * (at - F.col("b"))) < CLIP, p * (1 - p) * F.col("a")).otherwise(0.0)
    points = F.explode(F.array(*[F.lit(float(x)) for x in POINTS])).alias("_t")
    for _ in range(steps):
        each = with_values(both, state.where("open").select(*by, "scale", "shift"), by).select("*", points)
        curve = each.groupBy(*by, "scale", "shift", "_t").agg(F.sum(p - logistic(F.col("a0") * (t - F.col("b0")))).alias("e"), F.sum(slope).alias("d"))
        js, jh = -F.col("d") * at / scale, -F.col("d") / scale
        sums = curve.groupBy(*by).agg(F.sum(F.col("e") * F.col("e")).alias("rss"), F.sum(js * js).alias("ss"), F.sum(js * jh).alias("sh"), F.sum(jh * jh).alias("hh"), F.sum(js * F.col("e")).alias("se"), F.sum(jh * F.col("e")).alias("he"))
        now = with_values(state.where("open"), sums, by)
        better = F.col("rss") <= F.col("least")
        det = F.col("ss") * F.col("hh") - F.col("sh") * F.col("sh")
        solved = det > 1e-12 * F.col("ss") * F.col("hh")
        ds = F.when(solved, (F.col("sh") * F.col("he") - F.col("hh") * F.col("se")) / det).otherwise(0.0)
        dh = F.when(solved, (F.col("sh") * F.col("se") - F.col("ss") * F.col("he")) / det).when(F.col("hh") > 0, -F.col("he") / F.col("hh")).otherwise(0.0)
        pick = lambda yes, no: F.when(better, yes).otherwise(F.col(no))
        now = now.select(*by, pick(scale, "s0").alias("s0"), pick(shift, "h0").alias("h0"), pick(ds, "ds").alias("ds"), pick(dh, "dh").alias("dh"), F.when(better, F.lit(1.0)).otherwise(F.col("size") / 2).alias("size"), F.least("rss", "least").alias("least"))
        # a step must leave the scale over 0.05
        now = now.withColumn("size", F.when(F.col("s0") + F.col("size") * F.col("ds") > 0.05, F.col("size")).otherwise(F.least(F.col("size"), (F.col("s0") - 0.05) / (-2 * F.col("ds")))))
        now = now.withColumn("open", F.col("size") * F.greatest(F.abs("ds"), F.abs("dh")) >= 1e-9)
        now = now.withColumns({"scale": F.col("s0") + F.when(F.col("open"), F.col("size") * F.col("ds")).otherwise(0.0), "shift": F.col("h0") + F.when(F.col("open"), F.col("size") * F.col("dh")).otherwise(0.0)})
        after = written(state.where("not open").unionByName(now))
        released(state)
        state = after
        if state.where("open").isEmpty():
            break
    return state.select(*by, F.col("s0").alias("scale"), F.col("h0").alias("shift"))


def equated(params: DataFrame) -> DataFrame:
    """(benchmark, epoch, item, a, b) on the scale of each benchmark's first epoch, over the items that both have."""
    params = written(params.select("benchmark", "epoch", "item", "a", "b"))
    first = params.groupBy("benchmark").agg(F.min("epoch").alias("_first"))
    ref = params.join(first, "benchmark").where("epoch = _first").select("benchmark", "item", F.col("a").alias("a0"), F.col("b").alias("b0"))
    both = written(params.join(ref, ["benchmark", "item"]))
    moved = with_values(both, equating_constants(both.drop("item"), ["benchmark", "epoch"]), ["benchmark", "epoch"])
    return moved.select("benchmark", "epoch", "item", (F.col("a") / F.col("scale")).alias("a"), (F.col("scale") * F.col("b") + F.col("shift")).alias("b"))


def longitudinal(responses: DataFrame, min_models: int = 3, min_epochs: int = 3) -> DataFrame:
    """(benchmark, item, class, a_slope, b_slope) from responses with `epoch`: fit each epoch, equate to the first, test trends, name classes."""
    from wanescope.operators import stats

    fits = equated(two_pl(responses, ["benchmark", "epoch"], min_models))
    ages = fits.select("benchmark", "epoch").distinct()
    places = ages.select(F.col("benchmark").alias("_b"), F.col("epoch").alias("_e"))
    t = ages.join(places, (F.col("benchmark") == F.col("_b")) & (F.col("_e") <= F.col("epoch"))).groupBy("benchmark", "epoch").agg((F.count("*") - 1).cast("double").alias("t"))
    rows = fits.join(t, ["benchmark", "epoch"])
    a = stats.detect_drift(rows, value="a").select("benchmark", "item", F.col("t_n"), F.col("slope").alias("a_slope"), F.col("significant").alias("a_sig"))
    b = stats.detect_drift(rows, value="b").select("benchmark", "item", F.col("slope").alias("b_slope"), F.col("significant").alias("b_sig"))
    last = rows.groupBy("benchmark", "item").agg(F.avg("a").alias("a_mean"), F.max_by("b", "t").alias("b_last"))
    x = a.join(b, ["benchmark", "item"]).join(last, ["benchmark", "item"]).where(F.col("t_n") >= min_epochs)
    ceiling = prob_2pl(F.lit(0.0), F.col("a_mean"), F.col("b_last"))
    return x.select("benchmark", "item", stats.drift_class(ceiling, F.col("a_sig"), F.col("a_slope"), F.col("b_sig"), F.col("b_slope")).alias("class"), "a_slope", "b_slope")
