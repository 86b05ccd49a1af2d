"""Curve models of score against unit count: line, hinge, step, logistic; AIC and BIC; dataset intercepts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.stats import bounded_least_squares
from tokenloom.operators.ranks import largest, written

#: Distinct x of a group that one task fits a logistic curve to; beyond it sums are taken by Spark, round by round.
ONE_TASK_VALUES = 1_000_000

#: Breakpoints tried, and the percentiles that they lie between.
GRID, LOW, HIGH = 300, 0.05, 0.95
PARAMETERS = {"linear": 2, "hinge": 4, "step": 3, "logistic": 4}


def linear(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, n, a, b, rss) of y = a + b x, residuals summed in a second pass."""
    fit = df.groupBy(*keys).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"))
    r = F.col(y) - F.col("a") - F.col("b") * F.col(x)
    return _with(df, fit, keys).groupBy(*keys).agg(F.count("*").cast("long").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.sum(r * r).alias("rss"))


def _with(df: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(fit, keys) if keys else df.crossJoin(F.broadcast(fit))  # without keys fit is one row


def grid(df: DataFrame, keys: list[str], x: str = "x", points: int = GRID) -> DataFrame:
    """(keys, k, bp): breakpoints evenly from the 5th to the 95th percentile."""
    ends = df.groupBy(*keys, x).agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.percentile(x, [LOW, HIGH], F.col("__n")).alias("q"))
    at = ends.select(*keys, "q", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return at.select(*keys, "k", (F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * F.col("k") / (points - 1)).alias("bp"))


def step(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", points: int = GRID) -> DataFrame:
    """(keys, n, bp, level_high, level_low, rss): the step of least RSS with two rows or more on each side.

    Rows are first summed by x, so that the breakpoints meet distinct values, not rows. Sums are taken about the
    group's mean.
    """
    mean = df.groupBy(*keys).agg(F.avg(y).alias("__m"))
    c = F.col(y) - F.col("__m")
    sums = _with(df, mean, keys).groupBy(*keys, x, "__m").agg(F.count("*").alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("ss"))
    cells = _with(sums, grid(df, keys, x, points), keys) if keys else sums.crossJoin(F.broadcast(grid(df, keys, x, points)))
    below = F.col(x) < F.col("bp")
    side = lambda c, d: F.sum(F.when(d, F.col(c)).otherwise(0))
    per = cells.groupBy(*keys, "k", "bp").agg(
        F.sum("n").alias("n"), side("n", below).alias("n1"), side("s", below).alias("s1"), side("n", ~below).alias("n2"), side("s", ~below).alias("s2"), F.sum("ss").alias("ss"), F.first("__m").alias("m")
    ).where("n1 >= 2 and n2 >= 2")
    rss = F.col("ss") - F.col("s1") ** 2 / F.col("n1") - F.col("s2") ** 2 / F.col("n2")
    per = per.select(*keys, "k", "n", "bp", (F.col("m") + F.col("s1") / F.col("n1")).alias("level_high"), (F.col("m") + F.col("s2") / F.col("n2")).alias("level_low"), rss.alias("rss"))
    return _least(per, keys)


def _least(per: DataFrame, keys: list[str]) -> DataFrame:
    """The row of least RSS, the first breakpoint among equals to nine decimals."""
    order = Window.partitionBy(*keys).orderBy(F.round("rss", 9), "k") if keys else Window.orderBy(F.round("rss", 9), "k")
    return per.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "k")


def _products(df: DataFrame, keys: list[str], by: list[str], x: str, y: str, points: int) -> DataFrame:
    """(keys, k, bp, n, xx, xh, hh, xy, hy, yy, mx, mh, my): for each breakpoint with h = max(0, x - bp), sums of products
    about the means within `by`, and overall means.

    Rows are first summed by distinct x about the group's means; what meets the breakpoints are these sums.
    """
    df = df.withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})
    mean = df.groupBy(*keys).agg(F.avg("__x").alias("__mx"), F.avg("__y").alias("__my"))
    c = F.col("__y") - F.col("__my")
    sums = _with(df, mean, keys).groupBy(*keys, *by, "__x", "__mx", "__my").agg(F.count("*").alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("ss"))
    steps = grid(df, keys, "__x", points)
    cells = sums.join(steps, keys) if keys else sums.crossJoin(F.broadcast(steps))  # `points` rows
    u, h, n, s = F.col("__x") - F.col("__mx"), F.greatest(F.lit(0.0), F.col("__x") - F.col("bp")), F.col("n"), F.col("s")
    terms = {"n": n, "x": n * u, "h": n * h, "y": s, "xx": n * u * u, "xh": n * u * h, "hh": n * h * h, "xy": u * s, "hy": h * s, "yy": F.col("ss")}
    per = cells.groupBy(*keys, "k", "bp", "__mx", "__my", *by).agg(*(F.sum(t).alias(f"s_{name}") for name, t in terms.items()))
    about = lambda a, b: F.sum(F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("s_n")).alias(a + b)
    whole = lambda a: F.sum(f"s_{a}") / F.sum("s_n")
    return per.groupBy(*keys, "k", "bp", "__mx", "__my").agg(
        F.sum("s_n").cast("long").alias("n"), *(about(a, b) for a, b in ("xx", "xh", "hh", "xy", "hy", "yy")),
        (F.col("__mx") + whole("x")).alias("mx"), whole("h").alias("mh"), (F.col("__my") + whole("y")).alias("my"),
    )


def _hinges(products: DataFrame, keys: list[str]) -> DataFrame:
    """The two normal equations of each breakpoint solved: (keys, n, bp, a, b, c, rss) of the least RSS. Where h is no
    direction of its own the line is the fit."""
    v = lambda name: F.col(name)
    det = v("xx") * v("hh") - v("xh") ** 2
    own = det > 1e-9 * v("xx") * v("hh")
    b = F.when(own, (v("xy") * v("hh") - v("hy") * v("xh")) / F.nullif(det, F.lit(0.0))).otherwise(v("xy") / F.nullif(v("xx"), F.lit(0.0)))
    c = F.when(own, (v("hy") * v("xx") - v("xy") * v("xh")) / F.nullif(det, F.lit(0.0))).otherwise(F.lit(0.0))
    solved = products.withColumns({"b": F.coalesce(b, F.lit(0.0)), "c": c})
    rss = v("yy") - v("b") * v("xy") - v("c") * v("hy")
    return _least(solved.select(*keys, "k", "n", "bp", (v("my") - v("b") * v("mx") - v("c") * v("mh")).alias("a"), "b", "c", rss.alias("rss")), keys)


def hinge(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", points: int = GRID) -> DataFrame:
    """(keys, n, bp, a, b, c, rss) of y = a + b x + c max(0, x - bp)."""
    return _hinges(_products(df, keys, [], x, y, points), keys)


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    """The median of values that stand n times each."""
    order = np.argsort(x, kind="stable")
    upto, total = np.cumsum(n[order]), int(n.sum())
    low, high = (x[order][np.searchsorted(upto, k, "right")] for k in ((total - 1) // 2, total // 2))
    return float(low + high) / 2


def logistic(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", intercepts: str | None = None, one_task: int = ONE_TASK_VALUES) -> DataFrame:
    """(keys, n, low, high, k, x0, rss) of low + (high - low) / (1 + exp(-k (x - x0))) within bounds, from sums over distinct x.

    intercepts: a column whose values get intercepts of their own, sharing the curve. A group is fitted by one task
    while it has at most one_task distinct x; where one has more, all groups take rounds of sums over Spark, which give
    the same residual sums.
    """
    own = keys or ["__all"]
    df = df if keys else df.withColumn("__all", F.lit(0))
    by = [*own, *([intercepts] if intercepts else [])]
    sums = df.groupBy(*by, F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("ss"), F.min(y).alias("lo"), F.max(y).alias("hi"))
    sums = written(sums)
    if largest(sums, own) > one_task:
        out = _logistic_rounds(sums, own, intercepts)
        return out if keys else out.drop("__all")
    kind = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in own)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, n, s, ss = (pdf[c].to_numpy(float) for c in ("x", "n", "s", "ss"))
        group = pd.factorize(pdf[intercepts], sort=True)[0] if intercepts else np.zeros(len(xs), int)
        extra = group.max()
        w, mean = np.sqrt(n), s / n
        within = float((ss - s * s / n).sum())  # about each x's own mean

        def residuals(p):
            shift = np.concatenate([[0.0], p[4:]])[group]
            return w * (p[0] + (p[1] - p[0]) / (1 + np.exp(-np.clip(p[2] * (xs - p[3]), -500, 500))) + shift - mean)

        lo, hi, mid = max(pdf["lo"].min(), 0.0), min(pdf["hi"].max(), 1.0), _weighted_median(xs, n)
        low = np.array([-0.5, -0.5, 1e-5, xs.min(), *[-1.0] * extra])
        high = np.array([1.5, 1.5, 10.0, max(xs.max(), xs.min() + 1e-9), *[1.0] * extra])
        starts = [(a, b, k, c) for a, b in ((lo, hi), (hi, lo)) for k in (0.1, 1.0) for c in (mid, *np.percentile(xs, [25, 75]))]
        p, rss = min((bounded_least_squares(residuals, np.array([*start, *[0.0] * extra]), low, high) for start in starts), key=lambda r: r[1])
        return pd.DataFrame([[*pdf.iloc[0][own], int(n.sum()), *p[:4], rss + within]], columns=[*own, "n", "low", "high", "k", "x0", "rss"])

    out = sums.groupBy(*own).applyInPandas(fit, f"{kind}, n long, low double, high double, k double, x0 double, rss double")
    return out if keys else out.drop("__all")


#: Dampings tried at once in a round, as multiples of the last; rounds at most; gain in rss below which a start is done.
_DAMPINGS, _ROUNDS, _GAIN = (0.25, 1.0, 8.0, 64.0), 100, 1e-13


def _logistic_rounds(sums: DataFrame, own: list[str], intercepts: str | None) -> DataFrame:
    """logistic() by Levenberg-Marquardt whose normal equations are sums over Spark, all groups and starts in one job a round.

    The driver holds twelve curves of each group, with a shift for each intercept, and in a round four proposals for each:
    it grows with the number of groups, never with rows or distinct x.
    """
    spark = sums.sparkSession
    level = F.col(intercepts).cast("string") if intercepts else F.lit("")
    table = sums.select(*(F.col(k).alias(f"__own{i}") for i, k in enumerate(own)), F.coalesce(level, F.lit("\0")).alias("__level"), "x", "n", (F.col("s") / F.col("n")).alias("mean"), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"), "lo", "hi")
    mine = [f"__own{i}" for i in range(len(own))]
    groups = table.groupBy(*mine).agg(
        F.sum("n").alias("n"), F.sum("within").alias("within"), F.greatest(F.min("lo"), F.lit(0.0)).alias("lo"), F.least(F.max("hi"), F.lit(1.0)).alias("hi"), F.min("x").alias("first"), F.max("x").alias("last"),
        F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("q"), F.sort_array(F.collect_set("__level")).alias("levels"),
    ).collect()
    place = ", ".join(f"__of{i} {sums.schema[k].dataType.simpleString()}" for i, k in enumerate(own))

    def evaluate(trials: list[tuple]) -> dict:
        """Normal matrix, gradient and residual sum of each (group, start, proposal, parameters)."""
        rows = [(*(groups[g][k] for k in mine), g, t, u, *map(float, p[:4]), {v: float(s) for v, s in zip(groups[g]["levels"], [0.0, *p[4:]], strict=True)}) for g, t, u, p in trials]
        small = spark.createDataFrame(rows, f"{place}, g int, t int, u int, a double, b double, k double, x0 double, shift map<string, double>")
        same = F.lit(True)
        for i, c in enumerate(mine):
            same = same & F.col(c).eqNullSafe(F.col(f"__of{i}"))
        met = table.join(F.broadcast(small), same)  # twelve curves of a group, four proposals each
        z = F.least(F.greatest(F.col("k") * (F.col("x") - F.col("x0")), F.lit(-500.0)), F.lit(500.0))
        met = met.withColumn("q", 1 / (1 + F.exp(-z))).withColumn("w", (F.col("b") - F.col("a")) * F.col("q") * (1 - F.col("q")))
        met = met.withColumns({"d0": 1 - F.col("q"), "d1": F.col("q"), "d2": F.col("w") * (F.col("x") - F.col("x0")), "d3": -F.col("w") * F.col("k"), "r": F.col("a") + (F.col("b") - F.col("a")) * F.col("q") + F.element_at("shift", F.col("__level")) - F.col("mean")})
        n, d = F.col("n"), [F.col(f"d{i}") for i in range(4)]
        pairs = [(i, j) for i in range(4) for j in range(i, 4)]
        agg = met.groupBy("g", "t", "u", "__level").agg(
            F.array(*(F.sum(n * d[i] * d[j]) for i, j in pairs)).alias("jj"), F.array(*(F.sum(n * v * F.col("r")) for v in d)).alias("jr"), F.array(*(F.sum(n * v) for v in d)).alias("j"),
            F.sum(n).alias("nn"), F.sum(n * F.col("r")).alias("nr"), F.sum(n * F.col("r") * F.col("r")).alias("rr"),
        )
        out: dict = {}
        for row in agg.collect():
            size = 3 + len(groups[row["g"]]["levels"])
            a, grad, rss = out.setdefault((row["g"], row["t"], row["u"]), [np.zeros((size, size)), np.zeros(size), 0.0])
            for (i, j), v in zip(pairs, row["jj"], strict=True):
                a[i, j] += v
                a[j, i] = a[i, j]
            grad[:4] += row["jr"]
            out[row["g"], row["t"], row["u"]][2] = rss + row["rr"]
            at = 3 + groups[row["g"]]["levels"].index(row["__level"])
            if at > 3:  # the first intercept is the curve's own
                a[at, :4] = a[:4, at] = row["j"]
                a[at, at], grad[at] = row["nn"], row["nr"]
        return out

    state, bounds = {}, []
    for g, row in enumerate(groups):
        extra = len(row["levels"]) - 1
        bounds.append((np.array([-0.5, -0.5, 1e-5, row["first"], *[-1.0] * extra]), np.array([1.5, 1.5, 10.0, max(row["last"], row["first"] + 1e-9), *[1.0] * extra])))
        starts = [(a, b, k, c) for a, b in ((row["lo"], row["hi"]), (row["hi"], row["lo"])) for k in (0.1, 1.0) for c in row["q"]]
        for t, start in enumerate(starts):
            state[g, t] = {"p": np.clip(np.array([*start, *[0.0] * extra]), *bounds[g]), "damp": 1e-2, "done": False}
    for (g, t, _), found in evaluate([(g, t, 0, s["p"]) for (g, t), s in state.items()]).items():
        state[g, t]["at"] = found
    for _ in range(_ROUNDS):
        trials = []
        for (g, t), s in state.items():
            if s["done"]:
                continue
            low, high = bounds[g]
            a, grad, _ = s["at"]
            free = ~(((s["p"] <= low) & (grad > 0)) | ((s["p"] >= high) & (grad < 0)))
            for u, times in enumerate(_DAMPINGS):
                move = np.zeros(len(grad))
                if free.any():
                    m = a[np.ix_(free, free)]
                    move[free] = -np.linalg.lstsq(m + s["damp"] * times * np.diag(np.maximum(np.diag(m), 1e-12)), grad[free], rcond=None)[0]
                trials.append((g, t, u, np.clip(s["p"] + move, low, high)))
        if not trials:
            break
        found = evaluate(trials)
        best: dict = {}
        for g, t, u, p in trials:
            if (g, t) not in best or found[g, t, u][2] < best[g, t][0]:
                best[g, t] = (found[g, t, u][2], u, p)
        for (g, t), (rss, u, p) in best.items():
            s = state[g, t]
            gain = s["at"][2] - rss
            if gain > 0:
                s |= {"p": p, "at": found[g, t, u], "damp": max(s["damp"] * _DAMPINGS[u], 1e-12)}
                s["done"] = gain <= _GAIN * (1 + rss)
            else:
                s["damp"] *= _DAMPINGS[-1] * 4
                s["done"] = s["damp"] > 1e10
    rows = []
    for g, row in enumerate(groups):
        s = min((state[g, t] for t in range(12)), key=lambda s: s["at"][2])
        rows.append((*(row[k] for k in mine), int(row["n"]), *map(float, s["p"][:4]), float(s["at"][2] + row["within"])))
    return spark.createDataFrame(rows, ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in own) + ", n long, low double, high double, k double, x0 double, rss double")


def demeaned(df: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """Columns less their mean within `by`: a model with an intercept for each."""
    w = Window.partitionBy(*keys, by)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def linear_by_dataset(df: DataFrame, keys: list[str], by: str = "dataset", x: str = "x", y: str = "y") -> DataFrame:
    """(keys, n, datasets, b, rss) of one slope and an intercept per dataset."""
    m = demeaned(df, keys, by, [x, y])
    fit = m.groupBy(*keys).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("b"))
    r = F.col(y) - F.col("b") * F.col(x)
    return _with(m, fit, keys).groupBy(*keys).agg(F.count("*").cast("long").alias("n"), F.count_distinct(by).cast("long").alias("datasets"), F.first("b").alias("b"), F.sum(r * r).alias("rss"))


def hinge_by_dataset(df: DataFrame, keys: list[str], by: str = "dataset", x: str = "x", y: str = "y", points: int = GRID) -> DataFrame:
    """(keys, n, bp, b, c, rss): a hinge with an intercept per dataset."""
    return _hinges(_products(df, keys, [by], x, y, points), keys).drop("a")


def information(rss: F.Column, n: F.Column, parameters) -> tuple[F.Column, F.Column]:
    """AIC and BIC of a least-squares fit; the variance counts as a parameter, and an RSS of nothing as 1e-12."""
    k = parameters + 1
    fit = n * F.log(F.when(rss <= 0, F.lit(1e-12)).otherwise(rss) / n)
    return fit + 2 * k, fit + k * F.log(n)


def compare(fits: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One row per group and model: n, rss, aic, bic, and the distances to the group's least."""
    parts = []
    for name, fit in fits.items():
        aic, bic = information(F.col("rss"), F.col("n"), F.lit(PARAMETERS[name]) + (F.col("__more") if "__more" in fit.columns else F.lit(0)))
        parts.append(fit.select(*keys, F.lit(name).alias("model"), "n", "rss", aic.alias("aic"), bic.alias("bic")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return out.withColumns({"delta_aic": F.col("aic") - F.min("aic").over(w), "delta_bic": F.col("bic") - F.min("bic").over(w)})


def compare_by_dataset(df: DataFrame, keys: list[str], by: str = "dataset", x: str = "x", y: str = "y") -> DataFrame:
    """compare() of line, hinge and logistic curve with an intercept for each dataset, each one more parameter than the first."""
    more = df.groupBy(*keys).agg((F.count_distinct(by) - 1).alias("__more"))
    fits = {"linear": linear_by_dataset(df, keys, by, x, y), "hinge": hinge_by_dataset(df, keys, by, x, y), "logistic": logistic(df, keys, x, y, intercepts=by)}
    return compare({name: fit.join(more, keys) for name, fit in fits.items()}, keys).withColumn("model", F.concat("model", F.lit("_ds")))


def model_comparison(df: DataFrame, by: str = "dataset", least: int = 30, without: str | None = None) -> DataFrame:
    """(scope, model, n, rss, aic, bic, delta_aic, delta_bic) of every model in every scope.

    Line, hinge, step and logistic curve over all rows and each dataset that has enough; line, hinge and logistic curve
    with an intercept for each dataset over all, and over all but one, if enough rows of two datasets stay.
    """
    plain = scopes(df, by, least)
    out = compare({"linear": linear(plain, ["scope"]), "hinge": hinge(plain, ["scope"]), "step": step(plain, ["scope"]), "logistic": logistic(plain, ["scope"])}, ["scope"])
    parts = [df.withColumn("scope", F.lit("all_dataset_controlled"))]
    if without is not None:
        rest = df.where(F.col(by) != without).withColumn("scope", F.lit(f"dataset_controlled_excl_{without}"))
        enough = rest.groupBy("scope").agg(F.count("*").alias("n"), F.count_distinct(by).alias("d")).where((F.col("n") >= least) & (F.col("d") >= 2))
        parts.append(rest.join(enough.select("scope"), "scope", "left_semi"))
    controlled = parts[0]
    for p in parts[1:]:
        controlled = controlled.unionByName(p)
    return out.unionByName(compare_by_dataset(controlled, ["scope"], by))


def scopes(df: DataFrame, by: str = "dataset", least: int = 30, without: str | None = None) -> DataFrame:
    """Rows under each scope that they belong to: all, their dataset if it has enough rows, and all but one dataset."""
    n = F.count("*").over(Window.partitionBy(by))
    names = [F.lit("all"), F.when(n >= least, F.col(by))]
    if without:
        names.append(F.when(F.col(by) != without, F.lit(f"without_{without}")))
    return df.withColumn("__scopes", F.array_compact(F.array(*names))).withColumn("scope", F.explode("__scopes")).drop("__scopes")
