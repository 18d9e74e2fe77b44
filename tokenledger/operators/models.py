"""Regressions from one pass of sufficient statistics; the driver solves systems as large as the feature set."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut
from tokenledger.operators.factors import dummies, identifiability

#: Limits of variance inflation, quantiles, and groups that a random intercept needs.
WARNING, SEVERE = 5.0, 10.0
QUANTILES = {"reference": 0.50, "upper_tail": 0.90, "sensitivity": 0.95}
LEAST_GROUPS = 10


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def _of(columns: list[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in columns]


class Gram(NamedTuple):
    """Rows, means, and sums of products of deviations from the means; two of them add up to that of both parts."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Gram(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def line(self, penalty: float = 0.0) -> tuple[np.ndarray, float]:
        """(intercept and slopes, residual sum of squares) of the last column on the others, `penalty` times their variances added."""
        xx, xy = self.products[:-1, :-1], self.products[:-1, -1]
        slopes = np.linalg.lstsq(xx + penalty * np.diag(np.diag(xx)), xy, rcond=None)[0] if len(xy) else np.empty(0)
        return np.concatenate([[self.mean[-1] - slopes @ self.mean[:-1]], slopes]), float(self.products[-1, -1] - 2 * slopes @ xy + slopes @ xx @ slopes)

    def errors(self, beta: np.ndarray) -> float:
        """Sum of squared residuals of a line on these rows."""
        away = self.mean[-1] - beta[0] - beta[1:] @ self.mean[:-1]
        slopes = np.append(-beta[1:], 1.0)
        return float(slopes @ self.products @ slopes + self.n * away * away)


def _parts(columns: list[Column]) -> list[Column]:
    """Aggregates of a Gram: one pass, and stable where means are large against deviations."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[(F.covar_pop(columns[i], columns[j]) * F.count("*")).alias(f"s{i}_{j}") for i, j in pairs]]


def _gram(row, k: int, first: int = 0) -> Gram:
    square = [[float(row[f"s{min(i, j)}_{max(i, j)}"] or 0) for j in range(first, k)] for i in range(first, k)]
    return Gram(float(row["n"] or 0), np.array([float(row[f"m{i}"] or 0) for i in range(first, k)]), np.array(square).reshape(k - first, k - first))


def gram(df: DataFrame, columns: list[str]) -> Gram:
    """The Gram of all rows without a null in these columns."""
    return _gram(_complete(df, columns).agg(*_parts(_of(columns))).first(), len(columns))


def grams(df: DataFrame, columns: list[str], by: str) -> dict:
    """The same for each value of `by` (folds and the like: the driver holds one row for each)."""
    return {r[by]: _gram(r, len(columns)) for r in _complete(df, [*columns, by]).groupBy(by).agg(*_parts(_of(columns))).collect()}


def weighted_gram(df: DataFrame, columns: list[str], weight: Column, center: np.ndarray) -> Gram:
    """The Gram of weighted rows, summed as deviations from `center`, which should be near the means."""
    shifted = [c - F.lit(float(m)) for c, m in zip(_of(columns), center, strict=True)]
    k = len(columns)
    sums = [F.sum(weight).alias("n"), *[F.sum(weight * c).alias(f"m{i}") for i, c in enumerate(shifted)]]
    sums += [F.sum(weight * shifted[i] * shifted[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    raw = _gram(df.agg(*sums).first(), k)
    mean = raw.mean / raw.n if raw.n else raw.mean
    return Gram(raw.n, center + mean, raw.products - np.outer(mean, mean) * raw.n)


def within_gram(df: DataFrame, columns: list[str], group: str) -> tuple[Gram, int]:
    """(products of deviations from the group's means, groups): fixed effects. One aggregate per group, then one over groups."""
    k = len(columns)
    per = _complete(df, [*columns, group]).groupBy(group).agg(*_parts(_of(columns)))
    sums = [F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    r = per.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), *[F.lit(0.0).alias(f"m{i}") for i in range(k)], *sums).first()
    return _gram(r, k), r["groups"]


def _fit(g: Gram) -> dict:
    beta, rss = g.line()
    total = float(g.products[-1, -1])
    return {"beta": beta, "rss": rss, "r2": 1 - rss / total if total > 0 else float("nan"), "n": int(g.n)}


def _some(g: Gram, k: int) -> Gram:
    """The Gram of the first k columns and the last."""
    pick = [*range(k), len(g.mean) - 1]
    return Gram(g.n, g.mean[pick], g.products[np.ix_(pick, pick)])


def least_squares(df: DataFrame, features: list[str], target: str) -> dict:
    return _fit(gram(df, [*features, target]))


def fixed_effects(df: DataFrame, features: list[str], target: str, group: str) -> dict:
    """Least squares with an intercept for each group; r2 is that of the deviations from the groups' means."""
    g, groups = within_gram(df, [*features, target], group)
    fit = _fit(g)
    return {**fit, "beta": fit["beta"][1:], "groups": groups}


def nested_models(df: DataFrame, blocks: dict[str, list[str]], target: str, group: str) -> list[dict]:
    """One row for each model (M0, M1, ...), each with its block's features and all those before it, on the rows that all of them can use.

    One pass: the Gram of the last model holds those of the others.
    """
    every = [f for own in blocks.values() for f in own]
    g, groups = within_gram(df, [*every, target], group)
    out, used, before = [], 0, None
    for name, own in blocks.items():
        used += len(own)
        fit = _fit(_some(g, used))
        left = fit["n"] - groups - used
        gain = fit["r2"] - before["r2"] if before else None
        f = (before["rss"] - fit["rss"]) / len(own) / (fit["rss"] / left) if before and left > 0 and fit["rss"] > 0 else None
        out.append({"model": name, "features": used, "n": fit["n"], "groups": groups, "r2": fit["r2"], "delta_r2": gain, "f": f, "p_value": f_tail(f, len(own), left) if f is not None else None})
        before = fit
    return out


def block_increment(df: DataFrame, small: list[str], large: list[str], target: str) -> dict:
    """Gain of the larger feature set (the smaller one and more) on the rows that it can use: difference of R2, F and its tail. One pass."""
    more = [f for f in large if f not in small]
    g = gram(df, [*small, *more, target])
    a, b = _fit(_some(g, len(small))), _fit(g)
    left = b["n"] - len(large) - 1
    f = (a["rss"] - b["rss"]) / len(more) / (b["rss"] / left)
    return {"delta_r2": b["r2"] - a["r2"], "f": f, "p_value": f_tail(f, len(more), left), "n": b["n"]}


def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f), by the continued fraction of the incomplete beta function."""
    if f <= 0:
        return 1.0
    return _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def inflation(df: DataFrame, features: list[str]) -> list[dict]:
    """Rows (feature, vif, warning, severe): the diagonal of the inverse correlation matrix. Nothing is dropped for it."""
    cov = gram(df, features).products
    spread = np.sqrt(np.diag(cov))
    values = np.diag(np.linalg.pinv(cov / np.outer(spread, spread)))
    return [{"feature": f, "vif": float(v), "warning": bool(v > WARNING), "severe": bool(v > SEVERE)} for f, v in zip(features, values, strict=True)]


def _line(fit: dict, features: list[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(f) for b, f in zip(fit["beta"][1:], features, strict=True)), F.lit(float(fit["beta"][0])))


def reweighted(df: DataFrame, features: list[str], target: str, weights: Callable[[Column, DataFrame], Column], rounds: int = 25, tolerance: float = 1e-8) -> dict:
    """Iterated weighted least squares on rows that are written once; each round is one aggregate over them (two, if the weights need a scale)."""
    columns = [*features, target]
    rows = cut(_complete(df, columns).select(*[F.col(c).cast("double").alias(c) for c in columns]))
    start = gram(rows, columns)
    fit = _fit(start)
    for step in range(rounds):
        new = _fit(weighted_gram(rows, columns, weights(F.col(target) - _line(fit, features), rows), start.mean))
        new["n"] = fit["n"]
        moved = float(np.abs(new["beta"] - fit["beta"]).max())
        fit = new
        if moved < tolerance:
            return {**fit, "converged": True, "rounds": step + 1}
    return {**fit, "converged": False, "rounds": rounds}


def huber(df: DataFrame, features: list[str], target: str, delta: float = 1.345, tolerance: float = 1e-6) -> dict:
    """Huber regression; delta counts in units of the residuals' spread (median absolute residual / 0.6745)."""

    def weights(residual: Column, rows: DataFrame) -> Column:
        middle = rows.agg(F.percentile_approx(F.abs(residual), 0.5, 100_000).alias("m")).first()["m"] or 0.0
        limit = delta * max(middle / 0.6745, 1e-12)
        return F.least(F.lit(1.0), limit / F.greatest(F.abs(residual), F.lit(1e-12)))

    return reweighted(df, features, target, weights, rounds=50, tolerance=tolerance)


def _length(pairs: list[tuple[Column, Column]]) -> Column:
    """The longest step (at most 1) along which no value reaches 0: pairs of values and directions."""
    return F.min(F.least(*[F.when(d < 0, -v / d).otherwise(F.lit(1e20)) for v, d in pairs], F.lit(1e20)))


def quantile_regression(df: DataFrame, features: list[str], target: str, q: float, tolerance: float = 1e-8, rounds: int = 60) -> dict:
    """The line below which a share q of the target lies, by interior-point steps (predictor and corrector) on the linear program.

    Every row has a place x in (0, 1), 1 above the line and 0 below it in the end, and slacks z and w; their table is written
    once a round. A round takes two systems of weighted sums as large as the feature set, from three aggregates. loss is the
    sum of check losses, gap a bound a row on what another line could save: the loss less the value of the dual
    program at the places found. It converged if the gap came under a millionth of the target's spread.
    """
    columns = [*features, target]
    g = gram(df, columns)
    if not g.n:
        return {"beta": np.full(len(columns), np.nan), "loss": 0.0, "gap": float("nan"), "n": 0, "converged": False, "rounds": 0}
    spread = np.sqrt(np.maximum(np.diag(g.products) / g.n, 0))
    spread[spread == 0] = 1.0
    k = len(columns)
    # features and target in units of their spread, about their means
    unit = [((c - F.lit(float(m))) / F.lit(float(d))).alias(f"x{i + 1}") for i, (c, m, d) in enumerate(zip(_of(columns), g.mean, spread, strict=True))]
    rows = _complete(df, columns).select(F.lit(1.0).alias("x0"), *unit).withColumnRenamed(f"x{k}", "y")
    names = [f"x{i}" for i in range(k)]
    xs = [F.col(c) for c in names]
    line = lambda b: sum((F.lit(float(v)) * c for v, c in zip(b, xs, strict=True)), F.lit(0.0))
    slopes = _fit(Gram(g.n, np.zeros(k), g.products / np.outer(spread, spread)))["beta"]
    dual = -np.append(0.0, slopes[1:])
    left = -F.col("y") - line(dual)
    left = F.when(F.abs(left) < 1e-3, 1e-3).otherwise(left)
    state = cut(rows.withColumns({"x": F.lit(1 - q), "z": F.greatest(left, F.lit(0.0)), "w": F.greatest(-left, F.lit(0.0))}).withColumns({"z": F.col("z") + 1e-3, "w": F.col("w") + 1e-3}))
    x, z, w = F.col("x"), F.col("z"), F.col("w")
    step = 0
    for step in range(1, rounds + 1):
        now = state.withColumn("s", 1 - x).withColumn("q", 1 / (z / x + w / F.col("s"))).withColumn("r", -F.col("y") - line(dual))
        s, weight, r = F.col("s"), F.col("q"), F.col("r")
        first = now.agg(F.sum(z * x + w * s).alias("gap"), *[F.sum(weight * r * c).alias(f"v{i}") for i, c in enumerate(xs)], *[F.sum(weight * xs[i] * xs[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        if first["gap"] / g.n < tolerance:
            break
        normal = np.array([[first[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        right = np.array([first[f"v{i}"] for i in range(k)])
        move = np.linalg.lstsq(normal, right, rcond=None)[0]
        # predictor: where the slacks would go
        ahead = now.withColumn("dx", weight * (line(move) - r)).withColumns({"dz": -z * (1 + F.col("dx") / x), "dw": -w * (1 - F.col("dx") / s)})
        dx, dz, dw = F.col("dx"), F.col("dz"), F.col("dw")
        mixed = [F.sum(v).alias(n) for n, v in {"a": z * x + w * s, "b": z * dx - w * dx, "c": dz * x + dw * s, "d": dz * dx - dw * dx}.items()]
        turn = [F.sum(weight * (dx * dz + dx * dw) * c).alias(f"t{i}") for i, c in enumerate(xs)] + [F.sum(weight * (1 / x - 1 / s) * c).alias(f"i{i}") for i, c in enumerate(xs)]
        second = ahead.agg(_length([(x, dx), (s, -dx)]).alias("p"), _length([(z, dz), (w, dw)]).alias("u"), *mixed, *turn).first()
        p, u = min(1.0, 0.99995 * second["p"]), min(1.0, 0.99995 * second["u"])
        rest = second["a"] + p * second["b"] + u * second["c"] + p * u * second["d"]
        middle = second["a"] * (rest / second["a"]) ** 3 / (2 * g.n)
        move = np.linalg.lstsq(normal, right + np.array([second[f"t{i}"] - middle * second[f"i{i}"] for i in range(k)]), rcond=None)[0]
        # corrector: towards the middle, second-order terms of the predictor taken off
        pull = F.lit(float(middle))
        bent = ahead.withColumn("ex", weight * (line(move) + pull * (1 / x - 1 / s) - r - dx * dz - dx * dw))
        ex = F.col("ex")
        bent = bent.withColumns({"ez": pull / x - z - z / x * ex - dx * dz, "ew": pull / s - w + w / s * ex + dx * dw})
        third = bent.agg(_length([(x, ex), (s, -ex)]).alias("p"), _length([(z, F.col("ez")), (w, F.col("ew"))]).alias("u")).first()
        p, u = min(1.0, 0.99995 * third["p"]), min(1.0, 0.99995 * third["u"])
        state = cut(bent.select(*names, "y", (x + p * ex).alias("x"), (z + u * F.col("ez")).alias("z"), (w + u * F.col("ew")).alias("w")))
        dual = dual + u * move
    residual = F.col("y") + line(dual)
    r = state.agg(F.sum(F.when(residual >= 0, q * residual).otherwise((q - 1) * residual)).alias("loss"), F.sum(F.col("y") * (x - (1 - q))).alias("dual")).first()
    beta = -dual[1:] * spread[-1] / spread[:-1]
    gap = (r["loss"] - r["dual"]) / g.n
    return {
        "beta": np.append(g.mean[-1] - dual[0] * spread[-1] - beta @ g.mean[:-1], beta), "loss": float(r["loss"] * spread[-1]), "gap": float(gap * spread[-1]), "n": int(g.n), "converged": bool(abs(gap) < 1e-6), "rounds": step,
    }


def random_intercept(df: DataFrame, features: list[str], target: str, group: str, fixed: tuple[str, ...] = ()) -> dict:
    """Linear model with a normal intercept for each group, by maximum likelihood over the groups' sums; factors in `fixed` have an effect for each level.

    The driver holds one row of sums for each group (sources, not documents) and searches the ratio of the two
    variances. `usable` needs LEAST_GROUPS groups, an identified model (features that don't depend on each other, and
    groups that every fixed factor's levels connect), a search that converged, and a ratio that isn't at the border.
    """
    rows = _complete(df, [*features, target, group, *fixed])
    connected = all(identifiability(rows, group, f)["identified"] for f in fixed)
    for f in fixed:
        rows, names = dummies(rows, f)
        features = [*features, *names]
    columns = [*features, target]
    k = len(columns) + 1
    found = rows.groupBy(group).agg(*_parts(_of(columns))).collect()
    per = [_gram(r, k - 1) for r in found]
    whole = sum(per[1:], per[0]) if per else Gram(0, np.zeros(k - 1), np.zeros((k - 1, k - 1)))
    sizes = np.array([g.n for g in per])
    # sums of products of each group about the means of all, a one first
    full = np.zeros((len(per), k, k))
    for i, g in enumerate(per):
        away = np.append(1.0, g.mean - whole.mean)
        full[i] = np.outer(away, away) * g.n
        full[i, 1:, 1:] += g.products
    n = whole.n
    scale = np.sqrt(np.maximum(np.diag(whole.products)[:-1], 1e-300))
    identified = connected and (not len(scale) or np.linalg.matrix_rank(whole.products[:-1, :-1] / np.outer(scale, scale), tol=1e-10) == len(scale))

    def solve(ratio: float) -> tuple[float, np.ndarray, float]:
        shrink = ratio / (1 + ratio * sizes)
        sums = full.sum(0) - np.einsum("g,gi,gj->ij", shrink, full[:, 0], full[:, 0])
        beta = np.linalg.lstsq(sums[:-1, :-1], sums[:-1, -1], rcond=None)[0]
        noise = max((sums[-1, -1] - beta @ sums[:-1, -1]) / n, 1e-300)
        return -0.5 * (n * math.log(2 * math.pi * noise) + np.log1p(ratio * sizes).sum() + n), beta, noise

    low, high, golden = -14.0, 8.0, (math.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb = solve(math.exp(a))[0], solve(math.exp(b))[0]
    for _ in range(200):
        if high - low < 1e-8:
            break
        if fa >= fb:
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = solve(math.exp(a))[0]
        else:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = solve(math.exp(b))[0]
    ratio = math.exp((low + high) / 2)
    value, beta, noise = solve(ratio)
    plain = solve(0.0)
    converged, singular = high - low < 1e-6, plain[0] >= value - 1e-9
    if singular:
        value, beta, noise, ratio = *plain, 0.0
    beta = np.append(whole.mean[-1] + beta[0] - beta[1:] @ whole.mean[:-1], beta[1:])
    return {
        "beta": beta, "residual_variance": float(noise), "group_variance": float(ratio * noise), "log_likelihood": float(value), "n": int(n), "groups": len(per),
        "converged": bool(converged), "singular": bool(singular), "identified": bool(identified),
        "usable": bool(len(per) >= LEAST_GROUPS and identified and converged and not singular),
    }
