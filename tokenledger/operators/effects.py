"""Crossed factors absorbed by alternating projections, errors that hold within clusters, and tests of interactions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut
from tokenledger.operators.factors import identifiability
from tokenledger.operators.models import _complete, _fit, _of, _parts, Gram, gram
from tokenledger.operators.stats import normal_tail, two_sided

#: Sweeps over all factors between two looks at the moments, looks at most, and the relative change at which they are settled.
SWEEPS, LOOKS, SETTLED = 4, 100, 1e-11


def absorbed(df: DataFrame, columns: list[str], factors: list[str], looks: int = LOOKS) -> tuple[Gram, bool, int]:
    """(Gram of the columns less the effects of all factors, whether it settled, sweeps).

    One pass over the rows gives a row for each cell, a combination of levels that occurs: its number of rows, means
    and products of deviations. Projections change a cell's means alone, so rounds run over cells: a factor's effects are
    the weighted means, by level, of what the other factors' effects leave; factor follows factor until the moments of what all
    of them leave settle.
    """
    k = len(columns)
    cells = _complete(df, [*columns, *factors]).groupBy(*factors).agg(*_parts(_of(columns)))
    cells = cut(cells)
    inner = cells.agg(F.sum("n").alias("n"), *[F.lit(0.0).alias(f"m{i}") for i in range(k)], *[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    n = float(inner["n"] or 0)
    within = np.array([[float(inner[f"s{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]).reshape(k, k)
    # of very large means only what differs between cells counts
    whole = cells.agg(*[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(k)]).first()
    cells = cut(cells.select(*factors, "n", *[(F.col(f"m{i}") - F.lit(float(whole[f"m{i}"] or 0))).alias(f"m{i}") for i in range(k)]))
    levels: dict[str, DataFrame] = {}

    def left(but: str | None = None) -> DataFrame:
        """Cells less the effects of all factors but one."""
        out = cells
        for factor in factors:
            if factor != but and factor in levels:
                out = out.join(levels[factor], factor).select(*factors, "n", *[(F.col(f"m{i}") - F.col(f"a{i}")).alias(f"m{i}") for i in range(k)])
        return out

    before = None
    for look in range(looks):
        for sweep in range(SWEEPS):
            for factor in factors:
                means = left(factor).groupBy(factor).agg(*[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"a{i}") for i in range(k)])
                # of two factors each one's effects are read once a sweep, so that a look is one chain
                levels[factor] = cut(means) if len(factors) > 2 or sweep == SWEEPS - 1 else means
        r = left().agg(*[F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        products = within + np.array([[float(r[f"s{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]).reshape(k, k)
        scale = np.sqrt(np.maximum(np.diag(products), 1e-300))
        if before is not None and (np.abs(products - before) <= SETTLED * np.outer(scale, scale)).all():
            return Gram(n, np.zeros(k), products), True, (look + 1) * SWEEPS
        before = products
    return Gram(n, np.zeros(k), before), False, looks * SWEEPS


def crossed_effects(df: DataFrame, features: list[str], target: str, factors: list[str]) -> dict:
    """Least squares with an effect for every level of every factor, none of which becomes a column.

    beta and errors are those of the features; r2 is of what the factors leave; lost counts contrasts of levels that
    can't be estimated (of two factors; with more of them, of neighbours in the list), which the degrees of freedom
    get back.
    """
    rows = _complete(df, [*features, target, *factors])
    g, settled, sweeps = absorbed(rows, [*features, target], factors)
    graphs = [identifiability(rows, a, b) for a, b in zip(factors, factors[1:], strict=False)]
    levels = graphs[0]["levels_a"] + sum(x["levels_b"] for x in graphs) if graphs else rows.select(factors[0]).distinct().count()
    lost = sum(x["lost"] for x in graphs)
    left = int(g.n) - (levels - len(graphs) - lost) - len(features)
    fit = _fit(g)
    cov = np.linalg.pinv(g.products[:-1, :-1]) * (fit["rss"] / left if left > 0 else float("nan"))
    return {**fit, "beta": fit["beta"][1:], "errors": np.sqrt(np.diag(cov)), "levels": levels, "lost": lost, "left": left, "settled": settled, "sweeps": sweeps}


def cluster_covariance(df: DataFrame, features: list[str], target: str, cluster: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(intercept and slopes, their covariance, clusters): a sandwich of the scores that each cluster's rows add up to.

    Two passes: the Gram, then sums per cluster and their products. Rows of a cluster may depend on each other in any way.
    """
    rows = _complete(df, [*features, target, cluster])
    g = gram(rows, [*features, target])
    beta = g.line()[0]
    x = [F.lit(1.0), *[c - F.lit(float(m)) for c, m in zip(_of(features), g.mean, strict=False)]]
    y = F.col(target).cast("double") - F.lit(float(g.mean[-1]))
    residual = y - sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(0.0))
    k = len(x)
    scores = rows.groupBy(cluster).agg(*[F.sum(c * residual).alias(f"u{i}") for i, c in enumerate(x)])
    r = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[float(r[f"s{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)])
    bread = np.zeros((k, k))
    bread[0, 0] = 1 / g.n if g.n else 0
    bread[1:, 1:] = np.linalg.pinv(g.products[:-1, :-1])
    cov = bread @ meat @ bread * (r["g"] / (r["g"] - 1) if r["g"] > 1 else float("nan"))
    # about the means the intercept is the mean of the target; back to the intercept at zero
    move = np.eye(k)
    move[0, 1:] = -g.mean[:-1]
    return beta, move @ cov @ move.T, r["g"]


def coefficients(df: DataFrame, features: list[str], target: str, cluster: str, width: float = 1.959963984540054) -> list[dict]:
    """Rows (feature, coefficient, std_error, low, high, z, p_value), errors clustered."""
    beta, cov, _ = cluster_covariance(df, features, target, cluster)
    out = []
    for name, b, e in zip(["intercept", *features], beta, np.sqrt(np.maximum(np.diag(cov), 0)), strict=True):
        z = float(b / e) if e > 0 else None
        out.append({"feature": name, "coefficient": float(b), "std_error": float(e), "low": float(b - width * e), "high": float(b + width * e), "z": z, "p_value": 2 * normal_tail(abs(z)) if z is not None else None})
    return out


def wald(beta: np.ndarray, cov: np.ndarray, contrasts: np.ndarray) -> tuple[float, int]:
    """(statistic, degrees of freedom) of all contrasts being zero at once."""
    gap, spread = contrasts @ beta, contrasts @ cov @ contrasts.T
    return float(gap @ np.linalg.pinv(spread) @ gap), int(np.linalg.matrix_rank(spread))


def interaction_tests(df: DataFrame, value: str, a: str, b: str, cluster: str) -> DataFrame:
    """Rows (a, b, n, contrast, std_error, wald, p_value): whether a cell of two factors has more than both of its levels explain.

    The contrast of cell (i, j) is mean(i, j) - mean(i, first b) - mean(first a, j) + mean(first a, first b), with the
    smallest levels as the first ones. Its variance comes from the scores of clusters: what a cluster's rows add to the
    four means. Cells that lack one of the four have no contrast and are left out, as are rows with a null. Scores are one row
    for each cluster and cell; contrasts one for each cell.
    """
    rows = _complete(df, [value, a, b, cluster]).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(cluster).alias("c"), F.col(value).cast("double").alias("v"))
    per = cut(rows.groupBy("c", "a", "b").agg(F.count("*").alias("n"), F.avg("v").alias("m")))
    cells = cut(per.groupBy("a", "b").agg(F.sum("n").alias("cell_n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("cell_m")))
    scores = per.join(cells, ["a", "b"]).select("c", "a", "b", (F.col("n") * (F.col("m") - F.col("cell_m")) / F.col("cell_n")).alias("s"))
    clusters = per.select("c").distinct().count()
    first = cells.agg(F.min("a").alias("a0"), F.min("b").alias("b0"))
    own = cells.select("a", "b", "cell_n").join(F.broadcast(first)).where("a <> a0 AND b <> b0")  # one row
    corners = [F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(w).alias("w")) for x, y, w in (("a", "b", 1.0), ("a", "b0", -1.0), ("a0", "b", -1.0), ("a0", "b0", 1.0))]
    weights = own.select("a", "b", "cell_n", F.explode(F.array(*corners)).alias("k")).select(F.col("a").alias("i"), F.col("b").alias("j"), "cell_n", F.col("k.x").alias("a"), F.col("k.y").alias("b"), F.col("k.w").alias("w"))
    contrast = weights.join(cells.select("a", "b", "cell_m"), ["a", "b"]).groupBy("i", "j", "cell_n").agg(F.sum(F.col("w") * F.col("cell_m")).alias("contrast"), F.count("*").alias("corners")).where("corners = 4")
    pulls = weights.join(scores, ["a", "b"]).groupBy("i", "j", "c").agg(F.sum(F.col("w") * F.col("s")).alias("u"))
    spread = pulls.groupBy("i", "j").agg((F.sum(F.col("u") * F.col("u")) * F.lit(clusters / (clusters - 1) if clusters > 1 else float("nan"))).alias("var"))
    z: Column = F.col("contrast") / F.sqrt("var")
    out = contrast.join(spread, ["i", "j"]).where("var > 0")
    return out.select(F.col("i").alias(a), F.col("j").alias(b), F.col("cell_n").alias("n"), "contrast", F.sqrt("var").alias("std_error"), (z * z).alias("wald"), two_sided(z).alias("p_value"))


def chi_square_tail(x: float, d: int) -> float:
    """P(chi-square of d degrees of freedom > x), by the series or the continued fraction of the incomplete gamma function."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 10_000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d_ = 1e300, 1 / b
    out = d_
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d_ = 1 / (step * d_ + b)
        c = b + step / c
        out *= c * d_
        if abs(c * d_ - 1) < 1e-15:
            break
    return front * out
