"""Inference on DataFrames: rank and sign tests, bootstrap, false discovery rate, empirical distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.draws import drawn_medians
from tokenledger.operators.ranks import falling, running
from tokenledger.operators.resampling import poisson_medians


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: Column) -> Column:
    """P(a standard normal lies farther from 0 than z), without leaving the JVM: by Horner's scheme near 0, by the continued fraction beyond."""
    x = F.abs(z) / F.lit(math.sqrt(2))
    steps = F.array(*[F.lit(float(k)) for k in range(60, 0, -1)])
    near = F.aggregate(steps, F.lit(1.0), lambda s, k: 1.0 + 2.0 * x * x / (2.0 * k + 1.0) * s)
    far = F.aggregate(steps, F.lit(0.0), lambda t, k: k / 2.0 / (x + t))
    scale = F.exp(-x * x) / F.lit(math.sqrt(math.pi))
    return F.when(x < 2, 1.0 - 2.0 * scale * x * near).otherwise(scale / (x + far))


def signed_rank(df: DataFrame, value: str) -> DataFrame:
    """One row: n (zeros left out), w_plus, z by the normal approximation with tie correction.

    Mid-ranks come from counts per distinct magnitude and running counts over those, so rows aren't ordered.
    """
    sizes = df.where(F.col(value) != 0).groupBy(F.abs(value).alias("m")).agg(F.count("*").alias("t"), F.sum((F.col(value) > 0).cast("long")).alias("p"))
    ranked = running(sizes, ["m"], F.col("t"), "upto").withColumn("mid", F.col("upto") - (F.col("t") - 1) / 2.0)
    out = ranked.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum(F.col("p") * F.col("mid")).alias("w_plus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.select("n", "w_plus", F.when(spread > 0, (F.col("w_plus") - n * (n + 1) / 4) / spread).alias("z"))


def sign_counts(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count_if(F.col(value) > 0).alias("n_plus"), F.count_if(F.col(value) < 0).alias("n_minus"), F.count_if(F.col(value) == 0).alias("n_zero"))


def sign_tail(plus: int, minus: int) -> float:
    """P(at least `plus` successes of plus + minus at one half)."""
    n = plus + minus
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(plus, n + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs)) if n else 1.0


def location_tests(df: DataFrame, value: str) -> list[dict]:
    """Signed-rank and sign test of a median over 0, as rows for the driver: test, n, statistic, one-sided p."""
    rank, signs = signed_rank(df, value).first(), sign_counts(df, value).first()
    return [
        {"test": "signed_rank", "n": rank["n"], "statistic": rank["w_plus"] or 0.0, "p_value": normal_tail(rank["z"]) if rank["z"] is not None else 1.0},
        {"test": "sign", "n": signs["n_plus"] + signs["n_minus"], "statistic": float(signs["n_plus"]), "p_value": sign_tail(signs["n_plus"], signs["n_minus"])},
    ]


def bootstrap_medians(df: DataFrame, value: str, key: str, resamples: int, seed: int) -> DataFrame:
    """Rows (resample, median): draws are MD5 of seed, resample and draw, modulo n. Makes n * resamples draws, of which only counts are kept (draws.drawn_medians)."""
    return drawn_medians(df, value, key, resamples, seed)


def bootstrap_interval(df: DataFrame, value: str, key: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """One row (low, high): the percentile interval of the resamples' medians, each of n draws."""
    return _interval(bootstrap_medians(df, value, key, resamples, seed), level)


def poisson_interval(df: DataFrame, value: str, key: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """The same from Poisson weights (resampling.poisson_medians), for tables of any size: what is shuffled doesn't grow with the rows of a task."""
    return _interval(poisson_medians(df, value, key, resamples, seed), level)


def _interval(medians: DataFrame, level: float) -> DataFrame:
    ends = [(1 - level) / 2, (1 + level) / 2]
    found = F.percentile("median", F.array(*[F.lit(x) for x in ends]))  # one row a resample
    return medians.agg(found.alias("x")).select(F.get("x", F.lit(0)).alias("low"), F.get("x", F.lit(1)).alias("high"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, alpha: float = 0.05, family: str | None = None) -> DataFrame:
    """Adds rank, q and rejected (q of at most alpha) within each family of secondary hypotheses. q is the running minimum, from the largest p, of p * m / rank.

    Rows with a null p are no hypotheses and are left out; a null family is one. Families may be many and of any size:
    no task holds a whole one. Keys must be unique within a family.
    """
    by = [family] if family else ["family_"]
    rows = df.where(F.col(p).isNotNull())
    rows = rows if family else rows.withColumn("family_", F.lit(0))
    out = falling(rows, by, [p, key], F.least(F.lit(1.0), F.col(p) * F.col("size_") / F.col("rank")), "rank", "size_", "q")
    return out.drop("size_", "family_").withColumn("rejected", F.col("q") <= alpha)


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Rows (value, n, share at or below), one per distinct value; running sums over distinct values only."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    ranked = running(counts, [value], F.col("n"), "upto")
    return ranked.select(value, "n", (F.col("upto") / F.lit(df.count())).alias("share"))
