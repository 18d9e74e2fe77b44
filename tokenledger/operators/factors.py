"""Factors of a model: columns for their levels, and which of their contrasts the data can tell apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.clusters import connected

#: Levels of a factor that become columns; one with more is absorbed instead (effects.crossed_effects).
MOST_LEVELS = 256


def dummies(df: DataFrame, factor: str) -> tuple[DataFrame, list[str]]:
    """df with a column of 0 and 1 for each level of a factor but the smallest, and the columns' names."""
    levels = [r[0] for r in df.where(F.col(factor).isNotNull()).select(factor).distinct().orderBy(factor).limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"{factor} has more than {MOST_LEVELS} levels")
    columns = {f"{factor}={i}": (F.col(factor) == F.lit(x)).cast("double") for i, x in enumerate(levels[1:], 1)}
    return df.withColumns(columns) if columns else df, list(columns)


def level_graph(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (v, root): levels of two factors, `a:...` and `b:...`, with the smallest level that shared rows connect them to."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.concat(F.lit("a:"), F.col(a).cast("string")).alias("a"), F.concat(F.lit("b:"), F.col(b).cast("string")).alias("b"))
    return connected(pairs.distinct())


def identifiability(df: DataFrame, a: str, b: str) -> dict:
    """Levels of two factors, components of the graph in which shared rows connect them, and contrasts that can't be estimated.

    Effects of levels in different components can't be compared: each component beyond the first loses one contrast.
    Rows with a null level are left out; without rows there are no components, and nothing is identified.
    """
    r = level_graph(df, a, b).agg(F.count_if(F.col("v").startswith("a:")).alias("a"), F.count_if(F.col("v").startswith("b:")).alias("b"), F.count_if(F.col("v") == F.col("root")).alias("c")).first()
    return {"levels_a": r["a"], "levels_b": r["b"], "components": r["c"], "lost": max(0, r["c"] - 1), "identified": r["c"] == 1}
