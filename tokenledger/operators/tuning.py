"""A ridge penalty chosen inside the training part, from one pass of sums per fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.models import grams
from tokenledger.operators.splits import unit_hash, with_holdout

#: Penalties in units of the features' variances.
PATH = (0.0, 0.001, 0.01, 0.1, 1.0, 10.0)


def fold_of(key: Column, seed: int, folds: int) -> Column:
    """A fold from 0 by the key's hash, which no other row changes."""
    return F.floor(unit_hash(key, seed) * folds).cast("long")


def tuned_ridge(df: DataFrame, features: list[str], target: str, key: str, split_seed: int, fold_seed: int, folds: int = 5, path: tuple[float, ...] = PATH) -> list[dict]:
    """Rows (penalty, error, slopes, chosen): the mean squared error out of fold, and the line fitted to the whole training part.

    Held-out rows (splits.with_holdout) are filtered off before anything is summed. One pass gives a Gram for each fold;
    a fold's training rows are the sum of the other folds' Grams, and its error under a line follows from its own. The
    penalty with the least error is chosen, the larger one of equals. Folds without rows count for nothing.
    """
    train = with_holdout(df, key, split_seed).where(~F.col("held_out"))
    per = grams(train.withColumn("fold_", fold_of(F.col(key), fold_seed, folds)), [*features, target], "fold_")
    if len(per) < 2:
        raise ValueError("fewer than two folds have rows")
    whole = sum(list(per.values())[1:], next(iter(per.values())))
    out = []
    for penalty in path:
        lost = 0.0
        for fold, own in per.items():
            others = [g for f, g in per.items() if f != fold]
            lost += own.errors(sum(others[1:], others[0]).line(penalty)[0])
        out.append({"penalty": float(penalty), "error": lost / whole.n, "slopes": [float(b) for b in whole.line(penalty)[0]]})
    best = min(out, key=lambda r: (r["error"], -r["penalty"]))
    return [{**r, "chosen": r is best} for r in out]
