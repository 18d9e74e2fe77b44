"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in OFTEN of all rows is often (so there are fewer than OFTEN of them); its rows are dealt to SALTS parts.
OFTEN, SALTS = 5_000, 64


def dealt_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, by: list[str], total: int | None = None) -> DataFrame:
    """rows joined with facts, which has one row for each key and its number of rows in `n` (`total` in all, summed if not given).

    The rows of an often key are dealt by a hash of the columns `by`, each part with its own copy of the fact; other
    keys meet as usual. Columns of both sides must differ but for the keys, which must not be null.
    """
    if total is None:
        total = facts.agg(F.sum(n)).first()[0] or 0
    often = F.broadcast(facts.where(F.col(n) * OFTEN > F.lit(total)).select(*keys, F.lit(True).alias("often_")))  # fewer than OFTEN rows
    part = F.when(F.col("often_"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0)
    left = rows.join(often, keys, "left").withColumn("part_", part).drop("often_")
    copies = F.when(F.col(n) * OFTEN > F.lit(total), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.join(facts.withColumn("part_", F.explode(copies)), [*keys, "part_"]).drop("part_")
