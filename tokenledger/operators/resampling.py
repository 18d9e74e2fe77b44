"""Bootstrap by Poisson weights: one row is drawn as often in a resample as a hash of both says."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut

#: Fixed values of the hash: a prime under 2**31, and three multipliers.
PRIME, MIX = 2_147_483_647, (1_103_515_245, 48_271, 69_621)
#: Where a hash stands for one draw more: the prime times the Poisson(1) distribution function.
STEPS = [int(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Parts of the interval that holds the medians.
PARTS = 128


def _fifth(rows: DataFrame, name: str) -> DataFrame:
    """`name` to the fifth power modulo PRIME, which maps the remainders one to one."""
    x, y = F.col(name), F.col("y_")
    return rows.withColumn("y_", x * x % PRIME).withColumn("y_", y * y % PRIME).withColumn(name, y * x % PRIME).drop("y_")


def weighted(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """A row for each of rows (k, ...) and resample that draws it: adds resample and w, how often. k is a number under PRIME."""
    out = rows.withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    out = _fifth(out.withColumn("h_", (F.col("k") + F.col("resample") * MIX[0] + F.lit(seed % PRIME)) % PRIME), "h_")
    out = _fifth(out.withColumn("h_", (F.col("h_") + F.col("k") * MIX[1] + F.col("resample") * MIX[2]) % PRIME), "h_")
    return out.withColumn("w", sum((F.when(F.col("h_") >= s, 1).otherwise(0) for s in STEPS), F.lit(0))).where("w > 0").drop("h_")


def key_number(key: Column) -> Column:
    """A number under PRIME for a key, from its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % PRIME


def poisson_medians(df: DataFrame, value: str, key: str, resamples: int, seed: int) -> DataFrame:
    """Rows (resample, median): of resamples in which each row of df has a Poisson(1) number of copies.

    Weights are made where the rows are and summed before they are shuffled: a task sends at most PARTS + 1 sums for each
    resample, whatever its rows. Each round cuts the interval that holds all medians into parts of about equal numbers
    of rows and keeps the parts that a median lies in; the last has a part for each value. Rows with a null value
    don't count; a resample without rows has no median.
    """
    rows = cut(df.select(F.col(value).cast("double").alias("v"), key_number(F.col(key)).alias("k")).where("v IS NOT NULL"))
    below, inside, parts = None, rows, PARTS
    by = W.partitionBy("resample").orderBy("part")
    while True:
        few = [r[0] for r in inside.select("v").distinct().orderBy("v").limit(parts + 1).collect()]
        last = len(few) <= parts
        if not few:
            return rows.sparkSession.createDataFrame([], "resample long, median double")
        edges = few if last else sorted(set(inside.agg(F.percentile_approx("v", [i / parts for i in range(1, parts + 1)], 100 * parts).alias("x")).first()["x"]))
        # part i: values above edge i - 1, up to edge i
        part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("v")))
        sums = cut(weighted(inside.select("k", part.alias("part")), resamples, seed).groupBy("resample", "part").agg(F.sum("w").alias("w")))
        if below is None:
            below = cut(sums.groupBy("resample").agg(F.sum("w").alias("n"), F.lit(0).cast("long").alias("below")))
        found = cut(sums.join(below, "resample").withColumn("upto", F.col("below") + F.sum("w").over(by)))
        # the two middle places, from 0
        low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
        hit = lambda place: (place < F.col("upto")) & (place >= F.col("upto") - F.col("w"))
        if last:
            values = F.get(F.array(*[F.lit(e) for e in edges]), F.col("part"))
            ends = found.groupBy("resample").agg(F.max(F.when(hit(low), values)).alias("a"), F.max(F.when(hit(high), values)).alias("b"))
            return ends.select("resample", ((F.col("a") + F.col("b")) / 2).alias("median"))
        a, b = found.where(hit(low) | hit(high)).agg(F.min("part"), F.max("part")).first()
        if a == 0 and b >= len(edges) - 1:  # the medians are everywhere: more parts
            parts *= 2
        before = found.where(F.col("part") < a).groupBy("resample").agg(F.sum("w").alias("more"))
        below = cut(below.join(before, "resample", "left").select("resample", "n", (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
        inside = inside.where((F.lit(True) if a == 0 else F.col("v") > edges[a - 1]) & (F.lit(True) if b >= len(edges) else F.col("v") <= edges[b]))
