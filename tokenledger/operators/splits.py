"""Hold-out splits, folds that keep groups together, and checks that no key is on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tokenledger.operators.clusters import cut


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from SHA-256 of key:seed."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def with_holdout(df: DataFrame, key: str, seed: int, share: float = 0.2) -> DataFrame:
    return df.withColumn("held_out", unit_hash(F.col(key), seed) < share)


#: Groups that are placed one by one.
LARGEST = 1_000


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Rows (group, n, fold): the LARGEST groups of several rows by falling size, each into the fold with the fewest rows so far, all others by hash.

    The driver holds the largest ones; a large number of small groups spreads evenly by itself.
    """
    sizes = cut(df.groupBy(group).agg(F.count("*").alias("n")))
    load, placed = [0] * folds, []
    for name, n in sizes.where("n > 1").orderBy(F.desc("n"), group).limit(LARGEST).collect():
        fold = min(range(folds), key=lambda i: (load[i], i))
        load[fold] += n
        placed.append((name, fold))
    kind = sizes.schema[group]
    own = df.sparkSession.createDataFrame(placed, StructType([StructField("g_", kind.dataType), StructField("fold", LongType())]))
    out = sizes.join(F.broadcast(own), sizes[group].eqNullSafe(F.col("g_")), "left")  # at most LARGEST rows
    return out.select(group, "n", F.coalesce("fold", F.pmod(F.xxhash64(group), F.lit(folds))).alias("fold"))


def leaked(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Training rows whose key is in the test part; none in a sound split."""
    return train.join(test.select(key).distinct(), key, "left_semi")


def with_group_holdout(df: DataFrame, group: str, seed: int, share: float = 0.2) -> DataFrame:
    """Adds held_out by the group's hash, so that a group is on one side as a whole."""
    return with_holdout(df, group, seed, share)


def leakage(df: DataFrame, group: str) -> DataFrame:
    """Rows (group, train, held) of groups that a split has on both sides."""
    sides = df.groupBy(group).agg(F.count_if(~F.col("held_out")).alias("train"), F.count_if("held_out").alias("held"))
    return sides.where("train > 0 AND held > 0")
