"""Running totals and ranks over a whole table, without one task that orders all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows up to this one in `order`, which must tell all rows apart.

    Rows are dealt to ranges of `order` and written; each range is summed by itself and starts from the totals of
    those before it. The driver holds one total per range.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))
    base, bases = 0, []
    for row in placed.groupBy("part_").agg(F.sum(value).alias("total_")).orderBy("part_").collect():
        bases.append((row["part_"], base))
        base += row["total_"] or 0
    kind = placed.select(F.sum(value).alias("total_")).schema[0].dataType.simpleString()
    frame = F.broadcast(df.sparkSession.createDataFrame(bases, f"part_ int, base_ {kind}"))  # one row per range
    within = F.sum(value).over(W.partitionBy("part_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.join(frame, "part_").withColumn(name, F.col("base_") + within).drop("part_", "base_")


def numbered(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place of each row in `order`, from 1."""
    return running(df, order, F.lit(1).cast("long"), name)


def _ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return cut(df.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id()))


def _beyond(placed: DataFrame, by: list[str], value: Column, fold, backwards: bool = False, rest: bool = False) -> DataFrame:
    """Rows (part_, by, base_) for groups that lie in several ranges: `value`'s totals of the ranges before (after, if backwards), or of all others.

    A range shares at most its first and last group with others, so the driver holds two rows a range.
    """
    per = placed.groupBy("part_", *by).agg(value.alias("total_"))
    many = per.groupBy(*by).agg(F.count("*").alias("ranges_")).where("ranges_ > 1").drop("ranges_")
    shared = per.alias("p").join(many.alias("m"), [F.col(f"p.{b}").eqNullSafe(F.col(f"m.{b}")) for b in by], "left_semi").orderBy("part_").collect()
    groups: dict = {}
    for r in shared:
        groups.setdefault(tuple(r[b] for b in by), []).append((r["part_"], r["total_"]))
    out = []
    for name, parts in groups.items():
        for i, (part, _) in enumerate(parts):
            others = [t for j, (_, t) in enumerate(parts) if (j != i if rest else j > i if backwards else j < i)]
            out.append((part, *name, fold(others) if others else None))
    kinds = per.schema
    return F.broadcast(placed.sparkSession.createDataFrame(out, kinds)).withColumnRenamed("total_", "base_")  # two rows a range


def _joined(placed: DataFrame, beyond: DataFrame, by: list[str]) -> DataFrame:
    right = beyond.select(F.col("part_").alias("part2_"), *[F.col(b).alias(f"{b}2_") for b in by], "base_")
    on = [placed["part_"] == right["part2_"], *[placed[b].eqNullSafe(right[f"{b}2_"]) for b in by]]
    return placed.join(right, on, "left").drop("part2_", *[f"{b}2_" for b in by])


def falling(df: DataFrame, by: list[str], order: list[str], value: Column, rank: str, size: str, name: str) -> DataFrame:
    """Adds `rank` (place in the group's order, from 1), `size` (rows of the group) and `name`: the least `value` from a row on to its group's last.

    `value` may use rank and size. `by` and `order` together must tell all rows apart. Rows are dealt to ranges of both
    and written, so that a group of any size spreads over tasks; what the ranges of a group owe each other is counted
    per range.
    """
    placed = _ranges(df, by, order)
    inside = W.partitionBy("part_", *by)
    earlier, others = _beyond(placed, by, F.count("*"), sum), _beyond(placed, by, F.count("*"), sum, rest=True)
    ranked = _joined(placed, earlier, by).withColumn(rank, F.coalesce("base_", F.lit(0)) + F.row_number().over(inside.orderBy(*order))).drop("base_")
    sized = _joined(ranked, others, by).withColumn(size, F.coalesce("base_", F.lit(0)) + F.count("*").over(inside)).drop("base_")
    valued = cut(sized.withColumn("value_", value))
    later = _beyond(valued, by, F.min("value_"), min, backwards=True)
    back = inside.orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return _joined(valued, later, by).withColumn(name, F.least("base_", F.min("value_").over(back))).drop("part_", "base_", "value_")
