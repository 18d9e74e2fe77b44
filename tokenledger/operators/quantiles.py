"""Exact quantiles of any number of groups, by histograms that narrow the interval of each wanted rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut
from tokenledger.operators.joins import dealt_join

#: Buckets of an interval, intervals that go by broadcast, and how often buckets follow ranks instead of values.
BUCKETS, LITTLE, BY_RANK = 1024, 10_000, 4


def _bucket(v: Column, low: Column, high: Column, edges: Column | None) -> Column:
    """Which part of [low, high] a value lies in: equal lengths, or between edges; the ends always lie in different parts."""
    if edges is not None:
        return F.when(v == high, F.size(edges)).otherwise(F.size(F.filter(edges, lambda e: e <= v)) - 1)
    # halves, as the length of the widest interval is no number
    return F.least(F.lit(BUCKETS - 1), F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS).cast("int"))


def order_statistics(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (g, r, value) for wanted (g, r): the value of rank r, from 0, among the values v of group g in rows (g, v).

    Each round counts the values of the open intervals by parts, keeps the part that a rank lies in, with the least
    and greatest value that really occur there, and ends for a rank when these are equal. No task holds a group's values,
    and values that repeat are counted, not gathered. Every fourth round takes the parts by approximate ranks, so that
    values of very different sizes settle too.
    """
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    now = cut(wanted.join(sizes, "g").where("r >= 0 AND r < n").select("g", "r", "low", "high", F.col("r").alias("left")))
    step = 0
    while True:
        open_ = now.where("low < high")
        groups = cut(open_.groupBy("g").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("xs")))  # two a wanted quantile
        many = groups.count()
        if not many:
            return now.select("g", "r", F.col("low").alias("value"))
        if many <= LITTLE:
            near = rows.join(F.broadcast(groups), "g")
        else:
            near = dealt_join(rows, groups.join(sizes.select("g", "n"), "g"), ["g"], "n", ["v"])
        near = near.withColumn("x", F.get(F.filter("xs", lambda x: (F.col("v") >= x["low"]) & (F.col("v") <= x["high"])), F.lit(0))).where("x IS NOT NULL").select("g", "v", "x.low", "x.high")
        edges = None
        step += 1
        if not step % BY_RANK:
            near = cut(near)
            ranks = near.groupBy("g", "low").agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*[F.lit(i / 64) for i in range(64)]), 1000).alias("edges"))
            near, edges = dealt_join(near, cut(ranks), ["g", "low"], "n", ["v"]), F.col("edges")
        parts = near.groupBy("g", "low", _bucket(F.col("v"), F.col("low"), F.col("high"), edges).alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = parts.withColumn("upto", F.sum("c").over(W.partitionBy("g", "low").orderBy("part")))  # at most BUCKETS rows
        found = open_.join(upto.withColumnRenamed("low", "low2"), (open_["g"] == upto["g"]) & (F.col("low") == F.col("low2"))).where("left < upto AND left >= upto - c")
        found = found.select(open_["g"], "r", F.col("a").alias("low"), F.col("b").alias("high"), (F.col("left") - F.col("upto") + F.col("c")).alias("left"))
        now = cut(now.where("low = high").unionByName(found))


def quantiles(df: DataFrame, value: Column, points: list[float], by: list[str]) -> DataFrame:
    """Rows (by, point, quantile): interpolated between the two values next to the place (n - 1) * point. Null values don't count; a group without others has no rows."""
    group = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all_"))
    rows = cut(df.select(group.alias("g"), value.cast("double").alias("v")).where("v IS NOT NULL"))
    at = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point"), "n").withColumn("place", (F.col("n") - 1) * F.col("point"))
    at = cut(at.select("g", "point", "place", F.floor("place").cast("long").alias("a"), F.ceil("place").cast("long").alias("b")))
    ranks = at.select("g", F.explode(F.array("a", "b")).alias("r")).distinct()
    values = cut(order_statistics(rows, ranks))
    out = at.join(values.select("g", F.col("r").alias("a"), F.col("value").alias("low")), ["g", "a"]).join(values.select("g", F.col("r").alias("b"), F.col("value").alias("high")), ["g", "b"])
    between = F.when(F.col("a") == F.col("b"), F.col("low")).otherwise((F.col("b") - F.col("place")) * F.col("low") + (F.col("place") - F.col("a")) * F.col("high"))
    return out.select(*[F.col("g")[b].alias(b) for b in by], "point", between.alias("quantile"))


def medians(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Rows (by, median)."""
    return quantiles(df, value, [0.5], by).select(*by, F.col("quantile").alias("median"))
