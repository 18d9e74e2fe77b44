"""Near-duplicate clusters as split keys: texts that share most of their word sequences stay on one side of a split."""

from __future__ import annotations

import math
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.joins import dealt_join

# workers get this module's functions with the task, so that they need not have the package
register_pickle_by_value(sys.modules[__name__])

#: Words of a shingle, least share of common shingles; sets of a group that are paired by a join, and sets of a block in larger ones.
WIDTH, SHARE, FEW, BLOCK = 5, 0.8, 32, 512


def cut(df: DataFrame) -> DataFrame:
    """Write df in the folder that spark.checkpoint.dir names, and read it back: its lineage, and what the optimizer has gathered about it, ends there.

    A checkpoint of Spark's keeps the constraints of its plan, which double in every round of a loop of joins.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tokenledger-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Rows (v, root) of all vertices of edges (a, b): root is the smallest vertex that can be reached.

    Every round takes the least root among a vertex and its neighbours, then jumps to that root's own; it ends when
    nothing changes.
    """
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct())
    roots = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "v")
    roots, mark = cut(roots), None
    for _ in range(rounds):
        seen = roots.agg(F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()[0]
        if seen == mark:
            return roots
        mark = seen
        near = both.join(roots.selectExpr("v AS b", "root"), "b").groupBy("a").agg(F.min("root").alias("low")).withColumnRenamed("a", "v")
        lower = roots.join(near, "v").select("v", F.least("root", "low").alias("up"))
        roots = cut(lower.join(roots.selectExpr("v AS up", "root AS top"), "up").select("v", F.least("up", "top").alias("root")))
    raise RuntimeError("clusters did not settle")


def shingle_sets(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """Rows (k, xs): the sorted distinct digests of runs of `width` lower-cased words; a shorter text is one run, one without words has no row."""
    words = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda x: F.xxhash64(x))
    base = docs.select(F.col(key).alias("k"), words.alias("w")).where(F.size("w") > 0)
    # places beyond the last word are null, which a hash passes over
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - width)), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(width)]))
    return base.select("k", F.array_sort(F.array_distinct(runs)).alias("xs"))


def _agree(n1: Column, n2: Column, common: Column, share: float) -> Column:
    """Whether sets of these sizes with so many common members have an intersection of at least `share` of their union."""
    return common >= (n1 + n2 - common) * F.lit(share) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Of pairs (a, b) those whose sets agree. A set in very many pairs is dealt with its pairs."""
    pairs = cut(pairs)
    n = pairs.count()
    a, b = (pairs.groupBy(x).agg(F.count("*").alias("n")).join(sets.select(F.col("k").alias(x), F.col("xs").alias(f"x{x}")), x) for x in "ab")
    full = dealt_join(dealt_join(pairs, a, ["a"], "n", ["b"], n).drop("n"), b, ["b"], "n", ["a"], n)
    return full.where(_agree(F.size("xa"), F.size("xb"), F.size(F.array_intersect("xa", "xb")), share)).select("a", "b")


def _may(share: float) -> Column:
    """Whether sets of sizes n and n2, met at places i and i2 of their prefixes, can agree: by length, and by what comes after the place."""
    least = F.ceil((F.col("n") + F.col("n2")) * F.lit(share / (1 + share)) - 1e-9)
    return (F.least("n", "n2") >= F.greatest("n", "n2") * F.lit(share) - 1e-9) & (F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) + F.least("i", "i2") >= least)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex of a graph to the smallest one it is connected with."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    low = np.arange(len(names))
    while (low[x] != low[y]).any():
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        while (low[low] != low).any():
            low = low[low]
    out = np.flatnonzero(low != np.arange(len(names)))
    return names[out], names[low[out]]


def _common(xs: list[np.ndarray], ys: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sorted sets, each of xs with each of ys."""
    flat = np.concatenate([*xs, *ys])
    code = np.unique(flat, return_inverse=True)[1]
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(x) for x in (*xs, *ys)])
    # only members that both sides have
    first = row < len(xs)
    counts = np.minimum(np.bincount(code[first], minlength=code.max() + 1), np.bincount(code[~first], minlength=code.max() + 1)) > 0
    code, row = (np.cumsum(counts) - 1)[code[counts[code]]], row[counts[code]]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, int(counts.sum()), wide):
        here = (code >= at) & (code < at + wide)
        table = np.zeros((len(xs) + len(ys), wide), np.float32)
        table[row[here], code[here] - at] = 1
        out += table[: len(xs)] @ table[len(xs) :].T
    return out


def _tile(table: pa.Table, share: float) -> pa.Table:
    """Links of two blocks of sets, or within one, as a forest of those that are in different clusters so far."""
    k = np.array(table.column("k").to_pylist())
    root = np.unique(np.array(table.column("root").to_pylist()), return_inverse=True)[1]
    first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
    xs = [np.array(x, np.int64) for x in table.column("xs").to_pylist()]
    n = np.array([len(x) for x in xs])
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    right = right if len(right) else left
    common = _common([xs[i] for i in left], [xs[i] for i in right])
    agree = common >= (n[left][:, None] + n[right][None] - common) * share - 1e-9
    i, j = np.nonzero(agree & (root[left][:, None] != root[right][None]))
    a, b = _forest(k[left[i]], k[right[j]])
    return pa.table({"a": pa.array(a.tolist(), table.schema.field("k").type), "b": pa.array(b.tolist(), table.schema.field("k").type)})


def near_duplicate_clusters(docs: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """Rows (key, cluster), one for each key: cluster is the smallest key of the texts linked to it, itself without links.

    Texts are linked if their shingle sets have an intersection of at least `share` of their union; every such pair is
    in one cluster, and no other. Two such sets agree on one of their rarest shingles, so sets meet at the
    (1 - share) rarest ones of each, and only sets that share those. Equal sets are one. First every set is compared with the smallest one that
    it meets at a shingle, and clusters are formed. Only where sets of several clusters meet are more pairs compared:
    in groups of up to FEW sets those that can agree by length and by place; in more crowded ones bands of lengths are
    dealt to blocks of about BLOCK sets, and each two blocks that can agree are compared by one task, which returns a
    forest, not its pairs. Keys must be unique; a null text, or one without words, is linked with nothing.
    """
    every = cut(shingle_sets(docs, key, text).withColumns({"h": F.xxhash64("xs"), "h2": F.xxhash64(F.lit(1), "xs")}))
    firsts = cut(every.groupBy("h", "h2").agg(F.min("k").alias("rep"), F.count("*").alias("copies")))
    sets = cut(every.join(firsts.select(F.col("rep").alias("k")), "k").select("k", "xs"))
    members = sets.select("k", F.size("xs").alias("n"), F.explode("xs").alias("s"))
    shared = cut(members.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"))
    # shingles of one set alone come first in its order and meet nothing
    rare = dealt_join(members, shared, ["s"], "f", ["k"]).groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1
    alone = F.col("n") - F.size("x")
    rare = rare.where(length > alone).select("k", "n", alone.alias("alone"), F.posexplode(F.slice("x", F.lit(1), (length - alone).cast("int"))).alias("at", "x"))
    prefix = cut(rare.select("k", "n", (F.col("alone") + F.col("at")).alias("i"), F.col("x.s").alias("s")))
    hubs = cut(prefix.groupBy("s").agg(F.count("*").alias("m"), F.min(F.struct("n", "k", "i")).alias("hub")).where("m > 1"))
    stars = dealt_join(prefix, hubs, ["s"], "m", ["k"]).select(F.col("k").alias("a"), F.col("hub.k").alias("b"), "n", "i", F.col("hub.n").alias("n2"), F.col("hub.i").alias("i2"))
    links = cut(_verified(stars.where("a <> b").where(_may(share)).select("a", "b").distinct(), sets, share))
    roots = cut(connected(links))
    # groups whose members are in several clusters so far
    placed = prefix.join(roots.select(F.col("v").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    still = cut(placed.groupBy("s").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s", "m"))
    open_ = cut(dealt_join(placed, still, ["s"], "m", ["k"]))
    few = open_.where(F.col("m") <= FEW).drop("m")
    other = few.select("s", F.col("k").alias("b"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("root").alias("root2"))
    pairs = few.withColumnRenamed("k", "a").join(other, "s").where("a < b AND root <> root2").where(_may(share)).select("a", "b").distinct()
    links = links.unionByName(_verified(pairs, sets, share))
    crowd = open_.where(F.col("m") > FEW).withColumn("band", F.floor(F.log("n") / F.lit(-math.log(share)) + 1e-9))
    bands = crowd.groupBy("s", "band").agg(F.count("*").alias("m2")).withColumn("blocks", F.ceil(F.col("m2") / BLOCK).cast("long"))
    if not crowd.isEmpty():
        dealt = dealt_join(crowd.select("s", "band", "k", "root"), bands, ["s", "band"], "m2", ["k"]).withColumn("block", F.pmod(F.xxhash64("k"), "blocks"))
        above = bands.select("s", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
        below = bands.select("s", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
        plan = bands.join(above, ["s", "band"], "left").join(below, ["s", "band"], "left").select("s", "band", "above", "below", "m2")
        dealt = dealt_join(dealt.drop("m2"), plan, ["s", "band"], "m2", ["k"])
        span = lambda low, high: F.when(F.coalesce(high, F.lit(0)) > low, F.sequence(F.lit(0).cast("long") + low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        # a block meets itself and the later ones of its band, and all of the band above; the first of two blocks names the tile
        own = F.transform(span(F.col("block"), F.col("blocks")), lambda j: F.struct(F.col("band").alias("t"), F.col("block").alias("x"), F.lit(0).alias("up"), j.alias("y"), F.lit(True).alias("first")))
        back = F.transform(span(F.lit(0), F.col("block")), lambda j: F.struct(F.col("band").alias("t"), j.alias("x"), F.lit(0).alias("up"), F.col("block").alias("y"), F.lit(False).alias("first")))
        up = F.transform(span(F.lit(0), F.col("above")), lambda j: F.struct(F.col("band").alias("t"), F.col("block").alias("x"), F.lit(1).alias("up"), j.alias("y"), F.lit(True).alias("first")))
        down = F.transform(span(F.lit(0), F.col("below")), lambda j: F.struct((F.col("band") - 1).alias("t"), j.alias("x"), F.lit(1).alias("up"), F.col("block").alias("y"), F.lit(False).alias("first")))
        tiles = dealt.join(sets, "k").select("s", "k", "root", "xs", F.explode(F.concat(own, back, up, down)).alias("x")).select("s", "k", "root", "xs", "x.*")
        kind = sets.schema["k"].dataType.simpleString()
        links = links.unionByName(tiles.groupBy("s", "t", "x", "up", "y").applyInArrow(lambda t: _tile(t, share), f"a {kind}, b {kind}"))
    whole = connected(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    facts = firsts.join(whole, F.col("rep") == F.col("v"), "left").select("h", "h2", "copies", F.coalesce("root", "rep").alias("cluster"))
    by_text = dealt_join(every.select("k", "h", "h2"), facts, ["h", "h2"], "copies", ["k"], every.count()).select("k", "cluster")
    return docs.select(F.col(key).alias("k")).join(by_text, "k", "left").select(F.col("k").alias(key), F.coalesce("cluster", "k").alias("cluster"))
