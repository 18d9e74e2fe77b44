"""Bootstrap by draws with replacement: what a digest draws is counted where it is made, and no row stands for a draw."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut
from tokenledger.operators.ranks import numbered

# workers get this module's functions with the task, so that they need not have the package
register_pickle_by_value(sys.modules[__name__])

#: Rows whose codes lie in one array, and arrays that a task holds at a time: beyond that many rows, draws are made once for each such slice.
BLOCK, SLICE = 65_536, 64
#: Draws that are hashed side by side, and parts that resamples are dealt to, at least.
CHUNK, PARTS = 32_768, 64
#: Standard deviations of a resample's median, by rank, that the first interval reaches; accuracy of its ends.
SPREAD, ACCURACY = 5.0, 10_000
#: Fixed values of MD5: start, sines, rotations, words by step.
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
TURNS = np.array([s for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in r * 4], np.uint32)
WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def digits(low: int, high: int) -> tuple[list[list[np.ndarray]], np.ndarray]:
    """The decimal numbers from low up to high, each with MD5's end mark, as little-endian words: for each number of bytes before them (0 to 3) a list of words; and how many digits each has."""
    many = len(str(high - 1))
    text = np.zeros((high - low, 3 + many + 4), np.uint8)
    size = np.empty(high - low, np.uint32)
    for d in range(len(str(low)), many + 1):
        a, b = max(low, 10 ** (d - 1) if d > 1 else 0), min(high, 10**d)
        k, part = np.arange(a, b), slice(a - low, b - low)
        for j in range(d):
            text[part, 3 + j] = k // 10 ** (d - 1 - j) % 10 + 48
        text[part, 3 + d] = 0x80
        size[part] = d
    wide = (many + 4) // 4 * 4
    out = []
    for before in range(4):
        shifted = np.zeros((high - low, wide + 4), np.uint8)
        shifted[:, before : before + many + 1] = text[:, 3 : 3 + many + 1]
        out.append(list(np.ascontiguousarray(shifted.view("<u4").T)))
    return out, size


def md5_heads(prefix: bytes, words: list[list[np.ndarray]], size: np.ndarray) -> np.ndarray:
    """The first four bytes, as a big-endian number, of the MD5 of prefix and each of the numbers that digits() gave."""
    if len(prefix) > 39:
        raise ValueError("a prefix has at most 39 bytes")
    whole, before = divmod(len(prefix), 4)
    fixed = np.frombuffer(prefix + bytes(4 - before), "<u4")
    message = [np.uint32(0)] * 16
    message[:whole] = fixed[:whole]
    message[whole : whole + len(words[before])] = words[before]
    message[whole] = message[whole] | fixed[whole]
    bits = (size + np.uint32(len(prefix))) * np.uint32(8)
    message[14] = bits[0] if bits[0] == bits[-1] else bits
    a, b, c, d = (np.full(len(size), x, np.uint32) for x in START)
    f, t = np.empty_like(a), np.empty_like(a)
    with np.errstate(over="ignore"):
        for i, g in enumerate(WORDS):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            if message[g].ndim:
                np.add(f, message[g], out=f)
                np.add(f, SINES[i], out=f)
            else:
                np.add(f, message[g] + SINES[i], out=f)
            np.left_shift(f, TURNS[i], out=t)
            np.right_shift(f, np.uint32(32) - TURNS[i], out=f)
            np.bitwise_or(f, t, out=f)
            np.add(f, b, out=a)
            a, b, c, d = d, a, b, c
        return (a + np.uint32(START[0])).byteswap()


def _counter(seed: int, n: int, resamples: int, parts: int, top: int, held: int, chunk: int):
    """For a part's resamples and a slice's codes: rows (resample, code, w), how often the resample draws rows of that code; code 0 is left out."""

    def count(rows: pa.Table) -> pa.Table:
        part, first = rows["part"][0].as_py(), rows["slice"][0].as_py() * held
        codes = rows.sort_by("block")["codes"].combine_chunks().flatten().to_numpy()
        mine = range(part * resamples // parts, (part + 1) * resamples // parts)
        counts = np.zeros((len(mine), top + 1), np.int64)
        for low in range(0, n, chunk):
            words, size = digits(low, min(n, low + chunk))
            for b, row in zip(mine, counts, strict=True):
                i = md5_heads(f"{seed}:{b}:".encode(), words, size)
                i = i % np.uint32(n) if n < 2**32 else i
                if len(codes) < n:
                    i = i.astype(np.int64) - first
                    i = i[(i >= 0) & (i < len(codes))]
                row += np.bincount(codes[i], minlength=top + 1)
        at, code = np.nonzero(counts[:, 1:])
        return pa.table({"resample": pa.array(at + mine.start, pa.int64()), "code": pa.array(code + 1, pa.int32()), "w": pa.array(counts[at, code + 1], pa.int64())})

    return count


def drawn_medians(df: DataFrame, value: str, key: str, resamples: int, seed: int) -> DataFrame:
    """Rows (resample, median): draw k of resample b is the row whose place in the order of keys is MD5("seed:b:k") modulo n; there are n draws.

    Medians of resamples lie close to the median by rank, so a row is known by a code: below an interval, above it, or
    which of the interval's values it has. Tasks get the codes of a slice of the rows (four bytes each) and some of the
    resamples, make the draws and send sums by code. Where a median falls outside, the interval is widened and all is
    done again, so that results are exact. Rows with a null value are drawn but don't count; a resample without others has no row.
    """
    spark = df.sparkSession
    rows = cut(df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")))  # ranges read their input twice
    ordered = cut(numbered(rows, ["k"], "nth").select((F.col("nth") - 1).alias("i"), "v"))
    n, full = ordered.agg(F.count("*"), F.count("v")).first()
    if not full:
        return spark.createDataFrame([], "resample long, median double")
    parts = min(resamples, max(PARTS, 4 * spark.sparkContext.defaultParallelism))
    spread = SPREAD
    while True:
        reach = spread / (2 * math.sqrt(full)) + 2 / ACCURACY
        below = above = F.lit(False)
        if reach < 0.5:
            low, high = ordered.agg(F.percentile_approx("v", [0.5 - reach, 0.5 + reach], ACCURACY)).first()[0]
            below, above = F.col("v") < low, F.col("v") > high
        values = cut(numbered(ordered.where(F.col("v").isNotNull() & ~below & ~above).select("v").distinct(), ["v"], "code").select("v", (F.col("code") + 1).alias("code")))
        last = values.count() + 1
        code = F.when(F.col("v").isNull(), 0).when(below, 1).when(above, last + 1).otherwise(F.col("code")).cast("int")
        coded = ordered.join(F.broadcast(values), "v", "left").select("i", code.alias("code"))  # the interval's values: some times the root of n
        block = F.floor(F.col("i") / BLOCK).alias("block")
        blocks = cut(coded.groupBy(block).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"]).alias("codes")))
        copies = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.floor(F.col("block") / SLICE).alias("slice"), "block", "codes")
        count = _counter(seed, n, resamples, parts, last + 1, BLOCK * SLICE, CHUNK)
        counted = copies.repartitionByRange(parts, "part").groupBy("part", "slice").applyInArrow(count, "resample long, code int, w long")
        sums = counted.repartition("resample").groupBy("resample", "code").agg(F.sum("w").alias("w"))
        each = W.partitionBy("resample")  # at most a row for each code
        found = sums.withColumn("upto", F.sum("w").over(each.orderBy("code"))).withColumn("n", F.sum("w").over(each))
        # the two middle places, from 0
        hit = lambda place: (place < F.col("upto")) & (place >= F.col("upto") - F.col("w"))
        middle = [F.max(F.when(hit(place), F.col("code"))).alias(x) for place, x in ((F.floor((F.col("n") - 1) / 2), "a"), (F.ceil((F.col("n") - 1) / 2), "b"))]
        ends = cut(found.groupBy("resample").agg(*middle))
        if ends.where((F.col("a") < 2) | (F.col("b") > last)).isEmpty():
            a, b = (values.select(F.col("code").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
            return ends.join(a, "a").join(b, "b").select("resample", ((F.col("va") + F.col("vb")) / 2).alias("median"))
        spread *= 2
