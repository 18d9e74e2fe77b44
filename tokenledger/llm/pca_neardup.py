"""Embedding near-dedup by PCA-ordered, tiled comparison.

Unit vectors are rotated to principal axes, so that the leading dimensions carry most of every dot product,
and laid along a Hilbert curve of the first three into sides of tiles. Two sides meet unless their boxes in the
leading dimensions are too far apart, and so do the strips inside a tile. There, products accumulate leading
dimensions first; a pair whose partial sum plus the product of suffix norms is below the threshold is dropped
unfinished. Sums that end next to the threshold are settled on the vectors as they came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, offsets_of, often_keys, ship, spread_join, stored
from .hilbert_pack import hilbert_keys

#: Rows of a strip, dimensions of boxes, where sums pause; bytes of a side at most, and its rows at least.
STRIP, BOX, STAGES, SIDE_BYTES, SIDE_ROWS = 512, 8, (8, 16, 32), 16 << 20, 256
#: Slack of bounds, and how near the threshold a rotated sum is settled by the plain product.
SLACK, EDGE = 1e-12, 1e-9


def scaled(e: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows as float64 of `width` places, scaled by a power of two so that nothing overflows; which rows are of use)."""
    counts = pc.fill_null(pc.list_value_length(e), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = e.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(e), width))
    row = np.repeat(np.arange(len(e)), counts)
    out[row, np.arange(len(flat)) - offsets_of(counts)[:-1][row]] = flat
    good = np.isfinite(out).all(1)
    out[~good] = 0
    top = np.abs(out).max(1, initial=0)
    good &= top > 0
    return np.ldexp(out, -np.frexp(np.where(top > 0, top, 1))[1][:, None]), good


def packed(rows: np.ndarray) -> list[bytes]:
    """Bytes of each row: as float32 where that loses nothing, else as float64."""
    small = rows.astype(np.float32)
    same = (small.astype(np.float64) == rows).all(1).tolist()
    return [(small[i] if same[i] else rows[i]).tobytes() for i in range(len(rows))]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `packed` as float64."""
    parts = (x.as_buffer() for x in column)
    rows = [np.frombuffer(b, np.float32 if b.size == 4 * width else np.float64) for b in parts]
    return np.array(rows, np.float64).reshape(-1, width)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def boxes(y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest leading coordinates of each strip of `size` rows."""
    cuts = np.arange(0, len(y), size)
    return np.minimum.reduceat(y[:, :BOX], cuts, axis=0), np.maximum.reduceat(y[:, :BOX], cuts, axis=0)


def compare(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (into x, into y) of rows whose dot product comes up to the threshold less EDGE, with the product; i < j if same.

    Strips whose boxes are farther apart than the threshold allows are left out as a whole.
    """
    d = x.shape[1]
    stops = [s for s in STAGES if s < d]
    norms = [(np.linalg.norm(x[:, s:], axis=1), np.linalg.norm(y[:, s:], axis=1)) for s in stops]
    reach = max(0.0, 2 - 2 * threshold) + EDGE
    (low, high), (low2, high2) = boxes(x, STRIP), boxes(y, STRIP)
    for m, at in enumerate(range(0, len(x), STRIP)):
        a = x[at : at + STRIP]
        gaps = np.maximum(np.maximum(low[m] - high2, low2 - high[m]), 0)
        for n in np.flatnonzero((gaps**2).sum(1) <= reach).tolist():
            begin = n * STRIP
            if same and n < m:
                continue
            b = y[begin : begin + STRIP]
            first = stops[0] if stops else d
            sums = a[:, :first] @ b[:, :first].T
            if stops:
                keep = sums + norms[0][0][at : at + STRIP, None] * norms[0][1][None, begin : begin + STRIP] >= threshold - EDGE
            else:
                keep = sums >= threshold - EDGE
            if same and n == m:
                keep &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            i, j = np.nonzero(keep)
            part = sums[i, j]
            for k, stop in enumerate(stops):
                to = stops[k + 1] if k + 1 < len(stops) else d
                if not len(i):
                    break
                if len(i) * 8 > keep.size:  # most pairs are open: one matrix product is cheaper than pair by pair
                    part = part + (a[:, stop:to] @ b[:, stop:to].T)[i, j]
                else:
                    part = part + np.einsum("ij,ij->i", a[i, stop:to], b[j, stop:to])
                rest = norms[k + 1][0][at + i] * norms[k + 1][1][begin + j] + SLACK if to < d else 0.0
                good = part + rest >= threshold - EDGE
                i, j, part = i[good], j[good], part[good]
            if len(i):
                yield i + at, j + begin, part


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of vectors.

    Two rows are linked if their cosine, x.y / (|x| |y|) in double precision, is at least `threshold` (over 0). A
    null, empty or zero vector, and one with null or non-finite components, links with nothing, nor does a row
    whose key is null (its component is null, and it is kept). A shorter vector counts as padded with zeros. Rows
    that repeat a key are one vertex, with their links added up. An empty table gives no rows. Other columns are
    ignored, whatever their names.

    Equal vectors are one row of the comparison, with their number. Vectors travel as they came (in 4 bytes a
    component where that is exact), once to their sides and once to each tile that needs them; tiles rotate
    them. A tile sends link counts and a spanning forest, never its pairs. The driver holds the rotation, and one
    total per range partition.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(vectors[key].cast("long").alias("k"), vectors[vector].cast("array<double>").alias("e"))
    width = max(base.agg(F.max(F.size("e"))).first()[0] or 0, 1)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, good = scaled(part.column("e"), width)
                cells = [b if ok else None for b, ok in zip(packed(x), good.tolist(), strict=True)]
                names = [None if b is None else xxhash.xxh3_128_digest(b) for b in cells]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(names, pa.binary()), pa.array(cells, pa.binary())], ["k", "content", "v"])

    rows = stored(base.mapInArrow(clean, "k long, content binary, v binary"), "vectors")
    useful = F.col("content").isNotNull() & F.col("k").isNotNull()
    valid = rows.where(useful)
    reps = valid.groupBy("content").agg(F.min("k").alias("k"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("id"), "content", "k", "copies", "v"), "reps")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                y = units(unpacked(batch.column("v"), width))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["i", "m"])

    moment, many = np.zeros(width * width), reps.count()
    for r in reps.select("v").mapInArrow(moments, "i long, m double").groupBy("i").agg(F.sum("m").alias("m")).collect():
        moment[r.i] = r.m
    rotation = np.linalg.eigh(moment.reshape(width, width))[1][:, ::-1].copy()

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = units(unpacked(batch.column("v"), width)) @ rotation[:, : min(3, width)]
            grid = np.clip((lead + 1) * (1 << 15), 0, (1 << 16) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hilbert_keys(grid)), batch.column("v")], ["id", "k", "copies", "curve", "v"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = [pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(np.arange(n, n + batch.num_rows))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "pid", "nth"])
            n += batch.num_rows

    turned = stored(reps.select("id", "k", "copies", "v").mapInArrow(rotate, "id long, k long, copies long, curve long, v binary"), "turned")
    order = turned.repartitionByRange("curve", "id").sortWithinPartitions("curve", "id").select("id", "k", "copies", "v")
    order = stored(order.mapInArrow(number, "id long, k long, copies long, v binary, pid int, nth long"), "ordered")
    bases, n = [], 0
    for r in order.groupBy("pid").agg(F.count("*").alias("n")).orderBy("pid").collect():
        bases.append((r.pid, n))
        n += r.n
    frame = spark.createDataFrame(bases, "pid int, base long")
    # tiles enough for all cores, of sides that fit a task
    wanted = max(6, math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)))
    side = max(SIDE_ROWS, min(-(-many // wanted), SIDE_BYTES // (4 * width)))
    placed = order.join(F.broadcast(frame), "pid").withColumn("side", F.floor((F.col("base") + F.col("nth")) / side))  # one row a range
    lead_boxes = placed.select("side", "v").mapInArrow(lambda batches: _lead_boxes(batches, width, rotation), "side long, low array<double>, high array<double>")
    corner = lambda name, f, b: F.array(*[f(F.get(name, F.lit(i))) for i in range(b)]).alias(name)
    box = min(BOX, width)
    sides = stored(lead_boxes.groupBy("side").agg(corner("low", F.min, box), corner("high", F.max, box)), "boxes")
    # sides meet where their boxes, widened by half the reach, share a grid cell; their distance then decides
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    cell = lambda side, i, by: F.floor((F.get(side, F.lit(i)) + by) / reach).cast("int")
    cells = sides
    for i in range(min(3, width)):
        cells = cells.withColumn(f"c{i}", F.explode(F.sequence(cell("low", i, -reach / 2), cell("high", i, reach / 2))))
    names = [f"c{i}" for i in range(min(3, width))]
    other = cells.select(*names, F.col("side").alias("side2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.aggregate(
        F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))),
        F.lit(0.0),
        lambda s, g: s + g * g,
    )
    tiles = cells.join(other, names).where("side <= side2").select("side", "side2", gap.alias("gap")).distinct().where(F.col("gap") <= reach * reach).select("side", "side2")
    calls = tiles.select(F.col("side").alias("x"), "side", "side2").unionByName(tiles.where("side < side2").select(F.col("side2").alias("x"), "side", "side2"))
    calls = stored(calls.groupBy("x").agg(F.collect_list(F.struct("side", "side2")).alias("tiles")), "calls")
    members = placed.select("side", "id", "k", "copies", "v").groupBy("side").applyInArrow(lambda t: _side(t, width), "x long, ids binary, ks binary, copies binary, vs binary")
    sent = members.join(calls, "x").withColumn("t", F.explode("tiles")).select("x", "t.side", "t.side2", "ids", "ks", "copies", "vs")

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("x")
        get = lambda c, r, kind: np.frombuffer(table.column(c)[r].as_buffer(), kind)
        same = table.num_rows == 1
        found = []
        for r in (0, 0 if same else 1):
            ids, raw = get("ids", r, np.int64), table.column("vs")[r].as_buffer()
            x = np.frombuffer(raw, np.float32 if raw.size == 4 * width * len(ids) else np.float64).reshape(-1, width).astype(np.float64)
            found.append((ids, get("ks", r, np.int64), get("copies", r, np.int64), x, np.sqrt(np.einsum("ij,ij->i", x, x))))
        (id1, k1, m1, x1, s1), (id2, k2, m2, x2, s2) = found
        n1, n2 = np.zeros(len(id1)), np.zeros(len(id2))
        trees = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i, j, part in compare(units(x1) @ rotation, units(x2) @ rotation, threshold, same):
            good = part >= threshold + EDGE
            edge = np.flatnonzero(~good)
            a, b = i[edge], j[edge]
            good[edge] = np.einsum("ij,ij->i", x1[a], x2[b]) / (s1[a] * s2[b]) >= threshold
            i, j = i[good], j[good]
            n1 += np.bincount(i, m2[j], len(id1))
            n2 += np.bincount(j, m1[i], len(id2))
            trees.append(forest(k1[i], k2[j]))
        a, b = forest(*(np.concatenate(t) for t in zip(*trees, strict=True)))
        ids, links = np.concatenate([id1, id2]), np.concatenate([n1, n2]).astype(np.int64)
        ids, links = ids[links > 0], links[links > 0]
        to = pa.array(np.concatenate([np.zeros(len(ids), np.int64), b]), mask=np.arange(len(ids) + len(b)) < len(ids))
        return pa.table({"x": np.concatenate([ids, a]), "links": np.concatenate([links, np.zeros(len(a), np.int64)]), "b": to})

    found = stored(sent.groupBy("side", "side2").applyInArrow(tile, "x long, links long, b long"), "tiles")
    counts = found.where("b IS NULL").groupBy("x").agg(F.sum("links").alias("links"))
    facts = reps.join(counts, reps.id == counts.x, "left").select("content", F.col("k").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = spread_join(valid.select("k", "content"), facts, often_keys(reps, "content", "copies"), "content")
    named = stored(named.groupBy("k", "content").agg(F.first("rep").alias("rep"), F.first("links").alias("links")), "named")
    by_key = named.groupBy("k").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"), F.sum("links").alias("links"))
    # keys that repeat with other vectors tie those vectors' vertices together
    tied = named.select("k", F.col("rep").alias("a")).join(by_key.where("rep < other").select("k", F.col("rep").alias("b")), "k").select("a", "b")
    roots = components(found.where("b IS NOT NULL").selectExpr("x AS a", "b").unionByName(tied))
    by_key = by_key.join(roots, by_key.rep == roots.v, "left").select("k", "links", F.coalesce("root", "rep").alias("root"))
    out = rows.select("k").join(by_key, "k", "left")
    component = F.coalesce("root", "k")
    return out.select(F.col("k").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("k")).alias("kept"))


def _lead_boxes(batches: Iterator[pa.RecordBatch], width: int, rotation: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Least and largest leading coordinates of each side in a batch."""
    for batch in batches:
        if batch.num_rows:
            y = units(unpacked(batch.column("v"), width)) @ rotation[:, :BOX]
            names, flat = np.unique(batch.column("side").to_numpy(), return_inverse=True)
            parts = [y[flat == i] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([p.min(0).tolist() for p in parts]), pa.array([p.max(0).tolist() for p in parts])], ["side", "low", "high"])


def _side(table: pa.Table, width: int) -> pa.Table:
    """A side as one row: keys, copies, vectors (in 4 bytes a component if all of them allow it)."""
    column = table.column("v").combine_chunks()
    small = pc.max(pc.binary_length(column)).as_py() == 4 * width
    data = unpacked(column, width).astype(np.float32 if small else np.float64).tobytes()
    return pa.table({"x": table.column("side")[:1], "ids": [table.column("id").to_numpy().tobytes()], "ks": [table.column("k").to_numpy().tobytes()], "copies": [table.column("copies").to_numpy().tobytes()], "vs": [data]})
