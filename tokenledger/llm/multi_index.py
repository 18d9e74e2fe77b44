"""Nearest neighbours by an inverted multi-index.

Each half of a vector has centroids of its own, and a vector's cell is the pair of its nearest two. For a query, a
centroid's reach is the inner product with it plus what a vector of its list can add: the query half's norm times the
list's radius. A heap takes pairs of centroids by falling sums of reaches until enough entries are seen; these are
reranked by their exact products, and the last place found so far is the bar for the rest. Rounds go on in the order of
summed reaches, each over WIDER times as many entries, and leave out cells that don't come up to the bar: those hold no
nearer vector, so the result is that of all pairs. Later rounds send nothing below the bar either.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import offsets_of, release, salted_join, ship, stored
from .pca_neardup import packed, unpacked

#: Vectors that centroids are fitted to, and their bytes; rounds of fitting; entries a cell should have; centroids at most (so cells are at most their square).
SAMPLE, SAMPLE_BYTES, ROUNDS, PER_CELL, MOST = 16_384, 32 << 20, 10, 64, 512
#: Entries that the heap sees before the bar is set, and how many times more each further round may see; bytes of a block of entries, in 8 bytes a component, and its rows at least; queries multiplied at once.
FIRST, WIDER, BLOCK_BYTES, BLOCK_ROWS, AT_ONCE = 1024, 4, 2 << 20, 256, 512
#: Share of the norms by which a product computed in another order may differ.
EDGE = 1e-12


def padded(e: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows as float64 of `width` places, padded with zeros; which rows are neither null, empty, zero nor hold null or non-finite components)."""
    counts = pc.fill_null(pc.list_value_length(e), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = e.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(e), width))
    row = np.repeat(np.arange(len(e)), counts)
    out[row, np.arange(len(flat)) - offsets_of(counts)[:-1][row]] = flat
    return out, np.isfinite(out).all(1) & out.any(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centroid."""
    return ((centroids**2).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids by Lloyd's rounds from evenly spaced rows; one that loses all its rows stays where it is."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centroids)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


class Index:
    """Centroids and radii of both halves, and where the cells' entries lie: everything that a query needs to choose blocks."""

    def __init__(self, centroids: tuple[np.ndarray, np.ndarray]) -> None:
        self.centroids, self.half = centroids, centroids[0].shape[1]
        self.k = len(centroids[1])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its first centroid, to its second)."""
        own = [nearest(h, c) for h, c in zip(self.halves(x), self.centroids, strict=True)]
        away = [np.linalg.norm(h - c[i], axis=1) for h, c, i in zip(self.halves(x), self.centroids, own, strict=True)]
        return own[0] * self.k + own[1], *away

    def lay_out(self, counts: np.ndarray, radii: tuple[np.ndarray, np.ndarray], rows: int) -> None:
        """Neighbouring cells share a block up to `rows` entries; a larger cell has blocks of its own, dealt by hash."""
        self.counts, self.radii = counts, radii
        self.first, self.many = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        block, room = 0, rows
        for cell in np.flatnonzero(counts).tolist():
            n = int(counts[cell])
            if n > room:
                block, room = block + (room < rows), rows
            self.first[cell], self.many[cell] = block, max(1, -(-n // rows))
            if n > rows:
                block += int(self.many[cell])
            else:
                room -= n

    def blocks(self, cell: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cell] + (mixed % self.many[cell].astype(np.uint64)).astype(np.int64)

    def reaches(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and centroid of a half, the largest product that the half of an entry in its list can give."""
        return tuple(h @ c.T + np.linalg.norm(h, axis=1)[:, None] * r for h, c, r in zip(self.halves(q), self.centroids, self.radii, strict=True))

    def begin(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells of one query by falling sums of reaches, until they hold FIRST entries."""
        up, down = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, seen, out = [(-(a[up[0]] + b[down[0]]), 0, 0)], 0, []
        while heap and seen < FIRST:
            _, i, j = heapq.heappop(heap)
            cell = int(up[i]) * self.k + int(down[j])
            if self.counts[cell]:
                out.append(cell)
                seen += int(self.counts[cell])
            if j + 1 < len(down):
                heapq.heappush(heap, (-(a[up[i]] + b[down[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(up):
                heapq.heappush(heap, (-(a[up[i + 1]] + b[down[0]]), i + 1, 0))
        return out

    def visits(self, q: np.ndarray, bars: np.ndarray, step: int) -> Iterator[np.ndarray]:
        """Blocks that each query calls on in a round: in round 0 those of its first cells, then those of cells that come up to the bar and to the round's entries, but for earlier rounds' blocks."""
        a, b = self.reaches(q)
        full = np.flatnonzero(self.counts)
        slack = EDGE * np.linalg.norm(q, axis=1) * (np.abs(np.concatenate(self.centroids, axis=None)).max(initial=0) + max(r.max(initial=0) for r in self.radii) + 1) * q.shape[1]
        for i in range(len(q)):
            start = self.spread(self.begin(a[i], b[i]))
            if not step:
                yield start
                continue
            sums = a[i][full // self.k] + b[i][full % self.k]
            order = np.argsort(-sums, kind="stable")
            seen = np.cumsum(self.counts[full[order]]) - self.counts[full[order]]
            earlier, now = (int(np.searchsorted(seen, FIRST * WIDER**k)) for k in (step - 1, step))
            now = min(now, int(np.searchsorted(-sums[order], slack[i] - bars[i], side="right")))
            before = start if step == 1 else np.union1d(start, self.spread(full[order[:earlier]]))
            yield np.setdiff1d(self.spread(full[order[:now]]), before)

    def spread(self, cells) -> np.ndarray:
        """Blocks of cells, each once."""
        cells = np.asarray(cells, np.int64)
        many = self.many[cells]
        return np.unique(np.repeat(self.first[cells] - offsets_of(many)[:-1], many) + np.arange(many.sum()))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    return np.add.accumulate(q * x, axis=1)[:, -1]


def rerank(q: np.ndarray, x: np.ndarray, count: int, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, product) of each query's `count` largest products that come up to its bar, and of those that tie with the last or nearly so."""
    sums = q @ x.T
    at = max(0, len(x) - count)
    bar = np.maximum(np.partition(sums, at, axis=1)[:, at], bars)
    edge = EDGE * len(x[0]) * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    i, j = np.nonzero(sums >= (bar - edge)[:, None])
    return i, j, products(q[i], x[j])


def search(vectors: DataFrame, count: int = 20, every: int = 20, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the `count` rows of largest inner product for each row whose key is divisible by `every`.

    Candidates are all rows but the query's own; with fewer of them, all are returned. Nearest first, ties to the
    smaller key. score is the inner product in double precision of the vectors as they came. A vector that is null,
    empty, zero or holds null or non-finite components takes no part, nor does a row with a null key. A shorter vector
    counts as padded with zeros. Rows that repeat key and vector are one; a key with several vectors is as many rows.
    An empty table gives no rows. Other columns are ignored, whatever their names.

    Equal vectors are one entry with their `count` + 1 smallest keys, and are searched for once. Centroids are fitted
    to about SAMPLE vectors, chosen by hash; every vector is indexed. The driver and each worker hold centroids and one
    count a cell, at most MOST squared. Entries of a cell larger than a block are dealt to several; queries travel in
    groups, one row for each block that the group calls on. Where no bar excludes a cell (vectors spread evenly over a
    sphere), queries meet all entries in blocks.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(vectors[key].cast("long").alias("k"), vectors[vector].cast("array<double>").alias("e")).where("k IS NOT NULL")
    width = max(base.agg(F.max(F.size("e"))).first()[0] or 0, 1)
    some = count + 1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, good = padded(part.column("e"), width)
                yield pa.RecordBatch.from_arrays([part.column("k").filter(pa.array(good)), pa.array(packed(x[good]), pa.binary())], ["k", "v"])

    rows = stored(base.mapInArrow(clean, "k long, v binary").distinct(), "vectors")
    asks = rows.where(F.col("k") % every == 0)
    # the smallest keys of a vector: windows keep that many in each task before they shuffle
    few = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("k"))).where(F.col("nth") <= some)
    keys = few.groupBy("v").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    asked = asks.groupBy("v").agg(F.count("*").alias("n"))
    reps = stored(keys.join(asked, "v", "left").select(F.monotonically_increasing_id().alias("id"), "v", "ks", "n"), "reps")
    total = reps.count()
    if not total:
        return rows.select(F.col("k").alias("query_id"), F.lit(0).alias("rank"), F.col("k").alias(key), F.lit(0.0).alias("score")).where("false")
    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    near = reps.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / total) * (1 << 30)) + 1)).orderBy(F.xxhash64("v"), "v").select("v").toArrow()
    sample = unpacked(near.column("v"), width)
    if not len(sample):
        sample = unpacked(reps.select("v").limit(1).toArrow().column("v"), width)
    k, half = min(MOST, max(1, int(np.ceil(np.sqrt(total / PER_CELL)))), len(sample)), (width + 1) // 2
    index = Index((fitted(sample[:, :half], k), fitted(sample[:, half:], k if width > 1 else 1)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, r1, r2 = index.cells(unpacked(batch.column("v"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r1), pa.array(r2)], [*batch.schema.names, "cell", "r1", "r2"])

    entries = stored(reps.mapInArrow(assign, "id long, v binary, ks array<long>, n long, cell long, r1 double, r2 double"), "entries")
    counts, radii = np.zeros(len(index.centroids[0]) * index.k, np.int64), (np.zeros(len(index.centroids[0])), np.zeros(index.k))
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toLocalIterator():  # one row a cell
        counts[r.cell] = r.n
        i, j = divmod(r.cell, index.k)
        radii[0][i], radii[1][j] = max(radii[0][i], r.r1), max(radii[1][j], r.r2)
    index.lay_out(counts, radii, max(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    shared = spark.sparkContext.broadcast(index)  # at most MOST squared counts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = shared.value.blocks(batch.column("cell").to_numpy(), batch.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(block), *(batch.column(c) for c in ("id", "ks", "n", "v"))], ["block", "id", "ks", "n", "v"])

    placed = stored(entries.mapInArrow(place, "block long, id long, ks array<long>, n long, v binary"), "placed")

    def side(table: pa.Table) -> pa.Table:
        """A block as one row."""
        x = unpacked(table.column("v").combine_chunks(), width)
        return pa.table({"block": table.column("block")[:1], "ids": [table.column("id").to_numpy().tobytes()], "ks": [table.column("ks").to_pylist()], "vs": [x.tobytes()]}, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("ks", pa.list_(pa.list_(pa.int64()))), ("vs", pa.binary())]))

    def caller(step: int):
        def call(table: pa.Table) -> pa.Table:
            """A block's queries, as one row for each block that some of them call on."""
            q, ids, bars = unpacked(table.column("v").combine_chunks(), width), table.column("id").to_numpy(), table.column("bar").to_numpy()
            where = list(shared.value.visits(q, bars, step))
            who, block = np.repeat(np.arange(len(q)), [len(w) for w in where]), np.concatenate(where)
            order = np.argsort(block, kind="stable")
            who, block = who[order], block[order]
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))[: len(block)]
            parts = np.split(who, cuts[1:]) if len(block) else []
            return pa.table({"block": pa.array(block[cuts], pa.int64()), **{n: pa.array([x[p].tobytes() for p in parts], pa.binary()) for n, x in (("queries", ids), ("bars", bars), ("qs", q))}})

        return call

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                of = lambda c, kind, n=n, batch=batch: np.frombuffer(batch.column(c)[n].as_buffer(), kind)
                x, q, ids, queries, bars = of("vs", float).reshape(-1, width), of("qs", float).reshape(-1, width), of("ids", np.int64), of("queries", np.int64), of("bars", float)
                ks = batch.column("ks")[n].values
                for at in range(0, len(q), AT_ONCE):
                    i, j, score = rerank(q[at : at + AT_ONCE], x, some, bars[at : at + AT_ONCE])
                    yield pa.RecordBatch.from_arrays([pa.array(queries[at + i]), pa.array(ids[j]), ks.take(pa.array(j)), pa.array(score)], ["query", "id", "ks", "score"])
        release()

    sides = stored(placed.groupBy("block").applyInArrow(side, "block long, ids binary, ks array<array<long>>, vs binary"), "sides")
    queries = placed.where("n IS NOT NULL").select("block", "id", "v")
    best = W.partitionBy("query").orderBy(F.desc("score"), F.get("ks", F.lit(0)), "id")
    top, step = None, 0
    while True:
        if top is None:
            asking = queries.withColumn("bar", F.lit(float("-inf")))
        else:
            bar = top.groupBy("query").agg(F.when(F.count("*") >= some, F.min("score")).otherwise(float("-inf")).alias("bar"))
            asking = queries.join(bar.withColumnRenamed("query", "id"), "id")
        calls = stored(asking.groupBy("block").applyInArrow(caller(step), "block long, queries binary, bars binary, qs binary"), "calls")
        if top is not None and calls.isEmpty():
            break
        found = sides.join(calls, "block").mapInArrow(meet, "query long, id long, ks array<long>, score double")
        found = found if top is None else top.unionByName(found)
        top = stored(found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= some).drop("nth"), "top")
        if FIRST * WIDER**step >= total:
            break
        step += 1
    top = top.select("query", "id", "score", F.explode("ks").alias("k"))
    # of their keys, as many again, and the queries' rows find the list of their vector
    order = F.struct((-F.col("score")).alias("s"), "k", "id", "score")
    lists = top.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(order)), 1, some).alias("xs"))
    lists = lists.join(reps.where("n IS NOT NULL").select(F.col("id").alias("query"), "v", "n"), "query")
    out = salted_join(asks, lists, "v", "n", ["k"])
    xs = F.slice(F.filter("xs", lambda x: (x["k"] != F.col("k")) | (x["id"] != F.col("query"))), 1, count)
    out = out.select(F.col("k").alias("query_id"), F.posexplode(xs).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.k").alias(key), F.col("x.score").alias("score"))
