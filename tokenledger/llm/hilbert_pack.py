"""Packing along a space-filling curve: similar documents share training sequences.

A document's hashed bag of ids is projected to three dimensions, its place on a Hilbert curve is its sort
key, and the range-sorted documents are laid end to end and cut every `size` ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import word_level
from .common import offsets_of, ship, stored, text_slices, texts_of

DIMENSIONS, BITS, SEED = 3, 16, 20250


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of rows of non-negative integers below 2**bits (dimensions * bits < 64)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations and reflections, from the highest bit down
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def directions(vocabulary: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A random direction for each id, one row a dimension."""
    return np.ascontiguousarray(np.random.default_rng(SEED).standard_normal((vocabulary, dimensions)).astype(np.float32).T)


def projected(ids: np.ndarray, offsets: np.ndarray, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Points on a grid: mean of the ids' random directions, spread by the arc tangent."""
    counts = np.diff(offsets)
    sums = np.zeros((len(counts), len(table)))
    some = np.flatnonzero(counts)
    for d, row in enumerate(table):
        if len(some):
            sums[some, d] = np.add.reduceat(row[ids], offsets[some], dtype=np.float64)
    unit = sums / np.maximum(1, counts)[:, None]
    return np.clip((np.arctan(4 * unit) / np.pi + 0.5) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def tail_cuts(total: int, size: int) -> list[int]:
    """Where the sequences after the last full one begin: the rest is cut at powers of two, so none needs padding."""
    at, out = total - total % size, []
    while at < total:
        out.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return out


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, start, length, doc_tokens, sequence_id, offset, ids binary), one for each piece of a document.

    A null or empty text has the end id only; a very long one is encoded whole and cut into many pieces; keys may
    be null or repeat, equal rows stay apart (the order of the table decides between them); an empty table gives
    no rows; other columns are ignored, whatever their names. Texts are encoded once, into a written table;
    ordering shuffles (curve key, key, row, count) only; the encoded rows are shuffled once, to meet their
    places. The driver holds one total per range partition.
    """
    spark = docs.sparkSession
    ship(spark)
    key_kind = docs.select(key).schema[0].dataType.simpleString()
    vocabulary = word_level(path).tokenizer.get_vocab_size()
    narrow = max(vocabulary, end_id) < 1 << 16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_level(path)
        table, kind = directions(vocabulary), np.dtype("<u2" if narrow else "<u4")
        for part in text_slices(batches, "text"):
            ids, offsets = own.batch(texts_of(part))
            keys = hilbert_keys(projected(ids, offsets, table))
            ids = np.insert(ids, offsets[1:], end_id).astype(kind)
            counts = np.diff(offsets) + 1
            places = offsets_of(counts) * kind.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(places), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [part.column("row"), part.column("k"), pa.array(keys), pa.array(counts), data]
            yield pa.RecordBatch.from_arrays(columns, ["row", "k", "curve", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("k"), docs[text].cast("string").alias("text"))
    encoded = stored(rows.mapInArrow(encode, f"row long, k {key_kind}, curve long, n long, ids binary"), "packed")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), pid, np.int32)), pa.array(ends - n), batch.column("n")], ["row", "pid", "before", "m"])
            before = int(ends[-1]) if len(n) else before

    sort = ["curve", "k", "row"]
    order = encoded.select(*sort, "n").repartitionByRange(*sort).sortWithinPartitions(*sort)
    order = stored(order.mapInArrow(place, "row long, pid int, before long, m long"), "places")
    bases, total = [], 0
    for r in order.groupBy("pid").agg(F.sum("m").alias("n")).orderBy("pid").collect():
        bases.append((r.pid, total))
        total += r.n
    frame = spark.createDataFrame(bases, "pid int, base long")
    placed = order.join(F.broadcast(frame), "pid").selectExpr("row", "base + before AS place")
    full, tail = total // size, tail_cuts(total, size)
    stops = np.array([*tail, total], np.int64)  # where the sequences after the full ones begin

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "ids"):
            place, n = (part.column(c).to_numpy() for c in ("place", "n"))

            def sequence(at: np.ndarray) -> np.ndarray:
                return np.where(at < full * size, at // size, full + np.searchsorted(stops, at, "right") - 1)

            def begins(which: np.ndarray) -> np.ndarray:
                return np.where(which < full, which * size, stops[np.clip(which - full, 0, len(stops) - 1)])

            first = sequence(place)
            pieces = sequence(place + n - 1) - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            which = first[doc] + np.arange(len(doc)) - offsets_of(pieces)[:-1][doc]
            begin, end = begins(which), begins(which + 1)
            low, high = np.maximum(begin, place[doc]), np.minimum(end, (place + n)[doc])
            # a document's pieces follow each other, so all ids keep their order
            raw = texts_of(part, "ids", pa.large_binary())
            ids = np.frombuffer(raw.buffers()[2], np.uint8)[: pc.sum(pc.binary_length(raw)).as_py()].view("<u2" if narrow else "<u4").astype("<u4")
            data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * offsets_of(high - low)), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [part.column("k").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (low - place[doc], high - low, n[doc], which, low - begin)), data]
            yield pa.RecordBatch.from_arrays(columns, [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return encoded.select("row", "k", "n", "ids").join(placed, "row").mapInArrow(
        cut, f"`{key}` {key_kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
