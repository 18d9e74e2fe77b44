"""Substring dedup by longest previous factors over a distributed, sparse suffix array.

Two equal stretches of `length` bytes share an anchor: a place whose 64-byte hash is the least in a window,
chosen by content only, at the same offset in both. So a suffix meets all its matches of `length` bytes in the
bucket of its anchor. There, suffixes are sorted by their bytes: first the ones that start at the anchors, then,
byte by byte to the left, those before them, each from its own first byte and the rank of the suffix that
follows. Neighbours that agree on `length` bytes form plateaus of the longest-common-prefix array; a suffix's
previous and next smaller places (of document, then offset) within its plateau are its earlier matches, so its
longest previous factor reaches `length` if it has either.

`keep="first"` removes what has an earlier match; `keep="none"` removes every copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, salted_join, ship, stored, text_slices

GRAM = 64
#: Anchors' buckets above this many places are ordered by a shuffle on the prefix hash instead of in one task.
LARGE = 20_000

_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_STEP, _BLOCK = 1 << 16, 1 << 22
_UP, _DOWN = _powers(_STEP, _BASE), _powers(_STEP, pow(_BASE, -1, 1 << 64))


def _scaled(values: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """values[i] * base**i."""
    if len(values) <= _STEP:
        return values * table[: len(values)]
    outer = np.repeat(_powers(-(-len(values) // _STEP), pow(base, _STEP, 1 << 64)), _STEP)[: len(values)]
    return values * np.tile(table, -(-len(values) // _STEP))[: len(values)] * outer


class Rolling:
    """Hashes of all stretches of any width of a byte string."""

    def __init__(self, data: np.ndarray, table: int = 0) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_scaled(_BYTES[table][data], _UP, _BASE), out=self.sums[1:])

    def of(self, width: int) -> np.ndarray:
        x = _scaled(self.sums[width:] - self.sums[:-width], _DOWN, pow(_BASE, -1, 1 << 64))
        x = (x ^ x >> np.uint64(30)) * _M1
        x = (x ^ x >> np.uint64(27)) * _M2
        return x ^ x >> np.uint64(31)


def least_places(values: np.ndarray, window: int) -> np.ndarray:
    """For each window its leftmost least value's place."""
    best, span = values, 1
    at = np.arange(len(values), dtype=np.int64)
    while span * 2 <= window:
        a, b = best[:-span], best[span:]
        right = b < a
        best, at = np.where(right, b, a), np.where(right, at[span:], at[:-span])
        span *= 2
    if span < window:
        shift = window - span
        a, b = best[: len(best) - shift], best[shift:]
        at = np.where(b < a, at[shift:], at[: len(at) - shift])
    return at


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of each stretch of `length` bytes, distinct anchors, their hashes); long texts are done in blocks."""
    at, places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for begin in range(0, len(data) - length + 1, _BLOCK):
        grams = Rolling(data[begin : begin + _BLOCK + length - 1]).of(GRAM)
        own = least_places(grams, length - GRAM + 1)
        some = own[np.append(True, own[1:] != own[:-1])]
        at.append(own + begin)
        places.append(some + begin)
        found.append(grams[some])
    places, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(at), places, np.concatenate(found)[first]


def sorted_suffixes(bucket: np.ndarray, lead: np.ndarray, offset: np.ndarray, count: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the stretches of some contexts: (context, offset of the stretch in it), one bucket and lead after the other.

    A context has `count` stretches from data[offset] on; its anchor stands at data[offset + lead]. Equal suffixes
    keep the order of their contexts.
    """
    m = len(bucket)
    low = lead - count + 1  # the anchor's offset in the last stretch, so `length - low` bytes are known from the anchor on
    known = length - low
    cells = np.zeros((m, 4 + length), np.uint8)
    cells[:, :4] = bucket.astype(">u4").view(np.uint8).reshape(m, 4)
    cells[np.repeat(np.arange(m), known), 4 + gather(np.zeros(m, np.int64), known)] = data[gather(offset + lead, known)]
    rank = np.empty(m, np.int64)
    rank[np.argsort(cells.view(f"S{4 + length}").ravel(), kind="stable")] = np.arange(m)
    major, live = bucket.astype(np.int64) * 256, np.arange(m)
    contexts, inner = [], []
    for depth in range(int(lead.max(initial=-1)) + 1):
        if depth:
            live = live[lead[live] >= depth]
        key = rank[live] if not depth else (major[live] + data[offset[live] + lead[live] - depth]) * m + rank[live]
        order = live[np.argsort(key, kind="stable")]
        rank[order] = np.arange(len(order))
        order = order[low[order] <= depth]
        contexts.append(order)
        inner.append(lead[order] - depth)
    return np.concatenate([np.empty(0, np.int64), *contexts]), np.concatenate([np.empty(0, np.int64), *inner])


def plateaus(at: np.ndarray, group: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix but the first agrees with the one before it in suffix order, in its group, on `length` bytes."""
    if len(at) < 2:
        return np.zeros(0, bool)
    windows, kind = np.lib.stride_tricks.sliding_window_view(data, length), np.uint64 if length % 8 == 0 else np.uint8
    same = group[1:] == group[:-1]
    for begin in range(0, len(at) - 1, 1 << 14):
        rows = windows[at[begin : begin + (1 << 14) + 1]].view(kind)
        same[begin : begin + len(rows) - 1] &= (rows[1:] == rows[:-1]).all(1)
    return same


def smaller_neighbours(place: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a previous, and a next, suffix of the same plateau has a smaller place; places are not negative."""
    n = len(place)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    plateau = np.cumsum(np.append(True, ~same))
    step = int(place.max()) + 1
    before = np.minimum.accumulate(place - plateau * step)  # a new plateau is below all that came before
    after = np.minimum.accumulate((place + plateau * step)[::-1])[::-1]
    previous = np.append(False, same & (before[:-1] < (place - plateau * step)[1:]))
    following = np.append(same & (after[1:] < (place + plateau * step)[:-1]), False)
    return previous, following


def unpacked(value: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer())


def repeated_spans(docs: DataFrame, length: int = 200, keep: str = "none", text: str = "text", key: str = "doc_id", large: int = LARGE) -> DataFrame:
    """Rows (row, key, data binary (zstd), starts array<long>, ends array<long>): each text's bytes and its removed runs.

    A byte is removed if a stretch of `length` bytes that covers it also starts elsewhere (keep="none"), or starts
    earlier, in order of (row, place) (keep="first"); a row's number follows the order of the table's files. The same
    document counts, and stretches may overlap. Matches never cross documents. Null text is empty; repeated rows
    are copies of each other; keys may be null or repeat; other columns are ignored. length is 80 to 1000.

    A very long text is one row; its anchors are found in blocks. An empty table gives no rows.

    Shuffles: the texts once (by row, read again in place), anchors' hashes for counting (combined before the
    shuffle), anchors that repeat with up to 2 * length bytes around them. Anchors that repeat too often for one
    task go through a shuffle on 128 bits of prefix hashes, combined before it; there, equal hashes stand for equal bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(key).schema[0].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in text_slices(batches, "text"):
            data = [press.compress(x.encode()) for x in part.column("text").to_pylist()]
            sizes = pc.binary_length(part.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), sizes, pa.array(data, pa.binary())], ["row", "k", "n", "data"])

    table = stored(source.mapInArrow(squeeze, f"row long, k {kind}, n long, data binary"), "texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "data", 1 << 20):
            row, place, found = [], [], []
            for i, r in enumerate(part.column("row").to_pylist()):
                _, at, grams = anchors(np.frombuffer(unpacked(part.column("data")[i]), np.uint8), length)
                row.append(np.full(len(at), r))
                place.append(at)
                found.append(grams.view(np.int64))
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in (found, row, place)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "row", "place"])

    every = table.where(F.col("n") >= length).select("row", "data").mapInArrow(find, "h long, row long, place long")
    repeats = stored(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeats")
    again = salted_join(every, repeats, "h", "n", ["row", "place"]).select("row", "place", "h", (F.col("n") > large).alias("large"))
    lists = stored(again.groupBy("row").agg(F.collect_list(F.struct("place", "h", "large")).alias("anchors")), "anchors")

    def contexts(large: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Bytes of the stretches that have a repeated anchor as theirs: they start at consecutive places."""
            for part in text_slices(batches, "data", 1 << 19):
                out: list[list] = [[] for _ in range(5)]
                for i, r in enumerate(part.column("row").to_pylist()):
                    raw = unpacked(part.column("data")[i])
                    at, _, _ = anchors(np.frombuffer(raw, np.uint8), length)
                    wanted = part.column("anchors")[i].values
                    own = wanted.field("large").to_numpy(zero_copy_only=False) == large
                    places, grams = wanted.field("place").to_numpy()[own], wanted.field("h").to_numpy()[own]
                    low, high = np.searchsorted(at, places, "left"), np.searchsorted(at, places, "right")
                    for p, h, a, b in zip(places.tolist(), grams.tolist(), low.tolist(), high.tolist(), strict=True):
                        for column, value in zip(out, (h, r, a, p - a, raw[a : b - 1 + length]), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["h", "row", "start", "lead", "bytes"])

        some = lists if not large else lists.where(F.exists("anchors", lambda x: x["large"]))
        return table.select("row", "data").join(some, "row").mapInArrow(run, "h long, row long, start long, lead int, bytes binary")

    def laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(all contexts' bytes in a row, where each begins and the last ends)."""
        column = pa.concat_arrays([batch.column("bytes").cast(pa.large_binary())])
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]

    def prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(batch row, place in the document, two hashes of the first `length` bytes with the anchor's mixed in) of every stretch."""
        data, offsets = laid_out(batch)
        grams = batch.column("h").to_numpy().view(np.uint64)
        counts = np.diff(offsets) - length + 1
        at = gather(offsets[:-1], counts)
        which = np.repeat(np.arange(len(counts)), counts)
        inner = at - offsets[:-1][which]
        lead = batch.column("lead").to_numpy().astype(np.uint64)[which] - inner.astype(np.uint64)  # the anchor's offset in the stretch
        first, second = Rolling(data).of(length)[at], Rolling(data, 1).of(length)[at]
        return which, batch.column("start").to_numpy()[which] + inner, first ^ (grams[which] * _M1) ^ (lead * _M2), second

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of whole buckets: sorted by anchor, cut where the anchor changes."""
        held: list[pa.RecordBatch] = []

        def resolve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            batch = pa.Table.from_batches(parts).combine_chunks().sort_by([("row", "ascending"), ("start", "ascending")]).combine_chunks().to_batches()[0]
            data, offsets = laid_out(batch)
            row, start = batch.column("row").to_numpy(), batch.column("start").to_numpy()
            lead, count = batch.column("lead").to_numpy().astype(np.int64), np.diff(offsets) - length + 1
            bucket = np.unique(batch.column("h").to_numpy(), return_inverse=True)[1]
            context, inner = sorted_suffixes(bucket, lead, offsets[:-1], count, data, length)
            same = plateaus(offsets[context] + inner, bucket[context] * length + lead[context] - inner, data, length)
            if keep == "first":
                previous, following = smaller_neighbours(context * length + inner, same)
                good = previous | following
            else:
                good = np.append(False, same) | np.append(same, False) if len(context) else same
            context, inner = context[good], inner[good]
            return runs(row[context], start[context] + inner)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            change = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            if held and h[0] != held[-1].column("h")[-1].as_py() and size > 4000:
                yield resolve(held)
                held, size = [], 0
            at = 0
            for cut in change.tolist()[1:]:
                if size + cut - at > 4000:
                    yield resolve([*held, batch.slice(at, cut - at)])
                    held, size, at = [], 0, cut
            held.append(batch.slice(at))
            size += batch.num_rows - at
        if held:
            yield resolve(held)

    def runs(row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """Matched places as runs of consecutive ones."""
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        first = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)) if len(row) else np.empty(0, bool)
        last = np.append(first[1:], True) if len(row) else first
        return pa.RecordBatch.from_arrays([pa.array(row[first], pa.int64()), pa.array(place[first], pa.int64()), pa.array(place[last], pa.int64())], ["row", "a", "b"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                which, place, first, second = prefixes(part)
                columns = [pa.array(x.view(np.int64)) for x in (first, second)] + [pa.array(part.column("row").to_numpy()[which]), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["f", "g", "row", "place"])

    found = contexts(False).repartition("h").sortWithinPartitions("h").mapInArrow(in_task, "row long, a long, b long")
    if lists.where(F.exists("anchors", lambda x: x["large"])).limit(1).count():
        many = contexts(True).mapInArrow(spread, "f long, g long, row long, place long")
        groups = many.groupBy("f", "g").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("first")).where("n > 1")
        many = salted_join(many, stored(groups.withColumnRenamed("g", "g2"), "prefixes"), "f", "n", ["row", "place"]).where("g = g2")
        if keep == "first":
            many = many.where("first.row <> row OR first.place <> place")
        found = found.unionByName(many.selectExpr("row", "place AS a", "place AS b"))
    marks = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("marks"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "data"):
            starts, ends = [], []
            for marks in part.column("marks").to_pylist():
                own_a, own_b = [], []
                for m in marks or ():
                    if own_a and m["a"] <= own_b[-1]:
                        own_b[-1] = max(own_b[-1], m["b"] + length)
                    else:
                        own_a.append(m["a"])
                        own_b.append(m["b"] + length)
                starts.append(own_a)
                ends.append(own_b)
            columns = [part.column("row"), part.column("k"), part.column("data"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", key, "data", "starts", "ends"])

    return table.join(marks, "row", "left").select("row", "k", "data", "marks").mapInArrow(
        merge, f"row long, `{key}` {kind}, data binary, starts array<long>, ends array<long>"
    )


def remove_spans(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (row, key, n_bytes, n_removed, n_spans, kept binary) of repeated_spans' rows: the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "data", 2 << 20):
            kept, removed, count = [], [], []
            for i in range(part.num_rows):
                data, at, out = unpacked(part.column("data")[i]), 0, []
                starts, ends = part.column("starts")[i].as_py(), part.column("ends")[i].as_py()
                for a, b in zip(starts, ends, strict=True):
                    out.append(data[at:a])
                    at = b
                kept.append(b"".join([*out, data[at:]]))
                removed.append(len(data) - len(kept[-1]))
                count.append(len(starts))
            n = [len(k) + r for k, r in zip(kept, removed, strict=True)]
            columns = [part.column("row"), part.column(key), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", key, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = found.select(key).schema[0].dataType.simpleString()
    return found.mapInArrow(run, f"row long, `{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
