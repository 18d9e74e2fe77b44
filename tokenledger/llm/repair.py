"""Re-Pair grammar compression of token ids, in shards of consecutive documents.

A shard's sequence shrinks in rounds until no pair occurs `min_uses` times. In each round the adjacent pairs
inside documents are counted where they overlap none of their own, every pair that outranks both pairs it
overlaps is a candidate, and candidates that occur often enough become nonterminals. Rules keep their expansion
lengths, and documents keep their places in the shrunken sequence, so a document or a range of it is decoded
without the rest of its shard.

Blob layout, little-endian: 4 bytes `RPG1`; uint32 counts: documents, rules, rounds, symbols, first
nonterminal; then uint32 arrays: rules' left and right symbols, expansion lengths, last rule of each round,
documents' first symbols (one more than documents), documents' token counts; then the symbols.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_level
from .common import gather, merged, offsets_of, ship, stored, text_slices, texts_of

MAGIC = b"RPG1"
SHARD_TOKENS = 1 << 20
#: A rule takes 12 bytes in the blob and saves 4 at each use: from 4 uses on it pays.
MIN_USES = 4
_SLOTS = 1 << 20
#: Bytes of text encoded at once, and of chunks remembered: the more, the fewer are looked up or encoded again.
SLICE, CACHE = 10 << 20, 192 << 20


def compress(ids: np.ndarray, offsets: np.ndarray, min_uses: int = MIN_USES) -> bytes:
    """Blob of documents whose ids are ids[offsets[i]:offsets[i + 1]]."""
    counts = np.diff(offsets)
    first = int(ids.max()) + 1 if len(ids) else 0
    seq, ends = ids.astype(np.uint32), offsets.astype(np.int64)
    left, right, stops, made = [], [], [], 0
    lengths = np.ones(first, np.uint32)
    # places whose pair may be frequent: one found rare stays so, but beside new symbols there are new pairs
    inner = np.ones(len(seq), bool)
    inner[ends[1:][ends[1:] > 0] - 1] = False
    live, stuck = np.flatnonzero(inner), False
    while len(live):
        place = live
        pair = seq[place].astype(np.uint64) << np.uint64(32) | seq[place + 1]
        exact = stuck or len(place) <= 1 << 16
        mixed = pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
        if not exact:  # a hashed count is never below the pair's own
            slot = (mixed >> np.uint64(20)).astype(np.int64)
            table = np.bincount(slot, minlength=_SLOTS)
            enough = np.flatnonzero((table >= min_uses)[slot])
            place, pair, mixed, times = place[enough], pair[enough], mixed[enough], table[slot[enough]]
            live = place
        if not len(place):
            break
        # every second pair in a run of one symbol overlaps the one before
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1] + 1) | (pair[1:] != pair[:-1])
        apart = fresh
        if not fresh.all():
            apart = (np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))) % 2 == 0
        if exact:
            names, which = np.unique(pair, return_inverse=True)
            times = np.bincount(which[apart], minlength=len(names))[which]
            live = place[times >= min_uses]
        best = apart & (times >= min_uses)
        place, pair, rank = place[best], pair[best], times[best].astype(np.uint64) << np.uint64(40) | mixed[best]
        # a candidate outranks the pairs that it overlaps
        best = np.ones(len(place), bool)
        beside = place[1:] == place[:-1] + 1
        best[1:] = ~beside | (rank[1:] > rank[:-1])
        best[:-1] &= ~beside | (rank[:-1] >= rank[1:])
        at = place[best]
        pairs, which, uses = np.unique(pair[best], return_inverse=True, return_counts=True)
        good = uses >= min_uses
        if not good.any():
            if exact:
                break
            stuck = True
            continue
        stuck = False
        at = at[good[which]]
        symbols = (np.cumsum(good) - 1 + first + made).astype(np.uint32)
        seq[at] = symbols[which[good[which]]]
        keep, inner = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        keep[at + 1] = False
        for some in (live, at, np.maximum(at - 1, 0)):
            inner[some] = True
        ends = ends - np.searchsorted(at + 1, ends)
        seq, inner = seq[keep], inner[keep]
        inner[ends[1:][ends[1:] > 0] - 1] = False
        live = np.flatnonzero(inner)
        x, y = (pairs[good] >> np.uint64(32)).astype(np.uint32), (pairs[good] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        lengths = np.concatenate([lengths, lengths[x] + lengths[y]])
        left.append(x)
        right.append(y)
        made += len(x)
        stops.append(made)
    head = struct.pack("<5I", len(counts), made, len(stops), len(seq), first)
    arrays = [*left, *right, lengths[first:], np.array(stops), ends, counts, seq]
    return MAGIC + head + b"".join(np.ascontiguousarray(x, np.dtype("<u4")).tobytes() for x in arrays)


class Shard:
    """A parsed blob."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, rules, rounds, symbols, self.first = struct.unpack_from("<5I", blob, 4)
        data, at = np.frombuffer(blob, "<u4", offset=24), 0

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return data[at - n : at]

        self.left, self.right, self.expands, self.stops = take(rules), take(rules), take(rules), take(rounds)
        self.ends, self.counts, self.symbols = take(docs + 1).astype(np.int64), take(docs), take(symbols)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, offsets of the documents).

        All symbols are expanded first, a round at a time: a rule's sides are terminals or rules of earlier rounds.
        """
        lengths = np.concatenate([np.ones(self.first, np.int64), self.expands.astype(np.int64)])
        starts = offsets_of(lengths)[:-1]
        flat = np.empty(int(lengths.sum()), np.uint32)
        flat[: self.first] = np.arange(self.first)
        begin = 0
        for stop in self.stops.tolist():
            sides = np.stack([self.left[begin:stop], self.right[begin:stop]], 1).ravel()
            found = flat[gather(starts[sides], lengths[sides])]
            to = int(starts[self.first + begin])
            flat[to : to + len(found)] = found
            begin = stop
        return flat[gather(starts[self.symbols], lengths[self.symbols])], offsets_of(self.counts)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a few symbols: each rule that they reach gives its two sides, until only terminals are left."""
        while (rules := symbols >= self.first).any():
            at = offsets_of(1 + rules.astype(np.int64))[:-1][rules]
            own = symbols[rules] - self.first
            symbols = np.repeat(symbols, 1 + rules)
            symbols[at], symbols[at + 1] = self.left[own], self.right[own]
        return symbols.astype(np.uint32)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of the i-th document; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.ends[i] : self.ends[i + 1]]
        rules = symbols >= self.first
        lengths = np.ones(len(symbols), np.int64)
        lengths[rules] = self.expands[symbols[rules] - self.first]
        places = offsets_of(lengths)
        stop = int(places[-1]) if stop is None else min(stop, int(places[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = int(np.searchsorted(places, start, "right")) - 1, int(np.searchsorted(places, stop, "left"))
        return self._expand(symbols[a:b])[start - places[a] : stop - places[a]]


def write_shards(docs: DataFrame, path: str, end_id: int = 0, text: str = "text", key: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts, append end_id, and write shards in ascending key order (null first).

    The file's added tokens in a text give their own ids. A null or empty text has the end id only; a very long one has a shard of its own. Rows with the same key stay
    apart, also if they are equal. An empty table gives no shards. Other columns are ignored, whatever their names.
    One range shuffle of the texts; a task holds one shard (shard_tokens, or one longer document) at a time.
    Returns the written table: pid (range), nth, before (ids before the shard in its range), n_tokens,
    keys array, blob.
    """
    ship(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    ordered = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    # rows of one key, or of none, may lie in several ranges
    ordered = ordered.repartitionByRange("k", "row").sortWithinPartitions("k", "row").drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pid = byte_level(path), TaskContext.get().partitionId()
        own.cache = CACHE
        nth = before = held = 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth, before, held, keys, ids, sizes
            every, counts = np.concatenate(ids), np.concatenate(sizes)
            names = pa.concat_arrays(keys)
            blob = compress(every, offsets_of(counts))
            row = [pa.array([pid], pa.int32()), pa.array([nth], pa.int32()), pa.array([before], pa.int64()), pa.array([len(every)], pa.int64())]
            row += [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([blob], pa.binary())]
            nth, before, held, keys, ids, sizes = nth + 1, before + len(every), 0, [], [], []
            return pa.RecordBatch.from_arrays(row, ["pid", "nth", "before", "n_tokens", "keys", "blob"])

        for part in text_slices(merged(batches, "text", SLICE), "text", SLICE):
            flat, offsets = own.batch(texts_of(part))
            at = 0
            counts = np.diff(offsets) + 1
            places = offsets_of(counts)
            every = np.full(places[-1], end_id, np.uint32)
            inner = np.ones(len(every), bool)
            inner[places[1:] - 1] = False
            every[inner] = flat
            flat = every
            while at < part.num_rows:
                to = max(at + (not held), int(np.searchsorted(places, places[at] + shard_tokens - held, "right")) - 1)
                if to > at:
                    keys.append(part.column("k").slice(at, to - at))
                    ids.append(flat[places[at] : places[to]])
                    sizes.append(counts[at:to])
                    held += int(places[to] - places[at])
                if to < part.num_rows or held >= shard_tokens:
                    yield flush()
                at = to
        if held:
            yield flush()

    return stored(ordered.mapInArrow(run, f"pid int, nth int, before long, n_tokens long, keys array<{kind}>, blob binary"), "repair")


def read_shards(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, start long, ids binary) decoded from the written shards, none from none; ids are little-endian uint32.

    Repeated rows and rows without a key come back as often as they were written.

    start counts the ids of all documents before this one in key order. Ranges' totals (one number per range
    partition) are summed in order; each row then needs its own shard only.
    """
    ship(shards.sparkSession)
    spark = shards.sparkSession
    kind = shards.schema["keys"].dataType.elementType.simpleString()
    totals = shards.groupBy("pid").agg(F.sum("n_tokens").alias("n")).orderBy("pid").collect()
    bases, base = [], 0
    for row in totals:
        bases.append((row.pid, base))
        base += row.n
    frame = spark.createDataFrame(bases, "pid int, base long")
    placed = shards.join(F.broadcast(frame), "pid").selectExpr("base + before AS start", "keys", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("blob")[i].as_py())
                ids, offsets = shard.tokens()
                raw = pa.py_buffer(ids.astype("<u4"))
                keys = batch.column("keys")[i].values
                for at in range(0, len(keys), 2048):
                    own = offsets[at : at + 2049]
                    data = pa.Array.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(own * 4), raw]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([keys.slice(at, 2048), pa.array(own[:-1] + batch.column("start")[i].as_py()), data], [key, "start", "ids"])

    return placed.mapInArrow(run, f"`{key}` {kind}, start long, ids binary")
