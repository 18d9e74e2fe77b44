"""LM scoring by online logistic context mixing.

A document is coded word by word, with three kinds of predictors.

Segments: after some triples of words (every SPARSE-th by hash) the corpus may know how the text goes on, up to the
next such triple. One bit says whether it goes on in a known way; predictors of that bit (the triple's counts in
the training documents, the hits so far in this document) are combined in the logistic domain by weights that a
gate selects and that are learned online, bit after bit, in each document. A hit codes all of the segment's words.

Words: what no segment codes is a mix of four predictors, by training frequency, by the document's own words
so far, by its words so far after the same word, and by spelling; the mix's weights follow the words coded so far.

Spelling: byte by byte, a byte bit by bit. Predictors are hashed contexts (the last one to four bytes of the word)
with counts of zeros and ones over all training words; their stretched probabilities are summed with weights that
the counts' confidence selects (the gate), learned online, word after word, own occurrences left out.

The corpus is dealt into chunks of documents. A chunk sends its distinct words and segments with counts, its
spelling counts and its weights; it gets back the totals of the words and segments that it has. No vocabulary is
collected: words and segments grow with the corpus, only the spelling tables have a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import offsets_of, salted_join, ship, stored, text_slices

#: Bytes of text per chunk, bits of each order's table of counts, gates (confidence of orders 3 and 4, 5 levels each).
CHUNK, TABLE_BITS, LEVELS = 20 << 20, (16, 18, 19, 20), 5
#: Learning: rate of the weights, bytes per step; words per refinement, the mix's first weights (spelling, training
#: words, own words, own words after the same word) and their strength in words.
RATE, STEP, REFINE, START, STRENGTH = 0.1, 2048, 32, (0.1, 0.6, 0.15, 0.15), 16.0
#: One in SPARSE triples of words begins a segment; rate and first weights (counts, hits so far, bias) of its bit.
SPARSE, SEGMENT_RATE, SEGMENT_START = 32, 0.05, (0.5, 0.5, 0.0)
#: Spelling tables are summed in so many parts, and so many chunks (or sums) at a time.
PARTS, FAN = 16, 32
#: Words whose decisions are held at once, and while learning (more are mixed better); bytes of text split at
#: once; tokens refined at once (or one document's).
PART, LEARN, SLICE, TOKENS = 8_000, 20_000, 2 << 20, 1 << 18
_SIZES = [1 << b for b in TABLE_BITS]
_STARTS = np.concatenate([[0], np.cumsum(_SIZES)])


class Nodes:
    """The binary decisions of some words: table places for each order and bits, one row of eight for each byte.

    Words that begin alike share their first bytes' decisions: words must be in order, and a word adds only
    the bytes after what it shares with the one before. `source` has each byte's row, shared ones included.
    """

    SHARED = 48

    def __init__(self, words: list[str] | pa.Array) -> None:
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
        raw = pc.binary_join_element_wise(words, *(pa.scalar(x, pa.large_string()) for x in ("", " ")))  # each word and a space
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
        sizes, starts = np.diff(ends), ends[:-1] - ends[0]
        self.word = np.repeat(np.arange(len(words)), sizes)
        within = np.arange(len(data)) - starts[self.word]
        common = np.zeros(len(words), np.int64)
        open_ = np.arange(1, len(words))
        for d in range(self.SHARED):
            open_ = open_[np.minimum(sizes[open_], sizes[open_ - 1]) > d]
            open_ = open_[data[starts[open_] + d] == data[starts[open_ - 1] + d]]
            common[open_] = d + 1
        place = np.arange(len(data))
        for d in range(int(common.max(initial=0))):
            owner = np.maximum.accumulate(np.where(common <= d, np.arange(len(words)), 0))
            shared = np.flatnonzero(common > d)
            place[starts[shared] + d] = starts[owner[shared]] + d
        own = place == np.arange(len(data))
        self.source = (np.cumsum(own) - 1)[place]
        context, history = [], np.zeros(len(data), np.uint32)
        for k in range(1, 5):
            last = np.zeros(len(data), np.uint32)
            last[k:] = data[:-k]
            last[within < k] = 0
            history = history << np.uint32(8) | last
            context.append(history[own])
        data = data[own]
        depth = np.arange(8, dtype=np.uint32)
        node = np.uint32(1) << depth | data[:, None] >> (np.uint32(8) - depth)
        self.bits = (data[:, None] >> (np.uint32(7) - depth) & np.uint32(1)).astype(np.int8)
        self.slots = [context[0][:, None] << np.uint32(8) | node]
        for k in (1, 2, 3):
            h = (context[k] * np.uint32(0x9E3779B1))[:, None] ^ node * np.uint32(0x85EBCA6B)
            h = (h ^ h >> np.uint32(15)) * np.uint32(0xC2B2AE35)
            self.slots.append((h >> np.uint32(32 - TABLE_BITS[k])) + np.uint32(_STARTS[k]))

    def times(self, times: np.ndarray) -> np.ndarray:
        """How often each byte row is passed."""
        return np.bincount(self.source, times[self.word], len(self.bits))

    def add(self, zeros: np.ndarray, ones: np.ndarray, times: np.ndarray) -> None:
        own = np.repeat(self.times(times), 8)
        for k, slots in enumerate(self.slots):
            low, size = int(_STARTS[k]), _SIZES[k]
            at = ((slots.astype(np.int64) - low) * 2 + self.bits).ravel()
            found = np.bincount(at, own, 2 * size)
            zeros[low : low + size] += found[::2]
            ones[low : low + size] += found[1::2]

    def inputs(self, zeros: np.ndarray, ones: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """(stretched probabilities [byte, bit, order], gate of each decision)."""
        out = np.empty((*self.bits.shape, 4), np.float32)
        gate = np.zeros(self.bits.shape, np.int64)
        for k, slots in enumerate(self.slots):
            n0, n1 = zeros[slots], ones[slots]
            if leave_out:
                n1 = np.maximum(n1 - self.bits, 0)
                n0 = np.maximum(n0 - (1 - self.bits), 0)
            out[:, :, k] = np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3)))
            if k >= 2:
                gate = gate * LEVELS + np.minimum(LEVELS - 1, np.log2(n0 + n1 + 1) / 2).astype(np.int64)
        return np.clip(out, -9, 9), gate


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def learn_weights(words: list[str] | pa.Array, times: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Weights [gate, order] after one online pass over the words (in order), parts and their bytes shuffled."""
    weights, seen = np.full((LEVELS * LEVELS, 4), 0.3), np.full((LEVELS * LEVELS, 4), 1.0)
    starts = np.random.default_rng(3).permutation(np.arange(0, len(words), LEARN))
    for at in starts.tolist():
        nodes = Nodes(words[at : at + LEARN])
        x, gate = nodes.inputs(zeros, ones, True)
        share = np.log2(1 + nodes.times(times[at : at + LEARN]))
        mixed = np.random.default_rng(at).permutation(len(x))
        for a in range(0, len(x), STEP):
            rows = mixed[a : a + STEP]
            g, own = gate[rows].ravel(), x[rows].reshape(-1, 4)
            error = (nodes.bits[rows].ravel() - squash(np.einsum("ij,ij->i", own, weights[g]))) * np.repeat(share[rows], 8)
            step = np.stack([np.bincount(g, error * own[:, k], len(weights)) for k in range(4)], 1)
            seen += step**2
            weights += RATE * step / np.sqrt(seen)
    return weights


def word_logs(words: list[str] | pa.Array, zeros: np.ndarray, ones: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log10 of each word's probability, its end included."""
    out = np.empty(len(words))
    for at in range(0, len(words), PART):
        some = words[at : at + PART]
        nodes = Nodes(some)
        x, gate = nodes.inputs(zeros, ones, False)
        z = np.einsum("bdk,bdk->bd", x, weights[gate].astype(np.float32)).astype(np.float64)
        z = np.clip(np.where(nodes.bits == 1, z, -z), -20, 20)
        logs = -np.log1p(np.exp(-z)).sum(1)[nodes.source]
        out[at : at + len(some)] = np.bincount(nodes.word, logs, len(some)) / math.log(10)
    return out


def earlier(key: np.ndarray) -> np.ndarray:
    """How many earlier places have the same key (integers from 0 on)."""
    at, bits = np.arange(len(key)), max(1, int(len(key)).bit_length())
    if len(key) and key.dtype == np.int64 and int(key.max()) < 1 << (62 - bits):  # place and key in one number: plain sorting keeps the order
        both = np.sort(key << bits | at)
        order, ordered = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1]) if len(key) else np.empty(0, bool)
    out = np.empty(len(key), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return out


def own_words(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each word by its document's words so far, and by its words so far after the same word (0 where there are none)."""
    if not len(codes):
        return np.empty(0), np.empty(0)
    owner, many = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), int(codes.max()) + 2
    before = np.arange(len(codes)) - offsets[owner]
    alone = owner * many + codes
    last = np.append(many - 1, codes[:-1])
    last[offsets[:-1][np.diff(offsets) > 0]] = many - 1  # no word stands before the first
    after = np.unique(owner * many + last, return_inverse=True)[1]
    pair, times = earlier(after * many + codes), earlier(after)
    return earlier(alone) / np.maximum(before, 1), np.where(last < many - 1, pair / np.maximum(times, 1), 0.0)


def refined(coded: np.ndarray, parts: tuple[np.ndarray, ...], offsets: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Sums per document, over its counted words, of log10 of the mix of all predictors; the weights follow the words coded so far.

    coded holds each word's log10 probability by its spelling, parts the other predictors' probabilities.
    Documents advance together, REFINE words at a time: a predictor's weight is its share of the mix so far.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    every = np.stack([10.0**coded, *parts])
    share, total = np.tile(np.array(START)[:, None] * STRENGTH, (1, len(sizes))), np.zeros(len(sizes))
    block = 0
    while True:
        live = order[: np.searchsorted(-sizes[order], -block * REFINE, "left")]
        if not len(live):
            return total
        count = np.minimum(sizes[live] - block * REFINE, REFINE)
        owner = np.repeat(np.arange(len(live)), count)
        at = np.repeat(offsets[live] + block * REFINE, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        weight = share[:, live] / (STRENGTH + block * REFINE)
        weight /= weight.sum(0)
        each = weight[:, owner] * every[:, at]
        mix = each.sum(0)
        with np.errstate(divide="ignore"):
            logs = np.where(mix > 0, np.log10(mix), coded[at] + np.log10(weight[0, owner]))
        total[live] += np.bincount(owner, logs * counted[at], len(live))
        each = np.divide(each, mix, out=np.zeros_like(each), where=mix > 0)
        for k in range(len(every)):
            share[k, live] += np.bincount(owner, each[k], len(live))
        block += 1


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def segments(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, token after the last, hash of the triple before, hash of triple and segment) of all segments, in order.

    hashes are the tokens' words' hashes. A segment ends with the next chosen triple, or with the document.
    """
    empty = np.empty(0, np.int64)
    n = len(hashes)
    if n < 4:
        return empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    triple = _stir(hashes[2:] + _stir(hashes[1:-1] + _stir(hashes[:-2] + _MIX)))  # of tokens i to i + 2, at i
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    last = np.flatnonzero((triple % np.uint64(SPARSE) == 0) & (owner[2:] == owner[:-2])) + 2
    first = last + 1
    inside = first < offsets[owner[last] + 1]
    first, last = first[inside], last[inside]
    end = offsets[owner[last] + 1]
    more = np.append(owner[last[1:]] == owner[last[:-1]], False) if len(last) else np.empty(0, bool)
    end[more] = first[1:][more[:-1]] if len(last) else end[more]
    power = np.cumprod(np.full(n, int(_MIX) | 1, np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(n, pow(int(_MIX) | 1, -1, 1 << 64), np.uint64), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(hashes * power, dtype=np.uint64))
    body = (sums[end] - sums[first]) * back[first]
    before = triple[last - 2]
    return first, end, before, _stir(body + (end - first).astype(np.uint64) * _MIX + before * np.uint64(3))


def segment_logs(owner: np.ndarray, known: np.ndarray, ways: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, whether it was a hit) of segments in document order; owner is each one's document, ascending.

    known: how often the triple went on in the documents learned from; ways: in how many ways; same: how often in
    this way. No bit is coded where known is 0. A document's weights start anew and are learned online.
    """
    logs, hit = np.zeros(len(owner)), (same > 0) & (known > 0)
    asked = np.flatnonzero(known > 0)
    if not len(asked):
        return logs, hit
    docs, doc, counts = np.unique(owner[asked], return_inverse=True, return_counts=True)
    order, begins = np.argsort(-counts, kind="stable"), np.cumsum(counts) - counts
    weights = np.tile(np.array(SEGMENT_START), (len(docs), 12, 1))
    won, tries, state = np.zeros(len(docs)), np.zeros(len(docs)), np.zeros(len(docs), np.int64)
    for step in range(int(counts.max())):
        live = order[: np.searchsorted(-counts[order], -step, "left")]
        at = asked[begins[live] + step]
        x = np.stack([np.log((known[at] + 0.2) / (ways[at] + 0.2)), np.log((won[live] + 0.4) / (tries[live] - won[live] + 0.4)), np.ones(len(live))], 1)
        gate = np.minimum(3, np.log2(known[at])).astype(np.int64) * 3 + state[live]
        p = np.clip(squash(np.einsum("ij,ij->i", x, weights[live, gate])), 1e-4, 1 - 1e-4)
        bit = hit[at]
        logs[at] = np.where(bit, np.log10(p) + np.log10(np.maximum(same[at], 1) / known[at]), np.log10(1 - p))
        weights[live, gate] += SEGMENT_RATE * (bit - p)[:, None] * x
        won[live] += bit
        tries[live] += 1
        state[live] = np.where(bit, 1, 2)
    return logs, hit


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _short(words: pa.Array) -> pa.Array:
    """Words as they are counted: themselves, or a digest if they are long (a mark tells them apart)."""
    long_ = pc.greater(pc.utf8_length(words), 64)
    digests = ["\x1f" + xxhash.xxh3_128_hexdigest(w.encode()) for w in words.filter(long_).to_pylist()]
    return pc.replace_with_mask(words, long_, pa.array(digests, pa.large_string())).cast(pa.string())


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a chunk's texts: (place of each token's word, offsets of texts, distinct words in order, bytes of texts).

    Texts are unpacked and split a few at a time; only distinct words and codes stay.
    """
    press, data, size, encoded, counts, n_bytes = zstandard.ZstdDecompressor(), [], 0, [], [], []

    def flush() -> None:
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(data, pa.large_binary()).cast(pa.large_string())))
        flat, ends = pieces.flatten(), pieces.offsets.to_numpy().astype(np.int64)
        full = pc.not_equal(flat, "")
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        counts.append(np.diff(before[ends - ends[0]]))
        encoded.append(flat.filter(full).dictionary_encode())

    for packed in (x for c in table.column("data").chunks for x in c):
        data.append(press.decompress(packed.as_buffer()))
        n_bytes.append(len(data[-1]))
        size += n_bytes[-1]
        if size > SLICE:
            flush()
            data.clear()
            size = 0
    if data or not encoded:
        flush()
    whole = pa.chunked_array(encoded).unify_dictionaries()
    names = whole.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in whole.chunks])
    order = pc.array_sort_indices(names)
    place = np.empty(len(names), np.int32)
    place[order.to_numpy()] = np.arange(len(names), dtype=np.int32)
    return place[codes], offsets_of(np.concatenate(counts)), names.take(order), np.array(n_bytes, np.int64)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Rows (key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one for each row of docs.

    Tokens are words with A-Z lowered, then one end. The base score sums log10((c + 0.5) / (N + 0.5 * (V + 1))).
    score is the model's log10 probability of the document's words and end; bits_per_byte is that in bits over the
    bytes that it codes, which are the lowered words with one separator each and the end. Rows whose crc32 of the
    key as text is not 1 modulo 5 are learned from; a document's own segments do not count for itself. A null or
    empty text is an end alone. A null key counts as an empty string for that remainder; keys may repeat, rows stay
    apart, and each row counts in training. Without training rows, and for an empty table, all counts are 0.
    Other columns are ignored, whatever their names.

    A task holds one chunk of text (chunk bytes, or one longer document) and that chunk's words and segments.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(key).schema[0].dataType.simpleString()
    base = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("k"), held_out(docs[key]).alias("held"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_chunks = max(1, -(-size // chunk))
    base = base.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(n_chunks)).cast("int"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in text_slices(batches, "text"):
            data = pa.array([press.compress(x.encode()) for x in part.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], data], ["chunk", "row", "k", "held", "data"])

    dealt = base.select("chunk", "row", "k", "held", "text").mapInArrow(squeeze, f"chunk int, row long, k {kind}, held boolean, data binary")

    def count(table: pa.Table) -> pa.Table:
        codes, offsets, words, _ = _words(table)
        held = table.column("held").to_numpy()
        train = np.repeat(~held, np.diff(offsets))
        times = np.bincount(codes[train], minlength=len(words))
        hashes, parts = _hashes(words), [(np.empty(0, bool), np.empty(0, np.uint64), np.empty(0, np.uint64))]
        for begin, end in _some(offsets):
            own = slice(offsets[begin], offsets[end])
            first, _, before, found = segments(hashes[codes[own]], offsets[begin : end + 1] - offsets[begin])
            parts.append((train[own][first], before, found))
        taught, before, found = (np.concatenate(x) for x in zip(*parts, strict=True))
        names, at, which = np.unique(found, return_index=True, return_inverse=True)
        learned, every = np.bincount(which, taught, len(names)).astype(np.int64), np.bincount(which, minlength=len(names))
        del codes, train, hashes, parts
        seen = np.flatnonzero(times)
        both = np.zeros(2 * int(_STARTS[-1]))
        zeros, ones = np.split(both, 2)
        known = words.take(pa.array(seen))
        for begin in range(0, len(seen), PART):
            Nodes(known[begin : begin + PART]).add(zeros, ones, times[seen[begin : begin + PART]])
        weights = learn_weights(known, times[seen], zeros.astype(np.float32), ones.astype(np.float32))
        press = zstandard.ZstdCompressor(level=3)
        tables = [press.compress(x.astype("<i8").tobytes()) for x in np.array_split(both, PARTS)]
        del both, zeros, ones
        tables.append(press.compress(np.concatenate([weights.ravel() * times.sum(), [times.sum(), (~held).sum()]]).tobytes()))
        blank = lambda n, t: pa.nulls(n, t)
        n, m, r = len(words), len(names), PARTS + 1
        columns = {
            "chunk": pa.array(np.full(n + m + r, table.column("chunk")[0].as_py(), np.int32)),
            "word": pa.concat_arrays([_short(words), blank(m + r, pa.string())]),
            "segment": pa.concat_arrays([blank(n, pa.int64()), pa.array(names.view(np.int64)), blank(r, pa.int64())]),
            "triple": pa.concat_arrays([blank(n, pa.int64()), pa.array(before[at].view(np.int64)), blank(r, pa.int64())]),
            "times": pa.concat_arrays([pa.array(times.astype(np.int64)), pa.array(learned), blank(r, pa.int64())]),
            "occurs": pa.concat_arrays([blank(n, pa.int64()), pa.array(every.astype(np.int64)), blank(r, pa.int64())]),
            "part": pa.concat_arrays([blank(n + m, pa.int32()), pa.array(np.arange(r, dtype=np.int32))]),
            "data": pa.concat_arrays([blank(n + m, pa.binary()), pa.array(tables, pa.binary())]),
        }
        return pa.table(columns)

    shape = "chunk int, word string, segment long, triple long, times long, occurs long, part int, data binary"
    counted = stored(dealt.groupBy("chunk").applyInArrow(count, shape), "counts")
    words = counted.where("word IS NOT NULL").select("chunk", "word", "times")
    zeros_ones, (learned, ends), weights = _summed(counted.where("part IS NOT NULL").selectExpr("cast(chunk AS long) AS nth", "part", "data"), n_chunks)
    sent = spark.sparkContext.broadcast((zstandard.ZstdCompressor(level=3).compress(zeros_ones.tobytes()), weights))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words with the log10 of their spelling's probability; null for digests of long words, whose chunks know them."""
        both, weights = np.frombuffer(zstandard.ZstdDecompressor().decompress(sent.value[0]), np.float32), sent.value[1]
        for table in _gathered(batches, 100_000):
            table = table.sort_by("word")
            words = table.column("word").combine_chunks().cast(pa.large_string())
            logs = word_logs(words, both[: _STARTS[-1]], both[_STARTS[-1] :], weights)
            long_ = pc.starts_with(words, "\x1f")
            yield from table.append_column("coded", pa.array(logs.astype(np.float32), mask=long_.to_numpy(zero_copy_only=False))).combine_chunks().to_batches()

    totals = words.groupBy("word").agg(F.sum("times").alias("c"), F.count("*").alias("rows"))
    totals = stored(totals.mapInArrow(spell, "word string, c long, rows long, coded float"), "totals")
    sums = totals.where("c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n_train, v_train = (sums.n or 0) + ends, sums.v + (1 if ends else 0)
    mine = salted_join(words.select("chunk", "word"), totals, "word", "rows", ["chunk"]).select("chunk", "word", "c", "coded")
    # a triple that occurs once in all rows tells nothing
    found = counted.where("segment IS NOT NULL")
    by_segment = found.groupBy("segment").agg(F.first("triple").alias("triple"), F.sum("times").alias("same"), F.sum("occurs").alias("occurs"), F.count("*").alias("rows"))
    by_segment = stored(by_segment, "segments")
    by_triple = by_segment.groupBy("triple").agg(F.sum("same").alias("known"), F.count_if(F.col("same") > 0).alias("ways"), F.sum("occurs").alias("all"), F.count("*").alias("parts"))
    by_triple = stored(by_triple.where("all > 1 AND known > 0").drop("all"), "triples")
    told = stored(salted_join(by_segment.select("segment", "triple", "same", "rows"), by_triple, "triple", "parts", ["segment"]).select("segment", "rows", "known", "ways", "same"), "told")
    told = salted_join(found.select("chunk", "segment"), told, "segment", "rows", ["chunk"]).select("chunk", "segment", "known", "ways", "same")
    nothing = lambda *names: [F.lit(None).cast("long").alias(x) for x in names]
    blank = [F.lit(None).cast("string").alias("word"), *nothing("c"), F.lit(None).cast("float").alias("coded")]
    facts = mine.select("chunk", "word", "c", "coded", *nothing("segment", "known", "ways", "same")).unionByName(told.select("chunk", *blank, "segment", "known", "ways", "same"))
    unit = n_train + 0.5 * (v_train + 1)
    log_end = math.log10((ends + 0.5) / (n_train + 1))
    log_word = math.log10(1 - min(0.999999, (ends + 0.5) / (n_train + 1)))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, offsets, words, _ = _words(left)
        of_words, of_segments = right.filter(pc.is_valid(right.column("word"))), right.filter(pc.is_valid(right.column("segment")))
        at = pc.index_in(_short(words), of_words.column("word").combine_chunks().cast(pa.string()))
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)  # all words have a total
        c, coded = of_words.column("c").to_numpy()[at].astype(np.float64), of_words.column("coded").to_numpy()[at].astype(np.float64)
        long_ = np.flatnonzero(np.isnan(coded))
        if len(long_):
            both = np.frombuffer(zstandard.ZstdDecompressor().decompress(sent.value[0]), np.float32)
            coded[long_] = word_logs(words.take(pa.array(long_)), both[: _STARTS[-1]], both[_STARTS[-1] :], sent.value[1])
            del both
        known, plain = c / max(1, n_train - ends), np.log10((c + 0.5) / unit)
        hashes, widths = _hashes(words), pc.binary_length(words).to_numpy() + 1
        names = of_segments.column("segment").to_numpy()
        order = np.argsort(names)
        names, numbers = names[order], [of_segments.column(x).to_numpy()[order] for x in ("known", "ways", "same")]
        held, sizes = left.column("held").to_numpy(), np.diff(offsets)
        base_score = np.full(len(sizes), math.log10((ends + 0.5) / unit))
        n_known, n_bytes = np.full(len(sizes), int(ends > 0), np.int64), np.ones(len(sizes), np.int64)
        model = sizes * log_word + log_end
        for begin, end in _some(offsets):
            own, at = codes[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            owner = np.repeat(np.arange(end - begin), sizes[begin:end])
            base_score[begin:end] += np.bincount(owner, plain[own], end - begin)
            n_known[begin:end] += np.bincount(owner, (c > 0)[own], end - begin).astype(np.int64)
            n_bytes[begin:end] += np.bincount(owner, widths[own], end - begin).astype(np.int64)
            logs, of, open_ = _told(hashes[own], at, names, numbers, held[begin:end])
            model[begin:end] += np.bincount(of, logs, end - begin)
            model[begin:end] += refined(coded[own], (known[own], *own_words(own, at)), at, open_)
        bits = -model * math.log2(10) / n_bytes
        columns = [left.column("k"), left.column("held"), pa.array(sizes + 1), pa.array(n_known), pa.array(np.full(len(sizes), n_train)), pa.array(base_score), pa.array(model), pa.array(bits)]
        return pa.table(columns, [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInArrow(judge, schema)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least `rows` rows, and the rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _some(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with TOKENS words each, or one longer document."""
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + TOKENS, "right")) - 1)
        yield begin, end
        begin = end


def _hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64)


def _told(hashes: np.ndarray, offsets: np.ndarray, names: np.ndarray, numbers: list[np.ndarray], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 probabilities of segments, their documents, which tokens no segment codes) of some documents.

    names (ascending) and numbers have the corpus' counts. What a document itself added to them is taken off, and
    what it has coded so far is put on.
    """
    first, end, before, found = segments(hashes, offsets)
    owner = np.searchsorted(offsets, first, "right") - 1
    at = np.minimum(np.searchsorted(names, found.view(np.int64)), max(0, len(names) - 1))
    hit = names[at] == found.view(np.int64) if len(names) else np.zeros(len(found), bool)
    known, ways, same = (np.where(hit, x[at], 0) if len(names) else np.zeros(len(found), np.int64) for x in numbers)
    for own, total in ((before, known), (found, same)):
        key = _stir(own + owner.astype(np.uint64) * _MIX)
        so_far = earlier(key)
        times = np.unique(key, return_inverse=True, return_counts=True)[1:]
        total += np.where(hit, so_far - np.where(held[owner], 0, times[1][times[0]]), 0)
    logs, coded = segment_logs(owner, known, np.minimum(ways, np.maximum(known, 1)), same)
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[first[coded]] += 1
    edges[end[coded]] -= 1
    return logs, owner, np.cumsum(edges[:-1]) == 0


def _summed(tables: DataFrame, chunks: int) -> tuple[np.ndarray, tuple[int, int], np.ndarray]:
    """(zeros and ones as float32, (words learned from, documents learned from), weights) from rows (nth, part, data) of all chunks.

    FAN tables at a time are added up, in 64 bits, until one is left; what reaches the driver has a fixed size.
    """

    def add(table: pa.Table) -> pa.Table:
        kind = "<f8" if table.column("part")[0].as_py() == PARTS else "<i8"
        total = sum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), kind) for x in table.column("data"))
        packed = zstandard.ZstdCompressor(level=3).compress(total.astype(kind).tobytes())
        return pa.table({"nth": table.column("nth")[:1], "part": table.column("part")[:1], "data": pa.array([packed], pa.binary())})

    while chunks > 1:
        tables = tables.withColumn("nth", F.floor(F.col("nth") / FAN))
        tables = stored(tables.groupBy("nth", "part").applyInArrow(add, "nth long, part int, data binary"), "tables")
        chunks = -(-chunks // FAN)
    parts = [(r.part, zstandard.ZstdDecompressor().decompress(bytes(r.data))) for r in tables.select("part", "data").collect()]
    found = dict(sorted(parts))
    if not found:
        return np.zeros(2 * int(_STARTS[-1]), np.float32), (0, 0), np.full((LEVELS * LEVELS, 4), 0.3)
    mean = np.frombuffer(found.pop(PARTS))
    learned, docs = int(mean[-2]), int(mean[-1])
    weights = mean[:-2].reshape(-1, 4) / learned if learned else np.full((LEVELS * LEVELS, 4), 0.3)
    return np.concatenate([np.frombuffer(x, "<i8") for x in found.values()]).astype(np.float32), (learned, docs), weights
