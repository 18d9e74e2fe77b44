"""Periodic runs of words: a harmonic grid of (period, place) pairs, prefix hashes and binary searches in NumPy.

A stretch of words with period p that is `times` periods long has a place x that is a multiple of (times - 2) * p
where words x to x + p equal the p words that follow. So all such pairs (p, x) of a batch of texts are probed
together; there are about n ln n of them in a text of n words. Where the probe succeeds, binary searches on prefix
hashes, all at once, find how far the words agree to the right and to the left. Each stretch is then verified on
its words; of equal stretches the smallest period stays, which is the stretch's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather, offsets_of, ship, text_slices, texts_of, words_of

#: Bytes of text handled at once (or one text), pairs probed at once, words verified at once.
SLICE, PAIRS, CHECKED = 1 << 20, 1 << 19, 1 << 21
#: Odd multiplier of the prefix hashes, which wrap at 2**64.
BASE = 0x9E3779B97F4A7C15

RUNS = "array<struct<start: long, length: long, period: long>>"


def prefix_hashes(codes: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(sums of mixed codes times powers of base up to each place, the powers), modulo 2**64."""
    x = codes.astype(np.uint64) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    powers = np.full(len(x) + 1, base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers[:-1], out=sums[1:])
    return sums, powers


def _extent(low: np.ndarray, high: np.ndarray, same) -> np.ndarray:
    """For each pair the largest n in [low, high] with same(pairs, n), by binary searches side by side."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_] + 1) >> 1
        good = same(open_, middle)
        low[open_[good]] = middle[good]
        high[open_[~good]] = middle[~good] - 1
        open_ = open_[low[open_] < high[open_]]
    return low


def _equal(codes: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which stretches do have their periods, word by word."""
    out, sizes = np.ones(len(start), bool), length - period
    ends = np.cumsum(sizes)
    at = 0
    while at < len(start):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHECKED, side="right")))
        places = gather(start[at:to], sizes[at:to])
        wrong = codes[places] != codes[places + np.repeat(period[at:to], sizes[at:to])]
        if wrong.any():
            out[at:to] = np.bincount(np.repeat(np.arange(to - at), sizes[at:to]), wrong, to - at) == 0
        at = to
    return out


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = 6, times: int = 4, base: int = BASE) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts codes[offsets[i]:offsets[i + 1]], by text, start and period.

    A run has its smallest period q, at least max(least, times * q) words, and can't be extended with period q.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")
    sums, powers = prefix_hashes(codes, base)
    begin, n = offsets[:-1].astype(np.int64), np.diff(offsets)
    most = np.where(n >= least, n // times, 0)
    text, period = np.repeat(np.arange(len(n)), most), np.arange(1, most.sum() + 1) - np.repeat(offsets_of(most)[:-1], most)
    stride = (times - 2) * period
    counts = (n[text] - 2 * period) // stride + 1
    ends = np.cumsum(counts)
    found = []
    at = 0
    while at < len(text):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        for k in range(0, int(ends[to - 1] - done), PAIRS):  # one period of a very long text has many places
            which = np.arange(k, min(k + PAIRS, int(ends[to - 1] - done))) if to == at + 1 else None
            pick = np.full(len(which), at) if which is not None else np.repeat(np.arange(at, to), counts[at:to])
            nth = which if which is not None else np.arange(len(pick)) - np.repeat(offsets_of(counts[at:to])[:-1], counts[at:to])
            p = period[pick]
            x = begin[text[pick]] + nth * stride[pick]
            alike = codes[x] == codes[x + p]
            pick, p, x = pick[alike], p[alike], x[alike]
            alike = (sums[x + p] - sums[x]) * powers[p] == sums[x + 2 * p] - sums[x + p]
            pick, p, x = pick[alike], p[alike], x[alike]
            if not len(p):
                continue
            first = begin[text[pick]]
            last = first + n[text[pick]]

            def right(i, m, p=p, x=x):
                return (sums[x[i] + m] - sums[x[i]]) * powers[p[i]] == sums[x[i] + p[i] + m] - sums[x[i] + p[i]]

            def left(i, m, p=p, x=x):
                return (sums[x[i]] - sums[x[i] - m]) * powers[p[i]] == sums[x[i] + p[i]] - sums[x[i] + p[i] - m]

            after, before = _extent(p, last - x - p, right), _extent(np.zeros(len(p), np.int64), x - first, left)
            length = before + after + p
            long = length >= np.maximum(least, times * p)
            rows = np.stack([x - before, length, p, text[pick]])[:, long]
            found.append(_firsts(rows, 3))
        at = to
    if not found:
        return np.empty((4, 0), np.int64)
    # of equal stretches, the smallest period is verified; if it fails (hashes agreed by chance), all of them are settled word by word
    rows = _firsts(np.concatenate(found, axis=1), 3)
    lead = np.ones(rows.shape[1], bool)
    lead[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    good = np.ones(rows.shape[1], bool)
    good[lead] = _equal(codes, *rows[:3, lead])
    good = good[lead][np.cumsum(lead) - 1]
    settled = [r for s, m, p, t in rows[:, ~good].T for r in _settled(codes, begin[t], begin[t] + n[t], s, s + m, p, t)]
    extra = np.array([r for r in settled if r[1] >= max(least, times * r[2])], np.int64).reshape(-1, 4).T
    rows = _firsts(np.concatenate([rows[:, good & lead], extra], axis=1), 2)
    rows = rows[:, np.lexsort((rows[2], rows[0]))]
    return np.stack([rows[3], rows[0] - begin[rows[3]], rows[1], rows[2]])


def _firsts(rows: np.ndarray, k: int) -> np.ndarray:
    """Columns sorted by (start, length, period), the first of those that agree in k of these."""
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    keep = np.ones(rows.shape[1], bool)
    keep[1:] = (rows[:k, 1:] != rows[:k, :-1]).any(0)
    return rows[:, keep]


def _settled(codes: np.ndarray, first: int, last: int, start: int, end: int, p: int, text: int) -> list[tuple[int, int, int, int]]:
    """All stretches of period p that meet places start to end, word by word."""
    wrong = np.flatnonzero(codes[first : last - p] != codes[first + p : last]) + first
    lows, highs = np.append(first, wrong + 1), np.append(wrong, last - p)
    meet = (highs > lows) & (lows < end) & (highs + p > start)
    return [(int(a), int(b - a + p), int(p), int(text)) for a, b in zip(lows[meet], highs[meet], strict=True)]


def dropped(offsets: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words lie in a run, after its first period."""
    steps = np.zeros(offsets[-1] + 1, np.int64)
    text, start, length, period = runs
    at = offsets[text] + start
    np.add.at(steps, at + period, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps)[:-1] > 0


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_words, runs, collapsed), one for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0; null and empty texts have none, no runs and an empty collapsed
    text. `runs` are all runs (start, length, period) of at least max(least, times * period) words, by start, then
    period; `collapsed` is the words that no run holds after its first period, joined by one space. Rows that repeat a
    key, or equal each other, are handled each by itself; a null key is kept. Texts are handled whole, however long,
    in one pass without a shuffle. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "t", SLICE):
            codes, offsets, names = words_of(texts_of(batch, "t"), lower=False)
            codes = codes.astype(np.int64)
            runs = find_runs(codes, offsets, least, times)
            keep = ~dropped(offsets, runs)
            kept = offsets_of(keep.astype(np.int64))[offsets]
            words = pa.array(names, pa.string()).take(pa.array(codes[keep]))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words), " ")
            spans = pa.StructArray.from_arrays([pa.array(x) for x in runs[1:]], ["start", "length", "period"])
            per = offsets_of(np.bincount(runs[0], minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(np.diff(offsets)), lists, texts], ["k", "n_words", "runs", "collapsed"])

    out = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t")).mapInArrow(work, f"k {kind}, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("k", key)


def strongest(runs: Column) -> Column:
    """Of runs by start and period, the first with the greatest length / period (compared as fractions); null if there is none."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def replayed(text: Column, key: Column) -> Column:
    """The text of one in ten keys with its last words repeated: word i >= a becomes word a + (i - a) % p.

    With h the CRC-32 of the key in decimal and g = h div 10: if h % 10 = 0 and there are n > 0 words, a = g % n and
    p = 1 + (n - a) div (3 + g % 8). Other texts, and those of a null key, are unchanged.
    """
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # a one-element array binds the words once
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text)), F.lit(0))
    return F.when(h % 10 == 0, changed).otherwise(text)
