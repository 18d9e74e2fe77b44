"""MinHash near-dedup with SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash gives each element a random permutation of the signature's places and takes rank + fraction
as its value there, so an element's values are correlated and the estimate's variance is lower. Ranks are
drawn in turn for all elements at once, and a document stops as soon as every place has a value below the
next rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, gather, list_array, salted_join, ship, stored, text_slices, texts_of, words_of

WORDS, PLACES, ROWS = 5, 80, 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Buckets up to this size give all their pairs; larger ones go through tiles of blocks of so many shingles, exactly.
SMALL, BLOCK = 16, 150_000
#: Bytes of text shingled at once.
SLICE = 2 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def _step(j: int, by: int = 0x9E3779B97F4A7C15) -> np.uint64:
    return np.uint64((j + 1) * by & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` words, A-Z lowered.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    codes, offsets, names = words_of(texts)
    table = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)
    hashed = table[codes]
    total = np.zeros(len(hashed), np.uint64)
    for j in range(min(width, len(hashed))):
        total[: len(hashed) - j] += mixed(hashed[j:] + _step(j))
    total = mixed(total)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            short = hashed[a:b] * np.arange(1, b - a + 1, dtype=np.uint64)
            out.append(mixed(mixed(short).sum(keepdims=True) + _step(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """One row of float64 values per set; infinite for an empty set."""
    out = np.full((len(sets), places), np.inf)
    order = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(order):  # a bounded number of elements at a time, or one set
        to, total = at, 0
        while to < len(order) and (to == at or total + len(sets[order[to]]) <= 1 << 18):
            total += len(sets[order[to]])
            to += 1
        _fill(out, [sets[i] for i in order[at:to]], np.array(order[at:to]), places)
        at = to
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, places: int) -> None:
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.full(len(sets) * places, np.inf)
    ranks = None
    for j in range(places):
        state = mixed(element + _step(j))
        fraction = (state >> np.uint64(32)).astype(np.float64) / 2.0**32
        k = j + ((state & np.uint64(0xFFFFFFFF)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
        if ranks is None:
            place = k
        else:
            line = np.arange(len(element))
            place = ranks[line, k].astype(np.int64)
            ranks[line, k] = ranks[line, j]
            ranks[line, j] = place
        np.minimum.at(values, owner * places + place, fraction + j)
        open_ = values.reshape(len(sets), places).max(1) >= j + 1
        stay = open_[owner]
        if not stay.any():
            break
        if ranks is None:
            element, owner, k = element[stay], owner[stay], k[stay]
            ranks = np.tile(np.arange(places, dtype=np.uint8), (len(element), 1))
            line = np.arange(len(element))
            ranks[line, k] = 0
            ranks[line, 0] = k
        elif not stay.all():
            element, owner, ranks = element[stay], owner[stay], ranks[stay]
    out[rows] = values.reshape(len(sets), places)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of the bands; the band's number is part of its key."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, rows)
    key = np.arange(bits.shape[1], dtype=np.uint64) * _M2 + np.zeros((len(signature), 1), np.uint64)
    for j in range(rows):
        key = mixed(key + bits[:, :, j] * _M3)
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, in whole numbers."""
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (low + high - common)


def tile_links(a: tuple, b: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into a, into b) of linked sets of two blocks, each (sizes, concatenated sets); exact.

    Shingles that many sets of both blocks have are counted by a matrix product, the others one by one.
    """
    (na, va), (nb, vb) = a, b
    names, flat = np.unique(np.concatenate([va, vb]), return_inverse=True)
    fa, fb = flat[: len(va)], flat[len(va) :]
    oa, ob = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ca, cb = np.bincount(fa, minlength=len(names)), np.bincount(fb, minlength=len(names))
    common = np.zeros((len(na), len(nb)), np.float32)
    often = (ca >= 8) & (cb >= 8)
    dense = np.flatnonzero(often)
    column = np.full(len(names), -1)
    for at in range(0, len(dense), 4096):
        some = dense[at : at + 4096]
        column[:] = -1
        column[some] = np.arange(len(some))
        x, y = np.zeros((len(na), len(some)), np.float32), np.zeros((len(nb), len(some)), np.float32)
        x[oa[column[fa] >= 0], column[fa][column[fa] >= 0]] = 1
        y[ob[column[fb] >= 0], column[fb][column[fb] >= 0]] = 1
        common += x @ y.T
    order = np.argsort(fb, kind="stable")
    starts = np.cumsum(cb) - cb
    rare = np.flatnonzero(~often[fa] & (cb[fa] > 0))
    for at in range(0, len(rare), 1 << 14):
        some = rare[at : at + (1 << 14)]
        times = cb[fa[some]]
        other = ob[order[gather(starts[fa[some]], times)]]
        common += np.bincount(np.repeat(oa[some], times) * len(nb) + other, minlength=common.size).reshape(common.shape)
    union = na[:, None] + nb[None, :] - common
    return np.nonzero((100 * common.astype(np.float64) >= percent * union) & (common > 0))


def near_groups(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_shingles, component_id, kept), one for each row of docs.

    Sets are distinct shingles of WORDS words (shingle_sets). Documents with equal sets are linked; others are
    linked if 100 * intersection >= percent * union, checked on the full sets of every candidate pair.
    component_id is the smallest key reachable by links. A text that is null, empty or without words links with
    nothing. Keys must be integers; a row whose key is null has a null component and is kept. Rows that repeat a
    key, with equal or other texts, are one vertex with the links of all its texts. A very long text is one
    set. An empty table gives no rows. Other columns are ignored, whatever their names.

    Equal sets are collapsed first, so exact copies cost one row each. Band buckets of up to SMALL sets give
    all pairs; larger ones give each member's pair with the bucket's first set. Larger buckets that are then in
    several components are merged where they overlap, dealt into blocks of BLOCK shingles, and compared block
    by block on the full sets; such a tile sends a spanning forest of its links, never its pairs. With 20 bands
    of 4 places a pair at similarity 0.85 is missed with probability (1 - 0.85**4)**20 < 1e-6. Bands and sets
    with more than one in OFTEN of all rows are dealt to many tasks, so no key holds up one.
    """
    spark = docs.sparkSession
    ship(spark)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            sets = shingle_sets(texts_of(part))
            content = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            key_rows = bands(signatures(sets))
            columns = [part.column("k"), part.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(content, pa.binary())]
            offsets = np.arange(len(sets) + 1) * key_rows.shape[1]
            yield pa.RecordBatch.from_arrays([*columns, list_array(key_rows.ravel(), offsets, pa.int64())], ["k", "h", "n", "content", "bands"])

    base = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("text")).select("k", F.xxhash64("text").alias("h"), "text")
    sketches = stored(base.mapInArrow(sketch, "k long, h long, n long, content binary, bands array<long>"), "sketches")
    some = sketches.where("n > 0 AND k IS NOT NULL")
    # one row for each set: its smallest key is its vertex, (k, h) finds its text again, id tells sets apart
    reps = some.groupBy("content").agg(F.min(F.struct("k", "h", "n", "bands")).alias("x"), F.count("*").alias("copies"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("id"), "content", "copies", "x.k", "x.h", "x.n", "x.bands"), "reps")
    entries = reps.select("id", "k", "n", F.explode("bands").alias("band"))
    hub = F.min(F.struct("n", "id", "k"))
    sizes = stored(entries.groupBy("band").agg(F.count("*").alias("members"), hub.alias("hub")).where("members > 1"), "sizes")
    buckets = stored(salted_join(entries, sizes, "band", "members", ["id"]), "buckets")
    fits = f"100 * least(a.n, b.n) >= {int(percent)} * greatest(a.n, b.n)"
    small = buckets.where(f"members <= {SMALL}").groupBy("band").agg(F.collect_list(F.struct("n", "id", "k")).alias("xs"))
    small = small.select(F.explode("xs").alias("a"), "xs").select("a", F.explode("xs").alias("b")).where("a.id < b.id")
    star = buckets.where(f"members > {SMALL} AND hub.id <> id").select(F.struct("n", "id", "k").alias("a"), F.col("hub").alias("b"))
    pairs = small.unionByName(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).where(fits)
    pairs = stored(pairs.selectExpr("a.id AS a", "b.id AS b", "a.k AS ka", "b.k AS kb").distinct(), "pairs")
    sets = _sets(base, reps, buckets) if pairs.limit(1).count() else None

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("ka"), batch.column("kb")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    named = salted_join(some.select("k", "content"), reps.select("content", "copies", F.col("k").alias("rep")), "content", "copies", ["k"]).select("k", "rep")
    # keys that repeat with other texts tie their sets' vertices together
    tied = named.groupBy("k").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).where("b < other").select("k", "b")
    edges = stored(named.join(tied, "k").selectExpr("rep AS a", "b").distinct(), "tied")
    roots = None
    if sets is not None:
        left = pairs.join(sets.selectExpr("id AS a", "s AS x"), "a").select("a", "b", "ka", "kb", "x")
        both = left.join(sets.selectExpr("id AS b", "s AS y"), "b").select("ka", "kb", "x", "y")
        edges = stored(both.mapInArrow(verify, "a long, b long").unionByName(edges), "links")
        roots = stored(components(edges), "roots")
        tiles = _tiled(buckets.where(f"members > {SMALL}"), roots, sets, percent)
        if tiles is not None:
            roots = components(roots.selectExpr("v AS a", "root AS b").unionByName(tiles))
    elif not edges.isEmpty():
        roots = components(edges)
    named = named.groupBy("k").agg(F.min("rep").alias("rep"))
    if roots is not None:
        named = named.join(roots, named.rep == roots.v, "left").select("k", F.coalesce("root", "rep").alias("rep"))
    out = sketches.select("k", "n").join(named, "k", "left")
    component = F.coalesce("rep", "k")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("k")).alias("kept"))


def _sets(base: DataFrame, reps: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows (id, s binary): the full sets of all members of buckets, from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in shingle_sets(texts_of(part))], pa.binary())], ["id", "s"])

    wanted = reps.join(buckets.select("id").distinct(), "id").select("id", "k", "h")
    texts = base.where("k IS NOT NULL").join(wanted, ["k", "h"]).dropDuplicates(["k", "h"])
    return stored(texts.select("id", "text").mapInArrow(run, "id long, s binary"), "sets")


def _tiled(large: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) that join components inside large buckets, as spanning forests; None if there is nothing to compare."""
    named = large.join(roots, large.k == roots.v, "left").select("band", "id", "k", "n", F.coalesce("root", "k").alias("root"))
    split = stored(named.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("id").alias("low"), F.count("*").alias("rows")).where("x < y"), "split")
    if split.isEmpty():
        return None
    open_ = stored(salted_join(named, split.select("band", "low", "rows"), "band", "rows", ["id"]).select("low", "id", "k", "n"), "open")
    clusters = components(open_.selectExpr("id AS a", "low AS b"))
    members = open_.select("id", "k", "n").distinct().join(clusters, F.col("id") == clusters.v, "left").select("id", "k", "n", F.coalesce("root", "id").alias("c"))
    members = stored(members, "members")
    counts = stored(members.groupBy("c").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"), F.count("*").alias("rows")), "counts")
    dealt = salted_join(members, counts, "c", "rows", ["id"]).select("c", "id", "k", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    dealt = dealt.join(sets, "id").select("c", "block", "blocks", "k", "s")

    def assemble(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")]
        cells = {"ks": table.column("k").to_numpy().tobytes(), "sizes": np.array([len(x) for x in parts], np.int64).tobytes(), "flat": np.concatenate(parts).tobytes()}
        return pa.table({n: table.column(n)[:1] for n in ("c", "block", "blocks")} | {k: [v] for k, v in cells.items()})

    blocks = stored(dealt.groupBy("c", "block").applyInArrow(assemble, "c long, block long, blocks long, ks binary, sizes binary, flat binary"), "blocks")
    right = blocks.selectExpr("c", "block AS block2", "ks AS ks2", "sizes AS sizes2", "flat AS flat2")
    left = blocks.withColumn("block2", F.explode(F.sequence("block", F.col("blocks") - 1)))
    tiles = left.join(right, ["c", "block2"]).repartition("c", "block", "block2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind, r=r, batch=batch: np.frombuffer(batch.column(name)[r].as_buffer(), kind)
                k1, k2 = get("ks", np.int64), get("ks2", np.int64)
                i, j = tile_links((get("sizes", np.int64), get("flat", np.uint64)), (get("sizes2", np.int64), get("flat2", np.uint64)), percent)
                a, b = forest(k1[i], k2[j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiles.mapInArrow(compare, "a long, b long")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: one document of each group, with all rows of its key, and rows without a key. Columns are unchanged, whatever their names."""
    keep = near_groups(docs, percent, text, key).where("kept").select(F.col(key).alias("k")).distinct()
    rows = docs.select(docs[key].cast("long").alias("k"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.alias("r").join(keep.alias("s"), F.col("r.k").eqNullSafe(F.col("s.k")), "left_semi")
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
