"""The inverted multi-index against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import multi_index


def by_all_pairs(rows, count, every):
    """Rows (query, rank, key, score) from distinct (key, vector), the products summed in order."""
    rows = sorted({(k, tuple(v)) for k, v in rows}, key=lambda r: r[0])
    out = []
    for k, v in rows:
        if k % every == 0:
            found = []
            for c, w in rows:
                if (c, w) != (k, v):
                    total = v[0] * w[0]
                    for a, b in zip(v[1:], w[1:], strict=True):
                        total += a * b
                    found.append((-total, c))
            out += [(k, i + 1, c, -s) for i, (s, c) in enumerate(sorted(found)[:count])]
    return sorted(out)


def made(n, width, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * rng.uniform(0.5, 2, size=(n, 1))
    if clusters:
        x = rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)] * 4 + x * 0.2
    x[n // 2 : n // 2 + n // 3] = x[n // 2]  # a third are copies
    return [(int(k), v.tolist()) for k, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize("width,clusters", [(1, 0), (7, 0), (16, 12)])
def test_equals_all_pairs(spark, monkeypatch, width, clusters):
    """Small cells, blocks and first looks, so that bars decide which blocks are called on, and cells span blocks."""
    for name, value in (("FIRST", 20), ("PER_CELL", 4), ("BLOCK_BYTES", 1), ("BLOCK_ROWS", 16), ("AT_ONCE", 3), ("SAMPLE", 100)):
        monkeypatch.setattr(multi_index, name, value)
    rows = made(400, width, width, clusters)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("k", "v", "id", "ks", "cell", "block", "score", "rank")})
    got = sorted(tuple(r) for r in multi_index.search(df, count=5, every=10).collect())
    assert got == by_all_pairs(rows, 5, 10)


def test_bars_exclude_cells():
    """On clustered vectors a query calls on few cells, and none of those left out holds one of its nearest."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] * 4 + rng.normal(size=(4000, 16)) * 0.2
    index = multi_index.Index((multi_index.fitted(x[:, :8], 30), multi_index.fitted(x[:, 8:], 30)))
    cell, r1, r2 = index.cells(x)
    radii = [np.zeros(30), np.zeros(30)]
    np.maximum.at(radii[0], cell // 30, r1)
    np.maximum.at(radii[1], cell % 30, r2)
    index.lay_out(np.bincount(cell, minlength=900), tuple(radii), 50)
    block = index.blocks(cell, np.arange(4000))
    assert np.bincount(block).max() <= 100
    q = x[:50]
    bars = np.sort(q @ x.T, axis=1)[:, -21]
    rounds = [list(index.visits(q, bars, step)) for step in range(4)]
    called = 0
    for i in range(50):
        own = np.concatenate([r[i] for r in rounds])
        near = np.flatnonzero(q[i] @ x.T >= bars[i])
        assert len(own) == len(set(own)) and set(block[near]) <= set(own)
        called += len(own)
    assert called < 0.7 * 50 * (block.max() + 1)


def test_heap_gives_cells_in_order():
    rng = np.random.default_rng(4)
    index = multi_index.Index((np.zeros((5, 2)), np.zeros((6, 2))))
    index.counts = rng.integers(0, 400, 30)
    a, b = rng.normal(size=5), rng.normal(size=6)
    got = index.begin(a, b)
    order = [c for c in np.argsort(-(a[:, None] + b[None]).ravel()).tolist() if index.counts[c]]
    assert got == order[: len(got)] and index.counts[got].sum() >= multi_index.FIRST > index.counts[got[:-1]].sum()


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (None, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [3.0]), (20, [1.0, 0.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in multi_index.search(df).collect())
    # key 0 has two vectors: two queries, each a candidate of the other
    assert got == sorted([(0, 1, 6, 3.0), (0, 2, 20, 1.0), (0, 3, 0, 0.0), (0, 1, 0, 0.0), (0, 2, 6, 0.0), (0, 3, 20, 0.0), (20, 1, 6, 3.0), (20, 2, 0, 1.0), (20, 3, 0, 0.0)])
    assert multi_index.search(df.where("false")).count() == 0 and multi_index.search(df.where("vec_id = 3")).count() == 0
