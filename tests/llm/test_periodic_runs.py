"""Periodic runs against their definition, and the registered query against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import periodic_runs
from tokenledger.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def by_definition(words, least=6, times=4):
    """Runs (start, length, period): for each period the maximal stretches, less those that have a smaller one."""
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            begin = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            size = i - begin + p
            if i > begin and size >= max(least, times * p) and not any(words[begin : begin + size - q] == words[begin + q : begin + size] for q in range(1, p)):
                out.append((begin, size, p))
            i = max(i, begin + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def replayed(words, key):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def digest(words):
    runs = by_definition(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, lines, sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(rng):
    n, k = rng.choice([0, 1, 3, 5, 6, 7, 12, 40, 90]), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 8 else 0):
        p = rng.randrange(1, 1 + n // 5)
        a = rng.randrange(n - p)
        for i in range(a + p, min(n, a + p * rng.randrange(3, 8))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("base", [periodic_runs.BASE, 1])
@pytest.mark.parametrize("pairs", [5, 1 << 19])
def test_runs_by_definition(monkeypatch, base, pairs):
    """Base 1 makes all rearrangements collide, so that verification has to settle the runs; few pairs make many rounds."""
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    monkeypatch.setattr(periodic_runs, "CHECKED", 16)
    rng = random.Random(1)
    for _ in range(60):
        docs = [made(rng) for _ in range(rng.randrange(1, 8))]
        got = [[] for _ in docs]
        for t, *r in periodic_runs.find_runs(np.array([c for d in docs for c in d], np.int64), np.cumsum([0] + [len(d) for d in docs]), base=base).T.tolist():
            got[t].append(tuple(r))
        assert got == [by_definition(d) for d in docs]


def test_strings_that_defeat_wrapping_hashes():
    """Halves of Thue-Morse words have equal polynomial hashes modulo 2**64 for every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(1 << 11)]
    words = bits + [1 - b for b in bits] + bits + [1 - b for b in bits] * 2 + bits
    got = periodic_runs.find_runs(np.array(words, np.int64), np.array([0, len(words)]))
    assert [tuple(r[1:]) for r in got.T.tolist()] == [r for r in by_definition_fast(words)]


def by_definition_fast(words):
    """As by_definition, with NumPy, for long texts without nested periods."""
    x, out = np.array(words), {}
    for p in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], x[:-p] == x[p:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edges:
            if b - a + p >= max(6, 4 * p):
                out.setdefault((int(a), int(b - a + p)), p)
    return sorted(((s, m, p) for (s, m), p in out.items()), key=lambda r: (r[0], r[2]))


def test_query(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    rows = QUERIES["op11_periodic_runs"](spark, SMALL)
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = {}
    for k, t in texts.items():
        words = replayed(re.findall(r"[^\x20\x09-\x0D]+", t or ""), k)
        if len(words) < 1500:
            want[k] = digest(words)
    got = {r[0]: tuple(r[1:]) for r in rows.collect()}
    assert set(got) == set(texts) and len(want) > 150 and {k: got[k] for k in want} == want
    assert sum(n > 0 for n, *_ in want.values()) > 10


def test_awkward_rows(spark):
    long = "a b c " * 100_000 + "d"
    rows = [(1, long), (2, None), (2, None), (3, ""), (4, " \t\n"), (None, "x x x x x x"), (5, "é é é é é é\vz"), (6, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k", "t", "runs", "n_words", "collapsed", "start")})
    out = periodic_runs.periodic_runs(df)
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    assert got == [
        ("1", 300_001, [(0, 300_000, 3)], "a b c d"), ("2", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 0, [], ""),
        ("5", 7, [(0, 6, 1)], "é z"), ("6", 2, [], "one two"), ("None", 6, [(0, 6, 1)], "x"),
    ]
    assert out.where("false").count() == 0 and periodic_runs.periodic_runs(df.where("false")).count() == 0
    same = df.select("doc_id", F.struct(periodic_runs.replayed(F.col("text"), F.col("doc_id")).alias("t")).alias("x")).where("doc_id IS NULL").first()
    assert same.x.t == "x x x x x x"
