"""Conversation repair against plain audit strings, whole and cut into small chunks, and the registered query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import turn_repair
from tokenledger.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SHAPE = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Result of one conversation from rows (turn, role, text), with all cheapest audits as strings and the texts beside them."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"={KEY}\0{r[1]}\0{r[2]}".encode()).hexdigest()))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, counts, best = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, {"": (0, "", ())}
    for _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        for _ in range(2):  # insertions, one after the other
            best = relaxed([(s, *v) for s, v in best.items()] + [(n, c + 2, a + "I", t + (("assistant" if n == "a" else "user") + ":",)) for s, (c, a, t) in best.items() for n in ["a" if s == "u" else "u"]])
        steps, extra = [], fault == "truncated"
        for s, (c, a, t) in best.items():
            steps.append((s, c + 3, a + "D", t))
            if fault not in ("blank", "duplicate"):
                n = "a" if s == "u" else "u"
                steps.append((n, c + 2 + extra, a + "R", t + (("assistant" if n == "a" else "user") + ":" + text,)))
                if role[:1] == n or role[:1] == "s" and s == "":
                    steps.append((role[:1], c + extra, a + "K", t + (role + ":" + text,)))
        best = relaxed(steps)
    for _ in range(2):
        best = relaxed([(s, *v) for s, v in best.items()] + [(n, c + 2, a + "I", t + (("assistant" if n == "a" else "user") + ":",)) for s, (c, a, t) in best.items() if s for n in ["a" if s == "u" else "u"]])
    cost, audit, texts = min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())


KEY = 0


def relaxed(steps):
    out = {}
    for s, *v in steps:
        if s not in out or tuple(v[:2]) < out[s][:2]:
            out[s] = tuple(v)
    return out


def made(rng, k, n):
    role = lambda: rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " "])
    text = lambda: rng.choice(["one.", "two!", "three", " ", "", "four? ", "five\n", "é."])
    turns = [rng.choice([None, i, i, i, i + 3, i // 2]) for i in range(n)]
    return [(k, t, role(), text()) for t in turns]


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("chunk", [3, 16, 2048])
def test_equals_plain_strings(spark, monkeypatch, chunk):
    """Chunks of three turns cut nearly all conversations, so that most edits come from pointers and chosen states."""
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [r for k in range(60) for r in made(rng, k, rng.choice([1, 2, 3, 5, 9, 17, 40]))]
    df = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit(1) for c in ("pos", "conv", "chunk", "same", "at", "lines")})
    got, turns = turn_repair.repair(df)
    found = {r.conv_id: tuple(r[c] for c in FIELDS) for r in got.collect()}
    global KEY
    for k in range(60):
        KEY = k
        assert found[k] == plain([r[1:] for r in rows if r[0] == k]), k
    # the turns' own lines and letters make up the same results
    for k, own in turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "letters", "lines"))).alias("x")).collect():
        lines = [x.lines for x in own if x.lines is not None]
        assert "".join(x.letters for x in own) == found[k][6] and hashlib.sha256("\n".join(lines).encode()).hexdigest() == found[k][7]


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    after = {k: [] for k, *_ in rows}
    for k, t, role, text in rows:
        what = zlib.crc32(f"{k}:{t}".encode()) % 20
        own = (t, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
        after[k] += [own] * {0: 0, 3: 2}.get(what, 1)
    global KEY
    want = {}
    for k, own in after.items():
        KEY = k
        want[k] = plain(own)
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in QUERIES["op12_turn_repair"](spark, SMALL).collect()}
    assert got == want


def test_awkward_rows(spark):
    """Null and repeated rows, a conversation that loses all turns, a long text, no rows."""
    long = "word " * 300_000 + "end."
    rows = [(None, None, None, None), (None, 0, "user", long), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", "b."), (1, 9, None, "c."), (2, 1, "system", "s.")]
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in turn_repair.repair(spark.createDataFrame(rows, SHAPE))[0].collect()}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got == {
        None: (0, 1, 0, 0, 1, 5, "DKI", sha("user:" + long, "assistant:")),
        1: (3, 0, 1, 0, 2, 6, "KDKD", sha("user:a.", "assistant:b.")),
        2: (0, 0, 0, 0, 0, 3, "D", sha()),
    }
    empty = spark.createDataFrame([], SHAPE)
    assert [x.count() for x in turn_repair.repair(empty)] == [0, 0]
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert turn_repair.damaged(spark.createDataFrame([(lost, 0, "user", "gone.")], SHAPE)).count() == 0
