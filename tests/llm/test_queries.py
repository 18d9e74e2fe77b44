"""The registered queries, with all columns of their contracts: against SQL, or plain Python where SQL can't say it."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from tokenledger.llm.queries import ORACLE_SQL, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    return {k: (t, lang) for k, t, lang in rows}


def run(spark, name, folder=SMALL):
    return QUERIES[name](spark, folder)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path(name))
    return lambda t: own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_same_as_sql(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    want = sorted(tuple(dict(zip([c[0] for c in want.description], r, strict=True))[c] for c in columns) for r in want.fetchall())
    got = run(spark, name, folder)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want


def test_op1(spark, texts):
    rows = run(spark, "op1_crf_language_id").collect()
    langs = {lang for _, lang in texts.values() if lang}
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    for r in rows:
        letters = any(c.isalpha() for c in texts[r.doc_id][0])
        assert (r.lang_pred == "und") == (not letters) and (r.lang_pred in langs or r.lang_pred == "und") and 0 <= r.score <= 1
    own = [(r.lang_pred, texts[r.doc_id][1]) for r in rows if r.held_out and texts[r.doc_id][1] and r.lang_pred != "und"]
    assert np.mean([a == b for a, b in own]) > 0.9


def test_op2(spark, texts):
    encode, start, want = library("byte_bpe_50k.json"), 0, []
    for k in sorted(texts):
        ids = [*encode(texts[k][0]), 0]
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    got = run(spark, "op2_repair_token_file").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op3(spark, texts):
    data, times = {k: t.encode() for k, (t, _) in texts.items()}, Counter()
    for b in data.values():
        times.update(b[p : p + 200] for p in range(len(b) - 199))
    rows = {r.doc_id: r for r in run(spark, "op3_lpf_substring_dedup").collect()}
    assert set(rows) == set(data)
    for k, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            if times[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        left, r = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]), rows[k]
        spans = int((gone[1:] < gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()), k


def test_op6(spark, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), None] for k, (t, _) in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = run(spark, "op6_context_mixing").collect()
    assert sorted(r.doc_id for r in rows) == sorted(tokens)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9) and r.score < 0


def test_op8(spark, texts):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own, sha = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, (t, _) in sorted(texts.items()):
        ids = own.encode_ordinary(t)
        want.append((k, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    got = run(spark, "op8_spm_byte_bpe").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


def pieces_are_right(rows, ids):
    """Every id of each document in one piece, sequences gapless, full ones of 4096 and others of a power of two."""
    seen, sequences = {k: 0 for k in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == seen[r.doc_id] and len(own) == r.length and r.ids_crc32 == crc(own) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: len(v) for k, v in ids.items()}
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096 and ends[-1] & (ends[-1] - 1) == 0


def test_op9(spark, texts):
    encode = library("word_bpe_49k.json")
    pieces_are_right(run(spark, "op9_hilbert_packing").collect(), {k: [*encode(t), 2] for k, (t, _) in texts.items()})


def test_pipeline_packs_what_its_stages_keep(spark, texts):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    encode = library("word_bpe_49k.json")
    pieces_are_right(c.run(spark, SMALL).collect(), {r.doc_id: [*encode(r.text or ""), 2] for r in docs.collect()})
