"""Awkward tables for every operator and stage: null and repeated keys, megabytes in one text, equal rows, clashing columns, no rows."""

from __future__ import annotations

import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenledger.llm import context_mixing, crf_langid, exact_dedup, hilbert_pack, lpf_dedup, pca_neardup, pii_disclosure, repair, spm_bpe, superminhash

BYTE, WORD, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
#: Names that operators use for columns of their own, or that they return.
CLASHES = [
    "k", "h", "n", "t", "row", "id", "ids", "start", "bands", "content", "rep", "score", "lang_pred", "chunk", "word", "held", "data", "doc", "__row", "__text", "__spans", "__keep_id",
    "keep_id", "kept", "spans", "base", "first", "term", "curve", "place", "c0", "salt_", "often_", "xs", "members",
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    names = ["alpha", "beta", "gamma", "delta", "Straße", "niño", "weiß"]
    long = " ".join(rng.choice(names) + str(rng.randrange(5000)) for _ in range(500_000))
    rows = [(1, long, "en"), (2, "x" * 1_200_000, "de"), (3, "日本語" * 60_000, None), (None, "no key here", "en"), (None, "no key here", "en"), (4, "twice the same row", "de")]
    rows += [(4, "twice the same row", "de"), (4, "another text of the key", "en"), (5, None, None), (5, None, None), (6, "", "en"), (7, " \t\n", "fr"), (8, "mail a.b@c.de and +49 (30) 123456-78", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


OPERATORS = {
    "crf_langid": lambda d: crf_langid.predict(d, crf_langid.learn(d), runs="runs"),
    "repair": lambda d: repair.read_shards(repair.write_shards(d, BYTE, shard_tokens=1 << 16)),
    "lpf_dedup": lambda d: lpf_dedup.remove_spans(lpf_dedup.repeated_spans(d, keep="first")),
    "exact_dedup": exact_dedup.exact_groups,
    "pii_disclosure": pii_disclosure.spans,
    "context_mixing": context_mixing.score,
    "spm_bpe": lambda d: spm_bpe.encode(d, RANKS, P.PATTERN, decoded=True),
    "superminhash": superminhash.near_groups,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(odd, name):
    rows = OPERATORS[name](odd).drop("ids", "runs", "kept", "decoded", "starts", "ends").collect() if name != "exact_dedup" else OPERATORS[name](odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    # repeated rows have equal results, but for the places that number them
    own = [tuple(v for k, v in r.asDict().items() if k not in ("row", "start", "n_removed", "n_spans")) for r in rows if r.doc_id == 5]
    assert len(own) == 2 and own[0] == own[1]
    assert OPERATORS[name](odd.where("false")).count() == 0


def test_packing(odd):
    out = hilbert_pack.pack(odd, WORD)
    counts = {r.doc_id: (r.n, r.most) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("most")).collect()}
    assert set(counts) == {1, 2, 3, 4, 5, 6, 7, 8, None} and counts[5] == (2, 1) and counts[1][0] == counts[1][1] > 1_000_000
    assert hilbert_pack.pack(odd.where("false"), WORD).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, 1e-9]), (5, [float("nan"), 1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("k", "v", "id", "content", "copies", "label", "rep", "links")})
    out = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in pca_neardup.near_vectors(df).collect())
    assert out == sorted([("1", 2, "1", True)] * 2 + [("None", 0, "None", True), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 2, "1", False), ("5", 0, "5", True), ("6", 0, "6", True)])
    assert pca_neardup.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, name, stage):
    rows = stage(spark, odd, "")
    n = rows.count()
    if name == "packing":
        assert n > odd.count()
    else:
        assert rows.columns == odd.columns and {"language_id": 5, "exact_dedup": 8, "minhash_near_dedup": 8, "pii": 13}[name] <= n <= odd.count()
        mail = rows.where("doc_id = 8").first()
        assert mail is not None and mail["salt_"] == CLASHES.index("salt_") and (mail.text == "mail [email] and [phone]") == (name == "pii")
    assert stage(spark, odd.where("false"), "").count() == 0
