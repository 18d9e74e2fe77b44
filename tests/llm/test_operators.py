"""Operators of the llm subpackage against brute force, on small fixtures with the awkward cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tokenledger.llm import bpe, common, context_mixing, crf_langid, exact_dedup, hilbert_pack, lpf_dedup, pca_neardup, pii_disclosure, repair, spm_bpe, superminhash

BYTE, WORD, RANKS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
random.seed(5)
PASSAGE = " ".join(random.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(random.randrange(90)) for _ in range(80))
TEXTS = [
    "The cat sat on the mat, and the dog saw it.", "The  cat sat on the mat, and the dog saw it.", None, "", "   \n\t ", "it's we'll  I'M <|endoftext|> a  b",
    "x" * 4000, "Σας ΣΑΣ É é ́x", "日本語 テキスト 12345 ½", "a\r\n b", "😀 😀‍ x", "nul\x00byte, here", PASSAGE, "before " + PASSAGE, PASSAGE + " after it all", PASSAGE[:150],
    "mail a@b.c_d@e.f or 1.2.3.4.5.6.7.8 and 256.1.1.1; card 4111 1111 1111 1111, tel +1 (234) 567-8901", "The cat sat on the mat, and the dog saw it.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}", None if t is None else len(t), "clash", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, start int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def library(path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_slices_of_texts_are_lowered_right():
    batch = pa.record_batch({"text": ["Abc", None, "DÉF", "ghI"]}).slice(1)
    assert pc.ascii_lower(common.texts_of(batch)).to_pylist() == ["", "dÉf", "ghi"]


@pytest.mark.parametrize("path,make", [(BYTE, bpe.byte_level), (WORD, bpe.word_level)])
def test_encoders_equal_the_library(path, make):
    want = [library(path)(t) for t in TEXTS]
    for _ in range(2):  # the second time from the caches
        ids, at = make(path).batch(pa.array([t or "" for t in TEXTS], pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("path,make", [(BYTE, bpe.byte_level), (WORD, bpe.word_level)])
def test_added_tokens_are_cut_out_first(path, make):
    """Literals of the file's own tokens, alone, at both ends, side by side, in other case and cut short."""
    texts = ["<|endoftext|>", "a <|endoftext|> b", "A<|startoftext|><|endoftext|>  B", "<|ENDOFTEXT|> x", "<|endoftext", "x.<|endoftext|>\n\ny ", "<|endoftext|><|endoftext|>", "\x00<|startoftext|>z"]
    ids, at = make(path).batch(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library(path)(t) for t in texts]


@pytest.mark.parametrize("little", [0, 3, common.LITTLE])
def test_components(spark, little):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (9, 8), (7, 7), (30, 9)], "a long, b long")
    assert sorted(map(tuple, common.components(edges, little).collect())) == [(2, 1), (3, 1), (9, 8), (30, 8)]
    chain = spark.range(100, 160).selectExpr("id AS a", "id + 1 AS b").repartition(5, "b")
    assert sorted(map(tuple, common.components(chain, little).collect())) == [(v, 100) for v in range(101, 161)]
    assert common.components(edges.where("false"), little).count() == 0


@pytest.mark.parametrize("often", [1, 3, 10_000])
def test_joins_that_spread_often_keys(spark, often, monkeypatch):
    monkeypatch.setattr(common, "OFTEN", often)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 14}" if i % 3 else None) for i in range(400)], "i long, k string")
    facts = rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).where("k <> 'k2'").withColumn("v", F.length("k"))
    want = sorted(map(str, rows.join(facts, "k").select("k", "i", "n", "v").collect()))
    assert sorted(map(str, common.salted_join(rows, facts, "k", "n", ["i"]).select("k", "i", "n", "v").collect())) == want
    assert sorted(map(str, common.spread_join(rows, facts, common.often_keys(facts, "k", "n"), "k").select("k", "i", "n", "v").collect())) == want and len(want) > 200
    assert common.salted_join(rows.where("false"), facts.where("false"), "k", "n", ["i"]).count() == 0


# op1


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    for n in (1, 7, 200):
        e, move, first = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        starts = rng.random(n) < 0.1
        starts[0] = True
        want, cuts = [], [*np.flatnonzero(starts), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p, m = np.exp(e[a:b]), np.exp(move)
            forward, back = [np.exp(first) * p[0]], [np.ones(3)]
            for t in range(1, b - a):
                forward.append(forward[-1] @ m * p[t])
            for t in range(b - a - 1, 0, -1):
                back.insert(0, m @ (p[t] * back[0]))
            g = np.array(forward) * np.array(back)
            want.append(g / g.sum(1, keepdims=True))
        assert np.allclose(np.concatenate(want), crf_langid.posteriors(e, starts, move, first))


def test_language_id(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = crf_langid.learn(real)
    rows = crf_langid.predict(real.withColumn("held", crf_langid.held_out(real.doc_id)), model, keep=("lang", "held")).where("held AND lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in crf_langid.predict(docs, model).collect()}
    assert len(odd) == len(TEXTS) and all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (2, 3, 4)) and odd[6].lang_pred != "und"
    assert crf_langid.predict(empty, model).count() == 0 and crf_langid.predict(docs, crf_langid.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_languages_of_long_texts_are_learned(spark):
    import corpus_pipeline as c

    rows = [(i, "house water green " * 20, "en") for i in range(40)] + [(100 + i, "1" * 5000 + " haus wasser gruen" * 400, "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in crf_langid.predict(docs, crf_langid.learn(docs)).collect()} == {k: lang for k, _, lang in rows}
    bare = docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert c.language_id(spark, bare, "").count() == len(rows)


def test_switches_are_learned():
    text = lambda w: " ".join(w * 40)
    model = crf_langid.fit([(text(["house", "water", "green"]), "en"), (text(["haus", "wasser", "gruen"]), "de")])
    emit, _ = model.emissions(["house", "wasser"])
    mean = crf_langid.posteriors(emit[[0, 0, 0, 0, 1, 1, 1, 1]], np.arange(8) == 0, model.moves, model.first)
    assert [model.labels[i] for i in mean.argmax(1)] == ["en"] * 4 + ["de"] * 4


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(8)
    vocabulary = ["house", "haus", "maison", "water", "wasser", "eau", "x", "yy"]
    runs = [(int(rng.integers(3)), [vocabulary[i] for i in rng.integers(0, 8, rng.integers(1, 7))]) for _ in range(14)]
    chain = crf_langid.Chain(runs, 3, {"water": (0,), "x": (0, 2)})
    weights, moves, first = rng.normal(0, 0.3, (1 << crf_langid.BITS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)

    def likelihood(weights, moves, first):
        emit, total = chain.emissions(weights), 0.0
        cuts = [*np.flatnonzero(chain.starts), len(emit)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            truth = chain.gold[a:b].argmax(1)
            own = first[truth[0]] + emit[a + np.arange(b - a), truth].sum() + moves[truth[:-1], truth[1:]].sum()
            reach = first + emit[a]
            for t in range(a + 1, b):
                reach = np.log(np.exp(reach[:, None] + moves).sum(0)) + emit[t]
            total += own - np.log(np.exp(reach).sum())
        return total

    steps = chain.gradient(weights, moves, first)
    for which, step in enumerate(steps):
        places = zip(*np.nonzero(step), strict=True) if which == 0 else np.ndindex(step.shape)
        for place in list(places)[:12]:
            pair = []
            for d in (1e-5, -1e-5):
                moved = [weights, moves, first]
                moved[which] = moved[which].copy()
                moved[which][place] += d
                pair.append(likelihood(*moved))
            assert math.isclose((pair[0] - pair[1]) / 2e-5, step[place], rel_tol=1e-4, abs_tol=1e-6)


def test_prediction_and_fit_share_features():
    runs = [(0, ["house", "internationalisation" * 4, "x"]), (1, ["haus"])]
    chain = crf_langid.Chain(runs, 2, {"haus": (1,)})
    weights = np.random.default_rng(0).normal(size=(1 << crf_langid.BITS, 2))
    model = crf_langid.Model(["a", "b"], weights, np.eye(2), np.zeros(2), {"haus": (1,)})
    names = [w for _, run in runs for w in run]
    assert np.allclose(model.emissions(names)[0], chain.emissions(weights), atol=1e-5)
    model.held = 1 << 40  # a full cache is emptied
    assert np.allclose(model.emissions(names[::-1])[0], chain.emissions(weights)[::-1], atol=1e-5) and len(model.rows) == 4


def test_word_runs(spark):
    model = crf_langid.fit([(" ".join(["house", "water", "green"] * 40), "en"), (" ".join(["haus", "wasser", "gruen"] * 40), "de")])
    texts = ["house water 12 green house\n\n haus wasser gruen! wasser", "é ½ house", "", None, "...", "haus"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    out = {r.doc_id: r for r in crf_langid.predict(docs, model, keep=("doc_id", "score"), names=("l", "s"), runs="runs").collect()}
    assert [(texts[0][r.start : r.end], r["lang"]) for r in out[0].runs] == [("house water 12 green house", "en"), ("haus wasser gruen! wasser", "de")]
    assert [(texts[1][r.start : r.end], len(r["lang"])) for r in out[1].runs][-1][0].endswith("house") and all(out[i].runs == [] for i in (2, 3, 4))
    assert [tuple(r) for r in out[5].runs] == [(0, 4, "de")] and out[5].l == "de" and out[5].score == 0.5


def test_places_of_words():
    texts = ["", " a  béc\t", "日本 x", "\n", "abc"]
    low, high = crf_langid.places(common.texts_of(pa.record_batch({"text": texts})))
    want = [m.span() for t in texts for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    assert list(zip(low.tolist(), high.tolist(), strict=True)) == want


def test_language_stage_keeps_clashing_columns(spark):
    rows = [(i, w * 30, lang, 7.0, "mine", None) for i, (w, lang) in enumerate([("house water green ", "en"), ("haus wasser gruen ", "de")] * 8)] + [(90, None, "en", 1.0, "x", "y"), (91, "", None, None, None, None), (None, "house water " * 20, None, 2.0, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, __text string")
    kept = crf_langid.drop_unclear(docs, crf_langid.learn(docs), 0.4)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in (90, 91))


def test_lanes_equal_plain_forward_backward():
    rng = np.random.default_rng(5)
    for n, k, share in ((1, 2, 1.0), (70, 3, 0.1), (900, 4, 0.01), (900, 4, 0.0), (400, 2, 0.6)):
        emit, moves, first = rng.normal(0, 2, (n, k)), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k)
        starts = rng.random(n) < share
        starts[0] = True
        alpha, beta = np.empty((n, k)), np.ones((n, k))
        for i in range(n):
            alpha[i] = np.exp(emit[i]) * (np.exp(first) if starts[i] else alpha[i - 1] @ np.exp(moves))
            alpha[i] /= alpha[i].sum()
        for i in range(n - 2, -1, -1):
            beta[i] = 1.0 if starts[i + 1] else np.exp(moves) @ (np.exp(emit[i + 1]) * beta[i + 1])
            beta[i] /= beta[i].sum()
        want = alpha * beta
        assert np.allclose(crf_langid.posteriors(emit, starts, moves, first), want / want.sum(1, keepdims=True), atol=1e-9)


# op2


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    counts = np.array([1, 0, 5000, 3, 20000, 1])
    ids = rng.integers(0, 6, counts.sum()).astype(np.uint32)
    ids[100:3000] = 4
    at = np.concatenate([[0], np.cumsum(counts)])
    blob = repair.compress(ids, at, min_uses=4)
    shard = repair.Shard(blob)
    flat, ends = shard.tokens()
    assert (flat == ids).all() and (ends == at).all() and len(blob) < 4 * len(ids) and len(shard.left)
    for i in range(6):
        own = ids[at[i] : at[i + 1]]
        assert (shard.document(i) == own).all() and (shard.document(i, 2, 700) == own[2:700]).all()
    none = repair.Shard(repair.compress(np.empty(0, np.uint32), np.zeros(1, np.int64)))
    assert len(none.tokens()[0]) == 0


def test_repair_leaves_no_frequent_pair():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 5000, 3000)
    docs = [np.concatenate([rng.integers(0, 300, rng.integers(0, 400)), passage]) for _ in range(9)] + [np.arange(2000)] * 5 + [np.full(n, 7) for n in (1, 2, 3, 1000)]
    ids, at = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    shard = repair.Shard(repair.compress(ids, at))
    assert (shard.tokens()[0] == ids).all() and shard.expands.max() >= 2000
    left = Counter()
    for a, b in zip(shard.ends[:-1], shard.ends[1:], strict=True):
        own, i = shard.symbols[a:b].tolist(), 0
        last = {}
        for i, pair in enumerate(zip(own, own[1:])):  # noqa: B905
            if last.get(pair) != i - 1:
                left[pair] += 1
                last[pair] = i
    assert max(left.values()) < repair.MIN_USES
    assert len(shard.symbols) + 3 * len(shard.left) < 0.5 * len(ids)


def test_token_files(docs, empty):
    out = repair.read_shards(repair.write_shards(docs, BYTE, shard_tokens=64)).orderBy("doc_id").collect()
    want, start = library(BYTE), 0
    assert [r.doc_id for r in out] == list(range(len(TEXTS)))
    for r, text in zip(out, TEXTS, strict=True):
        assert r.start == start and np.frombuffer(bytes(r.ids), "<u4").tolist() == [*want(text), 0]
        start += len(r.ids) // 4
    assert repair.read_shards(repair.write_shards(empty, BYTE)).count() == 0


# op3


@pytest.mark.parametrize("keep,large", [("none", 20_000), ("none", 1), ("first", 20_000), ("first", 1)])
def test_repeated_spans(docs, keep, large):
    rows = {r.doc_id: r for r in lpf_dedup.remove_spans(lpf_dedup.repeated_spans(docs, 200, keep, large=large)).collect()}
    data = [(t or "").encode() for t in TEXTS]
    first, times = {}, Counter()
    order = sorted(rows, key=lambda k: rows[k].row)
    for k in order:
        for p in range(len(data[k]) - 199):
            first.setdefault(data[k][p : p + 200], (k, p))
            times[data[k][p : p + 200]] += 1
    for k, b in enumerate(data):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 199):
            s = b[p : p + 200]
            if times[s] > 1 and (keep == "none" or first[s] != (k, p)):
                gone[p : p + 200] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        assert (bytes(rows[k].kept), rows[k].n_removed) == (left, int(gone.sum())), k


def test_suffix_order_and_smaller_places_equal_brute_force():
    rng = np.random.default_rng(1)
    for length in (16, 21):
        data = np.tile(rng.integers(0, 3, 12), 500).astype(np.uint8)
        data[rng.integers(0, 6000, 40)] = 7
        m = 60
        lead, count = rng.integers(0, 9, m), np.empty(m, np.int64)
        count[:] = [rng.integers(1, x + 2) for x in lead]
        offset, bucket = np.sort(rng.choice(5900, m, replace=False)), rng.integers(0, 4, m)
        context, inner = lpf_dedup.sorted_suffixes(bucket, lead, offset, count, data, length)
        assert sorted(zip(context, inner, strict=True)) == [(c, j) for c in range(m) for j in range(count[c])]
        at, group = offset[context] + inner, bucket[context] * length + lead[context] - inner
        text = [bytes(data[p : p + length]) for p in at]
        for g in set(group):
            own = [text[i] for i in np.flatnonzero(group == g)]
            assert own == sorted(own)
        same = lpf_dedup.plateaus(at, group, data, length)
        assert same.tolist() == [text[i] == text[i - 1] and group[i] == group[i - 1] for i in range(1, len(at))] and same.any()
        place = context * length + inner
        previous, following = lpf_dedup.smaller_neighbours(place, same)
        first = {}
        for i in np.argsort(place):
            # the longest previous factor reaches the length if the same bytes start at a smaller place
            assert (previous[i] or following[i]) == ((group[i], text[i]) in first)
            first.setdefault((group[i], text[i]), i)


def test_smaller_places_on_both_sides():
    same = np.array([True, True, False, True])
    previous, following = lpf_dedup.smaller_neighbours(np.array([5, 2, 9, 4, 1]), same)
    assert previous.tolist() == [False, False, True, False, False] and following.tolist() == [True, False, False, True, False]


def test_repeated_spans_of_long_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(lpf_dedup, "_BLOCK", 1 << 16)
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(97, 123, 2_000_000)))
    part = long[65_400:66_200]
    rows = [(1, long + part), (1, "x" + part), (None, "é" * 150), (None, "é" * 150), (3, None), (4, "short")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, row int, h int").coalesce(1)
    out = sorted(tuple(r) for r in lpf_dedup.remove_spans(lpf_dedup.repeated_spans(df)).selectExpr("coalesce(doc_id, -1)", "n_bytes", "n_removed", "n_spans").collect())
    assert out == sorted([(1, 2_000_800, 1600, 2), (1, 801, 800, 1), (-1, 300, 300, 1), (-1, 300, 300, 1), (3, 0, 0, 0), (4, 5, 0, 0)])


def test_repeated_spans_of_nothing(empty):
    assert lpf_dedup.remove_spans(lpf_dedup.repeated_spans(empty)).count() == 0


# op4


def test_exact_groups(docs, empty):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in TEXTS]
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        group = [i for i, n in enumerate(norm) if n == norm[r.doc_id]]
        best = min(group, key=lambda i: (-len(TEXTS[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(group), best == r.doc_id, hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm)) and exact_dedup.exact_groups(empty).count() == 0


# op5


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])[::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans(spark, docs, empty):
    odd = ["é@b.c a..b@c-d.e 9999.1.1.1 4111-1111-1111-1111", "1" * 50, "+1" * 30 + " +1 2 3 4 5 6 7 8 9 0 1 2", "a@b a@b.c. x.@y.z", "01.002.0003.4 12 34"]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in more.collect()}
    for r in pii_disclosure.spans(more).collect():
        assert [(x.start, x.kind, x.end) for x in r.base] == plain_spans(text[r.doc_id])
        assert [x for x in r.spans if x.kind < 4] == r.base
    assert pii_disclosure.spans(empty).count() == 0


def test_telling_terms(spark):
    rows = [(i, f"note {i}: the falconer wrote to secret@box.org about the trip {i}") for i in range(4)] + [(10 + i, f"the plain text {i} about the trip") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in pii_disclosure.spans(docs).collect()}
    terms = {x.value for r in out.values() for x in r.spans if x.kind == 4}
    assert "falconer" in terms and not terms & {"the", "about", "trip"} and all(not out[10 + i].spans for i in range(40))
    clean = {r.doc_id: r.text for r in pii_disclosure.sanitised(docs).collect()}
    assert "falconer" not in clean[0] and "[email]" in clean[0] and clean[12] == "the plain text 2 about the trip"


def test_copied_texts_count_once_as_evidence(spark):
    rows = [f"note {i}: the falconer wrote to secret@box.org about the trip {i}" for i in range(4) for _ in range(50)]
    rows += [f"the plain text {i} about the trip" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: {x.value for x in r.spans if x.kind == 4} for r in pii_disclosure.spans(docs).collect()}
    assert all("falconer" in out[i] and not out[i] & {"the", "about", "trip"} for i in range(200)) and not any(out[i] for i in range(200, 600))


def test_telling_terms_everywhere(spark):
    far = " ".join(["about the trip"] * 60)
    rows = [f"Dear Falconer, {far} again {i} {far} Regards, secret@box.org" for i in range(4)] + [f"the plain text {i} about the trip" for i in range(400)]
    rows += [f"no address, but a falconer: {far} (Falconer) {'x' * 200}falconer falconers"] + [f"mail many@box.org about the trip {i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end, x.value) for x in r.spans if x.kind == 4] for r in pii_disclosure.spans(docs).collect()}
    # brute force: all pairs of an entity and a term that share texts
    term = lambda w: re.sub(r"^[^a-z]+|[^a-z]+$", "", w.lower())
    texts, holds, occurs = set(rows), {}, {}
    for t in texts:
        for a, _, b in plain_spans(t):
            holds.setdefault(t[a:b], set()).add(t)
        for w in t.split():
            occurs.setdefault(term(w), set()).add(t)
    n, telling = len(texts), set()
    for e in holds.values():
        for w, o in occurs.items():
            if w and len(e & o) >= 2 and len(e) < n and math.log2(len(e & o) * n / (len(e) * len(o))) >= 0.9 * math.log2(n / len(e)):
                telling.add(w)
    for i, t in enumerate(rows):
        inside = lambda m: any(a < m.end() and m.start() < b for a, _, b in plain_spans(t))
        assert got[i] == [(m.start(), m.end(), term(m[0])) for m in re.finditer(r"\S+", t) if term(m[0]) in telling and not inside(m)]
    assert "falconer" in telling and [x[2] for x in got[404]] == ["falconer"] * 2 and not telling & {"about", "the", "trip"}


# op6


def test_context_mixing(docs, empty):
    rows = {r.doc_id: r for r in context_mixing.score(docs, chunk=2000).collect()}
    tokens = {i: [*words(t), None] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9) and -1e5 < r.score < 0 and r.bits_per_byte > 0
    assert context_mixing.score(empty).count() == 0


def test_words_share_decisions():
    names = sorted(["a", "ab", "abc", "abd", "b", "zz", "y" * 100])
    nodes = context_mixing.Nodes(names)
    zeros, ones = np.zeros(context_mixing._STARTS[-1]), np.zeros(context_mixing._STARTS[-1])
    nodes.add(zeros, ones, np.ones(len(names), np.int64))
    assert (zeros + ones).sum() == 4 * 8 * sum(len(w) + 1 for w in names)
    alone = [context_mixing.word_logs([w], zeros, ones, np.full((25, 4), 0.3))[0] for w in names]
    assert np.allclose(alone, context_mixing.word_logs(names, zeros, ones, np.full((25, 4), 0.3)))


def test_next_bytes_add_up_to_one():
    rng = np.random.default_rng(4)
    zeros, ones = (rng.integers(0, 40, context_mixing._STARTS[-1]).astype(np.float32) for _ in range(2))
    weights = rng.normal(0.3, 0.2, (25, 4))
    for prefix in ("", "th", "wxyz"):
        words = [prefix + chr(b) for b in range(128)]
        nodes = context_mixing.Nodes(words)
        x, gate = nodes.inputs(zeros, ones, False)
        z = np.einsum("bdk,bdk->bd", x, weights[gate])
        p = np.where(nodes.bits == 1, context_mixing.squash(z), context_mixing.squash(-z))
        last = np.array([nodes.source[np.flatnonzero(nodes.word == i)[-2]] for i in range(128)])  # the byte before the end
        assert math.isclose(p[last, 1:].prod(1).sum(), 1, rel_tol=1e-9)  # half of all bytes: their first bit is 0


def test_own_words_equal_brute_force():
    rng = np.random.default_rng(2)
    offsets = np.array([0, 0, 1, 40, 41, 300])
    codes = rng.integers(0, 9, 300)
    alone, after = context_mixing.own_words(codes, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = codes[a:b].tolist()
        for i, w in enumerate(own):
            assert math.isclose(alone[a + i], own[:i].count(w) / max(1, i))
            pairs = list(zip(own[:i], own[1:i], strict=False))
            starts = [x for x, _ in pairs]
            want = pairs.count((own[i - 1], w)) / max(1, starts.count(own[i - 1])) if i else 0
            assert math.isclose(after[a + i], want)


def test_mixing_follows_the_better_predictor(monkeypatch):
    monkeypatch.setattr(context_mixing, "REFINE", 2)
    rng = np.random.default_rng(3)
    offsets, n = np.array([0, 5, 5, 12]), 12
    coded, parts = np.log10(rng.random(n)), tuple(np.where(rng.random(n) < 0.4, 0, rng.random(n)) for _ in range(3))
    counted = rng.random(n) < 0.7
    got = context_mixing.refined(coded, parts, offsets, counted)
    for d in range(3):
        share, total = np.array(context_mixing.START) * context_mixing.STRENGTH, 0.0
        own = range(offsets[d], offsets[d + 1])
        for begin in range(0, len(own), 2):
            weight, gain = share / share.sum(), np.zeros(4)
            for i in own[begin : begin + 2]:
                each = weight * np.array([10 ** coded[i], *(p[i] for p in parts)])
                total += math.log10(each.sum()) * counted[i]
                gain += each / each.sum()
            share = share + gain
        assert math.isclose(got[d], total, abs_tol=1e-12)
    assert math.isclose(context_mixing.refined(np.array([-400.0]), (np.zeros(1),) * 3, np.array([0, 1]), np.ones(1, bool))[0], -400 + math.log10(0.1))


def test_segments_and_their_bits(monkeypatch):
    monkeypatch.setattr(context_mixing, "SPARSE", 4)
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    parts = [rng.integers(0, 30, n) for n in (0, 2, 3, 80, 1, 200)]
    parts += [parts[3], np.concatenate([parts[5][:100], parts[3]])]
    offsets, codes = np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts)
    first, end, before, found = context_mixing.segments(words[codes], offsets)
    owner = np.searchsorted(offsets, first, "right") - 1
    assert len(first) > 60 and (first < end).all() and (end <= offsets[owner + 1]).all() and (before % np.uint64(4) == 0).all()
    assert all(end[i] == (first[i + 1] if i + 1 < len(first) and owner[i + 1] == owner[i] else offsets[owner[i] + 1]) for i in range(len(first)))
    names = {}
    for i in range(len(first)):
        names.setdefault(tuple(codes[first[i] - 3 : end[i]]), set()).add((before[i], found[i]))
    assert all(len(x) == 1 for x in names.values()) and len({x for v in names.values() for x in v}) == len(names) < len(first)

    known, same = rng.integers(0, 6, len(first)), rng.integers(0, 3, len(first))
    ways, same = np.minimum(known, 2), np.minimum(same, known)
    logs, hit = context_mixing.segment_logs(owner, known, ways, same)
    for d in set(owner.tolist()):
        weights, won, tries, state = np.tile(context_mixing.SEGMENT_START, (12, 1)), 0, 0, 0
        for i in np.flatnonzero(owner == d):
            if not known[i]:
                assert logs[i] == 0 and not hit[i]
                continue
            x = np.array([math.log((known[i] + 0.2) / (ways[i] + 0.2)), math.log((won + 0.4) / (tries - won + 0.4)), 1])
            gate = min(3, int(math.log2(known[i]))) * 3 + state
            p, bit = 1 / (1 + math.exp(-weights[gate] @ x)), bool(same[i])
            assert math.isclose(logs[i], math.log10(p * same[i] / known[i]) if bit else math.log10(1 - p), rel_tol=1e-9) and hit[i] == bit
            weights[gate] += context_mixing.SEGMENT_RATE * (bit - p) * x
            won, tries, state = won + bit, tries + 1, 1 if bit else 2


def test_spelling_tables_add_up(spark, docs, monkeypatch):
    whole = {r.doc_id: r.score for r in context_mixing.score(docs, chunk=1 << 30).collect()}
    import zstandard

    press, rng = zstandard.ZstdCompressor(), np.random.default_rng(0)
    tables = rng.integers(0, 1 << 40, (7, 2 * int(context_mixing._STARTS[-1])))
    rows = [(n, i, bytearray(press.compress(x.tobytes()))) for n in range(7) for i, x in enumerate(np.array_split(tables[n], context_mixing.PARTS))]
    rows += [(n, context_mixing.PARTS, bytearray(press.compress(np.append(np.full(100, 2.0 * n), [n, 1]).tobytes()))) for n in range(7)]
    monkeypatch.setattr(context_mixing, "FAN", 3)
    counts, (learned, of), weights = context_mixing._summed(spark.createDataFrame(rows, "nth long, part int, data binary"), 7)
    assert (counts == tables.sum(0).astype(np.float32)).all() and (learned, of) == (21, 7) and (weights == 2).all()
    assert len(whole) == len(TEXTS)


def test_repeated_documents_score_apart(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 3000) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(8)] + [(200, None), (200, ""), (None, "w1"), (300, "y" * 300_000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, chunk int, word string")
    out = [(r.doc_id, r.bits_per_byte, r.n_tokens, r.score) for r in context_mixing.score(df, chunk=20_000).collect()]
    bits = {k: b for k, b, *_ in out}
    alone, twice = [bits[i] for i in range(8, 40)], [bits[i] for i in range(8)] + [bits[100 + i] for i in range(8)]
    held = {k for k in bits if k is not None and zlib.crc32(str(k).encode()) % 5 == 1}
    learned_twin = [i for i in range(8) if 100 + i not in held] + [100 + i for i in range(8) if i not in held]
    assert len(out) == len(rows) and max(bits[i] for i in learned_twin) < min(alone) and np.mean(twice) < np.mean(alone) / 2
    assert sorted(n for k, _, n, _ in out if k == 200) == [1, 1] and all(s < 0 for *_, s in out)


# op7


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 24))
    x = np.concatenate([base, base[:10] + rng.normal(size=(10, 24)) * 0.2, base[:5] * 3, np.repeat(base[:1], 8, 0)])
    odd = [None, [0.0] * 24, [1.0] * 23 + [float("nan")], [1.0] * 23 + [None], [float("inf")] * 24, []]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(500 + i, v, 2) for i, v in enumerate(odd)] + [(None, x[0].tolist(), 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, k int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(x))])
    out = {r.vec_id: r for r in pca_neardup.near_vectors(df).collect()}
    assert all((out[i].n_links, out[i].component_id, out[i].kept) == (link[i].sum(), root[i], root[i] == i) for i in range(len(x)))
    assert all((out[500 + i].n_links, out[500 + i].component_id) == (0, 500 + i) for i in range(len(odd))) and out[None].kept
    assert pca_neardup.near_vectors(df.where("false")).count() == 0


def test_vectors_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(150):  # pairs built to have a cosine of 0.9, or as near as doubles come
        a = rng.normal(size=40)
        a /= np.linalg.norm(a)
        b = rng.normal(size=40)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [a * 3, 0.9 * a + math.sqrt(1 - 0.81) * b]
    x = np.array(rows)
    near = {i for i in range(0, 300, 2) if np.einsum("i,i->", x[i], x[i + 1]) / (np.sqrt(np.einsum("i,i->", x[i], x[i])) * np.sqrt(np.einsum("i,i->", x[i + 1], x[i + 1]))) >= 0.9}
    assert 20 < len(near) < 130
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.component_id for r in pca_neardup.near_vectors(df).collect()}
    wrong = sum((out[i + 1] == i) != (i in near) for i in range(0, 300, 2))
    assert wrong <= 3  # the order in which a product is summed moves its last place


def test_vectors_of_repeated_keys(spark):
    e = np.eye(6) * 1e300
    rows = [(1, e[0]), (1, e[1]), (2, e[0] + 0.1 * e[2]), (3, e[1] * 0.5), (4, e[3]), (4, e[3]), (5, e[4]), (None, e[4]), (6, e[5][:0])]
    df = spark.createDataFrame([(k, v.tolist(), 1, "x") for k, v in rows], "vec_id long, embedding array<double>, k int, content string")
    out = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in pca_neardup.near_vectors(df).collect()}
    assert out == {(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 0, 5, True), (None, 0, None, True), (6, 0, 6, True)}


def test_tiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pca_neardup, "SIDE_ROWS", 16)
    monkeypatch.setattr(pca_neardup, "STRIP", 8)
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(20, 12))[rng.integers(0, 20, 500)] + rng.normal(size=(500, 12)) * 0.25).astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.n_links for r in pca_neardup.near_vectors(df).collect()}
    assert [out[i] for i in range(500)] == link.sum(1).tolist() and link.sum() > 1000


# op8


def test_sentencepiece_form_equals_rank_encoder(docs, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spm_bpe.decode(spm_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(rows) == len(TEXTS) and sorted(map(str, rows)) == sorted(map(str, spm_bpe.encode(docs, RANKS, P.PATTERN, decoded=True).collect()))
    for r in rows:
        assert r.ids == own.encode_ordinary(TEXTS[r.doc_id] or "") and bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()
    assert spm_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


# op9


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    path = grid[np.argsort(hilbert_pack.hilbert_keys(grid, 3))]
    assert sorted(hilbert_pack.hilbert_keys(grid, 3)) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing(docs, empty):
    rows = hilbert_pack.pack(docs, WORD, size=256).collect()
    want = library(WORD)
    parts: dict[int, list] = {}
    for r in rows:
        own = [*want(TEXTS[r.doc_id]), 2]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == own[r.start : r.start + r.length] and r.doc_tokens == len(own)
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(want(t)) + 1 for t in TEXTS)
    for own in parts.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and (ends[-1] & (ends[-1] - 1)) == 0
    assert hilbert_pack.pack(empty, WORD).count() == 0


# op10


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:360], rng.integers(0, 1 << 63, 40, dtype=np.uint64)]))
    s = superminhash.signatures([a, b, a[:3], np.empty(0, np.uint64)], 255)
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.1 and np.isfinite(s[2]).all() and np.isinf(s[3]).all()


def test_near_groups(spark, docs, empty):
    base = [f"w{i}" for i in range(120)]
    texts = dict(enumerate(TEXTS))
    for i in range(60):  # more than a small bucket, not all linked
        own = list(base)
        for _ in range(random.randint(0, 4)):
            own[random.randrange(120)] = f"x{random.random()}"
        texts[100 + i] = " ".join(own)
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    out = {r.doc_id: r for r in superminhash.near_groups(df, 85).collect()}
    assert {k: out[k].component_id for k in out} == {k: top(k) for k in sets} and all(out[k].n_shingles == len(sets[k]) for k in sets)
    assert superminhash.near_groups(empty).count() == 0 and superminhash.drop_near_copies(docs).columns == docs.columns


@pytest.mark.parametrize("small", [16, 2])
def test_near_groups_of_repeated_keys(spark, small, monkeypatch):
    monkeypatch.setattr(superminhash, "SMALL", small)
    near = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, near("a")), (1, near("b")), (2, near("a") + " x"), (3, near("b") + " y"), (4, near("c")), (5, near("c")), (5, near("d")), (6, near("d") + " z")]
    rows += [(7, None), (8, ""), (None, near("a")), (9, near("e")), (9, None), (10, near("e"))] + [(11, near("f"))] * 40 + [(20 + i, near("a") + f" u{i}") for i in range(30)]
    df = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, k int, id int, __keep_id int")
    out = superminhash.near_groups(df, 85).collect()
    assert len(out) == len(rows)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, None: None, 9: 9, 10: 9, 11: 11} | {20 + i: 1 for i in range(30)}
    assert {(r.doc_id, r.component_id) for r in out} == set(want.items()) and all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = superminhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "4", "7", "8", "9", "9", "None"] + ["11"] * 40)


def test_exact_groups_of_repeated_keys(spark):
    rows = [(1, "a b"), (1, "c"), (2, "ab"), (None, "c"), (None, None), (3, ""), (3, " " * 70000)] + [(4, "hot")] * 300
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, k int, doc string")
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert out == {(1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (None, 1, 2, False), (None, 3, 3, False), (3, 3, 3, True), (4, 4, 300, True)}
    assert exact_dedup.drop_copies(df).columns == df.columns and exact_dedup.drop_copies(df).where("doc_id = 1").count() == 2


# pipeline


def test_pipeline(spark, docs, empty):
    import corpus_pipeline as c

    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now, n = real, real.count()
    for name, stage in c.STAGES[:-1]:
        now = common.stored(stage(spark, now, ""), name)
        assert now.columns == real.columns and 0 < now.count() <= n
        n = now.count()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in now.collect()]
    assert len(set(norm)) == n and all(not plain_spans(r.text) for r in now.collect())
    packed = c.STAGES[-1][1](spark, now, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    for name, stage in c.STAGES:
        assert stage(spark, empty.select(*real.columns), "").count() == 0, name
