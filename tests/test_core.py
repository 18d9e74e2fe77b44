"""Operators without SQL counterpart: against numpy, plain Python or recorded values."""

import itertools
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenledger.functions import canonical, text
from tokenledger.operators import clusters, contracts, models, morphology, pairs, qc, ranks, splits, stats, tokenizer
from tokenledger.plans import catalog
from tokenledger.sources import environment, files

DATA = "/root/testdata/sf0.001"


# models


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    n, g = 600, 15
    group, x = rng.integers(0, g, n), rng.normal(size=(n, 3))
    x[:, 2] = x[:, 1] + rng.normal(size=n) * 0.2
    y = 1 + x @ [2.0, -1.0, 0.5] + rng.normal(size=g)[group] * 1.5 + rng.standard_t(3, n) * 0.3
    rows = [(f"g{a}", *map(float, b), float(c)) for a, b, c in zip(group, x, y, strict=True)] + [("g0", None, 0.0, 0.0, 1.0), (None, 0.0, 0.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, "s string, x1 double, x2 double, x3 double, y double"), group, x, y


def test_least_squares_and_increment(sample):
    df, _, x, y = sample
    df = df.where("s IS NOT NULL")
    design = np.column_stack([np.ones(len(y)), x])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    fit = models.least_squares(df, ["x1", "x2", "x3"], "y")
    assert np.allclose(fit["beta"], want) and fit["n"] == len(y) and math.isclose(fit["rss"], ((y - design @ want) ** 2).sum(), rel_tol=1e-9)
    small = np.column_stack([np.ones(len(y)), x[:, 0]])
    rss = ((y - small @ np.linalg.lstsq(small, y, rcond=None)[0]) ** 2).sum()
    gain = models.block_increment(df, ["x1"], ["x1", "x2", "x3"], "y")
    assert math.isclose(gain["f"], (rss - fit["rss"]) / 2 / (fit["rss"] / (len(y) - 4)), rel_tol=1e-9) and 0 <= gain["p_value"] < 1e-6


def test_fixed_effects_equal_dummies(sample):
    df, group, x, y = sample
    dummies = np.eye(15)[group]
    want = np.linalg.lstsq(np.column_stack([x[:, :2], dummies]), y, rcond=None)[0][:2]
    fit = models.fixed_effects(df, ["x1", "x2"], "y", "s")
    assert np.allclose(fit["beta"], want) and fit["groups"] == 15
    rows = models.nested_models(df, {"M0": ["x1"], "M1": ["x2"]}, "y", "s")
    assert rows[1]["r2"] > rows[0]["r2"] and math.isclose(rows[1]["delta_r2"], rows[1]["r2"] - rows[0]["r2"]) and rows[0]["f"] is None


def test_tail_of_f():
    rng = np.random.default_rng(2)
    draws = (rng.chisquare(3, 400_000) / 3) / (rng.chisquare(20, 400_000) / 20)
    for f in (0.2, 1.0, 2.5, 5.0):
        assert abs(models.f_tail(f, 3, 20) - (draws > f).mean()) < 4e-3
    assert math.isclose(models.f_tail(1.0, 7, 7), 0.5, rel_tol=1e-12) and models.f_tail(0, 1, 1) == 1


def test_inflation(sample):
    df, _, x, _ = sample
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    rows = models.inflation(df.where("s IS NOT NULL"), ["x1", "x2", "x3"])
    assert np.allclose([r["vif"] for r in rows], want) and [r["severe"] for r in rows] == (want > 10).tolist() and [r["warning"] for r in rows] == (want > 5).tolist()


def test_huber_resists_outliers_at_any_scale(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    for scale in (1.0, 1000.0):
        y = scale * (3 * x + rng.normal(size=400) * 0.1)
        y[:30] += scale * 50
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
        fit = models.huber(df, ["x"], "y")
        assert fit["converged"] and abs(fit["beta"][1] / scale - 3) < 0.05 and abs(fit["beta"][0] / scale) < 0.1


def test_quantile_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.random(800)
    y = 2 * x + (1 + x) * rng.normal(size=800)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    for q in (0.5, 0.9):
        beta = models.quantile_regression(df, ["x"], "y", q)["beta"]
        loss = lambda b, q=q: np.where((r := y - b[0] - b[1] * x) >= 0, q * r, (q - 1) * r).mean()
        near = min(loss(beta + d) for d in itertools.product((-0.05, 0, 0.05), repeat=2))
        assert loss(beta) <= near * 1.001 and abs((y <= beta[0] + beta[1] * x).mean() - q) < 0.02


def test_random_intercept(sample):
    df, group, x, y = sample
    fit = models.random_intercept(df, ["x1", "x2"], "y", "s")
    design = np.column_stack([np.ones(len(y)), x[:, :2]])

    def likelihood(noise, between):
        v = noise * np.eye(len(y)) + between * (group[:, None] == group[None, :])
        r = y - design @ fit["beta"]
        return -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))

    best = likelihood(fit["residual_variance"], fit["group_variance"])
    assert math.isclose(best, fit["log_likelihood"], rel_tol=1e-9) and fit["usable"] and fit["groups"] == 15
    for a, b in ((1.05, 1), (0.95, 1), (1, 1.1), (1, 0.9)):
        assert likelihood(fit["residual_variance"] * a, fit["group_variance"] * b) < best
    few = models.random_intercept(df.where("s IN ('g0', 'g1')"), ["x1"], "y", "s")
    assert not few["usable"]


# statistics


def test_location_tests(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(0.4, 1, 80), 1)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    rows = {r["test"]: r for r in stats.location_tests(df, "v")}
    w = v[v != 0]
    order = np.abs(w)
    ranks = np.array([(order < x).sum() + ((order == x).sum() + 1) / 2 for x in order])
    assert rows["signed_rank"]["statistic"] == ranks[w > 0].sum() and 0 < rows["signed_rank"]["p_value"] < 0.05
    n, k = len(w), int((w > 0).sum())
    assert math.isclose(rows["sign"]["p_value"], sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n, rel_tol=1e-9)


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(101)], "k long, v double")
    r = stats.bootstrap_interval(df, "v", "k", 300, 5).first()
    assert 5 <= r.low <= 8 <= r.high <= 11


def test_proportional_sample(spark):
    rows = [(s, i) for s, n in (("a", 700), ("b", 200), (None, 99), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, k long")
    got = {r["s"]: r["count"] for r in qc.proportional_sample(df, "s", "k", 7, 100).groupBy("s").count().collect()}
    assert sum(got.values()) == 100 and got["a"] == 70 and got["b"] == 20
    assert qc.proportional_sample(df, "s", "k", 7, 5000).count() == 1000 and qc.proportional_sample(df.where("false"), "s", "k", 7).count() == 0


def test_running_totals_over_ranges(spark):
    rng = np.random.default_rng(7)
    v = rng.permutation(500)
    df = spark.createDataFrame([(int(x), int(x) % 5, "z") for x in v], "k long, v long, part string").repartition(7)
    out = {r.k: (r.total, r.part) for r in ranks.running(df, ["k"], F.col("v"), "total").collect()}
    assert all(out[k] == (sum(i % 5 for i in range(k + 1)), "z") for k in range(500))
    assert {r.k: r.rank for r in ranks.numbered(df.select("k"), ["k"]).collect()} == {k: k + 1 for k in range(500)}
    assert ranks.numbered(df.where("false"), ["k"]).count() == 0


# text and pairs


def test_registry_keeps_raw_text(spark):
    ko, en = "\ufeff 한글", "  Two  words\u3000"
    sides = [("s", "1", lang, t, "A", "news", "title", "KO_TO_EN", "") for lang, t in (("ko", ko), ("en", en))] + [("s", "2", "ko", "alone", "A", "news", "title", "KO_TO_EN", "")]
    df = spark.createDataFrame(sides, "source_id string, alignment string, language string, text string, source_tier string, domain string, sentence_type string, translation_direction string, source_license_note string")
    rows = pairs.registry(df)
    r = rows.first()
    assert rows.columns == pairs.REGISTRY and rows.count() == 1
    assert (r.ko_text_raw, r.en_text_raw, r.ko_text_analysis, r.en_text_analysis) == (ko, en, "한글", "Two  words") and pairs.taxonomy_violations(rows).count() == 0


@pytest.mark.parametrize("raw", ["two  inner   spaces", "“quoted” – dash…", "MiXed Case", "ｆｕｌｌ　ｗｉｄｔｈ", "ﬁ ² ①", "١٢٣ 123", "smile 😀‍ ok", "학교에서는 먹었습니다"])
def test_analysis_text_normalises_nothing_else(spark, raw):
    """One text for each of the forbidden silent normalisations: all stay as they are."""
    assert len(text.FORBIDDEN) == 8
    df = spark.createDataFrame([(raw,)], "t string").select("t", text.nfc("t").alias("c"))
    r = df.select(text.analysis_text(F.col("c")).alias("a"), *[v.alias(k) for k, v in text.sensitivity_texts(F.col("t"), F.col("c")).items()]).first()
    assert r.a == raw and r.raw == raw and r.whitespace_collapsed == " ".join(raw.split())


def test_exclusion_rules_in_order(spark):
    good = "a plain sentence"
    rows = [
        ("1", "", good, 2), ("2", None, good, 2), ("3", good, good, 2), ("4", good, good, 2), ("5", "한글 문장", good, 2), ("6", "<b><i><u></u></i></b>x", "y", 2),
        ("7", "a\u200b\u200b", "b", 2), ("8", "bad \ufffd", "c", 2), ("9", "d", "e", 0), ("10", "f", "g", None), ("11", "123", "456", 1),
    ]
    df = spark.createDataFrame(rows, "id string, a string, b string, audit int")
    out = {r.id: r.rule for r in qc.exclusion_rule(df, "a", "b", "id", audit=F.col("audit")).collect()}
    want = ["empty", "empty", "accepted", "duplicate", "language", "markup", "hidden", "round_trip", "meaning", "accepted", "accepted"]
    assert [out[r[0]] for r in rows] == want and set(want) == {*qc.RULES, "accepted"}


def test_soft_flags_are_strict(spark):
    rows = ["a" * 8 + "12", "a" * 7 + "123", "abcdefgh..", "abcdefg...", "abc 한글", "Anna Berta went Cologne", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    out = {r.i: r for r in df.select("i", *[v.alias(k) for k, v in qc.soft_flags(F.col("t"), 3, 100).items()]).collect()}
    assert [out[i].high_digit_ratio_flag for i in (0, 1)] == [False, True] and [out[i].high_punctuation_ratio_flag for i in (2, 3)] == [False, True]
    assert out[4].script_mix_flag and not out[0].script_mix_flag and out[5].named_entity_heavy_flag and not out[6].script_mix_flag and len(out[0]) == 9


# splits and clusters


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    docs = {}
    for i in range(60):
        own = list(base) if i % 3 else [f"v{i}_{j}" for j in range(40)]
        for _ in range(int(rng.integers(0, 5))):
            own[int(rng.integers(0, len(own)))] = f"x{rng.random()}"
        docs[i] = " ".join(own)
    docs |= {100: docs[0], 101: "", 102: None, 103: "two words", 104: "Two\twords"}
    sets = {}
    for k, t in docs.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in docs}
    for _ in range(len(docs)):
        for a, b in itertools.combinations(docs, 2):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.cluster for r in clusters.near_duplicate_clusters(df, "doc_id", "text").collect()}
    assert got == root and got[100] == 0 and got[104] == 103
    assert clusters.near_duplicate_clusters(df.where("false"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("few,block", [(32, 512), (2, 7), (0, 64)])
def test_clusters_where_shingles_are_in_very_many_sets(spark, monkeypatch, few, block):
    """Texts over two words: each of 32 shingles is in hundreds of sets, and no group may be taken for a cluster unseen."""
    monkeypatch.setattr(clusters, "FEW", few)
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(6)
    n = 1500 if few == 32 else 300
    texts = [" ".join("xy"[i] for i in rng.integers(0, 2, int(m))) for m in rng.integers(8, 19, n)]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    names = sorted({x for s in sets for x in s})
    table = np.array([[x in s for x in names] for s in sets], float)
    common, size = table @ table.T, table.sum(1)
    root = np.arange(n)
    a, b = np.nonzero(common >= 0.8 * (size[:, None] + size[None] - common) - 1e-9)
    while (root[a] != root[b]).any():
        np.minimum.at(root, a, root[b])
        root = root[root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.cluster for r in clusters.near_duplicate_clusters(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(n)] == root.tolist() and 20 < len(set(root)) < n


def test_folds_keep_groups_of_any_type(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(100)], "g long")
    out = splits.group_folds(df, "g", 3)
    assert out.schema["g"].dataType.simpleString() == "bigint" and out.count() == 7 and {r.fold for r in out.collect()} == {0, 1, 2}
    assert splits.group_folds(df.where("false"), "g", 3).count() == 0
    held = splits.with_group_holdout(df, "g", 3, 0.5)
    assert splits.leakage(held, "g").count() == 0 and splits.leakage(df.withColumn("held_out", F.rand(1) < 0.5), "g").count() == 7


# tokenizer and morphology


def test_round_trip_and_counts(spark):
    path, pattern = catalog._ranks()
    texts = ["한국어 토큰화 재현성 검사", "", None, "a\r\n b <|endoftext|>", "😀‍"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r.i: (r.r.token_count, r.r.ok, r.n, r.s) for r in df.select("i", tokenizer.round_trip(path, pattern)("t").alias("r"), tokenizer.token_count(path, pattern)("t").alias("n"), tokenizer.has_special(F.col("t"), ["<|endoftext|>"]).alias("s")).collect()}
    assert out[1] == (0, False, 0, False) and out[2][1:] == (False, None, False) and out[3][1] and out[3][3] and out[0][0] == out[0][2] > 0 and out[4][1]


def test_own_merges_equal_the_library(spark):
    """Distinct pre-tokens merged once: the same counts as tiktoken's, for long runs of one letter too."""
    path, pattern = catalog._ranks()
    own = tokenizer._encoding(path, pattern)
    texts = ["The cat sat on the mat.", "", None, "x" * 30_000, "ab" * 5000, "  two  spaces\n\n tab\t", "I'M we'll 12345", "한국어 토큰화 😀‍😀", "<|endoftext|>", "é" * 999, "The cat sat on the mat."]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.tokens for r in tokenizer.token_counts(df, "k", "t", path, pattern).collect()}
    assert got == {k: len(own.encode_ordinary(t)) for k, t in enumerate(texts) if t is not None}
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    counts = {r.doc_id: r.tokens for r in tokenizer.token_counts(real, "doc_id", "text", path, pattern).collect()}
    assert counts == {r.doc_id: len(own.encode_ordinary(r.text)) for r in real.collect()}


def test_folds_of_very_many_groups(spark, monkeypatch):
    monkeypatch.setattr(splits, "LARGEST", 3)
    df = spark.createDataFrame([(f"g{i % 400}" if i > 300 else f"big{i % 5}",) for i in range(2000)], "g string")
    out = {r.g: (r.n, r.fold) for r in splits.group_folds(df, "g", 4).collect()}
    assert sum(n for n, _ in out.values()) == 2000 and {f for _, f in out.values()} == {0, 1, 2, 3} and len({out[f"big{i}"][1] for i in range(3)}) >= 2


def test_tokenizer_manifest(spark):
    path, pattern = catalog._ranks()
    found = tokenizer.manifest(spark, path, pattern, "own", {"<|endoftext|>": 199999, "<|endofprompt|>": 200018})
    assert found["special_tokens_hash"].startswith("160541c3") and found["mergeable_ranks_count"] == 50256 and len(found["audit_sample"]) == 5
    import base64
    import hashlib

    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for rank, token in sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)):
            digest.update(rank.to_bytes(8, "big") + len(token).to_bytes(4, "big") + token)
    assert found["mergeable_ranks_hash"] == digest.hexdigest() and found["audit_sample"][0]["token_base64"] == "IQ=="


def test_morphology(spark):
    tags = ["NNP", "NNG", "NNG", "NNG", "XSN", "JKO", "NNG", "XSV", "EF", "SF"]
    df = spark.createDataFrame([("한국어 형태소",), (None,)], "t string")
    rows = morphology.analysed(df, "t", lambda: lambda x: [(x[i % len(x)], t, i, 1) for i, t in enumerate(tags)])
    seq = F.col("morpheme_sequence")
    out = rows.select(*[v.alias(k) for k, v in {**morphology.measures(seq), **morphology.densities(seq, F.col("t"))}.items()]).collect()
    assert (out[0].morpheme_count, out[0].particle_count, out[0].ending_count, out[0].deriv_affix_count) == (10, 1, 1, 2)
    assert math.isclose(out[0].function_morpheme_ratio, 0.2) and math.isclose(out[0].morphemes_per_word, 5.0)


# contracts, documents, surroundings


@pytest.fixture(scope="module")
def sound():
    return {
        "tokenizer": {"track": "A", "tokenizer_id": "o200k_base", "implementation": "tiktoken", "package_version": "0.13.0", "network_fallback_allowed": False},
        "serving": {**catalog._DOCUMENTS["serving"], "execution_permissions": {p.split(".")[1]: False for n, p, _ in contracts.RULES if p.startswith("execution_permissions")}},
        "morphology": catalog._DOCUMENTS["morphology"],
        "research": {"track_b_status": {"status": "DEFERRED_NOT_EXECUTED"}, "seed_policy": dict(contracts.SEEDS)},
    }


def test_contract_mutations(spark, sound):
    contracts.check_documents(spark, sound, seeds=True)
    for name, path, wrong, word in [
        ("serving", "execution_permissions.hosted_api_call_allowed", True, "permission"), ("serving", "enabled_in_phase_0", 0, "different"), ("tokenizer", "network_fallback_allowed", "false", "different"),
        ("research", "seed_policy.split", contracts.SEEDS["bootstrap"], "repeated"), ("research", "seed_policy.serving", -1, "no seed"), ("research", "seed_policy.auxiliary", True, "no seed"), ("morphology", "analyzer", {}, "missing"),
    ]:
        broken = json.loads(json.dumps(sound))
        *above, last = path.split(".")
        here = broken[name]
        for k in above:
            here = here[k]
        here[last] = wrong
        with pytest.raises(contracts.ContractValidationError, match=word):
            contracts.check_documents(spark, broken, seeds=True)


def test_contract_files(spark, sound, tmp_path):
    paths = {k: tmp_path / f"{k}.yaml" for k in sound}
    for k, path in paths.items():
        path.write_text(json.dumps(sound[k]))  # JSON is YAML
    (tmp_path / "project.toml").write_text('[tool.hatch.build.targets.wheel]\npackages = ["src/x"]\n')
    assert contracts.check_files(spark, paths, tmp_path / "project.toml", ["src/x"]) == {k: canonical.sha256_file(p) for k, p in paths.items()}
    with pytest.raises(contracts.ContractValidationError):
        contracts.check_files(spark, paths, tmp_path / "project.toml", ["src/x", "src/y"])
    with pytest.raises(contracts.ContractValidationError):
        contracts.check_namespace({"tool": {}}, ["src/x"])
    with pytest.raises(FileNotFoundError):
        contracts.check_files(spark, {"tokenizer": tmp_path / "none.yaml"}, tmp_path / "project.toml", [])


def test_documents_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("a: {b: [1, null]}\n")
    (tmp_path / "l.yaml").write_text("- 1\n")
    (tmp_path / "a.toml").write_text('[x]\ny = "z"\n')
    assert files.read_yaml(tmp_path / "a.yaml") == {"a": {"b": [1, None]}} and files.read_yaml(tmp_path / "l.yaml", mapping=False) == [1] and files.read_toml(tmp_path / "a.toml") == {"x": {"y": "z"}}
    with pytest.raises(files.ContractValidationError):
        files.read_yaml(tmp_path / "l.yaml")
    df = spark.createDataFrame([("c", 'two\nlines, "quoted"'), ("B", "한글"), ("b", None)], "k string, v string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(str, files.read_csv(spark, str(tmp_path / "csv"), "k string, v string").collect())) == sorted(map(str, df.collect()))
    files.write_lines(df.union(df), "k", str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["B", "b", "c"]
    (tmp_path / "x").mkdir()
    canonical.write_json(tmp_path / "x" / "y.json", {"한": 1e10, "a": [True, None]})
    assert (tmp_path / "x" / "y.json").read_bytes() == '{"a":[true,null],"한":10000000000.0}\n'.encode() and os.listdir(tmp_path / "x") == ["y.json"]
    assert files.checksum_line(tmp_path / "x" / "y.json").endswith("  y.json\n")
    with pytest.raises(files.ContractValidationError):
        files.checked_vocabulary(spark, str(tmp_path / "a.toml"), "0" * 64)
    found = files.digests(spark, str(tmp_path / "x")).collect()
    assert [(r.size_bytes, r.sha256) for r in found] == [((tmp_path / "x" / "y.json").stat().st_size, canonical.sha256_file(tmp_path / "x" / "y.json"))]


def test_surroundings(spark, tmp_path, capsys):
    bad = environment.command_result(["sh", "-c", "echo ' out '; echo err >&2; exit 3"])
    assert (bad["returncode"], bad["stdout"], bad["stderr"]) == (3, "out", "err") and environment.command_result(["no-such-command"])["returncode"] == -1
    host = environment.host_metadata()
    assert isinstance(host["version_info"], list) and host["unicode_database"] and json.loads(json.dumps(host)) == host
    rows = {r.package: (r.version != "", r.status) for r in environment.package_versions(spark, ["pyspark", "no-such-package", "pyspark"]).collect()}
    assert rows == {"pyspark": (True, "INSTALLED"), "no-such-package": (False, "NOT_INSTALLED")} and environment.distributions(spark).count() > 5
    assert environment.version_of("no-such-package", "0.1.0") == "0.1.0" and environment.probe_import("json")["status"] == "PASS" and environment.probe_import("no_such_module")["status"] == "FAIL"
    checks = spark.createDataFrame([("b", "FAIL", "x"), ("a", "PASS", "")], "check_id string, status string, evidence string")
    assert environment.report(checks) == 1 and environment.report(checks.where("status = 'PASS'")) == 0 and json.loads(capsys.readouterr().out.splitlines()[0])["check_id"] == "a"
    environment.ensure_folders(tmp_path / "o" / "p", tmp_path / "o")
    (tmp_path / "f").write_text("")
    with pytest.raises(FileExistsError):
        environment.ensure_folders(tmp_path / "f")
    assert environment.inside(tmp_path / "o" / ".." / "f", tmp_path) and not environment.inside(tmp_path / "..", tmp_path) and environment.utc_now().endswith("+00:00")
    (tmp_path / "o" / "x.json").write_text("{}")
    (tmp_path / "o" / "_y").write_text("1")
    found = environment.artifact_manifest(spark, files.file_list(tmp_path / "o"), tmp_path, environment.utc_now(), {"rows": 1}, {"G": "PASS"})
    assert [a["path"] for a in found["artifacts"]] == ["o/_y", "o/x.json"] and found["artifact_count"] == 2
    with pytest.raises(files.ContractValidationError, match="empty"):
        environment.artifact_manifest(spark, [tmp_path / "f"], tmp_path, "", {}, {})
    model = environment.model_manifest(spark, tmp_path / "o", {"dictionary": None})
    assert model["file_count"] == 2 and model["model_manifest_sha256"] == canonical.document_set_digest(model["artifacts"])
    with pytest.raises(files.ContractValidationError):
        environment.version_control(tmp_path)


def test_digests_do_not_depend_on_row_order(spark):
    rows = [(i, bytes([i, 7])) for i in range(9)]
    a, b = (canonical.ordered_digest(spark.createDataFrame(x, "rank long, token binary"), "rank", "token").first() for x in (rows, rows[::-1]))
    assert a == b and a["n"] == 9
    r = spark.createDataFrame([([b"ab", b"", b"c"],), ([],)], "x array<binary>").select(canonical.joined_bytes(F.col("x")).alias("y")).collect()
    assert [bytes(x.y) for x in r] == [b"abc", b""]


def test_outputs_name_queries():
    assert set(catalog.OUTPUTS.values()) <= set(catalog.QUERIES)
