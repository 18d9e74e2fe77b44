"""Golden values and negative cases of functions, sources and contracts."""

import pytest
from pyspark.sql import functions as F

from tokenledger.functions import canonical, text
from tokenledger.operators import contracts, models, morphology, splits, stats
from tokenledger.sources import files


def test_canonical_json():
    assert canonical.canonical_json({"한글": 1, "english": 2}) == canonical.canonical_json({"english": 2, "한글": 1}) == '{"english":2,"한글":1}\n'.encode()
    assert canonical.sha256_hex("한글\n".encode()) == "712f4b5a23ccde2c6cacfa46258849855f00be71873bb8e377132b8436030684"


def test_json_file(tmp_path):
    payload = {"언어": "한국어", "검증": True, "행수": 2}
    canonical.write_json(tmp_path / "a" / "x.json", payload)
    assert files.read_json(tmp_path / "a" / "x.json") == payload and "\\u" not in (tmp_path / "a" / "x.json").read_text()
    (tmp_path / "list.yaml").write_text("- 1\n")
    with pytest.raises(files.ContractValidationError):
        files.read_yaml(tmp_path / "list.yaml")


def test_round_trip_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([(1, "한국어", True), (2, "English", False)], "sample_id long, text string, valid boolean")
    assert files.round_trip_equal(df, str(tmp_path / "t"))
    for name in ("a-b", "a/b", "_x"):
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
    (tmp_path / "d" / "a").mkdir(exist_ok=True)
    for name in ("a-b", "a/b", "_x"):
        (tmp_path / "d" / name).write_text(name)
    rows = files.file_inventory(spark, files.file_list(tmp_path / "d"), tmp_path / "d").collect()
    assert [r.path for r in rows] == ["_x", "a/b", "a-b"]


def test_graphemes_and_analysis_text(spark):
    df = spark.createDataFrame([("가각A😀",), ("﻿  x  y　",)], "t string")
    out = df.select(text.graphemes(F.col("t")).alias("g"), text.analysis_text(text.nfc("t")).alias("x")).collect()
    assert out[0].g == 4 and out[1].x == "x  y"


def test_rules_are_typed(spark):
    rules = [("tokenizer", "network_fallback_allowed", False), ("serving", "enabled_in_phase_0", False), ("serving", "execution_permissions.hosted_api_call_allowed", False)]
    good = {"tokenizer": {"network_fallback_allowed": False}, "serving": {"enabled_in_phase_0": False, "execution_permissions": {"hosted_api_call_allowed": False}}}
    contracts.check_documents(spark, good, rules)
    for value in (True, 0, None, "false"):
        bad = {**good, "serving": {**good["serving"], "execution_permissions": {"hosted_api_call_allowed": value}}}
        with pytest.raises(files.ContractValidationError, match="permission"):
            contracts.check_documents(spark, bad, rules)
    seeds = contracts.value_rows(spark, {"r": {"s": {"a": 1, "b": 1, "c": 4294967295, "d": -1, "e": True}}})
    assert {r.seed for r in contracts.seed_violations(seeds, "r", "s", list("abcde")).collect()} == {"a", "b", "d", "e"}


def test_false_discovery_and_tails(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", 0.6)], "k string, p double")
    q = {r.k: round(r.q, 9) for r in stats.benjamini_hochberg(df, "p", "k").collect()}
    assert q == {"a": 0.025, "b": 0.05, "c": 0.05, "d": 0.025, "e": 0.6}
    assert abs(stats.sign_tail(5, 5) - 0.623046875) < 1e-12


def test_regression(spark):
    df = spark.range(200).selectExpr("id * 1.0D AS x", "(id % 7) * 1.0D AS z", "3 + 2.0D * id - (id % 7) + (id % 2) * 0.1D AS y", "id")
    fit = models.least_squares(df, ["x", "z"], "y")
    assert abs(fit["beta"][1] - 2) < 1e-2 and fit["r2"] > 0.999
    assert models.block_increment(df, ["x"], ["x", "z"], "y")["f"] > 100 and models.inflation(df, ["x", "z"])[0]["vif"] < 1.1
    assert abs(models.huber(df, ["x", "z"], "y")["beta"][1] - 2) < 1e-2


def test_splits_and_morphology(spark):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    held = splits.with_holdout(docs, "doc_id", 3)
    assert 0.1 < held.where("held_out").count() / 500 < 0.3
    assert splits.leaked(held.where("NOT held_out"), held.where("held_out"), "doc_id").count() == 0
    with pytest.raises(ValueError):
        morphology.feature_block({"function_morpheme_ratio", "particle_ratio"})
