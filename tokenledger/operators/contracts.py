"""Contracts as rows: rules over documents in, violations out."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.canonical import sha256_file
from tokenledger.sources.files import ContractValidationError, read_toml, read_yaml

#: Fixed values: (document, path, expected). Types must agree: 0 is not false.
RULES: list[tuple[str, str, Any]] = [
    ("tokenizer", "track", "A"),
    ("tokenizer", "tokenizer_id", "o200k_base"),
    ("tokenizer", "implementation", "tiktoken"),
    ("tokenizer", "package_version", "0.13.0"),
    ("serving", "track", "B"),
    ("serving", "execution_status", "deferred"),
    ("serving", "enabled_in_phase_0", False),
    ("serving", "deployment.baseline_if_reactivated", "hugging_face_hosted_api"),
    ("serving", "research_contract.serving_seed_path", "seed_policy.serving"),
    ("serving", "execution_permissions.model_download_allowed", False),
    ("serving", "execution_permissions.local_inference_allowed", False),
    ("serving", "execution_permissions.hosted_api_call_allowed", False),
    ("serving", "execution_permissions.serving_benchmark_allowed", False),
    ("serving", "execution_permissions.gpu_serving_setup_allowed", False),
    ("tokenizer", "network_fallback_allowed", False),
    ("morphology", "analyzer.primary_name", "Kiwi"),
    ("morphology", "analyzer.primary_package", "kiwipiepy"),
    ("morphology", "analyzer.design_freeze_version", "0.23.2"),
    ("research", "track_b_status.status", "DEFERRED_NOT_EXECUTED"),
    ("serving", "research_contract.track_b_status_path", "track_b_status.status"),
]
#: The six streams of random numbers.
SEEDS = {
    "master_seed": 20260816,
    "split": 1456095166,
    "bootstrap": 4263151703,
    "model_tuning": 3618347261,
    "serving": 2218276919,
    "auxiliary": 2995913794,
}


def required(document: dict[str, Any], path: str) -> Any:
    """The value at a dotted path; a missing level is an error, a null value is not."""
    here: Any = document
    for name in path.split("."):
        if not isinstance(here, dict) or name not in here:
            raise ContractValidationError(f"missing: {path}")
        here = here[name]
    return here


def leaves(documents: dict[str, Any]) -> list[tuple[str, str, str]]:
    """(document, dotted path, value as JSON) of all values that are no mappings, and of empty mappings."""
    out: list[tuple[str, str, str]] = []

    def walk(name: str, path: list[str], value: Any) -> None:
        if isinstance(value, dict) and value:
            for k, v in value.items():
                walk(name, [*path, str(k)], v)
        else:
            out.append((name, ".".join(path), json.dumps(value, ensure_ascii=False)))

    for name, document in documents.items():
        walk(name, [], document)
    return out


def value_rows(spark: SparkSession, documents: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame(leaves(documents), "name string, path string, value string")


def rule_rows(spark: SparkSession, rules: list[tuple[str, str, Any]]) -> DataFrame:
    return spark.createDataFrame([(n, p, json.dumps(v)) for n, p, v in rules], "name string, path string, expected string")


def violations(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (name, path, reason): a rule's value is missing, or different in type or value (their JSON differs)."""
    both = F.broadcast(rules).join(values, ["name", "path"], "left")
    reason = F.when(F.col("value").isNull(), "missing").when(F.col("value") != F.col("expected"), "different")
    return both.select("name", "path", reason.alias("reason")).where("reason IS NOT NULL")


def seed_violations(values: DataFrame, name: str = "research", path: str = "seed_policy", seeds: list[str] | None = None) -> DataFrame:
    """Rows (seed, reason): a seed is missing, no whole number from 0 to 2**32 - 1, or the same as another's."""
    wanted = values.sparkSession.createDataFrame([(s, f"{path}.{s}") for s in seeds or SEEDS], "seed string, path string")
    own = F.broadcast(wanted).join(values.where(F.col("name") == name).select("path", "value"), "path", "left")
    number = F.when(F.col("value").rlike("^-?[0-9]+$"), F.col("value").try_cast("long"))
    own = own.select("seed", "value", number.between(0, (1 << 32) - 1).alias("fits"))
    times = own.groupBy(F.col("value").alias("same")).agg(F.count("*").alias("times"))
    both = own.join(times, own["value"] == times["same"], "left")
    reason = F.when(F.col("value").isNull(), "missing").when(~F.coalesce("fits", F.lit(False)), "no seed").when(F.col("times") > 1, "repeated")
    return both.select("seed", reason.alias("reason")).where("reason IS NOT NULL")


def same_facts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (key columns, left, right) of facts that two documents state differently, or that one lacks; facts are (keys..., value)."""
    both = a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), keys, "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def check_documents(spark: SparkSession, documents: dict[str, Any], rules: list[tuple[str, str, Any]] | None = None, seeds: bool = False) -> None:
    """Raises ContractValidationError with all violations, if there are any."""
    values = value_rows(spark, documents)
    bad = [f"{r.name}.{r.path}: {r.reason}" for r in violations(values, rule_rows(spark, rules or RULES)).collect()]
    if seeds:
        bad += [f"seed {r.seed}: {r.reason}" for r in seed_violations(values).collect()]
    if bad:
        raise ContractValidationError("; ".join(sorted(bad)))


def check_namespace(document: dict[str, Any], packages: list[str], path: str = "tool.hatch.build.targets.wheel.packages") -> None:
    """The build must deliver exactly these packages."""
    if (found := required(document, path)) != packages:
        raise ContractValidationError(f"{path}: {found!r}")


def check_files(spark: SparkSession, paths: dict[str, str | Path], project: str | Path, packages: list[str]) -> dict[str, str]:
    """All contracts of YAML files by document name, and the namespace in a project's TOML file; digests of the contract files if everything holds."""
    check_documents(spark, {name: read_yaml(path) for name, path in paths.items()}, seeds=True)
    check_namespace(read_toml(project), packages)
    return {name: sha256_file(path) for name, path in paths.items()}


def gate(checks: DataFrame) -> DataFrame:
    """One row (passed): no check failed; true if there is none."""
    return checks.agg(F.coalesce(F.every(F.col("status") != "FAIL"), F.lit(True)).alias("passed"))
