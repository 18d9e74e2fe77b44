"""What a run records of its surroundings: packages, host, version control, commands. Driver only."""

from __future__ import annotations

import json
import os
import platform
import subprocess
import sys
import unicodedata
from collections.abc import Iterable
from datetime import UTC, datetime
from importlib import metadata
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.canonical import canonical_json, sha256_file
from tokenledger.sources.files import ContractValidationError, file_inventory, file_list


def utc_now() -> str:
    """ISO-8601 with offset, taken once per run and passed on as text."""
    return datetime.now(UTC).isoformat()


def command_result(arguments: list[str], folder: str | Path | None = None, seconds: float = 180) -> dict[str, Any]:
    """command, returncode, stdout and stderr (outer white space off) of a child process without a shell; a failed command is a result, not an error."""
    try:
        done = subprocess.run(arguments, cwd=folder, capture_output=True, text=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired) as problem:
        return {"command": list(arguments), "returncode": -1, "stdout": "", "stderr": str(problem)}
    return {"command": list(arguments), "returncode": done.returncode, "stdout": done.stdout.strip(), "stderr": done.stderr.strip()}


def host_metadata() -> dict[str, Any]:
    """JSON-stable facts (lists, no tuples) of machine, interpreter and Unicode tables."""
    facts = {
        "system": platform.system(), "release": platform.release(), "machine": platform.machine(), "logical_cpus": os.cpu_count(),
        "memory_bytes": os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"), "python": platform.python_version(),
        "implementation": platform.python_implementation(), "executable": sys.executable, "byte_order": sys.byteorder,
        "filesystem_encoding": sys.getfilesystemencoding(), "unicode_database": unicodedata.unidata_version, "version_info": list(sys.version_info[:3]),
    }
    return json.loads(canonical_json(facts))


def version_control(folder: str | Path) -> dict[str, Any]:
    """commit (40 hexadecimal digits), branch and whether the tree is clean, of a Git work tree."""
    ask = lambda *a: command_result(["git", *a], folder)
    commit = ask("rev-parse", "HEAD")["stdout"]
    if len(commit) != 40 or set(commit) - set("0123456789abcdef"):
        raise ContractValidationError(f"{folder}: no commit")
    return {"commit": commit, "branch": ask("rev-parse", "--abbrev-ref", "HEAD")["stdout"], "clean": not ask("status", "--porcelain")["stdout"]}


def distributions(spark: SparkSession) -> DataFrame:
    """Rows (package, version) of all installed distributions, distinct, in order of names without case."""
    rows = [(d.metadata["Name"], d.version) for d in metadata.distributions() if d.metadata["Name"]]
    return spark.createDataFrame(rows, "package string, version string").distinct().orderBy(F.lower("package"), "package", "version")


def package_versions(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """Rows (package, version, status) of the wanted names, distinct, in order without case; what is missing has an empty version and NOT_INSTALLED."""
    wanted = spark.createDataFrame([(n,) for n in names], "package string").distinct()
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_.]+", "-")
    found = distributions(spark).groupBy(plain(F.col("package")).alias("key")).agg(F.first("version").alias("version"))
    out = wanted.withColumn("key", plain(F.col("package"))).join(F.broadcast(found), "key", "left")  # as many rows as packages
    status = F.when(F.col("version").isNull(), "NOT_INSTALLED").otherwise("INSTALLED")
    return out.select("package", F.coalesce("version", F.lit("")).alias("version"), status.alias("status")).orderBy(F.lower("package"), "package")


def version_of(name: str, fallback: str) -> str:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return fallback


def probe_import(name: str, seconds: float = 180) -> dict[str, Any]:
    """Whether a module can be imported, found out in a child process: status, version, and the last three lines of its complaint."""
    code = "import importlib, json, sys; m = importlib.import_module(sys.argv[1]); print(json.dumps(str(getattr(m, '__version__', ''))))"
    result = command_result([sys.executable, "-c", code, name], seconds=seconds)
    if result["returncode"]:
        return {"package": name, "status": "FAIL", "version": "", "evidence": "\n".join(result["stderr"].splitlines()[-3:])}
    return {"package": name, "status": "PASS", "version": json.loads(result["stdout"].splitlines()[-1]), "evidence": ""}


def report(checks: DataFrame) -> int:
    """Prints one line of JSON for each check (check_id, status, evidence); the exit code is 1 if any failed."""
    rows = checks.select("check_id", "status", "evidence").orderBy("check_id").collect()
    for row in rows:
        print(json.dumps(row.asDict(), ensure_ascii=False))
    return int(any(row["status"] == "FAIL" for row in rows))


def ensure_folders(*paths: str | Path) -> None:
    """Make folders; an existing one is fine, a file in its place is an error."""
    for path in paths:
        Path(path).mkdir(parents=True, exist_ok=True)


def inside(path: str | Path, root: str | Path) -> bool:
    """Whether a path, links resolved, is root or below it."""
    return Path(path).resolve().is_relative_to(Path(root).resolve())


def artifact_problems(inventory: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows (path, reason): a wanted file is missing, empty, or has no digest of 64 digits."""
    paths = inventory.sparkSession.createDataFrame([(p,) for p in wanted], "path string")
    both = paths.join(inventory, "path", "left")
    reason = F.when(F.col("size_bytes").isNull(), "missing").when(F.col("size_bytes") <= 0, "empty").when(F.length("sha256") != 64, "no digest")
    return both.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def artifact_manifest(spark: SparkSession, paths: list[Path], base: str | Path, when: str, row_counts: dict[str, int], gates: dict[str, str], folder: str | Path | None = None) -> dict[str, Any]:
    """The run's artifacts with sizes and digests, row counts and gate results; an empty or missing artifact is an error."""
    files = file_inventory(spark, paths, base)
    names = [p.resolve().relative_to(Path(base).resolve()).as_posix() for p in paths]
    if problems := artifact_problems(files, names).collect():
        raise ContractValidationError("; ".join(f"{r.path}: {r.reason}" for r in problems))
    rows = [r.asDict() for r in files.collect()]
    code = version_control(folder) if folder else {"commit": "", "branch": ""}
    return {
        "schema_version": "artifacts-v1", "generated_at_utc": when, "code_commit": code["commit"], "code_branch": code["branch"],
        "artifact_count": len(rows), "artifacts": rows, "row_counts": row_counts, "gate_status": gates,
    }


def model_manifest(spark: SparkSession, folder: str | Path, config: dict[str, Any]) -> dict[str, Any]:
    """Provenance of a model folder (such as a morphological analyzer's): digests of its files' inventory and of its configuration."""
    import hashlib

    rows = [r.asDict() for r in file_inventory(spark, file_list(folder), folder).collect()]
    digest = lambda x: hashlib.sha256(canonical_json(x)).hexdigest()
    return {"file_count": len(rows), "artifacts": rows, "model_manifest_sha256": digest(rows), "analyzer_config_hash": digest(config)}


def checked_file(path: str | Path, sha256: str) -> Path:
    """The path, once its digest is the pinned one."""
    if (found := sha256_file(path)) != sha256:
        raise ContractValidationError(f"{path}: digest {found}")
    return Path(path)
