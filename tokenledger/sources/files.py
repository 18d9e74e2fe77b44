"""Sources and sinks of files: documents, vocabularies, inventories, round trips."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.canonical import sha256_file


class ContractValidationError(ValueError):
    """A document breaks a contract."""


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_toml(path: str | Path) -> dict[str, Any]:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def read_yaml(path: str | Path, mapping: bool = True) -> Any:
    """A YAML document; its root must be a mapping unless mapping is false."""
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if mapping and not isinstance(found, dict):
        raise ContractValidationError(f"{path}: the root is no mapping")
    return found


def variant_rows(spark: SparkSession, documents: dict[str, Any]) -> DataFrame:
    """Rows (name, doc variant) of in-memory documents."""
    rows = [(k, json.dumps(v)) for k, v in documents.items()]
    return spark.createDataFrame(rows, "name string, j string").select("name", F.parse_json("j").alias("doc"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, doc variant) of whole JSON files."""
    found = spark.read.text(path, wholetext=True)
    return found.select(F.input_file_name().alias("path"), F.parse_json("value").alias("doc"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Rows (token binary, rank long) of a rank file."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(F.unbase64(parts[0]).alias("token"), parts[1].cast("long").alias("rank"))


def checked_vocabulary(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The rank file's rows, once its digest is the pinned one; nothing is ever fetched."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if (found := sha256_file(path)) != sha256:
        raise ContractValidationError(f"{path}: digest {found}")
    return vocabulary(spark, path)


def file_list(root: str | Path) -> list[Path]:
    """Files below root, without caches of compiled code; hidden names are kept."""
    return [p for p in Path(root).rglob("*") if p.is_file() and "__pycache__" not in p.parts and p.suffix != ".pyc"]


def file_inventory(spark: SparkSession, paths: list[Path], base: str | Path) -> DataFrame:
    """Rows (path, size_bytes, sha256) below base, ordered by path components; a path outside base is an error."""
    base = Path(base).resolve()
    rows = [(p.resolve().relative_to(base).as_posix(), p.stat().st_size, sha256_file(p)) for p in paths]
    return spark.createDataFrame(rows, "path string, size_bytes long, sha256 string").orderBy(F.split("path", "/"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, size_bytes, sha256) of files below a path that Spark can read, digested on the workers.

    Each file is one cell, so it must be below 2 GiB. Names that begin with `_` or `.` are left out by the reader;
    file_inventory has them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def numbered(spark: SparkSession, samples: list[str]) -> DataFrame:
    """Rows (sample_id, text); ids are places in the list, from 0."""
    return spark.createDataFrame(list(enumerate(samples)), "sample_id long, text string")


def round_trip_equal(df: DataFrame, path: str) -> bool:
    """Write as Parquet, read, and compare schema and rows, duplicates included."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    same = [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in back.schema]
    return same and df.exceptAll(back).isEmpty() and back.exceptAll(df).isEmpty()


def write_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote; quoted values may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct lines of text in one file, in order without case."""
    df.select(column).distinct().orderBy(F.lower(column), column).coalesce(1).write.mode("overwrite").text(path)


def checksum_line(path: str | Path) -> str:
    return f"{sha256_file(path)}  {Path(path).name}\n"
