"""Canonical JSON and digests: equal documents have equal bytes, whatever the order of their keys."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(payload: Any) -> bytes:
    """UTF-8 with sorted keys, no spaces, non-ASCII kept, and one line feed at the end."""
    return (json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as source:
        return hashlib.file_digest(source, "sha256").hexdigest()


def write_json(path: str | Path, payload: Any) -> None:
    """Canonical JSON, complete or not at all, also if several writers meet: each has a file of its own that takes the name once it is on disk."""
    folder, name = os.path.split(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, draft = tempfile.mkstemp(prefix=f".{name}-", dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(canonical_json(payload))
            out.flush()
            os.fsync(out.fileno())
        os.chmod(draft, 0o644)
        os.replace(draft, os.path.join(folder, name))
    except BaseException:
        os.unlink(draft)
        raise


def canonical_struct(**fields: Column) -> Column:
    """Canonical JSON text of string, boolean and integer fields, on the JVM side; nulls are kept."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.to_json(ordered, {"ignoreNullFields": "false"}), F.lit("\n"))


@F.pandas_udf(StringType())
def canonical_text(document: pd.Series) -> pd.Series:
    """Canonical JSON of JSON text that may hold floats, which the JVM prints another way."""
    return document.map(lambda x: None if x is None else canonical_json(json.loads(x)).decode())


def document_set_digest(rows: list[dict[str, Any]]) -> str:
    """SHA-256 of the canonical JSON of rows; their order counts."""
    return sha256_hex(canonical_json(rows))


def joined_bytes(parts: Column) -> Column:
    """An array of binaries, end to end."""
    return F.aggregate(parts, F.lit(b""), lambda out, x: F.concat(out, x))


def big_endian(number: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(number), 2 * width, "0"))


def ordered_digest(table: DataFrame, rank: str, token: str) -> DataFrame:
    """One row: count and SHA-256 over (rank as 8 bytes, length as 4, bytes) in order of (rank, token).

    For tables of vocabulary size: the frames of the whole table meet in one cell.
    """
    frame = F.concat(big_endian(F.col(rank), 8), big_endian(F.octet_length(token), 4), F.col(token))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(token).alias("t"), F.hex(frame).alias("f"))))
    return table.agg(F.count("*").alias("n"), F.sha2(F.unhex(F.array_join(F.transform(rows, lambda x: x["f"]), "")), 256).alias("digest"))
