"""Rank-file BPE on workers: counts, round trips, pre-token chunks."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.functions.canonical import canonical_json, ordered_digest, sha256_file, sha256_hex
from tokenledger.operators.clusters import cut
from tokenledger.operators.joins import dealt_join
from tokenledger.sources.files import vocabulary


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    """One encoding per worker and file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(path: str, pattern: str):
    """Tokens of a text; a null text has none. Strings of special tokens are ordinary text (has_special finds them)."""

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        own = _encoding(path, pattern)
        found = text[text.notna()]
        counts = pd.Series([len(x) for x in own.encode_ordinary_batch(found.tolist(), num_threads=1)], index=found.index)
        return counts.reindex(text.index).astype("Int64")

    return count


def merged_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one pre-token: the neighbours of lowest rank become one, the leftmost of equals first, until no two make a token.

    A heap of pairs over linked places: n log n steps, however long the piece is.
    """
    n = len(piece)
    if n < 2 or piece in ranks:
        return min(n, 1)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part begins at its place; end is 0 once it is gone
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        # a pair is stale if either side has changed since
        if not middle or middle == n or end[middle] != stop:
            continue
        end[i], end[middle], left = stop, 0, left - 1
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (p := before[i]) >= 0 and (rank := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (rank, p, stop))
    return left


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_counts(docs: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Rows (key, tokens), one for each row with a text (keys must be unique): 0 for an empty one.

    The JVM finds the pre-tokens (a look-ahead and Unicode classes are no difficulty there), each distinct one is merged
    once, and the counts meet the texts by a join in which pre-tokens of many texts are dealt.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    pieces = F.regexp_extract_all("t", F.lit("(?U)" + pattern), F.lit(0))
    counts = cut(rows.select("k", F.explode(pieces).alias("piece")).groupBy("k", "piece").agg(F.count("*").alias("n")))
    sizes = cut(counts.groupBy("piece").agg(F.count("*").alias("texts")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ranks(path)
        for batch in batches:
            found = [merged_count(x.encode(), own) for x in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["piece", "texts", "tokens"])

    every = dealt_join(counts, cut(sizes.mapInArrow(merge, "piece string, texts long, tokens long")), ["piece"], "texts", ["k"])
    sums = every.groupBy("k").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"))
    return rows.select("k").join(sums, "k", "left").select(F.col("k").alias(key), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def has_special(text: Column, literals: list[str]) -> Column:
    """Whether a text holds the literal of a special token; such a text is rejected as input, row by row."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals], F.lit(False)), F.lit(False))


def round_trip(path: str, pattern: str):
    """struct(token_count, ok): tokens' bytes join to the text's UTF-8, the decoded text is the text, and there is a token."""

    @F.pandas_udf("token_count long, ok boolean")
    def check(text: pd.Series) -> pd.DataFrame:
        own = _encoding(path, pattern)
        texts = ["" if x is None else x for x in text]
        ids = own.encode_ordinary_batch(texts, num_threads=1)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        data, sizes, starts = _table(path)
        lengths = sizes[flat]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        joined = data[np.repeat(starts[flat] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum([len(x) for x in ids])])].tolist()
        parts = [joined[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ok = [bool(i) and p == t.encode() and p.decode(errors="replace") == t for i, p, t in zip(ids, parts, texts, strict=True)]
        return pd.DataFrame({"token_count": [len(x) for x in ids], "ok": ok})

    return check


@lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens' bytes end to end, their sizes, where each begins) by rank."""
    with open(path, "rb") as f:
        tokens = [t for _, t in sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))]
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), sizes, np.cumsum(sizes) - sizes


def mechanism(text: Column, pattern: str, tokens: Column) -> dict[str, Column]:
    """Pre-token chunks, their mean length in code points, tokens per chunk and per byte; null where there is nothing to divide by."""
    chunks = chunk_count(text, pattern).cast("long")
    share = lambda a, b: F.when(b > 0, a.cast("double") / b)
    return {
        "n_chunks": chunks,
        "chunk_length": share(F.char_length(text), chunks),
        "tokens_per_chunk": share(tokens, chunks),
        "tokens_per_byte": share(tokens, F.octet_length(text)),
    }


def manifest(spark: SparkSession, path: str, pattern: str, name: str, special: dict[str, int]) -> dict:
    """Provenance of a vocabulary: sizes and digests of file, ranks, pattern and special tokens, and the five lowest ranks."""
    ranks = vocabulary(spark, path)
    digest = ordered_digest(ranks, "rank", "token").first()
    lowest = ranks.orderBy("rank").limit(5).select("rank", F.base64("token").alias("token_base64")).collect()
    return {
        "schema_version": "tokenizer-artifact-v1", "tokenizer_id": name, "encoding_file_size_bytes": os.path.getsize(path),
        "encoding_file_sha256": sha256_file(path), "mergeable_ranks_count": digest["n"], "mergeable_ranks_hash": digest["digest"],
        "pat_str_sha256": sha256_hex(pattern.encode()), "special_tokens_count": len(special), "special_tokens_hash": sha256_hex(canonical_json(special)),
        "audit_sample": [r.asDict() for r in lowest], "network_fallback_allowed": False,
    }


def chunk_count(text: Column, pattern: str) -> Column:
    """Pre-token chunks on the JVM side; (?U) makes its classes Unicode ones, as in the tokenizer."""
    return F.regexp_count(text, F.lit("(?U)" + pattern))
