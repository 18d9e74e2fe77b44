"""Shared plumbing of the training-data operators: worker imports, scratch tables, batching, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one in OFTEN of all rows goes by broadcast in `spread_join`; so there are fewer than OFTEN of them.
OFTEN = 10_000
#: Parts that `salted_join` deals the rows of such a key to.
SALTS = 64
_SHIPPED: set[str] = set()
BATCH, _LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by the driver's own path in local mode, as an added archive on a cluster.

    Unless the application has its own limit, batches for them hold BATCH bytes from now on, as rows of whole texts
    make the default of 10,000 rows a large one on both sides.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if not context.getConf().contains(_LIMIT):
        spark.conf.set(_LIMIT, str(BATCH))
    context.environment.setdefault("TOKENIZERS_PARALLELISM", "false")
    if context.master.startswith("local"):
        parts = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(root) not in parts:
            context.environment["PYTHONPATH"] = os.pathsep.join([str(root), *parts])
    elif context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        archive = Path(tempfile.mkdtemp(prefix="tokenledger-")) / "tokenledger.zip"  # Spark serves it to the executors
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted((root / "tokenledger").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(archive))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local")
        found = "file://" + tempfile.mkdtemp(prefix="tokenledger-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/tokenledger-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tokenledger-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's written tables; results of operators can't be read after that."""
    jvm, path = spark.sparkContext._jvm, scratch_root(spark)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared scratch folder and read it back: lineage ends in files every executor sees."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """`name`, with underscores added until no column of `taken` has it (whatever the case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def often_keys(sizes: DataFrame, key: str, n: str) -> DataFrame:
    """Keys of `sizes` (distinct keys with their numbers of rows n) that hold more than one in OFTEN of all rows."""
    total = sizes.agg(F.sum(n)).first()[0] or 0
    return sizes.where(F.col(n) * OFTEN > F.lit(total)).select(key)


def spread_join(rows: DataFrame, wanted: DataFrame, often: DataFrame, key: str) -> DataFrame:
    """rows joined with wanted (distinct keys) on key; often holds the keys of very many rows, which go by broadcast.

    Such keys are few at any size of input, as each has at least one of OFTEN rows; the others make no hot key.
    """
    wide = F.broadcast(wanted.join(F.broadcast(often), key, "left_semi"))
    slim = wanted.join(F.broadcast(often), key, "left_anti")
    return rows.join(wide, key).unionByName(rows.join(F.broadcast(often), key, "left_anti").join(slim, key))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, n: str, by: list[str]) -> DataFrame:
    """rows joined with facts (distinct keys with their numbers of rows n) on key, one pass over rows.

    The rows of an often key are dealt by a hash of the columns `by` to SALTS parts, each with its copy of the fact.
    """
    often = F.broadcast(often_keys(facts, key, n).withColumn("often_", F.lit(True)))  # fewer than OFTEN rows
    salt = F.when(F.col("often_"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(often, key, "left").withColumn("salt_", salt).drop("often_")
    right = facts.join(often, key, "left").withColumn("salt_", F.explode(F.when(F.col("often_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("often_")
    return left.join(right, [key, "salt_"]).drop("salt_")


_HELD: dict = {}


def held(make, *args):
    """make(*args), made once per worker and kept until another is asked for: a worker that many operators use holds one."""
    if (make, args) not in _HELD:
        _HELD.clear()
        _HELD[make, args] = make(*args)
    return _HELD[make, args]


def release() -> None:
    """Give free memory back to the system, which idle workers of earlier stages would keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def merged(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold `limit` bytes of `column`."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Re-cut record batches so that each holds at most `limit` bytes of `column`, or one row; free memory is released at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    release()


def texts_of(batch: pa.RecordBatch, column: str = "text", kind: pa.DataType | None = None) -> pa.Array:
    """The column as one large string (or `kind`) array of its own; null is empty.

    The copy matters: ascii_lower returns wrong characters for a slice of large strings.
    """
    kind = kind or pa.large_string()
    empty = pa.array([b""], pa.large_binary()).cast(kind)
    texts = pc.fill_null(batch.column(column).cast(kind), empty[0])
    return pa.concat_arrays([texts, empty]).slice(0, len(texts))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [starts, starts + lengths)."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: (codes, offsets per text, distinct words), A-Z lowered if asked.

    Splitting and dictionary encoding run in Arrow; only distinct words become Python objects.
    """
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = pieces.flatten()
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    names = encoded.dictionary.to_pylist()
    if "" in names:
        keep = codes != names.index("")
        before = offsets_of(keep.astype(np.int64))
        codes, offsets = codes[keep], before[offsets]
    return codes, offsets, names


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (vertex, smallest vertex of its tree) of the graph with edges a-b."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(names))
    while True:
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        if not (open_ := low != high).any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    child = parent != np.arange(len(names))
    return names[child], names[parent[child]]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        held.append((a, b))
        rows += len(a)
        if rows > 1 << 20:
            held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if (rows := len(held[0][0])) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                held, rows = [], 0
    if held:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: Edges that one task can join up (4 MB).
LITTLE = 1 << 18


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b")) for batch in batches]
    if held:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["v", "root"])


def components(edges: DataFrame, little: int = LITTLE) -> DataFrame:
    """Connected components of edges (a long, b long): rows (v, root) for every vertex that isn't its own root.

    Local spanning forests shrink the edges, then large-star and small-star rounds run as joins until
    nothing changes, or until at most `little` edges are left, which one task joins up. Each round is cut off by a
    written table; no vertex set reaches the driver.
    """
    ship(edges.sparkSession)
    edges = edges.where("a <> b").mapInArrow(_local_forest, "a long, b long")
    now = stored(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum("b")).first()
        if tuple(seen) == mark or not seen[0]:
            return now.selectExpr("a AS v", "b AS root")
        if seen[0] <= little:
            return now.coalesce(1).mapInArrow(_whole_forest, "v long, root long")
        mark = tuple(seen)
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.selectExpr("b AS a", "m AS b").unionByName(low.selectExpr("a", "m AS b"))
        now = stored(small.where("a <> b").distinct(), "edges")
