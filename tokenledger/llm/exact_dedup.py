"""Exact dedup: group by a 128-bit content hash, split groups by their bytes, keep one stable id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES


def normalised(text: Column) -> Column:
    """The text without space and U+0009 to U+000D; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    return F.translate(out, SPACES, "")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256), one for each row of docs.

    Of rows whose normalised texts are identical the one with the most code points in the original text
    stays, then the smallest key; a null key sorts last. Null text counts as empty, and empty texts are one
    group. Rows that repeat a key within a group are one document and are kept or dropped together. Very long
    texts are compared whole; an empty table gives no rows. Other columns are ignored, whatever their names.

    The grouping key is (MD5, bytes): rows meet by hash and are told apart by their bytes, so a collision
    makes two groups. Copies are combined before the shuffle, so a text that fills a third of the table
    sends one row per task. Rows find their group again by (MD5, SHA-256) of the same bytes, without text.
    """
    base = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    base = base.select("k", F.coalesce(F.char_length("t"), F.lit(0)).alias("n"), normalised(F.col("t")).alias("norm"))
    order = F.struct((-F.col("n")).alias("n"), F.col("k").isNull().alias("z"), F.col("k").alias("k"))
    groups = (
        base.groupBy(F.md5("norm").alias("h"), "norm")
        .agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("s"), F.col("best.k").alias("keep_id"), "group_size")
    )
    rows = base.select("k", F.md5("norm").alias("h"), F.sha2("norm", 256).alias("s"))
    return rows.join(groups, ["h", "s"]).select(
        F.col("k").alias(key), "keep_id", "group_size", F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("s").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key exact_groups keeps. Columns are unchanged, whatever their names.

    A key that repeats with other texts stays whole if any of its texts is one that stays.
    """
    keep = exact_groups(docs, text, key).where("kept").select(F.col(key).alias("k")).distinct()
    rows = docs.select(docs[key].alias("k"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.alias("r").join(keep.alias("s"), F.col("r.k").eqNullSafe(F.col("s.k")), "left_semi")
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
