"""TF-IDF over documents: smoothed inverse document frequencies, rows of unit length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut
from tokenledger.operators.joins import dealt_join

#: Fixed value: runs of two or more word characters.
TERM = r"[\p{L}\p{N}_]{2,}"


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, term, weight): count * (ln((1 + n) / (1 + df)) + 1) of lower-cased terms, each document scaled to length 1.

    A document without terms has no rows. Counts combine before they are shuffled and are written once; a term's document
    frequency comes back by a join in which terms of very many documents are dealt, so no list of a term's documents is built.
    """
    rows = docs.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))).alias("term"))
    counts = cut(rows.groupBy("k", "term").agg(F.count("*").alias("tf")))
    n = docs.count()
    idf = cut(counts.groupBy("term").agg(F.count("*").alias("df"))).withColumn("idf", F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1)
    raw = dealt_join(counts, idf, ["term"], "df", ["k"]).select("k", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "k").select(F.col("k").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))
