"""A training corpus from raw documents: language ID, exact and near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage's result is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm import crf_langid, exact_dedup, hilbert_pack, pii_disclosure, superminhash
from tokenledger.llm.common import stored

#: A document stays if its words lean to one language: mean posterior of the label.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too), and those in which no language stands out, if any language was learned.

    Repeated rows stay or go together; an empty table stays empty; other columns are kept, whatever their names.
    """
    return crf_langid.drop_unclear(docs, crf_langid.learn(docs), LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays, the longest; null and empty texts are equal to each other.

    Rows that repeat a kept key stay; an empty table stays empty; other columns are kept, whatever their names.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 or more stays.

    Texts without words are like none and stay, as do rows without a key; rows that repeat a kept key stay; an empty
    table stays empty; other columns are kept, whatever their names.
    """
    return superminhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised; n_chars follows the text. Null and empty texts stay as they are, and so do all other columns; no row is dropped."""
    clean = pii_disclosure.sanitised(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text has the end id only, a long one many pieces, and repeated rows stay apart. No rows from an empty table."""
    from public_tokenizers import path

    out = hilbert_pack.pack(docs, path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("minhash_near_dedup", near), ("pii", personal_data), ("packing", packing)]

#: SQL can't express the stages; the test holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
