"""Aligned pairs: registry, strata, taxonomy checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.text import analysis_text, nfc
from tokenledger.operators.quantiles import quantiles
from tokenledger.operators.ranks import numbered

#: The allowed values of the registry's taxonomies, and the source tiers.
TAXONOMY = {
    "domain": ["general", "administration", "legal", "news", "technology", "education", "dialogue", "other"],
    "sentence_type": ["declarative", "interrogative", "imperative", "title", "list_item", "short_phrase", "other"],
    "translation_direction": ["KO_TO_EN", "EN_TO_KO", "HUMAN_PARALLEL_UNKNOWN", "UNKNOWN"],
}
TIERS = ["A", "B", "C"]
CURATED = ["A", "B"]
#: Columns of the registry.
REGISTRY = [
    "pair_id", "source_id", "source_tier", "domain", "sentence_type", "translation_direction",
    "ko_text_raw", "en_text_raw", "ko_text_nfc", "en_text_nfc", "ko_text_analysis", "en_text_analysis",
    "pair_quality_status", "pair_quality_score", "pair_version", "source_license_note",
]


def registry(sides: DataFrame, version: str = "1") -> DataFrame:
    """The pair registry from rows (source_id, alignment, language ko or en, text, source_tier, domain, sentence_type, translation_direction, source_license_note).

    One row for each alignment that has both sides; its id is a digest of source and alignment. Raw texts stay as
    they are; the composed and the analysis text stand beside them. Quality is `review` until it is judged.
    """
    key = ["source_id", "alignment"]
    facts = ["source_tier", "domain", "sentence_type", "translation_direction", "source_license_note"]
    ko = sides.where("language = 'ko'").select(*key, *facts, F.col("text").alias("ko_text_raw"))
    en = sides.where("language = 'en'").select(*key, F.col("text").alias("en_text_raw"))
    out = ko.join(en, key)
    for side in ("ko", "en"):
        composed = nfc(F.col(f"{side}_text_raw"))
        out = out.withColumn(f"{side}_text_nfc", composed).withColumn(f"{side}_text_analysis", analysis_text(F.col(f"{side}_text_nfc")))
    judged = {"pair_quality_status": F.lit("review"), "pair_quality_score": F.lit(None).cast("int"), "pair_version": F.lit(version)}
    return out.withColumns({"pair_id": F.sha2(F.concat_ws(":", *key), 256), **judged}).select(*REGISTRY)


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """Pair registry from dialogues: a user turn and the assistant turn that follows. One row per pair."""
    a = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("turn_a"), F.col("text").alias("a_text"))
    b = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn_a"), F.col("text").alias("b_text"))
    pairs = a.join(b, ["conv_id", "turn_a"])
    return pairs.select(F.sha2(F.concat_ws(":", "conv_id", "turn_a"), 256).alias("pair_id"), "conv_id", "turn_a", "a_text", "b_text")


def quintile_breaks(df: DataFrame, length: Column, parts: int = 5) -> list[float]:
    """Break points of `parts` equal shares, rounded to 6 decimals; none without rows."""
    found = quantiles(df, length, [i / parts for i in range(1, parts)], [])
    return [r[0] for r in found.orderBy("point").select(F.round("quantile", 6)).collect()]


def with_stratum(df: DataFrame, length: Column, parts: int = 5) -> DataFrame:
    """Adds stratum 1..parts by break points: ties stay together. The driver holds the break points."""
    return df.withColumn("stratum", sum((F.when(length > F.lit(float(b)), 1).otherwise(0) for b in quintile_breaks(df, length, parts)), F.lit(1)).cast("long"))


def with_ntile(df: DataFrame, length: Column, key: str, parts: int = 5) -> DataFrame:
    """Adds stratum by rank, which splits ties by key; the first strata have one row more if n is no multiple of parts. Keys must be unique."""
    ranked = numbered(df.select(F.col(key).alias("key_"), length.alias("length_")), ["length_", "key_"], "rank_")
    n = ranked.count()
    small, more = divmod(n, parts)
    place = F.col("rank_") - 1
    stratum = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / max(1, small)))
    return df.join(ranked.select("key_", (stratum + 1).cast("long").alias("stratum")), df[key] == F.col("key_")).drop("key_")


def tier_filter(df: DataFrame, tiers: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows whose source has an allowed tier."""
    return df.join(tiers.where(F.col("tier").isin(allowed)), "source")


def taxonomy_violations(df: DataFrame) -> DataFrame:
    """Rows (pair_id, column, value) of registry values outside their taxonomy, null included."""
    checks = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.coalesce(F.col(c).isin(v), F.lit(False)).alias("ok")) for c, v in {**TAXONOMY, "source_tier": TIERS}.items()])
    return df.select("pair_id", F.explode(checks).alias("x")).where("NOT x.ok").select("pair_id", "x.column", "x.value")


def outside_taxonomy(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value isn't among the allowed ones."""
    return df.join(allowed, df[column] == allowed["value"], "left_anti")
