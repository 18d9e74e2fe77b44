"""Unicode-safe text columns: normalised forms, anomalies, surface measures. Raw text is never replaced."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Classes of the text rules.
ZERO_WIDTH = "[\\u200B-\\u200D\\uFEFF]"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"
STACKED_MARKS = "\\p{M}{3,}"
HANGUL = "[\\uAC00-\\uD7A3]"
LATIN, HAN, LETTER = "[\\p{IsLatin}]", "[\\p{IsHan}]", "\\p{L}"
PUNCTUATION, SYMBOL = "[!-/:-@\\[-`{-~]", "[\\p{S}]"
CAPITALISED, WORDS = "\\p{Lu}\\p{Ll}+", "[^\\x20\\x09-\\x0D]+"
#: What the analysis text never undergoes silently.
FORBIDDEN = [
    "internal_whitespace_collapse", "punctuation_ascii_substitution", "lowercasing", "fullwidth_halfwidth_unification",
    "nfkc_normalization", "digit_substitution", "emoji_removal", "particle_ending_segmentation",
]
MARKUP = r"<[^<>]*>|https?://[^\s<>\"]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; no built-in has it."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def analysis_text(composed: Column) -> Column:
    """NFC text without a byte-order mark and outer white space; inner white space stays."""
    return F.regexp_replace(F.regexp_replace(composed, "^\\uFEFF", ""), r"(?U)^\s+|\s+\z", "")


def applied_operations(raw: Column, composed: Column, analysed: Column) -> Column:
    """Names of the steps that changed something, in order."""
    steps = F.array(
        F.when(raw != composed, F.lit("nfc")),
        F.when(composed.startswith("﻿"), F.lit("strip_bom")),
        F.when(F.regexp_replace(composed, "^\\uFEFF", "") != analysed, F.lit("trim_outer")),
    )
    return F.filter(steps, lambda x: x.isNotNull())


def sensitivity_texts(raw: Column, composed: Column) -> dict[str, Column]:
    """Variants for the separate sensitivity track: raw, composed only, white space collapsed. The analysis text is none of them."""
    return {"raw": raw, "nfc_only": composed, "whitespace_collapsed": F.regexp_replace(analysis_text(composed), r"(?U)\s+", " ")}


def graphemes(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\X"))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole)


def anomaly_flag(text: Column) -> Column:
    """Control characters, zero-width characters or stacked combining marks."""
    return (count_of(text, CONTROL) > 0) | (count_of(text, ZERO_WIDTH) > 0) | (count_of(text, STACKED_MARKS) > 0)


def markup_share(text: Column) -> Column:
    """Share of the text that tags and links take."""
    return ratio(F.char_length(text) - F.char_length(F.regexp_replace(text, MARKUP, "")), F.char_length(text))
