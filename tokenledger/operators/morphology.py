"""Aggregates of morpheme sequences; the analyzer itself is a worker function that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.text import WORDS

SEQUENCE = "array<struct<form:string,tag:string,start:int,length:int>>"
#: Tags of derivational affixes.
AFFIXES = ["XSN", "XSV", "XSA"]


def measures(sequence: Column) -> dict[str, Column]:
    """Counts, and their shares of all morphemes (null for an empty sequence)."""
    total = F.size(sequence).cast("long")
    count = lambda test: F.size(F.filter(sequence, test)).cast("long")
    counts = {
        "particle_count": count(lambda x: x["tag"].startswith("J")),
        "ending_count": count(lambda x: x["tag"].startswith("E")),
        "deriv_affix_count": count(lambda x: x["tag"].isin(AFFIXES)),
    }
    shares = {k.replace("_count", "_ratio"): F.when(total > 0, v.cast("double") / total) for k, v in counts.items()}
    return {"morpheme_count": total, **counts, **shares, "function_morpheme_ratio": shares["particle_ratio"] + shares["ending_ratio"]}


def densities(sequence: Column, text: Column) -> dict[str, Column]:
    """Morphemes per code point and per word of the text; which one is meant is not fixed, so each has its own name."""
    total, words = F.size(sequence).cast("double"), F.regexp_count(text, F.lit(WORDS))
    return {"morphemes_per_codepoint": F.when(F.char_length(text) > 0, total / F.char_length(text)), "morphemes_per_word": F.when(words > 0, total / words)}


def analysed(df: DataFrame, text: str, analyzer: Callable[[], Callable[[str], list[tuple[str, str, int, int]]]], column: str = "morpheme_sequence") -> DataFrame:
    """Adds the morphemes (form, tag, start, length) of a text, by an analyzer that `analyzer()` makes once per batch of rows.

    Spans may overlap and forms may be no part of the text, so they are kept as they are and never joined again. A
    null text has no sequence.
    """

    @F.pandas_udf(SEQUENCE)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = analyzer()
        for part in parts:
            yield part.map(lambda x: None if x is None else [{"form": f, "tag": t, "start": s, "length": n} for f, t, s, n in own(x)])

    return df.withColumn(column, run(F.col(text)))


#: Feature blocks that describe the same thing; a model may have one of them.
BLOCKS = {"composite": {"function_morpheme_ratio"}, "components": {"particle_ratio", "ending_ratio"}}
#: The two blocks as models take them.
PRIMARY = ["morpheme_density", "particle_ratio", "ending_ratio", "deriv_affix_ratio"]
ALTERNATIVE = ["morpheme_density", "function_morpheme_ratio", "deriv_affix_ratio"]


def feature_block(names: set[str]) -> str:
    """The block that a model's features belong to; features of both, or of none, are an error."""
    hit = [b for b, own in BLOCKS.items() if names & own]
    if len(hit) != 1:
        raise ValueError(f"features of {len(hit)} blocks: {sorted(names)}")
    return hit[0]
