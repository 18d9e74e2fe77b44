"""Token outcomes of a pair and their exact decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A tokenizer that both engines of the value check can express: letters, digits by three, other marks.
PLAIN_TOKENS = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
TOLERANCE = 1e-10


def measured(pairs: DataFrame, tokens=lambda t: F.regexp_count(t, F.lit("(?U)" + PLAIN_TOKENS))) -> DataFrame:
    """Adds bytes, code points and tokens of both sides; pairs with a side of no tokens are left out. Without `tokens`, the pairs have their columns."""
    out = pairs
    for side in ("a", "b"):
        text = F.col(f"{side}_text")
        counted = {f"{side}_tokens": tokens(text)} if tokens else {}
        out = out.withColumns({f"{side}_bytes": F.octet_length(text), f"{side}_points": F.char_length(text), **counted})
    return out.where("a_tokens > 0 AND b_tokens > 0")


def outcomes() -> dict[str, Column]:
    """Premium, its logarithm, difference, two of its three factors and what the logarithms of all three leave over.

    The third factor, the compression penalty, is an outcome of its own (penalty_outcomes) and never reported beside
    the premium. The factors are ratios of code points, of bytes per code point and of tokens per byte (inferred reading).
    """
    c = lambda n: F.col(n).cast("double")
    premium = c("a_tokens") / c("b_tokens")
    points = c("a_points") / c("b_points")
    density = (c("a_bytes") / c("a_points")) / (c("b_bytes") / c("b_points"))
    penalty = (c("a_tokens") / c("a_bytes")) / (c("b_tokens") / c("b_bytes"))
    return {
        "token_premium": premium,
        "log_premium": F.ln(premium),
        "token_difference": F.col("a_tokens") - F.col("b_tokens"),
        "point_ratio": points,
        "density_ratio": density,
        "residual": F.ln(premium) - F.ln(points) - F.ln(density) - F.ln(penalty),
    }


def penalty_outcomes() -> dict[str, Column]:
    """The compression penalty (ratio of tokens per byte) and its logarithm."""
    c = lambda n: F.col(n).cast("double")
    penalty = (c("a_tokens") / c("a_bytes")) / (c("b_tokens") / c("b_bytes"))
    return {"compression_penalty": penalty, "log_compression_penalty": F.ln(penalty)}


def densities() -> dict[str, Column]:
    """Tokens per byte and per code point of each side, for description only."""
    c = lambda n: F.col(n).cast("double")
    return {f"{s}_tokens_per_{unit}": c(f"{s}_tokens") / c(f"{s}_{of}") for s in ("a", "b") for unit, of in (("byte", "bytes"), ("codepoint", "points"))}
