"""Quality control: hard exclusions, soft flags, audit samples, flow counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenledger.functions.text import CAPITALISED, CONTROL, HAN, HANGUL, LATIN, LETTER, PUNCTUATION, WORDS, ZERO_WIDTH, anomaly_flag, count_of, markup_share, ratio

#: Our defaults where no number is given.
MARKUP_LIMIT, HIDDEN_LIMIT = 0.5, 0.01
#: Fixed value: shares above it are flagged.
DENSE = 0.20


def hidden_share(text: Column) -> Column:
    return ratio(count_of(text, CONTROL) + count_of(text, ZERO_WIDTH), F.char_length(text))


def first_copies(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The row with the smallest key of each group of equal texts; grouped by digest, so hot groups combine early."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.sha2(F.col(c), 256) for c in columns]), 256)
    keep = df.groupBy(digest.alias("d")).agg(F.min(key).alias(key)).drop("d")
    return df.join(keep, key, "left_semi")


def letter_share(text: Column, script: str) -> Column:
    """Share of a script among the letters, null without letters."""
    return ratio(count_of(text, script), count_of(text, LETTER))


#: The hard rules, in the order in which they are tried.
RULES = ["empty", "duplicate", "language", "markup", "hidden", "round_trip", "meaning"]


def exclusion_rule(pairs: DataFrame, a: str, b: str, key: str, scripts: tuple[str, str] = (LATIN, LATIN), least_script: float = 0.5, round_trip: Column | None = None, audit: Column | None = None) -> DataFrame:
    """Adds `rule`: the first of RULES that a pair breaks, or `accepted`.

    Language: letters of the side's script are fewer than `least_script` of its letters. Round trip: the text holds a
    replacement character, or `round_trip` is false. Meaning: the audit's score is 0; a pair without a score passes.
    Keys must be unique.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.sha2(F.col(a), 256), F.sha2(F.col(b), 256)), 256)
    firsts = pairs.groupBy(digest.alias("d")).agg(F.min(key).alias("first_")).select("first_")
    either = lambda f: f(F.col(a)) | f(F.col(b))
    wrong = lambda side, script: F.coalesce(letter_share(F.col(side), script) < least_script, F.lit(False))
    broken = either(lambda t: F.contains(t, F.lit("\ufffd")))
    rule = (
        F.when(either(lambda t: F.coalesce(F.trim(t), F.lit("")) == ""), "empty")
        .when(F.col("first_").isNull(), "duplicate")
        .when(wrong(a, scripts[0]) | wrong(b, scripts[1]), "language")
        .when(either(lambda t: markup_share(t) > MARKUP_LIMIT), "markup")
        .when(either(lambda t: hidden_share(t) > HIDDEN_LIMIT), "hidden")
        .when(broken | ~(round_trip if round_trip is not None else F.lit(True)), "round_trip")
        .when(F.coalesce(audit == 0, F.lit(False)) if audit is not None else F.lit(False), "meaning")
        .otherwise("accepted")
    )
    # a pair finds by its own key whether it is the first of its group, so no group meets in one task
    return pairs.join(firsts, pairs[key] == firsts["first_"], "left").withColumn("rule", rule).drop("first_")


def soft_flags(text: Column, short: int, long: int, mix: float = 0.1, entities: float = 0.3, review: Column | None = None) -> dict[str, Column]:
    """The eight flags; they keep their rows. Shares must be strictly over the limit.

    Script mix: the second most frequent of Latin, Hangul, Han and other letters has more than `mix` of the letters.
    Entities: capitalised words are more than `entities` of all words. `review` marks translations to be looked at.
    """
    n, letters = F.char_length(text), count_of(text, LETTER)
    known = [count_of(text, c) for c in (LATIN, HANGUL, HAN)]
    scripts = F.sort_array(F.array(*known, letters - sum(known[1:], known[0])), asc=False)
    over = lambda part, whole, limit: F.coalesce(ratio(part, whole) > limit, F.lit(False))
    return {
        "short_text_flag": n < short,
        "long_text_flag": n > long,
        "high_digit_ratio_flag": over(count_of(text, "[0-9]"), n, DENSE),
        "high_punctuation_ratio_flag": over(count_of(text, PUNCTUATION), n, DENSE),
        "script_mix_flag": over(F.get(scripts, F.lit(1)), letters, mix),
        "unicode_anomaly_flag": anomaly_flag(text),
        "translation_quality_review_flag": F.coalesce(review, F.lit(False)) if review is not None else F.lit(False),
        "named_entity_heavy_flag": over(count_of(text, CAPITALISED), count_of(text, WORDS), entities),
    }


def audit_sample(df: DataFrame, stratum: str, key: str, seed: int, each: int) -> DataFrame:
    """`each` rows of every stratum by hash order; the same rows in every run."""
    order = W.partitionBy(stratum).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256), key)
    return df.withColumn("audit_rank", F.row_number().over(order).cast("long")).where(F.col("audit_rank") <= each)


def proportional_sample(df: DataFrame, stratum: str, key: str, seed: int, n: int = 500) -> DataFrame:
    """n rows (all, if there are fewer), dealt to strata by their size: whole shares first, what is left by the largest remainders.

    Every task sends at most n rows of a stratum, as none gets more.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    share = F.col("size") * F.lit(min(n, total))
    strata = sizes.withColumn("whole", F.floor(share / max(1, total))).withColumn("left", share - F.col("whole") * total)
    short = min(n, total) - (strata.agg(F.sum("whole")).first()[0] or 0)
    nth = F.row_number().over(W.orderBy(F.desc("left"), stratum))  # one row a stratum
    quota = strata.withColumn("quota", F.col("whole") + (nth <= short).cast("long")).select(stratum, "quota")
    best = audit_sample(df, stratum, key, seed, n)
    return best.join(F.broadcast(quota), best[stratum].eqNullSafe(quota[stratum])).where("audit_rank <= quota").drop(quota[stratum])


def rubric(score: Column) -> Column:
    return F.when(score == 2, "primary").when(score == 1, "partial").when(score == 0, "mismatch")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
