"""Word segmentation learned from the corpus: pieces in a trie, a lattice of them over each word, costs by rounds of counts.

An analyzer's stand-in where none is at hand: pieces have no meanings, only places. Costs are learned from distinct words,
each counted once, so that what recurs in many words (stems and affixes) is cheap, and whole words that are merely
frequent aren't.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.clusters import cut
from tokenledger.operators.joins import dealt_join

# workers get this module's functions with the task, so that they need not have the package
register_pickle_by_value(sys.modules[__name__])

#: Code points of a piece at most, words that it must occur in, pieces of a lexicon at most, and rounds of counts.
LONGEST, LEAST_WORDS, LEXICON, ROUNDS = 12, 4, 30_000, 4
WORD = r"\p{L}+"
#: Places of pieces in a word.
PREFIX, STEM, SUFFIX = "PFX", "STM", "SFX"


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (k, word, n): how often a lower-cased run of letters occurs in a text."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return docs.select(F.col(key).alias("k"), F.explode(words).alias("word")).groupBy("k", "word").agg(F.count("*").alias("n"))


def trie(costs: dict[str, float]) -> dict:
    """Nested mappings by character; a piece's cost stands under the empty string."""
    root: dict = {}
    for piece, cost in costs.items():
        here = root
        for c in piece:
            here = here.setdefault(c, {})
        here[""] = cost
    return root


def best_path(word: str, root: dict, unknown: float) -> list[str]:
    """The cheapest pieces that make up a word, the fewest of equally cheap ones, then the longest last piece.

    A character that is no piece by itself costs `unknown`.
    """
    n = len(word)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(math.inf, 0, 0)] * n
    for i in range(n):
        cost, pieces, _ = best[i]
        here, j = root, i
        single = False
        while j < n and (here := here.get(word[j])) is not None:
            j += 1
            if "" in here:
                single |= j == i + 1
                way = (cost + here[""], pieces + 1, i)
                if way[:2] < best[j][:2]:
                    best[j] = way
        if not single:
            way = (cost + unknown, pieces + 1, i)
            if way[:2] < best[i + 1][:2]:
                best[i + 1] = way
    out, end = [], n
    while end:
        begin = best[end][2]
        out.append(word[begin:end])
        end = begin
    return out[::-1]


def _lexicon(counts: DataFrame, lexicon: int) -> tuple[dict[str, float], float]:
    """(costs of the most used pieces, the cost of a character that isn't among them)."""
    kept = counts.orderBy(F.desc(F.col("n") * F.char_length("piece")), "piece").limit(lexicon).collect()
    total = sum(r["n"] for r in kept)
    return {r["piece"]: -math.log(r["n"] / total) for r in kept}, -math.log(0.5 / max(total, 1))


def learn(words: DataFrame, lexicon: int = LEXICON, rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """(costs, cost of an unknown character) from distinct words (column word). The driver and each worker hold the lexicon, nothing of the corpus.

    Pieces start as all substrings of up to LONGEST code points that LEAST_WORDS words have, the single characters among
    them. A round cuts every word along its cheapest path, counts the pieces, and takes their logarithms for costs.
    """
    words = cut(_spread(words.select("word").distinct()))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.char_length("word") - i + 1)), lambda m: F.substring(F.col("word"), i, m))))
    found = words.select(F.explode(F.array_distinct(spans)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    costs, unknown = _lexicon(found.where((F.col("n") >= LEAST_WORDS) | (F.char_length("piece") == 1)), lexicon)
    for _ in range(rounds):
        counts = words.mapInArrow(_counter(costs, unknown), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        costs, unknown = _lexicon(counts, lexicon)
    return costs, unknown


def _spread(words: DataFrame) -> DataFrame:
    """Words dealt to all cores: cutting takes long for its few bytes, so that partitions sized by bytes would be too few."""
    spark = words.sparkSession
    return words.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")


def _counter(costs: dict[str, float], unknown: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie(costs)
        for batch in batches:
            counts: dict[str, int] = {}
            for word in batch.column("word").to_pylist():
                for piece in best_path(word, root, unknown):
                    counts[piece] = counts.get(piece, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    return run


def segmented(words: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """Rows (word, pieces) for the distinct words of column word."""
    costs, unknown = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = trie(costs)
        for batch in batches:
            names = batch.column("word")
            yield pa.RecordBatch.from_arrays([names, pa.array([best_path(w, root, unknown) for w in names.to_pylist()], pa.list_(pa.string()))], ["word", "pieces"])

    return _spread(words.select("word").distinct()).mapInArrow(run, "word string, pieces array<string>")


def places(pieces: Column) -> Column:
    """PFX, STM or SFX for each piece: the first of the longest is the stem, what precedes and follows it are affixes."""
    longest = F.array_max(F.transform(pieces, F.char_length))
    stem = F.array_position(F.transform(pieces, F.char_length), longest)
    return F.transform(pieces, lambda _, i: F.when(i + 1 < stem, PREFIX).when(i + 1 == stem, STEM).otherwise(SUFFIX))


def measures(docs: DataFrame, key: str, text: str, model: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """Rows (key, words, pieces, prefixes, suffixes), one for each text that has words; the model is learned from these texts if not given.

    Each distinct word is cut once, and its counts meet the texts by a join in which words of many texts are dealt.
    """
    counts = cut(word_counts(docs, key, text))
    sizes = cut(counts.groupBy("word").agg(F.count("*").alias("texts")))
    own = segmented(sizes, model or learn(sizes)).withColumn("at", places(F.col("pieces")))
    count = lambda p: F.size(F.filter("at", lambda x: x == p)).cast("long")
    facts = cut(own.select("word", F.size("pieces").cast("long").alias("pieces"), count(PREFIX).alias("prefixes"), count(SUFFIX).alias("suffixes")).join(sizes, "word"))
    rows = dealt_join(counts, facts, ["word"], "texts", ["k"])
    sums = [F.sum(F.col("n") * F.col(c)).alias(c) for c in ("pieces", "prefixes", "suffixes")]
    return rows.groupBy("k").agg(F.sum("n").alias("words"), *sums).withColumnRenamed("k", key)


def analyzer(model: tuple[dict[str, float], float]) -> Callable[[], Callable[[str], list[tuple[str, str, int, int]]]]:
    """The analyzer that morphology.analysed takes: (form, tag, start, length) of the pieces of a text's words, in code points."""
    costs, unknown = model

    def make() -> Callable[[str], list[tuple[str, str, int, int]]]:
        import regex

        root, find = trie(costs), regex.compile(WORD).finditer

        def run(text: str) -> list[tuple[str, str, int, int]]:
            out = []
            for m in find(text):
                # a character whose lower case has another length would move the places
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in m[0])
                pieces = best_path(low, root, unknown)
                stem, at = max(range(len(pieces)), key=lambda i: (len(pieces[i]), -i)), m.start()
                for i, piece in enumerate(pieces):
                    out.append((piece, PREFIX if i < stem else STEM if i == stem else SUFFIX, at, len(piece)))
                    at += len(piece)
            return out

        return run

    return make
