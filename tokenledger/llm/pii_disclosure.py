"""Personal data by patterns, and terms that give it away by information content. DataFrame functions only.

Base spans are matches of fixed patterns. The corpus then tells which terms reveal a protected entity (the
text of a base span): over the documents that mention it, a term's pointwise mutual information with the
entity is the information the term gives about it, and at `threshold` times the entity's own information
content the term discloses it. Such terms are marked wherever they stand as whole words, in any document of the
corpus, and are removed when a text is sanitised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, often_keys, spread_join, stored

#: The base kinds, in the order that breaks ties. The patterns match what the plain forms
#: match, but start a run of their first class at its front only (or where the last match ended) and never
#: give back what later parts can't use, so that time stays in proportion to the text. A card's pattern asks
#: for the 12 digits that it needs anyway.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: Terms: documents of different text that must agree, share of the entity's information.
SUPPORT, THRESHOLD = 2, 0.9
#: Items that a scan appends one by one before it hands them on, and code points of a text's blocks.
CHUNK, PART = 256, 4096
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def scan(n: Column, step, kind: str) -> Column:
    """Items that step(at, i) = struct(at bigint, out array of `kind` items) gives for i from 0 to n - 1, where at begins at 0.

    Items are gathered CHUNK at a time and the chunks after that, so that appending costs no square of n.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, i: Column) -> Column:
        return F.get(F.transform(F.array(step(acc["at"], i)), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out"))), F.lit(0))

    def outer(acc: Column, chunk: Column) -> Column:
        some = F.sequence(chunk * CHUNK, F.least(chunk * CHUNK + (CHUNK - 1), n - 1))
        part = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), inner)
        return F.get(F.transform(F.array(part), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), F.lit(0))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    return F.when(n > 0, F.aggregate(chunks, start, outer, lambda acc: F.flatten(acc["out"]))).otherwise(empty)


def matches(text: Column, pattern: str, kind: int, fits) -> Column:
    """Leftmost non-overlapping matches with their places in code points; those that don't fit are left out."""
    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def walk(bound: Column) -> Column:
        pieces, found = bound["pieces"], bound["found"]

        def step(at: Column, i: Column) -> Column:
            start = (at + F.char_length(F.get(pieces, i))).cast("bigint")
            end = (start + F.char_length(F.get(found, i))).cast("bigint")
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(found, i).alias("value"))
            return F.struct(end.alias("at"), F.array(span).cast(SPAN).alias("out"))

        return F.filter(scan(F.size(found), step, SPAN[6:-1]), lambda x: fits(x["value"]))

    # a one-element array binds the parts, so that they are computed once and not for each match
    return F.get(F.transform(F.array(parts), walk), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.char_length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.least(n, F.lit(19))),
        F.lit(0),
        lambda acc, i: acc
        + F.when(F.pmod(n - i, F.lit(2)) == 1, F.lit(1)).otherwise(F.lit(0)) * F.when(d.substr(i, F.lit(1)).cast("int") > 4, d.substr(i, F.lit(1)).cast("int") * 2 - 9).otherwise(d.substr(i, F.lit(1)).cast("int") * 2)
        + F.when(F.pmod(n - i, F.lit(2)) == 0, d.substr(i, F.lit(1)).cast("int")).otherwise(F.lit(0)),
    )
    return n.between(12, 19) & (F.pmod(total, F.lit(10)) == 0)


def _octets(value: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(value, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind; a kind's pattern runs only on texts that hold its necessary character."""
    digits = text.rlike("[0-9]")
    none = F.array().cast(SPAN)
    every = F.concat(
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, 0, lambda v: F.lit(True))).otherwise(none),
        F.when(digits & F.contains(text, F.lit(".")), matches(text, IP, 1, _octets)).otherwise(none),
        F.when(digits, matches(text, CARD, 2, _luhn)).otherwise(none),
        F.when(digits & F.contains(text, F.lit("+")), matches(text, PHONE, 3, lambda v: F.char_length(_digits(v)).between(9, 15))).otherwise(none),
    )
    return F.array_sort(every)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _term(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}]+|[^\p{L}]+$", "")


def _places(texts: DataFrame) -> DataFrame:
    """Rows (row, start, end, word, terms) of all words of texts (row, t, terms); places by a running sum, in time linear in the text."""
    pieces, gaps = F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), F.split("t", WORD, -1)
    words = texts.select("row", "terms", F.posexplode(F.arrays_zip(pieces.alias("p"), F.slice(gaps, F.lit(1), F.size(pieces)).alias("g"))).alias("at", "w"))
    size = F.char_length("w.p").cast("long")
    ends = F.sum(F.char_length("w.g") + size).over(Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return words.select("row", "terms", F.col("w.p").alias("word"), (ends - size).alias("start"), ends.alias("end"))


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id", support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (row, key, base, spans), one for each row of docs; span kinds 0 to 3 are base ones, 4 is a term.

    A null or empty text has no spans; an empty table gives no rows. Keys may be null or repeat: rows stay apart by
    their own numbers, and equal rows have equal spans. Patterns and places take time in proportion to a text, however
    long. Other columns are ignored, whatever their names. docs must give the same rows in the same order each time
    that it is read, as a table does. Exact copies of a text count once as evidence. An entity meets only
    those terms of its documents that are rare enough to tell it: n_both is at most n_entity, so a term in more
    than n_entity * (n / n_entity) ** (1 - threshold) texts never reaches the threshold. A text with many rare
    entities and many rare terms still compares each with each.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    firsts = base.groupBy(F.xxhash64("t").alias("same")).agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    terms = F.filter(F.array_distinct(F.transform(F.split(F.col("t"), r"[\x20\x09-\x0D]+"), _term)), lambda x: x != "")
    seen = stored(base.join(firsts, "row", "left").select("row", "k", F.coalesce("first", F.lit(False)).alias("first"), base_spans(F.col("t")).alias("base"), terms.alias("terms")), "mentions")
    once = seen.where("first")
    n_docs = F.lit(once.count()).cast("long")
    # texts and rows that hold each term; a row's number also names its text, if it is the first
    words = seen.select("row", "first", F.explode("terms").alias("term"))
    totals = stored(words.groupBy("term").agg(F.count_if("first").alias("n_term"), F.count("*").alias("n_rows")), "totals")
    often = often_keys(totals, "term", "n_rows")
    holds = once.where(F.size("base") > 0)
    entities = holds.select("row", F.explode(F.array_distinct(F.transform("base", lambda x: x["value"]))).alias("entity"))
    mentions = stored(entities.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support), "entities")
    known = often_keys(mentions, "entity", "n_entity")
    content = F.log2(n_docs / F.col("n_entity"))
    held = spread_join(entities, mentions, known, "entity").where(content > 0)
    beside = spread_join(holds.select("row", F.explode("terms").alias("term")), totals.where(F.col("n_term") >= support).select("term", "n_term"), often, "term")
    rare = F.log2("n_term") <= F.log2("n_entity") + (1 - threshold) * content + 1e-9
    both = beside.join(held, "row").where(rare).groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
    pmi = F.log2(F.col("n_both") * n_docs / (F.col("n_term") * F.col("n_entity")))
    telling = stored(both.where((F.col("n_both") >= support) & (pmi >= threshold * content)).select("term").distinct(), "telling")
    # telling terms at all their places, in every row of the corpus
    marked = spread_join(words.select("row", "term"), telling, often, "term").groupBy("row").agg(F.collect_set("term").alias("terms"))
    found = _places(base.select("row", "t").join(marked, "row")).withColumn("term", _term(F.col("word"))).where(F.array_contains("terms", F.col("term")))
    extra = found.select("row", F.struct("start", F.lit(4).alias("kind"), "end", F.col("term").alias("value")).alias("x"))
    extra = extra.groupBy("row").agg(F.collect_list("x").alias("extra"))
    # a word that touches a base span is no term of its own
    out = seen.select("row", "k", "base").join(extra, "row", "left")
    apart = F.filter(F.coalesce("extra", F.array().cast(SPAN)), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.select("row", F.col("k").alias(key), "base", F.array_sort(F.concat("base", apart.cast(SPAN))).alias("spans"))


def sanitised(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with every base span generalised to its kind in brackets and every telling term removed to `[term]`.

    Columns and rows are unchanged but for the text, whatever the other columns are called; a null text stays null,
    an empty one empty. docs must give the same rows in the same order each time that it is read, as a table does.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    marks = spans(docs, text, key, **options).where(F.size("spans") > 0).select("row", "spans")
    names = F.array(*[F.lit(f"[{k}]") for k in (*KINDS, "term")])
    source = F.col("doc")[text].cast("string")
    gap = "struct<a:bigint,b:bigint,kind:int>"

    def cut(bound: Column) -> Column:
        """The text before each span with the span's kind, then the rest; blocks keep every cut short."""
        blocks, found = bound["blocks"], bound["spans"]

        def part(a: Column, b: Column) -> Column:
            first = F.floor(a / PART).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, F.floor(b / PART).cast("int") - first + 1), "")
            return some.substr((a % PART + 1).cast("int"), (b - a).cast("int"))

        def step(at: Column, i: Column) -> Column:
            x = F.get(found, i)
            own = F.struct(at.alias("a"), x["start"].alias("b"), x["kind"].alias("kind"))
            return F.struct(F.greatest(at, x["end"]).cast("bigint").alias("at"), F.when(x["start"] >= at, F.array(own)).otherwise(F.array()).cast(f"array<{gap}>").alias("out"))

        pieces = F.transform(scan(F.size(found), step, gap), lambda x: F.concat(part(x["a"], x["b"]), F.get(names, x["kind"])))
        return F.concat(F.array_join(pieces, ""), part(F.array_max(F.transform(found, lambda x: x["end"])), bound["n"]))

    both = numbered.join(marks, "row", "left")
    bound = F.struct(F.regexp_extract_all(source, F.lit("(?s).{1,%d}" % PART), F.lit(0)).alias("blocks"), F.col("spans"), F.char_length(source).cast("bigint").alias("n"))
    clean = F.when(F.col("spans").isNull(), source).otherwise(F.get(F.transform(F.array(bound), cut), F.lit(0)))
    return both.select(*[clean.alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
