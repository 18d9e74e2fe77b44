"""Named queries over the tables, and the same results in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenledger.functions import canonical, text
from tokenledger.operators import clusters, contracts, effects, factors, models, morphology, outcomes, pairs, qc, resampling, segments, splits, stats, terms, tokenizer, tuning
from tokenledger.operators import quantiles as quantile
from tokenledger.sources import environment, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED, AUDIT_SEED = contracts.SEEDS["bootstrap"], contracts.SEEDS["auxiliary"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PAIRS = """
WITH p AS (
  SELECT a.conv_id, a.turn AS turn_a, a.text AS a_text, b.text AS b_text, sha256(concat(a.conv_id, ':', a.turn)) AS pair_id
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')
"""
_TOKENS = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
_MEASURED = _PAIRS + f""", m AS (
  SELECT *, octet_length(encode(a_text))::DOUBLE AS ab, octet_length(encode(b_text))::DOUBLE AS bb, length(a_text)::DOUBLE AS ac, length(b_text)::DOUBLE AS bc,
    len(regexp_extract_all(a_text, '{_TOKENS}'))::DOUBLE AS ta, len(regexp_extract_all(b_text, '{_TOKENS}'))::DOUBLE AS tb FROM p),
o AS (SELECT *, ta / tb AS tp, ln(ta / tb) AS lp FROM m WHERE ta > 0 AND tb > 0)
"""


@query(_PAIRS + "SELECT pair_id, conv_id, turn_a, length(a_text) AS a_points, length(b_text) AS b_points FROM p")
def pair_registry(spark, d):
    out = pairs.conversation_pairs(table(spark, d, "conversations"))
    return out.select("pair_id", "conv_id", "turn_a", F.char_length("a_text").cast("long").alias("a_points"), F.char_length("b_text").cast("long").alias("b_points"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(text) AS n_points, length_grapheme(text) AS n_graphemes FROM documents")
def text_lengths(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.char_length(t).cast("long").alias("n_points"), text.graphemes(t).cast("long").alias("n_graphemes"))


@query(r"""
WITH t AS (SELECT doc_id, text, nfc_normalize(text) AS c FROM documents),
a AS (SELECT *, regexp_replace(regexp_replace(c, '^\x{FEFF}', ''), '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+\z', '', 'g') AS x FROM t)
SELECT doc_id, sha256(c) AS nfc_sha256, sha256(x) AS analysis_sha256,
  concat_ws(',', CASE WHEN text <> c THEN 'nfc' END, CASE WHEN starts_with(c, chr(65279)) THEN 'strip_bom' END, CASE WHEN regexp_replace(c, '^\x{FEFF}', '') <> x THEN 'trim_outer' END) AS operations
FROM a""")
def nfc_analysis_text(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", text.nfc("text").alias("c")).withColumn("x", text.analysis_text(F.col("c")))
    ops = F.array_join(text.applied_operations(F.col("text"), F.col("c"), F.col("x")), ",")
    return df.select("doc_id", F.sha2("c", 256).alias("nfc_sha256"), F.sha2("x", 256).alias("analysis_sha256"), ops.alias("operations"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')) AS n_control, len(regexp_extract_all(text, '[\x{200B}-\x{200D}\x{FEFF}]')) AS n_zero_width,
  len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')) > 0 OR len(regexp_extract_all(text, '[\x{200B}-\x{200D}\x{FEFF}]')) > 0 OR len(regexp_extract_all(text, '\p{M}{3,}')) > 0 AS anomaly
FROM documents""")
def unicode_anomaly(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.count_of(t, text.CONTROL).cast("long").alias("n_control"), text.count_of(t, text.ZERO_WIDTH).cast("long").alias("n_zero_width"), text.anomaly_flag(t).alias("anomaly"))


_SURFACE = {
    "space_density": (r"\s", r"\s"), "digit_ratio": ("[0-9]", "[0-9]"), "punctuation_ratio": (text.PUNCTUATION, r"[!-/:-@\[-`{-~]"), "symbol_ratio": (text.SYMBOL, r"\p{S}"),
    "latin_ratio": (text.LATIN, r"\p{Latin}"), "hangul_ratio": (text.HANGUL, r"[\x{AC00}-\x{D7A3}]"), "han_ratio": (text.HAN, r"\p{Han}"),
}


@query("SELECT doc_id, length(text) AS n_points, octet_length(encode(text)) AS n_bytes, length_grapheme(text) AS n_graphemes, "
       + ", ".join(f"round(len(regexp_extract_all(text, '{p}')) / length(text), 9) AS {k}" for k, (_, p) in _SURFACE.items()) + " FROM documents WHERE length(text) > 0")
def surface_features(spark, d):
    t, n = F.col("text"), F.char_length("text")
    shares = [F.round(text.ratio(text.count_of(t, p), n), 9).alias(k) for k, (p, _) in _SURFACE.items()]
    sizes = [n.cast("long").alias("n_points"), F.octet_length(t).cast("long").alias("n_bytes"), text.graphemes(t).cast("long").alias("n_graphemes")]
    return table(spark, d, "documents").where(n > 0).select("doc_id", *sizes, *shares)


@query(r"""
WITH c AS (SELECT doc_id, text, length(text)::DOUBLE AS n, len(regexp_extract_all(text, '\p{L}'))::DOUBLE AS letters, len(regexp_extract_all(text, '\p{Latin}')) AS latin,
  len(regexp_extract_all(text, '[\x{AC00}-\x{D7A3}]')) AS hangul, len(regexp_extract_all(text, '\p{Han}')) AS han FROM documents)
SELECT c.doc_id, n < 200 AS short_text_flag, n > 5000 AS long_text_flag, coalesce(len(regexp_extract_all(text, '[0-9]')) / nullif(n, 0) > 0.2, false) AS high_digit_ratio_flag,
  coalesce(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) / nullif(n, 0) > 0.2, false) AS high_punctuation_ratio_flag,
  coalesce(list_sort([latin, hangul, han, letters - latin - hangul - han], 'DESC')[2] / nullif(letters, 0) > 0.1, false) AS script_mix_flag,
  regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]|[\x{200B}-\x{200D}\x{FEFF}]|\p{M}{3,}') AS unicode_anomaly_flag, coalesce(quality + toxic = 1, false) AS translation_quality_review_flag,
  coalesce(len(regexp_extract_all(text, '\p{Lu}\p{Ll}+')) / nullif(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::DOUBLE > 0.3, false) AS named_entity_heavy_flag
FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id""")
def soft_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id", "left")
    flags = qc.soft_flags(F.col("text"), 200, 5000, review=F.col("quality") + F.col("toxic") == 1)
    return docs.select("doc_id", *[v.alias(k) for k, v in flags.items()])


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def duplicate_removal(spark, d):
    return qc.first_copies(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id")


@query(r"""SELECT page_id, round((length(html) - length(regexp_replace(html, '<[^<>]*>|https?://[^\s<>"]+', '', 'g')))::DOUBLE / length(html), 9) AS markup_share,
  (length(html) - length(regexp_replace(html, '<[^<>]*>|https?://[^\s<>"]+', '', 'g')))::DOUBLE / length(html) > 0.5 AS dominated FROM pages WHERE length(html) > 0""")
def markup_dominance(spark, d):
    share = text.markup_share(F.col("html"))
    return table(spark, d, "pages").where(F.char_length("html") > 0).select("page_id", F.round(share, 9).alias("markup_share"), (share > qc.MARKUP_LIMIT).alias("dominated"))


_RULE = r"""CASE WHEN coalesce(trim(a_text), '') = '' OR coalesce(trim(b_text), '') = '' THEN 'empty' WHEN pair_id <> min(pair_id) OVER (PARTITION BY a_text, b_text) THEN 'duplicate'
  WHEN {l} THEN 'language' WHEN {m} THEN 'markup' WHEN {h} THEN 'hidden' WHEN contains(a_text, chr(65533)) OR contains(b_text, chr(65533)) THEN 'round_trip' WHEN quality + toxic = 0 THEN 'meaning' ELSE 'accepted' END"""
_SCRIPT = r"coalesce(len(regexp_extract_all({t}, '\p{{Latin}}'))::DOUBLE / nullif(len(regexp_extract_all({t}, '\p{{L}}')), 0) < 0.5, false)"
_SHARE = r"(length({t}) - length(regexp_replace({t}, '<[^<>]*>|https?://[^\s<>\"]+', '', 'g')))::DOUBLE / nullif(length({t}), 0) > 0.5"
_HIDDEN = r"(len(regexp_extract_all({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]')) + len(regexp_extract_all({t}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]')))::DOUBLE / nullif(length({t}), 0) > 0.01"
_BROKEN = {k: " OR ".join(p.format(t=t) for t in ("a_text", "b_text")) for k, p in (("l", _SCRIPT), ("m", _SHARE), ("h", _HIDDEN))}
_FLOW = _PAIRS + ", r AS (SELECT p.*, " + _RULE.format(**_BROKEN) + " AS rule FROM p LEFT JOIN labels l ON l.doc_id = p.conv_id)"


def _judged(spark, d):
    """Pairs with their rule; labels of a conversation's number stand in for audit scores."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), (F.col("quality") + F.col("toxic")).alias("audit"))
    rows = pairs.conversation_pairs(table(spark, d, "conversations")).join(labels, "conv_id", "left")
    return qc.exclusion_rule(rows, "a_text", "b_text", "pair_id", audit=F.col("audit"))


@query(_FLOW + " SELECT rule, count(*) AS n FROM r GROUP BY rule")
def hard_exclusion_flow(spark, d):
    return _judged(spark, d).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"SELECT lang, doc_id, audit_rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('{AUDIT_SEED}', ':', doc_id)), doc_id) AS audit_rank FROM documents) WHERE audit_rank <= 25")
def audit_sample(spark, d):
    return qc.audit_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", AUDIT_SEED, 25).select("lang", "doc_id", "audit_rank")


@query(f"""WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), t AS (SELECT sum(size)::BIGINT AS total, least(500, sum(size))::BIGINT AS n FROM s),
q AS (SELECT lang, size * n // total AS whole, (size * n) % total AS left_over, n FROM s, t),
o AS (SELECT lang, whole + CASE WHEN row_number() OVER (ORDER BY left_over DESC, lang) <= n - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('{AUDIT_SEED}', ':', doc_id)), doc_id) AS audit_rank FROM documents)
SELECT lang, doc_id, audit_rank FROM r JOIN o USING (lang) WHERE audit_rank <= quota""")
def audit_sample_500(spark, d):
    return qc.proportional_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", AUDIT_SEED).select("lang", "doc_id", "audit_rank")


@query("SELECT CASE quality + toxic WHEN 2 THEN 'primary' WHEN 1 THEN 'partial' ELSE 'mismatch' END AS cohort, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def audit_rubric(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy(qc.rubric(F.col("quality") + F.col("toxic")).alias("cohort")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT list_transform(quantile_cont(length(text)::DOUBLE, [0.2, 0.4, 0.6, 0.8]), lambda x: round(x, 6)) AS q FROM documents)
SELECT doc_id, 1 + (SELECT count(*) FROM unnest(q) AS u(v) WHERE v < length(text)) AS stratum FROM documents, b""")
def length_stratum_breaks(spark, d):
    return pairs.with_stratum(table(spark, d, "documents"), F.char_length("text")).select("doc_id", "stratum")


@query("SELECT doc_id, ntile(5) OVER (ORDER BY length(text), doc_id) AS stratum FROM documents")
def length_stratum_ntile(spark, d):
    return pairs.with_ntile(table(spark, d, "documents"), F.char_length("text"), "doc_id").select("doc_id", "stratum")


_TIERS = [(f"src{i}", "ABC"[i % 3]) for i in range(20)]
_TIER_SQL = ", ".join(f"('{s}', '{t}')" for s, t in _TIERS)


@query(f"SELECT doc_id, tier FROM documents JOIN (VALUES {_TIER_SQL}) AS t(source, tier) USING (source) WHERE tier IN ('A', 'B')")
def tier_filter(spark, d):
    return pairs.tier_filter(table(spark, d, "documents"), spark.createDataFrame(_TIERS, "source string, tier string"), ["A", "B"]).select("doc_id", "tier")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')")
def taxonomy_check(spark, d):
    return pairs.outside_taxonomy(table(spark, d, "documents"), "lang", spark.createDataFrame([("en",), ("de",)], "value string")).select("doc_id", "lang")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def semantic_similarity(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(qc.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT count(*) = count(DISTINCT doc_id) AS is_unique FROM documents")
def uniqueness_gate(spark, d):
    return table(spark, d, "documents").agg((F.count("*") == F.countDistinct("doc_id")).alias("is_unique"))


@query("SELECT coalesce(bool_and(quality IN (0, 1)), true) AS all_valid, coalesce(bool_or(toxic = 1), false) AS any_toxic, avg(quality::DOUBLE) AS pass_rate FROM labels")
def all_any_pass_rate(spark, d):
    q = F.coalesce(F.every(F.col("quality").isin(0, 1)), F.lit(True))
    return table(spark, d, "labels").agg(q.alias("all_valid"), F.coalesce(F.some(F.col("toxic") == 1), F.lit(False)).alias("any_toxic"), F.avg(F.col("quality").cast("double")).alias("pass_rate"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 5")
def top_k_rank(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(5)


@query("SELECT source, first(doc_id ORDER BY n_chars, doc_id) AS doc_id FROM documents GROUP BY source")
def first_match(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query("SELECT conv_id, array_to_string(list(turn ORDER BY turn)[greatest(1, count(*) - 2):], ',') AS last_turns FROM conversations GROUP BY conv_id")
def last_k(spark, d):
    """A window keeps three turns of each conversation before anything is gathered."""
    rows = table(spark, d, "conversations").select("conv_id", "turn").withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 3")
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("turn")), ",").alias("last_turns"))


@query("SELECT doc_id, coalesce(quality, -1)::INTEGER AS quality, CASE WHEN quality IS NULL THEN 'NOT_LABELLED' ELSE 'LABELLED' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def left_lookup_status(spark, d):
    out = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.col("quality"), F.lit(-1)).cast("int").alias("quality"), F.when(F.col("quality").isNull(), "NOT_LABELLED").otherwise("LABELLED").alias("status"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT doc_id, sha256(concat('{"chars":', n_chars, ',"id":', doc_id, ',"lang":"', lang, '"}', chr(10))) AS digest FROM documents""")
def canonical_json_digest(spark, d):
    body = canonical.canonical_struct(id=F.col("doc_id"), lang=F.col("lang"), chars=F.col("n_chars"))
    return table(spark, d, "documents").select("doc_id", F.sha2(body, 256).alias("digest"))


def _measured(spark, d):
    return outcomes.measured(pairs.conversation_pairs(table(spark, d, "conversations")))


@query(_MEASURED + """SELECT pair_id, round(tp, 9) AS token_premium, round(lp, 9) AS log_premium, (ta - tb)::BIGINT AS token_difference, round(ac / bc, 9) AS point_ratio,
  round((ab / ac) / (bb / bc), 9) AS density_ratio FROM o""")
def regex_token_premium(spark, d):
    cols = outcomes.outcomes()
    rounded = [F.round(v, 9).alias(k) if k != "token_difference" else v.cast("long").alias(k) for k, v in cols.items() if k != "residual"]
    return _measured(spark, d).select("pair_id", *rounded)


@query(_MEASURED + "SELECT pair_id, round((ta / ab) / (tb / bb), 9) AS compression_penalty, round(ln((ta / ab) / (tb / bb)), 9) AS log_compression_penalty FROM o")
def log_compression_penalty(spark, d):
    return _measured(spark, d).select("pair_id", *[F.round(v, 9).alias(k) for k, v in outcomes.penalty_outcomes().items()])


@query(_MEASURED + "SELECT pair_id, round(ta / ab, 9) AS a_tokens_per_byte, round(ta / ac, 9) AS a_tokens_per_codepoint, round(tb / bb, 9) AS b_tokens_per_byte, round(tb / bc, 9) AS b_tokens_per_codepoint FROM o")
def token_density_by_side(spark, d):
    return _measured(spark, d).select("pair_id", *[F.round(v, 9).alias(k) for k, v in outcomes.densities().items()])


@query(_MEASURED + "SELECT count(*) AS n, max(abs(lp - ln(ac / bc) - ln((ab / ac) / (bb / bc)) - ln((ta / ab) / (tb / bb)))) <= 1e-10 AS passed FROM o")
def identity_gate(spark, d):
    return _measured(spark, d).select(outcomes.outcomes()["residual"].alias("r")).agg(F.count("*").alias("n"), (F.max(F.abs("r")) <= outcomes.TOLERANCE).alias("passed"))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def strata_grouping_sets(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query(_MEASURED + """, k AS (SELECT lp, rank() OVER (ORDER BY abs(lp)) + (count(*) OVER (PARTITION BY abs(lp)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY abs(lp)) AS t FROM o WHERE lp <> 0),
w AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN lp > 0 THEN r::DOUBLE ELSE 0 END)::DOUBLE AS w, sum(t::DOUBLE * t - 1)::DOUBLE AS ties FROM k)
SELECT n::BIGINT AS n, w AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 9) AS z FROM w""")
def signed_rank(spark, d):
    return stats.signed_rank(_log_premium(spark, d), "v").select("n", "w_plus", F.round("z", 9).alias("z"))


def _log_premium(spark, d):
    return _measured(spark, d).select("pair_id", outcomes.outcomes()["log_premium"].alias("v"))


@query()
def rq1_tests(spark, d):
    return spark.createDataFrame(stats.location_tests(_log_premium(spark, d), "v"), "test string, n long, statistic double, p_value double")


@query(_MEASURED + "SELECT count(*) FILTER (lp > 0) AS n_plus, count(*) FILTER (lp < 0) AS n_minus, count(*) FILTER (lp = 0) AS n_zero FROM o")
def sign_test(spark, d):
    return stats.sign_counts(_measured(spark, d).select(outcomes.outcomes()["log_premium"].alias("v")), "v")


@query(_MEASURED + f""", q AS (SELECT row_number() OVER (ORDER BY pair_id) - 1 AS i, lp FROM o), n AS (SELECT count(*) AS n FROM q), k AS (SELECT n, unnest(range(n)) AS k FROM n), t AS (SELECT unnest(range(5000)) AS b),
x AS (SELECT b, ('0x' || substr(md5(concat('{SEED}', ':', b, ':', k)), 1, 8))::BIGINT % n AS i FROM k, t), med AS (SELECT b, median(lp) AS v FROM x JOIN q USING (i) GROUP BY b)
SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM med""")
def bootstrap_median_ci(spark, d):
    found = stats.bootstrap_interval(_log_premium(spark, d), "v", "pair_id", 5000, SEED)
    return found.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def _fifth_sql(x: str) -> str:
    p = resampling.PRIME
    square = f"({x}) * ({x}) % {p}"
    return f"(({square}) * ({square}) % {p}) * ({x}) % {p}"


@query(_MEASURED + f""", q AS (SELECT lp, ('0x' || substr(md5(pair_id), 1, 8))::BIGINT % {resampling.PRIME} AS k FROM o), t AS (SELECT unnest(range(5000)) AS b),
h AS (SELECT b, lp, k, (k + b * {resampling.MIX[0]} + {SEED % resampling.PRIME}) % {resampling.PRIME} AS x FROM q, t), h2 AS (SELECT b, lp, k, {_fifth_sql('x')} AS x FROM h),
h3 AS (SELECT b, lp, (x + k * {resampling.MIX[1]} + b * {resampling.MIX[2]}) % {resampling.PRIME} AS x FROM h2), h4 AS (SELECT b, lp, {_fifth_sql('x')} AS x FROM h3),
w AS (SELECT b, lp, unnest(range(len(list_filter({resampling.STEPS}, lambda s: s <= x)))) FROM h4), med AS (SELECT b, median(lp) AS v FROM w GROUP BY b)
SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM med""")
def poisson_median_ci(spark, d):
    """The interval of the median premium from Poisson weights."""
    found = stats.poisson_interval(_log_premium(spark, d), "v", "pair_id", 5000, SEED)
    return found.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(f"SELECT lang, unnest({_POINTS}) AS point, unnest(list_transform(quantile_cont(n_chars::DOUBLE, {_POINTS}), lambda x: round(x, 6))) AS quantile FROM documents GROUP BY lang")
def quantiles(spark, d):
    out = quantile.quantiles(table(spark, d, "documents"), F.col("n_chars"), _POINTS, ["lang"])
    return out.select("lang", "point", F.round("quantile", 6).alias("quantile"))


@query("SELECT DISTINCT n_chars, round(cume_dist() OVER (ORDER BY n_chars), 9) AS share FROM documents")
def ecdf(spark, d):
    return stats.ecdf(table(spark, d, "documents"), "n_chars").select("n_chars", F.round("share", 9).alias("share"))


@query("SELECT doc_id, ('0x' || substr(sha256(concat(doc_id, ':', 17)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS held_out FROM documents")
def holdout_split(spark, d):
    return splits.with_holdout(table(spark, d, "documents"), "doc_id", 17).select("doc_id", "held_out")


_HELD = "('0x' || substr(sha256(concat({key}, ':', 1456095166)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2"


def _sides(of: str) -> str:
    return f"""WITH d AS (SELECT *, sha256(text) AS digest FROM documents), s AS (SELECT digest, {_HELD.format(key=of)} AS held_out FROM d)
SELECT digest, count(*) FILTER (NOT held_out) AS train, count(*) FILTER (held_out) AS held FROM s GROUP BY digest HAVING train > 0 AND held > 0"""


@query(_sides("doc_id"))
def leakage_check(spark, d):
    """Texts that a split by document has on both sides."""
    docs = table(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    return splits.leakage(splits.with_holdout(docs, "doc_id", contracts.SEEDS["split"]), "digest").select("digest", "train", "held")


@query(_sides("digest"))
def leakage_check_grouped(spark, d):
    """The same for a split by text: none."""
    docs = table(spark, d, "documents").withColumn("digest", F.sha2("text", 256))
    return splits.leakage(splits.with_group_holdout(docs, "digest", contracts.SEEDS["split"]), "digest").select("digest", "train", "held")


_SETS = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING count(*) >= 0.8::DOUBLE * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*)) - 1e-9),
c(v, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.v)
"""


@query(_SETS + "SELECT v AS doc_id, min(root) AS cluster FROM c GROUP BY v")
def near_duplicate_clusters(spark, d):
    return clusters.near_duplicate_clusters(table(spark, d, "documents"), "doc_id", "text")


@query()
def group_kfold_clusters(spark, d):
    """Folds that keep near-duplicate clusters together."""
    return splits.group_folds(clusters.near_duplicate_clusters(table(spark, d, "documents"), "doc_id", "text"), "cluster", 5)


@query("SELECT round(regr_slope(octet_length(encode(text))::DOUBLE, n_chars::DOUBLE), 6) AS slope, round(regr_r2(octet_length(encode(text))::DOUBLE, n_chars::DOUBLE), 6) AS r2 FROM documents")
def regr_simple(spark, d):
    y, x = F.octet_length("text").cast("double"), F.col("n_chars").cast("double")
    return table(spark, d, "documents").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def _ranks() -> tuple[str, str]:
    from public_tokenizers import PATTERN, path

    return path("byte_bpe_50k.tiktoken"), PATTERN


@query()
def bpe_round_trip(spark, d):
    checked = table(spark, d, "documents").select("doc_id", tokenizer.round_trip(*_ranks())("text").alias("r"))
    return checked.select("doc_id", "r.token_count", "r.ok")


@query()
def bpe_premium(spark, d):
    both = clusters.cut(pairs.conversation_pairs(table(spark, d, "conversations")))
    sides = both.select(F.explode(F.array(*[F.struct(F.struct("pair_id", F.lit(s).alias("side")).alias("k"), F.col(f"{s}_text").alias("text")) for s in "ab"])).alias("x")).select("x.*")
    counts = tokenizer.token_counts(sides, "k", "text", *_ranks()).select("k.*", "tokens").groupBy("pair_id").agg(*[F.max(F.when(F.col("side") == s, F.col("tokens"))).alias(f"{s}_tokens") for s in "ab"])
    rows = outcomes.measured(both.join(counts, "pair_id"), None)
    return rows.select("pair_id", *[v.alias(k) for k, v in outcomes.outcomes().items()])


@query()
def chunk_features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    counted = docs.join(tokenizer.token_counts(docs, "doc_id", "text", *_ranks()).withColumnRenamed("tokens", "n_tokens"), "doc_id", "left")
    return counted.select("doc_id", "n_tokens", *[v.alias(k) for k, v in tokenizer.mechanism(F.col("text"), _ranks()[1], F.col("n_tokens")).items()])


@query()
def vocabulary_digest(spark, d):
    return canonical.ordered_digest(files.vocabulary(spark, _ranks()[0]), "rank", "token")


@query("""WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY source),
f(i, source, n, fold, load) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT g.i, g.source, g.n, list_position(load, list_min(load))::BIGINT - 1, list_transform(range(1, 6), lambda j: load[j] + CASE WHEN j = list_position(load, list_min(load)) THEN g.n ELSE 0 END) FROM f JOIN g ON g.i = f.i + 1)
SELECT source, n, fold FROM f WHERE i > 0""")
def group_kfold(spark, d):
    return splits.group_folds(table(spark, d, "documents"), "source", 5)


@query()
def morphology_ratios(spark, d):
    tags = ["NNP", "NNG", "NNG", "NNG", "XSN", "JKO", "NNG", "XSV", "EF", "SF"]
    rows = spark.createDataFrame([("s1", [("", t, 0, 0) for t in tags]), ("s2", [])], f"pair_id string, seq {morphology.SEQUENCE}")
    return rows.select("pair_id", *[v.alias(k) for k, v in morphology.measures(F.col("seq")).items()])


# models: regressions on documents, sources as groups

_MODEL = """WITH t AS (SELECT doc_id, lang, source, sha256(text) AS digest, ln(1 + len(regexp_extract_all(text, '{p}')))::DOUBLE AS y, length(text) / 1000.0::DOUBLE AS n_points, len(regexp_extract_all(text, '\\s')) / length(text)::DOUBLE AS space_density,
  len(regexp_extract_all(text, '[0-9]')) / length(text)::DOUBLE AS digit_ratio FROM documents WHERE length(text) > 0)""".format(p=_TOKENS)
_BLOCKS = {"M0": ["n_points"], "M1": ["space_density", "digit_ratio"]}


def _modelled(spark, d):
    t, n = F.col("text"), F.char_length("text")
    share = lambda p: text.count_of(t, p).cast("double") / n
    tokens = F.regexp_count(t, F.lit("(?U)" + outcomes.PLAIN_TOKENS))
    measured = [F.log1p(tokens).alias("y"), (n / 1000.0).alias("n_points"), share(r"\s").alias("space_density"), share("[0-9]").alias("digit_ratio")]
    return table(spark, d, "documents").where(n > 0).select("doc_id", "lang", "source", F.sha2(t, 256).alias("digest"), *measured)


def _swept(rows: str, columns: list[str], pivots: int) -> str:
    """CTEs q0, q1, ... over `rows`: sums of products of the columns' deviations, then swept on one of the first `pivots` columns after the other.

    After that, the last column's entries hold the coefficients and the residual sum of squares, the diagonal the
    negated inverse. A column without variance of its own is passed over.
    """
    k = len(columns)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    name = lambda i, j: f"s{min(i, j)}_{max(i, j)}"
    parts = ["q0 AS (SELECT count(*) AS n, " + ", ".join(f"covar_pop({columns[i]}, {columns[j]}) * count(*) AS s{i}_{j}" for i, j in cells) + f" FROM {rows})"]
    for p in range(pivots):
        d = name(p, p)

        def cell(i: int, j: int, p=p, d=d) -> str:
            if i == p and j == p:
                return f"-1 / {d}"
            return f"{name(i, j)} / {d}" if p in (i, j) else f"{name(i, j)} - {name(i, p)} * {name(p, j)} / {d}"

        parts.append(f"q{p + 1} AS (SELECT n, " + ", ".join(f"CASE WHEN {d} > 1e-9 THEN {cell(i, j)} ELSE {name(i, j)} END AS s{i}_{j}" for i, j in cells) + f" FROM q{p})")
    return ", ".join(parts)


@query(_MODEL + """, w AS (SELECT y - avg(y) OVER g AS y, n_points - avg(n_points) OVER g AS x FROM t WINDOW g AS (PARTITION BY source))
SELECT 'M0' AS model, 1::BIGINT AS features, count(*) AS n, round(power(sum(x * y), 2) / (sum(x * x) * sum(y * y)), 6) AS r2 FROM w""")
def fixed_effects_m0(spark, d):
    fit = models.nested_models(_modelled(spark, d), {"M0": ["n_points"]}, "y", "source")[0]
    return spark.createDataFrame([(fit["model"], fit["features"], fit["n"], round(fit["r2"], 6))], "model string, features long, n long, r2 double")


_FEATURES = ["n_points", "space_density", "digit_ratio"]
_LANGS = ["de", "es", "fr"]
#: Deviations from the source's means of columns for three of the four languages, the features and the target, then swept on all but the last.
_CROSSED = _MODEL + ", u AS (SELECT *, " + ", ".join(f"(lang = '{x}')::DOUBLE AS lang_{x}" for x in _LANGS) + " FROM t WHERE lang IS NOT NULL AND source IS NOT NULL), w AS (SELECT " + ", ".join(
    f"{c} - avg({c}) OVER (PARTITION BY source) AS {c}" for c in [*(f"lang_{x}" for x in _LANGS), *_FEATURES, "y"]) + " FROM u), " + _swept("w", [*(f"lang_{x}" for x in _LANGS), *_FEATURES, "y"], 6) + """,
l AS (SELECT n - count(DISTINCT lang) - count(DISTINCT source) + 1 - 3 AS left_ FROM u, q0 GROUP BY n)
SELECT unnest(['n_points', 'space_density', 'digit_ratio']) AS feature, unnest([q6.s3_6, q6.s4_6, q6.s5_6]).round(6) AS coefficient, unnest([sqrt(-q6.s3_3 * q6.s6_6 / left_), sqrt(-q6.s4_4 * q6.s6_6 / left_), sqrt(-q6.s5_5 * q6.s6_6 / left_)]).round(6) AS std_error,
  round(1 - q6.s6_6 / q3.s6_6, 6) AS r2, left_ AS degrees FROM q3, q6, l"""


@query(_CROSSED)
def crossed_effects(spark, d):
    """M0 with crossed factors: effects of languages and of sources, both absorbed."""
    fit = effects.crossed_effects(_modelled(spark, d), _FEATURES, "y", ["lang", "source"])
    rows = [(f, round(float(b), 6), round(float(e), 6), round(fit["r2"], 6), fit["left"]) for f, b, e in zip(_FEATURES, fit["beta"], fit["errors"], strict=True)]
    return spark.createDataFrame(rows, "feature string, coefficient double, std_error double, r2 double, degrees long")


_GRAPHS = [("documents", "lang", "source"), ("documents", "source", "digest"), ("conversations", "conv_id", "role"), ("conversations", "conv_id", "digest")]


def _graph_sql() -> str:
    edges = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{a}' AS fa, '{b}' AS fb, 'a:' || {a} AS a, 'b:' || {b} AS b FROM (SELECT *, sha256(text) AS digest FROM {t}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for t, a, b in _GRAPHS)
    return f"""WITH RECURSIVE e AS ({edges}), u AS (SELECT t, fa, fb, a AS v, b AS w FROM e UNION ALL SELECT t, fa, fb, b, a FROM e),
c(t, fa, fb, v, root) AS (SELECT DISTINCT t, fa, fb, v, v FROM u UNION SELECT u.t, u.fa, u.fb, u.w, c.root FROM c JOIN u ON u.t = c.t AND u.fa = c.fa AND u.fb = c.fb AND u.v = c.v WHERE c.root < u.w),
r AS (SELECT t, fa, fb, v, min(root) AS root FROM c GROUP BY ALL)
SELECT t AS "table", fa AS factor_a, fb AS factor_b, count(*) FILTER (starts_with(v, 'a:')) AS levels_a, count(*) FILTER (starts_with(v, 'b:')) AS levels_b, count(DISTINCT root) AS components, count(DISTINCT root) - 1 AS lost, count(DISTINCT root) = 1 AS identified FROM r GROUP BY t, fa, fb"""


@query(_graph_sql())
def identifiability_gate(spark, d):
    """Which pairs of factors have effects that can be told apart: components of the graph of their levels."""
    rows = []
    for name, a, b in _GRAPHS:
        found = factors.identifiability(table(spark, d, name).withColumn("digest", F.sha2("text", 256)), a, b)
        rows.append((name, a, b, *(found[k] for k in ("levels_a", "levels_b", "components", "lost", "identified"))))
    return spark.createDataFrame(rows, "table string, factor_a string, factor_b string, levels_a long, levels_b long, components long, lost long, identified boolean")


@query(_MODEL + """, m AS (SELECT avg(y) AS my, avg(n_points) AS mx, covar_pop(y, n_points) / var_pop(n_points) AS b FROM t WHERE source IS NOT NULL),
g AS (SELECT source, sum((y - my) - b * (n_points - mx)) AS u0, sum(((y - my) - b * (n_points - mx)) * (n_points - mx)) AS u1 FROM t, m WHERE source IS NOT NULL GROUP BY source),
v AS (SELECT count(*)::DOUBLE / (count(*) - 1) AS c, sum(u0 * u0) AS s00, sum(u0 * u1) AS s01, sum(u1 * u1) AS s11 FROM g), n AS (SELECT count(*)::DOUBLE AS n, var_pop(n_points) * count(*) AS sxx FROM t WHERE source IS NOT NULL),
k AS (SELECT unnest(['intercept', 'n_points']) AS feature, unnest([my - b * mx, b]) AS coefficient, unnest([sqrt(c * (s00 / (n * n) - 2 * mx * s01 / (n * sxx) + mx * mx * s11 / (sxx * sxx))), sqrt(c * s11) / sxx]) AS std_error FROM m, v, n)
SELECT feature, round(coefficient, 6) AS coefficient, round(std_error, 6) AS std_error, round(coefficient - 1.959963984540054 * std_error, 6) AS low, round(coefficient + 1.959963984540054 * std_error, 6) AS high FROM k""")
def coefficient_intervals(spark, d):
    """Coefficients with errors that hold when a source's documents depend on each other."""
    rows = effects.coefficients(_modelled(spark, d), ["n_points"], "y", "source")
    return spark.createDataFrame([(r["feature"], *(round(r[k], 6) for k in ("coefficient", "std_error", "low", "high"))) for r in rows], "feature string, coefficient double, std_error double, low double, high double")


_UNIT = "('0x' || substr(sha256(concat(doc_id, ':', {seed})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(_MODEL + f""", r AS (SELECT n_points AS x, y, floor({_UNIT.format(seed=contracts.SEEDS['model_tuning'])} * 5) AS fold FROM t WHERE NOT {_UNIT.format(seed=contracts.SEEDS['split'])} < 0.2),
l AS (SELECT unnest({list(tuning.PATH)}::DOUBLE[]) AS penalty), f AS (SELECT DISTINCT fold FROM r),
b AS (SELECT f.fold, penalty, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / (var_pop(x) * (1 + penalty)) AS slope FROM r JOIN f ON r.fold <> f.fold, l GROUP BY f.fold, penalty),
e AS (SELECT penalty, avg(power(y - my - slope * (x - mx), 2)) AS error FROM r JOIN b USING (fold) GROUP BY penalty), w AS (SELECT penalty, covar_pop(x, y) / (var_pop(x) * (1 + penalty)) AS slope FROM r, l GROUP BY penalty)
SELECT penalty, round(error, 6) AS error, round(slope, 6) AS slope, row_number() OVER (ORDER BY error, penalty DESC) = 1 AS chosen FROM e JOIN w USING (penalty)""")
def tuned_ridge(spark, d):
    """A ridge penalty chosen by folds of the training part."""
    found = tuning.tuned_ridge(_modelled(spark, d), ["n_points"], "y", "doc_id", contracts.SEEDS["split"], contracts.SEEDS["model_tuning"])
    return spark.createDataFrame([(r["penalty"], round(r["error"], 6), round(r["slopes"][1], 6), r["chosen"]) for r in found], "penalty double, error double, slope double, chosen boolean")


def _two_sided_sql(z: str) -> str:
    """stats.two_sided in SQL."""
    steps, x = "list_transform(range(60, 0, -1), lambda k: k::DOUBLE)", f"(abs({z}) / sqrt(2))"
    near = f"list_reduce({steps}, lambda s, k: 1 + 2 * {x} * {x} / (2 * k + 1) * s, 1.0::DOUBLE)"
    far = f"list_reduce({steps}, lambda s, k: k / 2 / ({x} + s), 0.0::DOUBLE)"
    scale = f"(exp(-{x} * {x}) / sqrt(pi()))"
    return f"CASE WHEN {x} < 2 THEN 1 - 2 * {scale} * {x} * {near} ELSE {scale} / ({x} + {far}) END"


_INTERACTIONS = _MODEL + """, v AS (SELECT lang AS a, source AS b, digest AS c, y FROM t WHERE lang IS NOT NULL AND source IS NOT NULL),
cells AS (SELECT a, b, count(*) AS n, avg(y) AS m FROM v GROUP BY a, b), s AS (SELECT v.a, v.b, c, sum(y - m) / min(n) AS s FROM v JOIN cells USING (a, b) GROUP BY v.a, v.b, c),
z AS (SELECT min(a) AS a0, min(b) AS b0, (SELECT count(DISTINCT c)::DOUBLE FROM v) AS g FROM v),
k AS (SELECT a AS i, b AS j, n, unnest([a, a, a0, a0]) AS a, unnest([b, b0, b, b0]) AS b, unnest([1, -1, -1, 1]) AS w FROM cells, z WHERE a <> a0 AND b <> b0),
x AS (SELECT i, j, k.n, sum(w * m) AS contrast FROM k JOIN cells USING (a, b) GROUP BY i, j, k.n HAVING count(*) = 4), u AS (SELECT i, j, c, sum(w * s) AS u FROM k JOIN s USING (a, b) GROUP BY i, j, c),
e AS (SELECT i, j, sum(u * u) * min(g) / (min(g) - 1) AS var FROM u, z GROUP BY i, j), tests AS (SELECT i AS lang, j AS source, n, contrast, sqrt(var) AS std_error, contrast / sqrt(var) AS z FROM x JOIN e USING (i, j) WHERE var > 0),
p AS (SELECT *, """ + _two_sided_sql("z") + " AS p FROM tests)"


@query(_INTERACTIONS + " SELECT lang, source, n, round(contrast, 9) AS contrast, round(std_error, 9) AS std_error, round(z * z, 6) AS wald, round(p, 9) AS p_value FROM p")
def interaction_tests(spark, d):
    """What a language has in a source beyond both: contrasts of cells, with errors that hold for copies of a text."""
    out = effects.interaction_tests(_modelled(spark, d), "y", "lang", "source", "digest")
    return out.select("lang", "source", "n", *[F.round(c, 9).alias(c) for c in ("contrast", "std_error")], F.round("wald", 6).alias("wald"), F.round("p_value", 9).alias("p_value"))


@query(_INTERACTIONS + """, r AS (SELECT lang, source, p, row_number() OVER (PARTITION BY lang ORDER BY p, source) AS rank, count(*) OVER (PARTITION BY lang) AS m FROM p),
q AS (SELECT lang, source, rank, min(least(1.0::DOUBLE, p * m / rank)) OVER (PARTITION BY lang ORDER BY p DESC, source DESC ROWS UNBOUNDED PRECEDING) AS q FROM r)
SELECT lang, source, rank, round(q, 9) AS q, q <= 0.05 AS rejected FROM q""")
def bh_fdr(spark, d):
    """False discovery rate of the interactions, a family for each language."""
    p = effects.interaction_tests(_modelled(spark, d), "y", "lang", "source", "digest")
    return stats.benjamini_hochberg(p, "p_value", "source", family="lang").select("lang", "source", F.col("rank").cast("long").alias("rank"), F.round("q", 9).alias("q"), "rejected")


_MODEL_ROW = "model string, features long, n long, groups long, r2 double, delta_r2 double, f double, p_value double"


@query()
def ols_blocks(spark, d):
    return spark.createDataFrame(models.nested_models(_modelled(spark, d), _BLOCKS, "y", "source"), _MODEL_ROW)


_OWN = _MODEL + ", w AS (SELECT " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY source) AS {c}" for c in [*_FEATURES, "y"]) + " FROM t WHERE source IS NOT NULL), " + _swept("w", [*_FEATURES, "y"], 3)


@query(_OWN + """, g AS (SELECT count(DISTINCT source) AS groups FROM t)
SELECT 'M0' AS model, 1::BIGINT AS features, q0.n, groups, round(1 - q1.s3_3 / q0.s3_3, 6) AS r2, NULL::DOUBLE AS delta_r2, NULL::DOUBLE AS f FROM q0, q1, g
UNION ALL SELECT 'M1', 3, q0.n, groups, round(1 - q3.s3_3 / q0.s3_3, 6), round((q1.s3_3 - q3.s3_3) / q0.s3_3, 6), round((q1.s3_3 - q3.s3_3) / 2 / (q3.s3_3 / (q0.n - groups - 3)), 4) FROM q0, q1, q3, g""")
def ols_fit(spark, d):
    """What ols_blocks reports, but for the tail of F."""
    cut = lambda x, n: None if x is None else round(x, n)
    rows = models.nested_models(_modelled(spark, d), _BLOCKS, "y", "source")
    return spark.createDataFrame([(r["model"], r["features"], r["n"], r["groups"], round(r["r2"], 6), cut(r["delta_r2"], 6), cut(r["f"], 4)) for r in rows], "model string, features long, n long, groups long, r2 double, delta_r2 double, f double")


@query(_MODEL + """, r AS (SELECT power(corr(y, n_points), 2) AS small, corr(y, n_points) AS r1, corr(y, digit_ratio) AS r2, corr(n_points, digit_ratio) AS r12 FROM t)
SELECT round((r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - small, 6) AS delta_r2 FROM r""")
def block_increment(spark, d):
    gain = models.block_increment(_modelled(spark, d), ["n_points"], ["n_points", "digit_ratio"], "y")
    return spark.createDataFrame([(round(gain["delta_r2"], 6),)], "delta_r2 double")


@query(_MODEL + """, v AS (SELECT 1 / (1 - power(corr(space_density, digit_ratio), 2)) AS v FROM t)
SELECT unnest(['space_density', 'digit_ratio']) AS feature, round(v, 6) AS vif, v > 5 AS warning, v > 10 AS severe FROM v""")
def vif(spark, d):
    rows = [{**r, "vif": round(r["vif"], 6)} for r in models.inflation(_modelled(spark, d), ["space_density", "digit_ratio"])]
    return spark.createDataFrame(rows, "feature string, vif double, warning boolean, severe boolean")


_FIT_ROW = "model string, intercept double, slope double, converged boolean"


@query()
def huber(spark, d):
    fit = models.huber(_modelled(spark, d), ["n_points"], "y")
    return spark.createDataFrame([("huber", float(fit["beta"][0]), float(fit["beta"][1]), fit["converged"])], _FIT_ROW)


@query()
def quantile_reg(spark, d):
    """Quantile lines, with a bound a row on what a better line could save."""
    rows = clusters.cut(_modelled(spark, d))
    fits = [(f"quantile {q:.2f}", models.quantile_regression(rows, ["n_points"], "y", q)) for q in models.QUANTILES.values()]
    return spark.createDataFrame([(k, float(f["beta"][0]), float(f["beta"][1]), f["loss"], f["gap"], f["converged"]) for k, f in fits], "model string, intercept double, slope double, loss double, gap double, converged boolean")


@query()
def random_intercept(spark, d):
    fit = models.random_intercept(_modelled(spark, d), ["n_points"], "y", "source", fixed=("lang",))
    row = (fit["n"], fit["groups"], float(fit["beta"][0]), float(fit["beta"][1]), fit["group_variance"], fit["residual_variance"], fit["converged"], fit["singular"], fit["identified"], fit["usable"])
    return spark.createDataFrame([row], "n long, groups long, intercept double, slope double, group_variance double, residual_variance double, converged boolean, singular boolean, identified boolean, usable boolean")


@query(r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM r GROUP BY ALL),
i AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM c GROUP BY term), x AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN i USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def tfidf(spark, d):
    return terms.tfidf(table(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


# strata, sensitivity, tables and figures

_STRATA = _MEASURED + ", s AS (SELECT lp, 's' || (conv_id % 3) AS source, CASE WHEN bc < 200 THEN 'short' WHEN bc < 1000 THEN 'middle' ELSE 'long' END AS stratum FROM o)"


def _strata(spark, d):
    stratum = F.when(F.col("b_points") < 200, "short").when(F.col("b_points") < 1000, "middle").otherwise("long")
    return _measured(spark, d).select("pair_id", outcomes.outcomes()["log_premium"].alias("v"), F.concat(F.lit("s"), F.col("conv_id") % 3).alias("source"), stratum.alias("stratum"))


def _with_median(rows, value, by, aggregates, name="median"):
    """Aggregates of groups (null keys are groups too) with the median of a value, rounded to 9 decimals."""
    group = F.struct(*by).alias("g")
    found = quantile.medians(rows, F.col(value), by).select(group, F.round("median", 9).alias(name))
    out = rows.groupBy(group).agg(*aggregates).join(found, "g", "left")
    return out.select("g.*", *[c for c in out.columns if c != "g"])


@query(_STRATA + " SELECT source, stratum, count(*) AS n, round(median(lp), 9) AS median, round(avg(lp), 9) AS mean FROM s GROUP BY GROUPING SETS ((source), (stratum), (source, stratum))")
def premium_by_stratum(spark, d):
    none = F.lit(None).cast("string")
    sets = [F.struct(F.col("source").alias("source"), none.alias("stratum")), F.struct(none.alias("source"), F.col("stratum").alias("stratum")), F.struct(F.col("source").alias("source"), F.col("stratum").alias("stratum"))]
    rows = _strata(spark, d).select(F.explode(F.array(*sets)).alias("x"), "v").select("x.*", "v")
    return _with_median(rows, "v", ["source", "stratum"], [F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean")])


@query(_STRATA + """, i AS (SELECT source, stratum, avg(lp) AS m, count(*) AS n FROM s GROUP BY ALL), a AS (SELECT source, avg(lp) AS ms FROM s GROUP BY source), b AS (SELECT stratum, avg(lp) AS mt FROM s GROUP BY stratum)
SELECT source, stratum, n, round(m - ms - mt + (SELECT avg(lp) FROM s), 9) AS interaction FROM i JOIN a USING (source) JOIN b USING (stratum)""")
def strata_interactions(spark, d):
    """What a cell of two strata has beyond its two margins."""
    rows = _strata(spark, d)
    sets = rows.groupingSets([["source", "stratum"], ["source"], ["stratum"], []], "source", "stratum").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("v").alias("m"))
    cells, sources, strata = (sets.where(F.col("g") == g) for g in (0, 1, 2))
    whole = F.broadcast(sets.where("g = 3").select(F.col("m").alias("all")))  # one row
    out = cells.join(F.broadcast(sources.select("source", F.col("m").alias("ms"))), "source").join(F.broadcast(strata.select("stratum", F.col("m").alias("mt"))), "stratum").join(whole)
    return out.select("source", "stratum", "n", F.round(F.col("m") - F.col("ms") - F.col("mt") + F.col("all"), 9).alias("interaction"))


_VARIANTS = {
    "accepted_cohort": ("rule = 'accepted'", "rule = 'accepted'"),
    "curated_only": ("rule = 'accepted' AND conv_id % 3 < 2", "rule = 'accepted' AND conv_id % 3 < 2"),
    "without_anomalies": ("rule = 'accepted' AND NOT anomaly", "rule = 'accepted' AND NOT anomaly"),
    "without_extreme_lengths": ("rule = 'accepted' AND b_points >= 200 AND b_points < 5000", "rule = 'accepted' AND bc >= 200 AND bc < 5000"),
    "known_direction": ("rule = 'accepted' AND turn_a % 2 = 0", "rule = 'accepted' AND turn_a % 2 = 0"),
}
_ODD = r"regexp_matches({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]|[\x{{200B}}-\x{{200D}}\x{{FEFF}}]|\p{{M}}{{3,}}')"
_TRIMMED = r"regexp_replace(regexp_replace(nfc_normalize({t}), '^\x{{FEFF}}', ''), '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+\z', '', 'g')"


def _variant_sql() -> str:
    count = lambda t: f"len(regexp_extract_all({t}, '{_TOKENS}'))::DOUBLE"
    head = _FLOW + f", x AS (SELECT *, length(b_text) AS bc, {_ODD.format(t='a_text')} OR {_ODD.format(t='b_text')} AS anomaly, "
    texts = {"raw_text": "{t}", "nfc_only": "nfc_normalize({t})", "analysis_text": _TRIMMED}
    head += ", ".join(f"ln({count(f.format(t='a_text'))} / nullif({count(f.format(t='b_text'))}, 0)) AS {k}" for k, f in texts.items()) + " FROM r)"
    rows = [f"SELECT '{k}' AS variant, {k} AS v FROM x WHERE rule = 'accepted'" for k in texts]
    rows += [f"SELECT '{k}', analysis_text FROM x WHERE {c}" for k, (_, c) in _VARIANTS.items()]
    return head + f", u AS ({' UNION ALL '.join(rows)}) SELECT variant, count(*) AS n, round(median(v), 9) AS median_log_premium, count(*) FILTER (v > 0) AS n_plus FROM u WHERE isfinite(v) GROUP BY variant"


@query(_variant_sql())
def sensitivity_variants(spark, d):
    """One measure of the premium under each cohort and text variant; sources by conversation number and turns stand in for tiers and directions."""
    count = lambda t: F.regexp_count(t, F.lit("(?U)" + outcomes.PLAIN_TOKENS)).cast("double")
    ratio = lambda a, b: F.when((a > 0) & (b > 0), F.ln(a / b))
    rows = _judged(spark, d).withColumns({f"{s}_nfc": text.nfc(f"{s}_text") for s in "ab"})
    every = {
        "raw_text": ratio(count(F.col("a_text")), count(F.col("b_text"))),
        "nfc_only": ratio(count(F.col("a_nfc")), count(F.col("b_nfc"))),
        "analysis_text": ratio(count(text.analysis_text(F.col("a_nfc"))), count(text.analysis_text(F.col("b_nfc")))),
    }
    rows = rows.select("conv_id", "turn_a", "rule", F.char_length("b_text").alias("b_points"), (text.anomaly_flag(F.col("a_text")) | text.anomaly_flag(F.col("b_text"))).alias("anomaly"), *[v.alias(k) for k, v in every.items()])
    parts = [F.struct(F.lit(k).alias("variant"), F.when(F.expr("rule = 'accepted'"), F.col(k)).alias("v")) for k in every]
    parts += [F.struct(F.lit(k).alias("variant"), F.when(F.expr(c), F.col("analysis_text")).alias("v")) for k, (c, _) in _VARIANTS.items()]
    out = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*").where("v IS NOT NULL")
    return _with_median(out, "v", ["variant"], [F.count("*").alias("n"), F.count_if(F.col("v") > 0).alias("n_plus")], "median_log_premium")


@query()
def sensitivity_models(spark, d):
    """The slope of length under other models: least squares, Huber, quantiles, fixed and random source intercepts."""
    rows = clusters.cut(_modelled(spark, d))
    fits = {"ols": models.least_squares(rows, ["n_points"], "y"), "huber": models.huber(rows, ["n_points"], "y")}
    fits |= {f"quantile_{q:.2f}": models.quantile_regression(rows, ["n_points"], "y", q) for q in models.QUANTILES.values()}
    out = [(k, float(f["beta"][1])) for k, f in fits.items()]
    out.append(("source_fixed", float(models.fixed_effects(rows, ["n_points"], "y", "source")["beta"][0])))
    out.append(("source_random", float(models.random_intercept(rows, ["n_points"], "y", "source")["beta"][1])))
    return spark.createDataFrame(out, "variant string, slope double")


@query(_MEASURED + """, l AS (SELECT unnest(['a', 'b']) AS side, unnest([ta, tb]) AS t, unnest([ab, bb]) AS y, unnest([ac, bc]) AS c FROM o)
SELECT side, count(*) AS n, sum(t)::BIGINT AS tokens, round(avg(t), 6) AS mean_tokens, median(t) AS median_tokens, round(sum(t) / sum(y), 9) AS tokens_per_byte, round(sum(t) / sum(c), 9) AS tokens_per_codepoint FROM l GROUP BY side""")
def table_t02(spark, d):
    """T02: what each side takes."""
    sides = [F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{x}").cast("double").alias(x) for x in ("tokens", "bytes", "points")]) for s in "ab"]
    rows = _measured(spark, d).select(F.explode(F.array(*sides)).alias("x")).select("x.*")
    total = F.sum("tokens")
    measures = [F.count("*").alias("n"), total.cast("long").alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.round(total / F.sum("bytes"), 9).alias("tokens_per_byte"), F.round(total / F.sum("points"), 9).alias("tokens_per_codepoint")]
    return _with_median(rows, "tokens", ["side"], measures, "median_tokens")


@query(_MEASURED + """, l AS (SELECT unnest(['point_ratio', 'density_ratio']) AS factor, unnest([ln(ac / bc), ln((ab / ac) / (bb / bc))]) AS v FROM o)
SELECT factor, count(*) AS n, round(median(v), 9) AS median, round(avg(v), 9) AS mean FROM l GROUP BY factor""")
def table_t03(spark, d):
    """T03: the factors of the premium on the logarithmic scale; the penalty is reported by itself."""
    cols = outcomes.outcomes()
    parts = [F.struct(F.lit(k).alias("factor"), F.ln(cols[k]).alias("v")) for k in ("point_ratio", "density_ratio")]
    rows = _measured(spark, d).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return _with_median(rows, "v", ["factor"], [F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean")])


@query()
def word_segments(spark, d):
    """Pieces of each distinct word, by costs learned from the documents' words."""
    words = segments.word_counts(table(spark, d, "documents"), "doc_id", "text").select("word").distinct()
    found = segments.segmented(words, segments.learn(words)).withColumn("places", segments.places(F.col("pieces")))
    return found.select("word", *[F.array_join(F.col(f"{c}"), "|").alias(f"{c}_") for c in ("pieces", "places")]).withColumnsRenamed({"pieces_": "pieces", "places_": "places"})


def _morphology(spark, d):
    """The models' rows with what the pieces of a document's words say: their density, and the shares of affixes."""
    own = segments.measures(table(spark, d, "documents"), "doc_id", "text")
    share = lambda c: F.col(c).cast("double") / F.col("pieces")
    own = own.select("doc_id", (F.col("pieces") / F.col("words")).alias("morpheme_density"), share("prefixes").alias("prefix_ratio"), share("suffixes").alias("suffix_ratio"), (share("prefixes") + share("suffixes")).alias("affix_ratio"))
    return _modelled(spark, d).join(own, "doc_id")


_M2 = {"primary": ["morpheme_density", "prefix_ratio", "suffix_ratio"], "alternative": ["morpheme_density", "affix_ratio"]}


@query()
def table_t04(spark, d):
    """T04: what the morphology block adds to M1, with source effects."""
    return spark.createDataFrame(models.nested_models(_morphology(spark, d), {**_BLOCKS, "M2": _M2["primary"]}, "y", "source"), _MODEL_ROW)


@query()
def morphology_blocks(spark, d):
    """The two morphology blocks beside each other, never in one model: a variant of the sensitivity runs. What one composite loses against its parts."""
    rows = clusters.cut(_morphology(spark, d))
    out = [{"block": k, **models.nested_models(rows, {**_BLOCKS, "M2": own}, "y", "source")[-1]} for k, own in _M2.items()]
    return spark.createDataFrame([(r["block"], r["n"], r["r2"], r["delta_r2"], r["f"], r["p_value"]) for r in out], "block string, n long, r2 double, delta_r2 double, f double, p_value double")


@query()
def table_t05(spark, d):
    """T05: what pre-token chunks add to M1; they come after treatment, so this describes a mechanism and controls nothing."""
    t, n = F.col("text"), F.char_length("text")
    chunks = tokenizer.chunk_count(t, _ranks()[1])
    share = lambda p: text.count_of(t, p).cast("double") / n
    counted = table(spark, d, "documents").where(n > 0).select("source", "text", tokenizer.token_count(*_ranks())("text").alias("tokens"))
    rows = counted.select("source", F.log1p("tokens").alias("y"), (n / 1000.0).alias("n_points"), share(r"\s").alias("space_density"), share("[0-9]").alias("digit_ratio"), (n / F.greatest(chunks, F.lit(1))).alias("chunk_length"))
    return spark.createDataFrame(models.nested_models(rows, {**_BLOCKS, "M3": ["chunk_length"]}, "y", "source"), _MODEL_ROW)


@query(_MEASURED + "SELECT pair_id, ta::BIGINT AS a_tokens, tb::BIGINT AS b_tokens FROM o")
def figure_f01(spark, d):
    """scatter of both sides' tokens."""
    return _measured(spark, d).select("pair_id", F.col("a_tokens").cast("long").alias("a_tokens"), F.col("b_tokens").cast("long").alias("b_tokens"))


@query(_MEASURED + ", x AS (SELECT round(tp, 9) AS token_premium FROM o) SELECT DISTINCT token_premium, round(cume_dist() OVER (ORDER BY token_premium), 9) AS share FROM x")
def figure_f02(spark, d):
    """distribution of the premium."""
    rows = _measured(spark, d).select(F.round(outcomes.outcomes()["token_premium"], 9).alias("token_premium"))
    return stats.ecdf(rows, "token_premium").select("token_premium", F.round("share", 9).alias("share"))


@query(_STRATA + """ SELECT source, count(*) AS n, round(avg(lp), 9) AS mean, round(avg(lp) - 1.96 * stddev_samp(lp) / sqrt(count(*)), 9) AS low, round(avg(lp) + 1.96 * stddev_samp(lp) / sqrt(count(*)), 9) AS high FROM s GROUP BY source""")
def figure_f08(spark, d):
    """forest of sources, mean and its interval."""
    mean, half = F.avg("v"), F.lit(1.96) * F.stddev_samp("v") / F.sqrt(F.count("*"))
    return _strata(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(mean, 9).alias("mean"), F.round(mean - half, 9).alias("low"), F.round(mean + half, 9).alias("high"))


@query(_MEASURED + """, k AS (SELECT pair_id, round(lp, 9) AS log_premium, row_number() OVER (ORDER BY lp, pair_id) AS up, row_number() OVER (ORDER BY lp DESC, pair_id) AS down FROM o)
SELECT pair_id, log_premium, CASE WHEN up <= 5 THEN 'lowest' ELSE 'highest' END AS panel FROM k WHERE up <= 5 OR down <= 5""")
def figure_f07(spark, d):
    """the pairs with the five lowest and the five highest premiums."""
    rows = _log_premium(spark, d)
    low, high = (rows.orderBy(o, "pair_id").limit(5).withColumn("panel", F.lit(p)) for o, p in ((F.asc("v"), "lowest"), (F.desc("v"), "highest")))
    both = low.unionByName(high.join(low.select("pair_id"), "pair_id", "left_anti"))
    return both.select("pair_id", F.round("v", 9).alias("log_premium"), "panel")


#: Question, data, estimand, method, outputs.
TRACEABILITY = [
    ("RQ1", "D-01,D-04", "median logTP", "signed-rank + bootstrap", "T01,F01-F03"),
    ("RQ2", "D-02,D-04", "exact decomposition identity", "distribution", "T02,F04-F05"),
    ("RQ3", "D-02,D-04", "logTP / logCompressionPenalty", "M1 regression", "T03,F06"),
    ("RQ4", "D-03,D-04", "incremental morphology value", "M2 vs M1", "T04,coefficient plot"),
    ("RQ5", "D-05,D-04", "chunk/token mechanism", "M3 mechanism audit", "T05,extreme audit"),
    ("RQ6", "D-01,D-02,D-03,D-04,D-05", "strata-specific effects", "interactions / forest plot", "T06,F08"),
    ("RQ7", "D-06,D-07", "request/output/latency/cost ratios", "paired serving analysis", "T07,F09"),
]
#: Which query gives which table or figure; those of RQ7 are deferred.
OUTPUTS = {
    "T01": "hard_exclusion_flow", "T02": "table_t02", "T03": "table_t03", "T04": "table_t04", "T05": "table_t05", "T06": "premium_by_stratum", "T08": "sensitivity_variants",
    "F01": "figure_f01", "F02": "figure_f02", "F03": "premium_by_stratum", "F04": "regex_token_premium", "F05": "log_compression_penalty", "F06": "coefficient_intervals", "F07": "figure_f07", "F08": "figure_f08",
}


def _values(rows, names: str) -> str:
    """A literal table in SQL."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"


@query("SELECT rq, unnest(string_split(data, ',')) AS data, estimand, method, outputs FROM " + _values(TRACEABILITY, "rq, data, estimand, method, outputs"))
def traceability(spark, d):
    rows = spark.createDataFrame(TRACEABILITY, "rq string, data string, estimand string, method string, outputs string")
    return rows.withColumn("data", F.explode(F.split("data", ",")))


# contracts and documents

#: Documents that break some rules: a permission is open, a zero stands for false, a version differs, a value is missing; two seeds are equal.
_DOCUMENTS = {
    "tokenizer": {"track": "A", "tokenizer_id": "o200k_base", "implementation": "tiktoken", "package_version": "0.12.0", "network_fallback_allowed": 0},
    "serving": {
        "track": "B", "execution_status": "deferred", "enabled_in_phase_0": False, "deployment": {"baseline_if_reactivated": "hugging_face_hosted_api"},
        "research_contract": {"serving_seed_path": "seed_policy.serving", "track_b_status_path": "track_b_status.status"},
        "execution_permissions": {"model_download_allowed": False, "local_inference_allowed": False, "hosted_api_call_allowed": True, "serving_benchmark_allowed": False},
    },
    "morphology": {"analyzer": {"primary_name": "Kiwi", "primary_package": "kiwipiepy", "design_freeze_version": "0.23.2"}},
    "research": {"track_b_status": {"status": "DEFERRED_NOT_EXECUTED"}, "seed_policy": {"master_seed": 20260816, "split": 1456095166, "bootstrap": 1456095166, "model_tuning": 4294967296, "serving": True}},
}
_LEAVES = _values(contracts.leaves(_DOCUMENTS), "name, path, value")


@query(f"SELECT r.name, r.path, CASE WHEN l.value IS NULL THEN 'missing' ELSE 'different' END AS reason FROM (SELECT * FROM {_values([(n, p, json.dumps(v)) for n, p, v in contracts.RULES], 'name, path, expected')}) r "
       f"LEFT JOIN (SELECT * FROM {_LEAVES}) l USING (name, path) WHERE l.value IS DISTINCT FROM r.expected")  # fmt: skip
def contract_violations(spark, d):
    return contracts.violations(contracts.value_rows(spark, _DOCUMENTS), contracts.rule_rows(spark, contracts.RULES))


@query(f"""WITH s AS (SELECT t.seed, l.value FROM {_values([(k,) for k in contracts.SEEDS], 'seed')} LEFT JOIN (SELECT * FROM {_LEAVES}) l ON l.name = 'research' AND l.path = 'seed_policy.' || t.seed),
k AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN NOT coalesce(try_cast(value AS BIGINT) BETWEEN 0 AND 4294967295 AND regexp_full_match(value, '-?[0-9]+'), false) THEN 'no seed' WHEN count(*) OVER (PARTITION BY value) > 1 THEN 'repeated' END AS reason FROM s)
SELECT seed, reason FROM k WHERE reason IS NOT NULL""")
def seed_policy_check(spark, d):
    return contracts.seed_violations(contracts.value_rows(spark, _DOCUMENTS))


_FACTS = ([("Kiwi", "0.23.2"), ("tiktoken", "0.13.0"), ("numpy", "2")], [("Kiwi", "0.23.2"), ("tiktoken", "0.12.0"), ("scipy", "1")])


@query(f"SELECT coalesce(a.key, b.key) AS key, a.value AS \"left\", b.value AS \"right\" FROM (SELECT * FROM {_values(_FACTS[0], 'key, value')}) a FULL JOIN (SELECT * FROM {_values(_FACTS[1], 'key, value')}) b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def cross_document_equality(spark, d):
    a, b = (spark.createDataFrame(x, "key string, value string") for x in _FACTS)
    return contracts.same_facts(a, b, ["key"])


_GATES = [(f"E{i:02}", "OPEN" if i == 11 else "PASS", f"check {i}") for i in range(1, 13)]


@query(f"SELECT count(*) AS checks, count(*) FILTER (status = 'OPEN') AS open, bool_and(status <> 'FAIL') AS passed FROM {_values(_GATES, 'check_id, status, evidence')}")
def gate_table(spark, d):
    rows = spark.createDataFrame(_GATES, "check_id string, status string, evidence string")
    counts = rows.agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "OPEN").alias("open"))
    return counts.join(contracts.gate(rows))


_REGISTRY = [
    ("p1", "A", "news", "declarative", "KO_TO_EN"), ("p2", "B", "dialogue", "title", "UNKNOWN"), ("p3", "D", "poetry", "declarative", "EN_TO_KO"), ("p4", None, "legal", "other", "en_to_ko"),
]
_ALLOWED = {**pairs.TAXONOMY, "source_tier": pairs.TIERS}


@query(f"WITH r AS (SELECT * FROM {_values(_REGISTRY, 'pair_id, source_tier, domain, sentence_type, translation_direction')}), "
       "c AS (" + " UNION ALL ".join(f"SELECT pair_id, '{k}' AS \"column\", {k} AS value FROM r WHERE coalesce({k} NOT IN ({', '.join(repr(x) for x in v)}), true)" for k, v in _ALLOWED.items()) + ") SELECT * FROM c")  # fmt: skip
def registry_taxonomy(spark, d):
    rows = spark.createDataFrame(_REGISTRY, "pair_id string, source_tier string, domain string, sentence_type string, translation_direction string")
    return pairs.taxonomy_violations(rows)


@query("SELECT source, min(n_chars) AS low, max(n_chars) AS high, min(n_chars) = max(n_chars) AS blank FROM documents GROUP BY source")
def extrema(spark, d):
    low, high = F.min("n_chars"), F.max("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(low.alias("low"), high.alias("high"), (low == high).alias("blank"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+')) AS scheme, starts_with(url, 'https://') AS secure, list_extract(string_split(split_part(url, '?', 1), '/'), 3) AS host, replace(trim(url), '/', '|') AS flat,
  contains(url, '?') AS has_query, array_to_string(string_split(split_part(url, '://', 2), '/'), ' > ') AS trail FROM pages""")
def string_functions(spark, d):
    u = F.col("url")
    parts = F.split(F.split(u, r"\?")[0], "/")
    return table(spark, d, "pages").select(
        "page_id", F.lower(F.regexp_extract(u, "^[a-zA-Z]+", 0)).alias("scheme"), F.startswith(u, F.lit("https://")).alias("secure"), F.get(parts, F.lit(2)).alias("host"),
        F.replace(F.trim(u), F.lit("/"), F.lit("|")).alias("flat"), F.contains(u, F.lit("?")).alias("has_query"), F.array_join(F.split(F.split_part(u, F.lit("://"), F.lit(2)), "/"), " > ").alias("trail"),
    )


@query("SELECT doc_id, sha256(base64(encode(text))) AS base64_sha256, printf('%016X', n_chars) AS n_chars_u64 FROM documents")
def binary_encodings(spark, d):
    """Base64 of the text's UTF-8, and a big-endian number."""
    body = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.sha2(body, 256).alias("base64_sha256"), F.hex(canonical.big_endian(F.col("n_chars"), 8)).alias("n_chars_u64"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, json_extract_string(props, '$.missing') IS NOT NULL AS has_missing, CASE WHEN json_valid(props) THEN 'PASS' ELSE 'FAIL' END AS status FROM events")
def json_paths(spark, d):
    """Dotted paths of parsed documents; what can't be parsed or found is a status or a default, not an error."""
    doc = F.try_parse_json("props")
    rows = table(spark, d, "events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", F.coalesce(F.try_variant_get("doc", "$.k", "long"), F.lit(-1)).cast("long").alias("k"), F.try_variant_get("doc", "$.missing", "string").isNotNull().alias("has_missing"), F.when(F.col("doc").isNull(), "FAIL").otherwise("PASS").alias("status"))


@query("SELECT page_id, starts_with(url || '/', 'https://m.') AS inside FROM pages")
def path_containment(spark, d):
    return table(spark, d, "pages").select("page_id", F.startswith(F.concat("url", F.lit("/")), F.lit("https://m.")).alias("inside"))


_SAMPLES = ["한국어 토큰화 재현성 검사", "English tokenization reproducibility check", "공백  두 개와\n줄바꿈", "NFC 한글과 emoji 😀 123"]


@query(f"SELECT row_number() OVER () - 1 AS sample_id, octet_length(encode(t.text)) AS n_bytes, length(t.text) AS n_points, length_grapheme(t.text) AS n_graphemes FROM {_values([(x,) for x in _SAMPLES], 'text')}")
def sample_lengths(spark, d):
    t = F.col("text")
    return files.numbered(spark, _SAMPLES).select("sample_id", F.octet_length(t).cast("long").alias("n_bytes"), F.char_length(t).cast("long").alias("n_points"), text.graphemes(t).cast("long").alias("n_graphemes"))


@query("SELECT doc_id, contains(text, '<|endoftext|>') OR contains(text, '<|endofprompt|>') AS rejected FROM documents")
def special_literals(spark, d):
    return table(spark, d, "documents").select("doc_id", tokenizer.has_special(F.col("text"), ["<|endoftext|>", "<|endofprompt|>"]).alias("rejected"))


@query()
def tokenizer_manifest(spark, d):
    path, pattern = _ranks()
    found = tokenizer.manifest(spark, path, pattern, "byte_bpe_50k", {"<|endoftext|>": 50256})
    return spark.createDataFrame([(k, canonical.canonical_json(v).decode().strip()) for k, v in found.items()], "field string, value string")


@query()
def file_inventory(spark, d):
    """The vocabulary folder's files, with digests from the workers."""
    import os

    found = files.digests(spark, "file://" + os.path.dirname(_ranks()[0]))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size_bytes", "sha256")


@query()
def package_inventory(spark, d):
    return environment.package_versions(spark, ["numpy", "pandas", "pyarrow", "pyspark", "duckdb", "NumPy", "no-such-package"])
