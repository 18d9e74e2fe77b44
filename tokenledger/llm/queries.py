"""The operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_langid import held_out, learn, predict

    docs = _documents(spark, sf_dir)
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_repair_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import read_shards, write_shards

    shards = write_shards(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))
    return read_shards(shards).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_lpf_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lpf_dedup import remove_spans, repeated_spans

    out = remove_spans(repeated_spans(_documents(spark, sf_dir), length=200, keep="none"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_documents(spark, sf_dir))


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_disclosure import KINDS, joined, spans

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    out = spans(_documents(spark, sf_dir))
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import score

    return score(_documents(spark, sf_dir))


def op7_pca_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pca_neardup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op8_spm_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from .spm_bpe import encode

    out = encode(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.tiktoken"), PATTERN, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_pack import pack

    out = pack(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superminhash import near_groups

    return near_groups(_documents(spark, sf_dir), percent=85)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs, replayed, strongest

    docs = _documents(spark, sf_dir).select("doc_id", replayed(F.col("text"), F.col("doc_id")).alias("text"))
    out = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_repair import damaged, repair

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damaged(rows))[0].withColumnRenamed("conv_id", "conv")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = every.join(found, every.conv_id.eqNullSafe(F.col("conv")), "left")
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_crf_language_id, op2_repair_token_file, op3_lpf_substring_dedup, op4_exact_dedup, op5_pii_disclosure, op6_context_mixing, op7_pca_near_vectors, op8_spm_byte_bpe, op9_hilbert_packing, op10_superminhash,
        op11_periodic_runs, op12_turn_repair, op13_multi_index,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The patterns as the contract has them, with the places that the split leaves between matches.
_SPANS = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
p(kind, name, pattern) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT row, kind, name, unnest(f) AS v, unnest(range(1, len(f) + 1)) AS i, f, string_split_regex(t, pattern) AS s FROM (SELECT row, t, kind, name, pattern, regexp_extract_all(t, pattern) AS f FROM d, p) WHERE len(f) > 0),
x AS (SELECT *, list_sum(list_transform(s[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda g: length(g))), 0) AS a, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM m),
base AS (SELECT row, kind, name, v, a::BIGINT AS a, (a + length(v))::BIGINT AS b FROM x WHERE CASE kind
  WHEN 1 THEN list_bool_and(list_transform(string_split(v, '.'), lambda g: length(ltrim(g, '0')) <= 3 AND coalesce(try_cast(ltrim(g, '0') AS INTEGER), 0) <= 255))
  WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INTEGER ELSE digits[i]::INTEGER * 2 - CASE WHEN digits[i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 3 THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
w AS (SELECT row, unnest(f) AS w, unnest(range(len(f))) AS i, unnest(list_transform(s[1:len(f)], lambda g: length(g))) AS gap FROM (SELECT row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS f, string_split_regex(t, '[^\x20\x09-\x0D]+') AS s FROM d) WHERE len(f) > 0),
term AS (SELECT row, regexp_replace(lower(w), '^[^\p{L}]+|[^\p{L}]+$', '', 'g') AS term, sum(gap + length(w)) OVER (PARTITION BY row ORDER BY i) AS b, length(w) AS n FROM w),
once AS (SELECT min(row) AS row FROM d GROUP BY t), total AS (SELECT count(*) AS n FROM once),
held AS (SELECT DISTINCT row, term FROM term JOIN once USING (row) WHERE term <> ''), by_term AS (SELECT term, count(*) AS n_term FROM held GROUP BY term HAVING count(*) >= 2),
entity AS (SELECT DISTINCT row, v AS entity FROM base JOIN once USING (row)), by_entity AS (SELECT entity, count(*) AS n_entity FROM entity GROUP BY entity HAVING count(*) >= 2),
both_ AS (SELECT entity, term, count(*) AS n_both FROM entity JOIN by_entity USING (entity) JOIN held USING (row) JOIN by_term USING (term) GROUP BY entity, term),
telling AS (SELECT DISTINCT term FROM both_ JOIN by_entity USING (entity) JOIN by_term USING (term), total
  WHERE n_both >= 2 AND n_entity < n AND log2(n_both * n::DOUBLE / (n_term * n_entity)) >= 0.9::DOUBLE * log2(n::DOUBLE / n_entity)),
extra AS (SELECT t.row, 4 AS kind, 'term' AS name, t.b - t.n AS a, t.b AS b FROM term t JOIN telling USING (term) WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.row = t.row AND s.a < t.b AND t.b - t.n < s.b)),
every AS (SELECT row, kind, name, a, b FROM base UNION ALL SELECT row, kind, name, a, b FROM extra),
j AS (SELECT row, coalesce(string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 4), '') AS base, string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
  count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone FROM every GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (row)
"""

_VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c(v, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.v),
r AS (SELECT v, min(root) AS root FROM c GROUP BY v)
SELECT vec_id, coalesce(n.n, 0) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN r ON r.v = vec_id LEFT JOIN n ON n.a = vec_id
"""

_SHINGLES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(""" + _LOWER + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT b.a, b.b FROM b JOIN n x ON x.doc_id = b.a JOIN n y ON y.doc_id = b.b WHERE 100 * b.n >= 85 * (x.n + y.n - b.n)),
c(v, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.v),
r AS (SELECT v, min(root) AS root FROM c GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept FROM documents d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: CRC-32 bit by bit, edits as audit strings: of each conversation's first i turns the cheapest audit for each last role, then the ASCII-least.
_TURNS = r"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS name FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT), lambda c, b: list_reduce(range(8), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS what FROM x),
r AS (SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE what WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE what <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(concat('=' || conv_id, chr(0), role, chr(0), text))) AS i, regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS inner_ FROM r),
f AS (SELECT *, CASE WHEN inner_ = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(inner_, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  i > 1 AND lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
l(conv_id, i, s, v) AS (SELECT conv_id, 0::BIGINT, '', {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} FROM k
  UNION ALL SELECT conv_id, i, s2, min({'c': c, 'a': a, 't': t}) FROM (
    SELECT conv_id, i, CASE e WHEN 'D' THEN s ELSE CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 's' ELSE up END END AS s2,
      c + CASE e WHEN 'D' THEN 3 ELSE CASE e WHEN 'R' THEN 2 ELSE 0 END + CASE fault WHEN 'truncated' THEN 1 ELSE 0 END END AS c, a || e AS a,
      CASE e WHEN 'D' THEN t WHEN 'K' THEN list_append(t, role || ':' || text) ELSE list_append(t, CASE up WHEN 'a' THEN 'assistant:' ELSE 'user:' END || text) END AS t
    FROM (SELECT *, CASE s WHEN 'u' THEN 'a' ELSE 'u' END AS up, unnest(['D', 'K', 'R']) AS e FROM (
      SELECT conv_id, i, role, text, fault, unnest([s0, s1, s2]) AS s, unnest([c, c + 2, c + 4]) AS c, unnest([a, a || 'I', a || 'II']) AS a, unnest([t, list_append(t, n1), list_append(list_append(t, n1), n2)]) AS t FROM (
        SELECT f.conv_id, f.i, role, text, fault, s AS s0, CASE s WHEN 'u' THEN 'a' ELSE 'u' END AS s1, CASE s WHEN 'u' THEN 'u' ELSE 'a' END AS s2, CASE s WHEN 'u' THEN 'assistant:' ELSE 'user:' END AS n1, CASE s WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS n2, v.c AS c, v.a AS a, v.t AS t
        FROM l JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i + 1)))
    WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR left(role, 1) = up OR left(role, 1) = 's' AND s = '')) GROUP BY conv_id, i, s2),
z AS (SELECT l.conv_id, min({'c': v.c + CASE s WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END, 'a': v.a || CASE s WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END, 't': list_concat(v.t, CASE s WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END)}) AS v
  FROM l JOIN k ON k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.n = l.i GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.v.c, 0) AS cost,
  coalesce(z.v.a, '') AS audit, sha256(coalesce(array_to_string(z.v.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: Products are added up from the first component to the last, as the operator does.
_NEAREST = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT q.vec_id AS query_id, e.vec_id, list_reduce(list_transform(range(1, len(e.e) + 1), lambda i: q.e[i] * e.e[i]), lambda a, b: a + b) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op13_multi_index": _NEAREST,
    "op12_turn_repair": _TURNS,
    "op5_pii_disclosure": _SPANS,
    "op7_pca_near_vectors": _VECTORS,
    "op10_superminhash": _SHINGLES,
    "op4_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""",
}
