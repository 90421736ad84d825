"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import divergence, imatch, kmtree, langid, licenses, mixing, mixlm, neardup, packing, quality, tokencount, urlfilter, whitening
from waymark.llm.base import crc_mod, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, window=1024)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    crf = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), crf)


#: Host and path prefix, and what it means.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=75)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_mixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    return mixlm.score(docs, ~F.col("held_out"))


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, limit=512)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", F.round("host_rate", 6).alias("host_rate"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op12_kmtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_langid, op3_urlfilter, op4_imatch, op5_neardup, op6_mixing, op7_licenses, op8_mixlm, op9_tokencount, op10_quality, op11_divergence, op12_kmtree, op13_whitening)}


OP3_SQL = f"""
WITH r(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}),
parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM parts),
m AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/')))
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)"""


OP7_SQL = f"""
WITH known(id, sentence) AS (VALUES {", ".join(f"('{i}', '{t}')" for i, t in licenses.SENTENCES)}),
rules(license, ids) AS (VALUES {", ".join(f"('{n}', ' {' '.join(q)} ')" for n, q in licenses.RULES)}),
d AS (SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t]+', '\\1' || chr(10), 'g'), '[\n\r]'),
  lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS s FROM documents),
e AS (SELECT n, unnest(s) AS raw, generate_subscripts(s, 1) AS pos FROM d),
h AS (SELECT DISTINCT n, pos, id FROM (SELECT n, pos, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM e) x
  JOIN (SELECT sentence, min(id) AS id FROM known GROUP BY sentence) k USING (sentence)),
o AS (SELECT n, string_agg(id, ' ' ORDER BY pos) AS ids FROM h GROUP BY n),
l AS (SELECT n, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS c FROM (SELECT DISTINCT n, license FROM o JOIN rules ON contains(' ' || o.ids || ' ', rules.ids)) y GROUP BY n)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, CAST(coalesce(c, 0) AS BIGINT) AS n_licenses
FROM d LEFT JOIN o USING (n) LEFT JOIN l USING (n)"""


#: Near-duplicates by all shared shingles and the closure of their links.
OP5_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS root FROM both_ways UNION SELECT t.b, r.root FROM r JOIN both_ways t ON t.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

#: The counts by lists, the beta prior by moments.
OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w) x),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, i + unnest([0, 1, 2, 3, 4]) AS pos FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) y WHERE c > 1) z GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (SELECT w.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN l ON l.r = w.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count_if(base_failed) AS k, count_if(base_failed) / count(*) AS q FROM b GROUP BY source),
m AS (SELECT avg(q) AS m, var_pop(q) AS v, avg(1 / n) AS inv FROM h),
o AS (SELECT m, CASE WHEN m * (1 - m) > 0 THEN least(0.99, greatest(0.0001, (v / (m * (1 - m)) - inv) / (1 - inv + 0.000000001))) ELSE 0.0001 END AS rho FROM m),
t AS (SELECT source, n, (k + m * (1 / rho - 1)) / (n + 1 / rho - 1) AS rate, 1 / rho - 1 AS strength FROM h JOIN o ON true),
u AS (SELECT source, rate, rate - 2 * sqrt(rate * (1 - rate) / (n + strength + 1)) <= 0.5 AS host_ok FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, b.source, round(rate, 6) AS host_rate
FROM b JOIN u ON u.source IS NOT DISTINCT FROM b.source"""


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
t AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + (1000000000 * (x.n + 1)) // (s.n + v) AS p FROM x JOIN s ON s.lang = x.lang AND s.source = x.source JOIN t ON t.lang = x.lang),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 1)) // (t.n + v) AS q FROM k JOIN t ON t.lang = k.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source AND sums.item = h.source),
terms AS (SELECT p.lang, source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) y)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op3_urlfilter": OP3_SQL, "op5_neardup": OP5_SQL, "op7_licenses": OP7_SQL, "op10_quality": OP10_SQL, "op11_divergence": OP11_SQL}
