"""The queries op1_ to op13_ over the tables of documents, benchmark, pages and embeddings, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.llm import decontaminate, exact_dedup, hard_negatives, hmm, html_text, language, licenses, line_dedup, packing, phrases, quality, simhash, token_counts


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_read(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(_read(spark, sf_dir, "documents"))


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hmm_scores, op2_decontamination, op3_retrieval_packing, op4_token_attribution, op5_license_scan, op6_language_id, op7_simhash_dedup,
        op8_host_quality, op9_line_dedup, op10_main_text, op11_exact_dedup, op12_hard_negatives, op13_phrases,
    )
}

# SQL for DuckDB.

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(coalesce(" + _LOWER + ", ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_TOKENS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM items, unnest(range(1, len(w) - n + 2)) AS t(i)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT DISTINCT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win USING (n, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN found USING (r)
"""


def _op5_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = [f"({rule}, {priority}, {sure}, {quote(word)}, {quote(f'^(?:{pattern})( |$)')}, {quote(label)}, false)" for rule, priority, sure, word, pattern, label in licenses.signature_rules()]
    rules += [f"({10_000 + i}, 0, 100, {quote(phrase.split(' ')[0])}, {quote(f'^(?:{phrase})( |$)')}, {quote(label)}, true)" for i, (phrase, label) in enumerate(licenses.BASE)]
    worst = max(x[1] for x in licenses.signature_rules())
    return f"""
WITH rules(rule, priority, sure, keyword, pattern, label, base) AS (VALUES {", ".join(rules)}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
places AS (SELECT r, i - 1 AS s, w[i] AS keyword, array_to_string(w[i:i + {licenses.HORIZON - 1}], ' ') AS near FROM d, unnest(range(1, len(w) + 1)) AS t(i) WHERE w[i] IN (SELECT keyword FROM rules)),
tried AS (SELECT r, s, rule, priority, sure, label, base, rtrim(regexp_extract(near, pattern, 0), ' ') AS m FROM places JOIN rules USING (keyword)),
found AS (SELECT r, s, s + len(string_split(m, ' ')) AS e, rule, priority, sure, label, base FROM tried WHERE m <> ''),
lost AS (SELECT DISTINCT a.r, a.s, a.e, a.rule FROM found a JOIN found b ON a.r = b.r AND NOT a.base AND NOT b.base AND (b.priority < a.priority AND b.s < a.e AND b.e > a.s
  OR b.priority <= a.priority AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e OR b.priority < a.priority OR b.rule < a.rule))),
stay AS (SELECT found.r, found.s, sure, label, base FROM found ANTI JOIN lost ON lost.r = found.r AND lost.s = found.s AND lost.e = found.e AND lost.rule = found.rule),
per AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) / 100.0::DOUBLE AS score FROM stay GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score
FROM d LEFT JOIN per USING (r)
"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_TOKENS.format("text")} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS win FROM d, unnest(range(1, len(w) - 3)) AS t(i) WHERE len(w) >= 5),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM again, unnest(range(i, i + 5)) AS t(p) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) - count(DISTINCT line) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n FROM lines GROUP BY r),
m AS (SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(dup.n AS BIGINT) AS n_dup_lines, n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN dup USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.5 * n_lines AS rule_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (rule_failed) AS failed, count(*) FILTER (rule_failed) / count(*)::DOUBLE AS rate FROM f GROUP BY source),
a AS (SELECT count(*) AS k, avg(rate) AS mean, var_samp(rate) AS v, avg(1.0::DOUBLE / n) AS inv FROM h),
s AS (SELECT k, mean, mean * (1 - mean) AS lim, v - mean * (1 - mean) * inv AS spread FROM a),
size AS (SELECT k, mean, lim, CASE WHEN spread <= 0 THEN 1000 ELSE greatest(1, lim / spread - 1) END AS size FROM s),
prior AS (SELECT CASE WHEN k > 1 AND lim > 0 THEN mean * size ELSE {quality.PRIOR[0]} END AS alpha, CASE WHEN k > 1 AND lim > 0 THEN (1 - mean) * size ELSE {quality.PRIOR[1]} END AS beta FROM size)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (SELECT (h.failed + alpha) / (h.n + alpha + beta) FROM prior) <= 0.8 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, {_LOWER.format(f"trim(ls[i], {_WHITE})")} AS key FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT l.*, owner IS NOT NULL AND owner IS DISTINCT FROM doc_id AS gone FROM l LEFT JOIN o USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents),
t AS (SELECT *, row_number() OVER w AS turn, first_value(doc_id) OVER w AS keep_id FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST, r))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY h) AS group_size, turn = 1 AS kept, h AS text_sha256 FROM t
"""

OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

OP13_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
w AS (SELECT r, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM w, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i) WHERE k <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score, j FROM c, unnest(range(1, c.k)) AS t(j)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ') JOIN n ON n.lang = c.lang),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM c, unnest(range(2, c.k)) AS t(m), unnest(range(1, c.k - m + 2)) AS s(i)),
top AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM part WHERE part.lang = low.lang AND part.phrase = low.phrase AND 100 * part.a >= 100 * low.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM top
QUALIFY rank <= 2000
"""

ORACLES = {"op11_exact_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_phrases": OP13_SQL, "op2_decontamination": OP2_SQL, "op5_license_scan": _op5_sql(), "op8_host_quality": OP8_SQL, "op9_line_dedup": OP9_SQL}
