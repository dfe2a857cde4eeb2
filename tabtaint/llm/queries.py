"""Queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtaint.llm import (
    alignment,
    bpe,
    collocations,
    decontaminate,
    licenses,
    maxent,
    neardup,
    packing,
    pii,
    quality,
    substrings,
    tokenfiles,
    urls,
)
from tabtaint.llm.common import table


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "p_good")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.default_templates(spark))


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.default_rules(spark))


def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return alignment.alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_files": op3_token_files,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filter": op6_url_filter,
    "op8_maxent_scores": op8_maxent_scores,
    "op10_pii_pseudonyms": op10_pii_pseudonyms,
    "op4_license_scan": op4_license_scan,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op9_quality_votes": op9_quality_votes,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_collocations": op12_collocations,
    "op13_best_fit_packing": op13_best_fit_packing,
}

# ---- DuckDB twins: the contracts' definitions by brute force ------------------------------

_BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(x) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(u, v) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.u, t.v FROM reach r JOIN (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) t ON r.v = t.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

_OP4 = f"""
WITH t AS (
  SELECT template, {_ALNUM_WORDS.format(_LOWER)} AS w
  FROM (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted(licenses.TEMPLATES.items()))}) x(template, text)),
ts AS (
  SELECT template, len(s) AS m, CAST(2 * pow(2, ceil(log2(len(s)))) AS BIGINT) AS size, unnest(s) AS x
  FROM (SELECT template, list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS s FROM t)),
d AS (SELECT doc_id, {_ALNUM_WORDS.format(_LOWER)} AS w FROM documents),
ds AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
h AS (
  SELECT doc_id, template, m, size, x, pos // (size // 2) AS g FROM ds JOIN ts USING (x)
  UNION
  SELECT doc_id, template, m, size, x, pos // (size // 2) - 1 FROM ds JOIN ts USING (x) WHERE pos // (size // 2) > 0),
f AS (SELECT doc_id, template, g, count(DISTINCT x) / any_value(m) AS c FROM h GROUP BY ALL HAVING c >= 0.75),
r AS (
  SELECT doc_id, count(DISTINCT template) AS n, string_agg(DISTINCT template, ',' ORDER BY template) AS l, max(c) AS c
  FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_licenses, coalesce(l, '') AS licenses, coalesce(c, 0.0) AS best_containment
FROM d LEFT JOIN r USING (doc_id)
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i
        FROM (SELECT doc_id, [md5(array_to_string(w[i:i + 19], ' ')) for i in range(1, len(w) - 18)] AS s FROM d WHERE len(w) >= 20))),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM p WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP6 = f"""
WITH u AS (
  SELECT page_id, strpos(coalesce(url, ''), '://') AS place, substr(coalesce(url, ''), place + 3) AS rest FROM pages),
v AS (
  SELECT page_id,
    CASE WHEN place = 0 THEN '' ELSE translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN place = 0 THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path FROM u),
r AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p
  FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in urls.RULES)}) x(rule, verdict)),
m AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM v JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT v.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM v LEFT JOIN m USING (page_id)
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS.format(_LOWER)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM_WORDS.format(_LOWER)} AS w FROM benchmark),
iw AS (
  SELECT item, least(len(w), 10) AS size, array_to_string(w[k:k + 9], ' ') AS x
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS x
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d JOIN sizes ON len(w) >= size)),
f AS (SELECT doc_id, size, k, item FROM dw JOIN iw USING (size, x)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS k FROM f) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP12 = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w JOIN (VALUES (1), (2), (3)) s(k) ON len(w) >= k),
f AS (
  SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM g)
  GROUP BY ALL),
t AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
u AS (
  SELECT lang, phrase, a, i, array_to_string(w[:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (
  SELECT u.lang, u.phrase, a, i, fx.f AS l, fy.f AS r,
         CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(fx.f AS HUGEINT) * fy.f) AS BIGINT) AS score
  FROM u JOIN f fx ON fx.lang = u.lang AND fx.phrase = x JOIN f fy ON fy.lang = u.lang AND fy.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
h AS (
  SELECT lang, phrase, max(a) AS a
  FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE h.a IS NULL OR 100 * h.a < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, score
FROM k JOIN t USING (lang) QUALIFY rank <= 2000
"""

#: The others are not expressible in SQL and are tested against brute force in tests/llm.
ORACLE = {
    "op2_minhash_near_dedup": _OP2,
    "op4_license_scan": _OP4,
    "op5_substring_dedup": _OP5,
    "op6_url_filter": _OP6,
    "op7_benchmark_decontamination": _OP7,
    "op12_collocations": _OP12,
}
