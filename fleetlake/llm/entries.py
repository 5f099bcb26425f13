"""Queries over the test tables, one for each text operator, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm import chat, decontaminate, language_id, lexical, license_scan, lm_score, ngram_join, packing, pii, quality, resample, token_store, url_filter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    kind = F.array(*map(F.lit, pii.KINDS))

    def spelled(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def number_of(kind_no: int):
        return F.size(F.filter("base", lambda x: x["k"] == kind_no)).cast("long")

    counts = [number_of(i).alias(f"n_{name}") for i, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_quality(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def remainder(id_col: str, n: int):
    """crc32 of the id as text modulo n; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n)), F.lit(0))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = docs.where(remainder("doc_id", 3) != 1).select(F.col("doc_id").alias("key"), "text", "lang")
    out = language_id.identify(docs, language_id.fit_ppm(learn))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 10) != 0).alias("train"))
    out = lm_score.score_texts(docs)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_digests(token_store.write_store(_table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: A conversation whose texts hold marks of templates.
MARKED = r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    path = chat.write_examples(rows.unionByName(marked), chat.new_path(spark))
    return chat.digests(*chat.read_examples(spark, path))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_token_store": op10_token_store,
    "op11_ranked_search": op11_ranked_search,
    "op12_chat_format": op12_chat_format,
    "op13_importance_resampling": op13_importance_resampling,
}

_WORDS = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
lines AS (
  SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
used AS (
  SELECT doc_id, host, t, line, regexp_extract_all(line, '{_WORDS}') AS lw FROM lines
  WHERE regexp_matches(line, '{_WORDS}')),
norm AS (
  SELECT *, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
                      'abcdefghijklmnopqrstuvwxyz000000000') AS nl FROM used),
shared AS (SELECT host, nl FROM norm GROUP BY ALL HAVING count(DISTINCT doc_id) > 30),
cut AS (SELECT doc_id, sum(len(lw)) AS cut_words FROM norm JOIN shared USING (host, nl) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM used GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(coalesce(cut_words, 0) AS BIGINT) AS cut_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * (n_words - cut_words) < 30 * n_words AS kept
FROM m
"""

_OP4 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, b FROM reach JOIN both_ways ON a = r)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = documents.doc_id
"""

_OP8 = r"""
WITH r(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
p AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
h AS (
  SELECT page_id, host, path, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, rverdict = 'block' DESC) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM h WHERE k = 1
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_OP11 = rf"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS t FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS t FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM len),
tf AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * max(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY t),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // l))))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN len USING (doc_id), tot GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

_OP12 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) x(i)),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || head || ': ' || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""

_OP13 = r"""
WITH table_of AS (
  SELECT list(list_reduce(list_prepend(i, range(8)::UBIGINT[]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)::UBIGINT ORDER BY i) AS tbl FROM range(256) r(x), LATERAL (SELECT x::UBIGINT AS i)),
words AS (
  SELECT 's' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
counts AS (SELECT side, id, w, count(*) AS c FROM words GROUP BY ALL),
spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counts)),
crc AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS UBIGINT))),
                            lambda c, b: xor(c >> 8, tbl[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM spelled, table_of),
f AS (SELECT side, id, bucket, CAST(sum(c) AS BIGINT) AS c FROM counts JOIN crc USING (w) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(c) FILTER (side = 's'), 0) AS s, coalesce(sum(c) FILTER (side = 't'), 0) AS t FROM f GROUP BY bucket),
tot AS (SELECT sum(s) AS ss, sum(t) AS tt FROM b),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM b, tot),
x AS (SELECT id AS doc_id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * gain) AS BIGINT) AS total FROM f JOIN g USING (bucket) WHERE side = 's' GROUP BY id),
w AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS UBIGINT) AS h FROM documents LEFT JOIN x USING (doc_id)),
sc AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, 10 * count(*) OVER () // 100 AS most FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= most THEN CAST(k AS BIGINT) END AS rank FROM sc LEFT JOIN k USING (doc_id)
"""

ORACLES = {"op11_ranked_search": _OP11, "op12_chat_format": _OP12, "op13_importance_resampling": _OP13, "op3_quality_rules": _OP3, "op4_ngram_jaccard": _OP4, "op8_url_filter": _OP8}
