"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, classifier, decontam, lm, minhash, negatives, quality, secrets, sharding, substring, toxicity, urls, variants

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    """The public tokenizer file that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return minhash.near_duplicates(docs, width=4, percent=80).drop("row_key")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal(_documents(spark, sf_dir).select("doc_id", "text"), width=35).drop("spans")


#: verdict, host and path of each rule
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: sites whose addresses the list holds, for every language and number
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")
LISTED_LANGS = ("de", "en", "es", "fr")
LISTED_NUMBERS = 20_000


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of every number of the listed sites, as far as pages can tell: the first ones and all that occur there.

    Numbers are digits without a leading zero, of any length.
    """
    spark, langs = pages.sparkSession, "|".join(LISTED_LANGS)
    seen = pages.select(F.explode(F.regexp_extract_all(F.col("url").cast("string"), F.lit(f"/(?:{langs})/(0|[1-9][0-9]*)"), F.lit(1))).alias("number"))
    numbers = spark.range(LISTED_NUMBERS).select(F.col("id").cast("string").alias("number")).union(seen).distinct()
    sites = numbers.select(F.explode(F.array(*map(F.lit, LISTED_HOSTS))).alias("host"), "number")
    parts = sites.select("host", F.explode(F.array(*map(F.lit, LISTED_LANGS))).alias("lang"), "number")
    return parts.select(F.concat(F.lit("http://"), "host", F.lit("/"), "lang", F.lit("/"), "number").alias("url"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES, listed_urls(pages))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "text")
    return quality.quality(docs).drop("row_key")


def _fold(modulus: int) -> Column:
    """crc32 of doc_id as text (null: empty), modulo a number."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")), F.lit(modulus))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    scored = lm.score_texts(docs, _fold(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "train_types")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classifier.score_quality(docs, labels, _fold(5) != 0)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, items, max_words=10).drop("spans")


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return sharding.shard_rows(docs, shards=16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "number")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, tokenizer(), ids=False).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, labels, _fold(5) != 0)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0, id_col="vec_id", v_col="embedding")


def op12_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_documents(spark, sf_dir).select("doc_id", "text"))
    base = ("assign", "access", "hex")
    counts = [F.size(secrets.of_kinds(F.col("found"), (k,))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.digest(secrets.of_kinds(F.col("found"), base)).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("found")).alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_documents(spark, sf_dir).select("doc_id", "text"), slips=199)


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_feistel_sharding": op8_feistel_sharding,
    "op9_bpe": op9_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secret_ledger": op12_secret_ledger,
    "op13_spelling_variants": op13_spelling_variants,
}

#: SQL of every match of each rule in every distinct text: (text, kind, place, start, stop)
_SPANS = " UNION ALL ".join(
    f"""SELECT text, '{r.kind}' AS kind, {i} AS place, list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(m) for m in whole[1:i - 1]]), 0) AS start, length(whole[i]) AS size
FROM (SELECT text, gaps, whole, part, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT text, regexp_split_to_array(text, p) AS gaps, regexp_extract_all(text, p) AS whole, regexp_extract_all(text, p, {r.group}) AS part
FROM t, (SELECT '{r.pattern.replace("'", "''")}' AS p)) WHERE len(whole) > 0) WHERE length(part[i]) >= {r.least}"""
    for i, r in enumerate(secrets.RULES)
)


_LISTED = " UNION ALL ".join(f"SELECT '{h}/{lang}/' || i AS form FROM range({LISTED_NUMBERS}) t(i)" for h in LISTED_HOSTS for lang in LISTED_LANGS)
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_QUERY_PARTS = "list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'), lambda x: x <> '' AND NOT list_contains([" + ", ".join(f"'{t}'" for t in urls.TRACKING) + "], string_split(x, '=')[1])))"

#: unsigned CRC-32 of the bytes in a list of integers, with the table of its 256 steps made by rule
_CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM (SELECT unnest(range(256))::BIGINT AS i)"
_BYTES = "[(list_position(hexes, substr(hex(x), k, 2)) - 1)::BIGINT for k in range(1, 2 * octet_length(encode(x)), 2)]"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS k FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, w.doc_id = min(c) AS kept FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op2_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM w, unnest(range(1, len(ws) - 33)) t(i)),
hit AS (SELECT DISTINCT doc_id, i + o AS spot FROM p JOIN (SELECT k FROM p GROUP BY k HAVING count(*) > 1) USING (k), range(35) t(o)),
one AS (SELECT w.doc_id, i, ws[i] AS word, spot IS NULL AS kept FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) w LEFT JOIN hit ON hit.doc_id = w.doc_id AND spot = i)
SELECT w.doc_id, any_value(len(ws))::BIGINT AS n_words, count(*) FILTER (WHERE kept = false) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE kept), '')) AS kept_sha256
FROM w LEFT JOIN one ON one.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op3_url_filter": f"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, {_QUERY_PARTS} AS q FROM pages),
c AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)$', ''), '^(www|m)\\.|\\.$', '', 'g')
|| regexp_replace(regexp_replace(path, '/index\\.[a-z]+$|\\.html?$', ''), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical FROM p),
r(verdict, h, b) AS (VALUES {_RULES}), l AS ({_LISTED}),
m AS (SELECT page_id, url, host, path, canonical, arg_max(r.h || r.b, length(r.h || r.b)) AS rule, arg_max(r.verdict, length(r.h || r.b)) AS v FROM c LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.b) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN form IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, canonical, form IS NOT NULL AS listed FROM m LEFT JOIN l ON form = canonical""",
    "op7_decontamination": """
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
k AS (SELECT item_id, least(10, len(ws)) AS n, array_to_string(ws[x:x + least(10, len(ws)) - 1], ' ') AS w FROM i, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) t(x) WHERE len(ws) > 0),
f AS (SELECT doc_id, x, n, item_id FROM (SELECT doc_id, x, n, array_to_string(ws[x:x + n - 1], ' ') AS w FROM d, (SELECT DISTINCT n FROM k) s, unnest(range(1, len(ws) - n + 2)) t(x)) JOIN k USING (n, w)),
h AS (SELECT doc_id, count(DISTINCT x + o) AS n_hit FROM f, range(10) t(o) WHERE o < n GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM f) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5""",
    "op12_secret_ledger": f"""
WITH t AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents), m AS ({_SPANS}),
s AS (SELECT text, kind, place, start::BIGINT AS start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM m),
g AS (SELECT text, count(*) FILTER (WHERE place = 0) AS a, count(*) FILTER (WHERE place = 1) AS b, count(*) FILTER (WHERE place = 2) AS c, string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM s GROUP BY text)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON g.text = coalesce(d.text, '')""",
    "op13_spelling_variants": f"""
WITH RECURSIVE c AS ({_CRC_TABLE}), hx AS (SELECT list(printf('%02X', i) ORDER BY i) AS hexes FROM (SELECT unnest(range(256)) AS i)),
r AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT doc_id, run, times, list_reduce(list_prepend(4294967295, {_BYTES}), lambda a, v: xor(a >> 8, steps[(xor(a, v) & 255) + 1])) AS s FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS x FROM r), c, hx),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM (SELECT *, xor(s, 4294967295) AS h FROM b)),
w AS (SELECT word, sum(times)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
d AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS cut FROM w, unnest(range(length(word))) t(i)),
m AS (SELECT DISTINCT word, n, substr(word, 1, i) || chr(1) || substr(word, i + 2) AS hole FROM w, unnest(range(length(word))) t(i)),
p AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM m x JOIN m y ON x.hole = y.hole AND x.word <> y.word
UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON w.word = d.cut UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.cut),
o AS (SELECT word, n, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, encode(near))) AS best FROM p GROUP BY ALL),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * w.n THEN best END AS form, CASE WHEN top >= 5 * w.n THEN top END::BIGINT AS form_n FROM w LEFT JOIN o ON o.word = w.word),
l AS (SELECT word, word AS spot, 0 AS step FROM f UNION ALL SELECT l.word, f.form, step + 1 FROM l JOIN f ON f.word = l.spot WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(spot, step) AS root FROM l GROUP BY word) z ON z.word = f.word""",
}
