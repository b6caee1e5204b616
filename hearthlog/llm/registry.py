"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_copies, html_extract, image_copies, mixing, periodic_runs, quality, simhash_dedup, spelling, substring_dedup, token_output, url_filter, warc
from .common import WORD, fresh_path, table

#: Rules of the url query, as the contract states them: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its class: links inside a class are not counted, for a mass of copies is not compared pair by pair."""
    return image_copies.find_copies(image_copies.page_features(table(spark, sf_dir, "pages"))).select(F.col("id").alias("page_id"), "class_id")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_output.token_digests(spark, path)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: in every tenth document (by a hash of the id) all words from some place on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, w = F.floor(h / 10), F.regexp_extract_all("text", F.lit(WORD), 0)
    n = F.size("w")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    turned = F.transform("w", lambda x, i: F.when(i < a, x).otherwise(F.get("w", (a + (i - a) % p).cast("int"))))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, w).alias("w"))
    return split.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return found.select(F.col("id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op12_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_copies.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def misspelt(doc_id: int | None, word: str) -> str:
    """One in 199 words of a document, by a hash, without one of its characters."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 199 else word[:at] + word[at + 1 :]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(table(spark, sf_dir, "documents"), change=misspelt))


QUERIES = {f.__name__: f for f in (op1_quality, op2_substring_dedup, op3_url_filter, op4_simhash_dedup, op5_decontaminate, op6_mixing, op7_warc, op8_image_copies, op9_token_output, op10_html_extract, op11_periodic_runs, op12_embedding_copies, op13_spelling_variants)}

_WORD = WORD
#: CRC-32 of a list of bytes, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

ORACLES = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS s FROM d WHERE len(ws) >= 20)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM dup),
words AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_url_filter": """
WITH rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
hit AS (SELECT page_id, arg_max(rhost || rpath, len(rhost || rpath)) AS rule, arg_max(verdict, len(rhost || rpath)) AS verdict
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, 'allow') AS verdict FROM p LEFT JOIN hit USING (page_id)""",
    "op6_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':42'), 1, 15) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS most, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(most) OVER a, 0) AS held, (SELECT sum(w) FROM s) - coalesce(sum(w) OVER a, 0) AS free FROM s
      WINDOW a AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - held) / free AS level, most / w AS r FROM o),
t AS (SELECT source, source_size, least(w * (SELECT arg_min(level, r) FROM l WHERE level < r), most) AS target FROM s),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, round(target)::BIGINT AS aim FROM t),
g AS (SELECT d.*, f.source_size, f.target, f.whole, f.aim - f.whole * f.source_size AS rest FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto, sum(size) OVER (PARTITION BY source, u) AS tied FROM g)
SELECT doc_id, size, source_size, target,
       (whole * size + CASE WHEN upto <= rest THEN size WHEN upto - tied < rest THEN (size * (rest - upto + tied)) // tied ELSE 0 END)::BIGINT AS taken FROM c""",
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS last FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, i * 5 + 1, 5))::INT >> k) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m""",
    "op11_periodic_runs": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws, {_CRC.format("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)")} AS h FROM documents),
k AS (SELECT doc_id, h, ws, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM d),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END) + 1]) ELSE ws END AS ws FROM k),
gram AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + 5], ' ') AS t FROM (SELECT *, unnest(range(n - 4)) AS i FROM w WHERE n >= 6)),
far AS (SELECT DISTINCT a.doc_id, b.i - a.i AS q FROM gram a JOIN gram b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
eq AS (SELECT doc_id, q, unnest(list_filter(range(n - q), lambda i: ws[i + 1] = ws[i + q + 1])) AS i FROM far JOIN w USING (doc_id)),
isl AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM eq) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM isl GROUP BY doc_id, s, l),
best AS (SELECT doc_id, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(n)) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, exponent_milli::BIGINT AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_embedding_copies": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_aggregate(embedding, 'count') = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
r AS (SELECT a AS vec_id, min(b) AS component_id FROM c GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = r.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM r""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE f AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS word FROM documents) GROUP BY ALL),
h AS (SELECT word, k, {_CRC.format("flatten(list_transform(string_split(doc_id::VARCHAR || ':' || word, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END))")} AS h FROM f),
voc AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, k FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM voc)),
pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word UNION SELECT word, d FROM less SEMI JOIN (SELECT word AS d FROM voc) USING (d) UNION SELECT d, word FROM less SEMI JOIN (SELECT word AS d FROM voc) USING (d)),
best AS (SELECT a AS word, b AS form, n AS form_n, count(*) OVER (PARTITION BY a) AS n_near FROM pairs JOIN voc ON voc.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
known AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM voc LEFT JOIN best USING (word)),
way AS (SELECT word, word AS here, 0 AS steps FROM known UNION ALL SELECT way.word, known.form, steps + 1 FROM way JOIN known ON known.word = way.here WHERE known.form IS NOT NULL)
SELECT word, n, n_near, form, form_n, root FROM known JOIN (SELECT word, arg_max(here, steps) AS root FROM way GROUP BY word) USING (word)""",
}
