"""The queries of this subpackage, each an operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bpe, embedding_dedup, importance_sample, license_scans, mixing, ngram_join, quality_classifier, quality_rules, ranked_search, secret_scans, token_counts, url_filters, warc
from lodestack.llm.common import stored

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host, path and verdict of the url rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024).drop("text")


def byte_bpe(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    both = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).drop("text")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).drop("text")


def scanned(docs: DataFrame, keep_text: bool) -> DataFrame:
    """A document's owner is its source, its repository that source's part in its language."""
    return secret_scans.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"), keep_text=keep_text)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scanned(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), keep_text=False)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return docs.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scans.written(F.col("base")), 256).alias("base_sha256"),
        secret_scans.written(F.col("spans")).alias("spans"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, trees).drop("text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Words are counted once, into a narrow table.
    sizes = stored(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size")), "document-sizes")
    mixed = stored(mixing.mix(sizes).withColumn("row", F.monotonically_increasing_id()), "mixed")
    order = mixing.ranked(mixing.training_order(mixed.select("row", "positions"), sizes.count()))
    places = order.groupBy("row").agg(F.min("position").alias("first_position"), F.min("place").alias("first_place"))
    return mixed.join(places, "row", "left").select("doc_id", "size", "source_size", "target", "taken", "first_position", "first_place")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scans": op4_secret_scans,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_license_scans": op11_license_scans,
    "op12_ranked_search": op12_ranked_search,
    "op13_importance_sample": op13_importance_sample,
}

URL_SQL = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT b.*, h || p AS rule, v FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(v, length(rule)), 'allow') AS verdict
FROM f GROUP BY page_id, host, path"""

WARC_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to, true AS intact
FROM d"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JOIN_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)"""

SEARCH_SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len))))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

# A byte's CRC is eight shifts of it; the table of all 256 is worked out first, then a feature's bytes go through it.
SAMPLE_SQL = f"""
WITH k AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
x AS (SELECT doc_id AS id, 'd' AS side, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents UNION ALL SELECT item_id, 't', regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) AS f FROM x),
h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM h, k),
u AS (SELECT id, side, b, count(*) AS n FROM f JOIN b USING (f) GROUP BY 1, 2, 3),
m AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM u GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (S_ + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (T_ + 10000)::DOUBLE)))::BIGINT AS g FROM m, (SELECT sum(s) AS S_, sum(t) AS T_ FROM m)),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM u JOIN g USING (b) WHERE side = 'd' GROUP BY id),
e AS (SELECT x.id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || x.id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x LEFT JOIN d ON d.id = x.id WHERE side = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS many FROM e WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * many // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": URL_SQL, "op5_embedding_dedup": EMBEDDING_SQL, "op7_warc": WARC_SQL, "op10_ngram_join": JOIN_SQL, "op12_ranked_search": SEARCH_SQL, "op13_importance_sample": SAMPLE_SQL,
}
