"""The queries of this package and, where SQL can say it, the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, arrowseq, decontaminate, jaccard, langid, mixing, pii, sharding, urlfilter, warc
from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH d AS (SELECT doc_id AS id, {WORDS} AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS id, {WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d), bw AS (SELECT id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM b),
hit AS (SELECT dw.id AS doc_id, bw.id AS item_id, dw.i - bw.j AS shift FROM dw JOIN bw USING (w) GROUP BY ALL HAVING count(*) * {decontaminate.WINDOW_WORDS} >= {decontaminate.MIN_MATCHES} * least({decontaminate.WINDOW_WORDS}, any_value(n))),
laid AS (SELECT doc_id, item_id, list_transform(range(len(b.ws)), lambda j: CASE WHEN shift + j >= 0 AND d.ws[shift + j + 1] = b.ws[j + 1] THEN 1 ELSE 0 END) AS same,
         least({decontaminate.WINDOW_WORDS}, len(b.ws)) AS w FROM hit JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
best AS (SELECT doc_id, item_id, w, list_sum(same) AS total, list_max(list_transform(range(len(same) - w + 1), lambda i: list_sum(same[i + 1 : i + w]))) AS best FROM laid)
SELECT doc_id, item_id, max(best)::INTEGER AS window_matches, max(total)::INTEGER AS overlap_words
FROM best WHERE best * {decontaminate.WINDOW_WORDS} >= {decontaminate.MIN_MATCHES} * w GROUP BY doc_id, item_id
""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query(f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {jaccard.NGRAM} THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(len(ws) - {jaccard.NGRAM - 1}), lambda i: array_to_string(ws[i + 1 : i + {jaccard.NGRAM}], ' ')) END)) AS grams FROM w WHERE len(ws) > 0),
r AS (SELECT grams, row_number() OVER (ORDER BY min(doc_id), grams) AS rep, min(doc_id) AS least, count(*) AS copies, len(grams) AS n FROM s GROUP BY grams),
g AS (SELECT rep, n, copies, unnest(grams) AS gram FROM r),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS common, any_value(x.n) AS nx, any_value(y.n) AS ny, any_value(y.copies) AS copies FROM g x JOIN g y ON x.gram = y.gram AND x.rep <> y.rep GROUP BY 1, 2),
e AS (SELECT a, b, copies FROM p WHERE common::DOUBLE / (nx + ny - common) >= {jaccard.THRESHOLD}),
c(rep, root) AS (SELECT rep, rep FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.rep AND e.b > c.root),
k AS (SELECT rep, min(root) AS root FROM c GROUP BY rep),
l AS (SELECT a, sum(copies) AS links FROM e GROUP BY a),
m AS (SELECT k.root, min(r.least) AS class_id FROM k JOIN r USING (rep) GROUP BY k.root)
SELECT s.doc_id, m.class_id, (r.copies - 1 + coalesce(l.links, 0))::BIGINT AS links FROM s JOIN r USING (grams) JOIN k USING (rep) JOIN m USING (root) LEFT JOIN l ON l.a = r.rep
""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document with its class and its number of links."""
    return jaccard.jaccard_groups(load(spark, sf_dir, "documents"))


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


@query(f"""
WITH RECURSIVE n AS (SELECT unnest([{sharding.SHARDS}, {sharding.MORE}]) AS n),
k AS (SELECT doc_id, n, ('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::UHUGEINT AS key, 0::DOUBLE AS pos FROM documents, n
      UNION ALL SELECT * FROM (SELECT doc_id, n, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next,
          floor((pos + 1) * (2147483648.0::DOUBLE / ((((key * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))) AS a FROM k) WHERE a < n),
s AS (SELECT doc_id, max(pos) FILTER (n = {sharding.SHARDS})::INTEGER AS shard, max(pos) FILTER (n = {sharding.MORE})::INTEGER AS new_shard FROM k GROUP BY doc_id)
SELECT d.*, s.shard, s.new_shard, s.shard <> s.new_shard AS moved FROM documents d JOIN s USING (doc_id)
""")
def op7_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.reshard(load(spark, sf_dir, "documents"), "doc_id")


@query()
def op8_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrowseq.sequences(load(spark, sf_dir, "documents"))


@query(f"""
WITH t AS (SELECT coalesce(source, '') AS source, doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS n,
      ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 15))::BIGINT AS key FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
laid AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY key, doc_id, n ROWS UNBOUNDED PRECEDING))::BIGINT - n AS start FROM t WHERE n > 0),
cut AS (SELECT *, unnest(range(start // {mixing.BLOCK_TOKENS}, (start + n - 1) // {mixing.BLOCK_TOKENS} + 1)) AS block FROM laid),
src AS (SELECT source, sum(n)::BIGINT AS tokens, ceil(sum(n) / {mixing.BLOCK_TOKENS})::BIGINT AS blocks, greatest(1, floor(sqrt(sum(n)::DOUBLE) * sqrt(sqrt(sum(n)::DOUBLE))))::HUGEINT AS w FROM laid GROUP BY source),
cum AS (SELECT *, sum(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING)::HUGEINT AS c, sum(w) OVER ()::HUGEINT AS total FROM src),
share AS (SELECT *, c * {mixing.ONE} // total AS hi, (c - w) * {mixing.ONE} // total AS lo FROM cum),
slots AS (SELECT unnest(range((SELECT ceil(max(blocks * total / w) * 1.1)::BIGINT + 1000 FROM share))) AS slot),
ranked AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN share ON slot * {mixing.GOLDEN} % {mixing.ONE} >= lo AND slot * {mixing.GOLDEN} % {mixing.ONE} < hi),
plan AS (SELECT * FROM ranked WHERE slot <= (SELECT max(slot) FROM ranked WHERE rank = blocks - 1))
SELECT slot, source, rank // blocks AS epoch, block, start + greatest(0, block * {mixing.BLOCK_TOKENS} - start) - block * {mixing.BLOCK_TOKENS} AS "offset",
       doc_id, greatest(0, block * {mixing.BLOCK_TOKENS} - start) AS token_from, least(n, (block + 1) * {mixing.BLOCK_TOKENS} - start) AS token_to
FROM plan JOIN cut USING (source) WHERE rank % blocks = block
""")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


@query(f"""
WITH h AS (SELECT page_id, url, coalesce(hex(encode(html)), '') AS h FROM pages),
c AS (SELECT *, length(h) // 2 AS n, unnest(range(greatest(1, ceil(length(h) / 2 / {warc.CHUNK})::BIGINT))) AS k FROM h)
SELECT '<urn:page:' || coalesce(page_id::VARCHAR, '') || '>' AS record_id, page_id, 'resource' AS warc_type, url AS target_uri, k::INTEGER AS chunk_no,
       k * {warc.CHUNK} AS "offset", least({warc.CHUNK}, n - k * {warc.CHUNK})::INTEGER AS length, unhex(substr(h, k * {2 * warc.CHUNK} + 1, {2 * warc.CHUNK})) AS payload,
       sha256(unhex(substr(h, 1, (k + 1) * {2 * warc.CHUNK}))) AS digest, (k + 1) * {warc.CHUNK} >= n AS is_last,
       CASE WHEN (k + 1) * {warc.CHUNK} >= n THEN true END AS digest_ok, NULL::VARCHAR AS error FROM c
""")
def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives the pages as WARC files and reads these as the chunk table."""
    chunks = warc.read_chunks(warc.archive(spark, load(spark, sf_dir, "pages")))
    page = F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(.*)>$', 1) AS BIGINT)")
    return chunks.withColumn("page_id", page).drop("path", "record_no")


@query()
def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(load(spark, sf_dir, "documents"), PII_KEY)


#: A key for tests and checks; in production it comes from a secret store.
PII_KEY = b"not a secret: replace me"
URL_RULES = [
    ("example.net", "block"), ("www.example.net", "allow"), ("example.net/en", "allow"), ("spam-farm.example.org", "block"), ("spam-farm.example.org/en", "allow"), ("cheap-pills.example.com", "block"),
    ("blog.example.com", "block"), ("example.org/de", "block"), ("example.org/es/1", "block"), ("thther.example.org", "allow"), ("example.com/fr", "block"), ("org", "allow"), ("therha.example.com/en", "block"), ("therha.example.com/en", "allow"),
]
_RULES = ", ".join(f"('{p}', '{a}')" for p, a in URL_RULES)
_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)"


@query(f"""
WITH r0(pattern, action) AS (VALUES {_RULES}),
r AS (SELECT pattern AS key, max(action) AS action, len(string_split(split_part(pattern, '/', 1), '.')) AS labels, len(string_split(pattern, '/')) - 1 AS segments FROM r0 GROUP BY pattern),
u AS (SELECT page_id, url, string_split(lower(trim(regexp_extract(url, '{_HOST}', 1), '. ')), '.') AS host, list_filter(string_split(regexp_extract(url, '{_HOST}', 2), '/'), lambda s: s <> '') AS path FROM pages),
k AS (SELECT *, unnest(range(1, len(host) + 1)) AS i FROM u), k2 AS (SELECT *, unnest(range(0, len(path) + 1)) AS j FROM k),
m AS (SELECT page_id, url, arg_max(struct_pack(a := action, k := r.key), i * 1000 + j) AS best FROM k2 JOIN r
      ON r.key = array_to_string(list_concat([array_to_string(host[len(host) - i + 1 :], '.')], path[1 : j]), '/') GROUP BY page_id, url)
SELECT p.page_id, p.url, coalesce(m.best.a, 'allow') AS url_action, m.best.k AS url_rule FROM pages p LEFT JOIN m ON m.page_id = p.page_id AND m.url = p.url
""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "pattern string, action string")
    return urlfilter.decide(load(spark, sf_dir, "pages").select("page_id", "url"), rules)


@query()
def op10_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50, against all rows."""
    return ann.neighbours(load(spark, sf_dir, "embeddings"), every=50)
