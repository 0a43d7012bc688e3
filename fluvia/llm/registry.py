"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import ann, audio, bpe, chat, collocations, line_dedup, packing, quality, reputation, sharding, simhash, time_partitions, warc
from fluvia.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_table(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("tensors", "segments")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return sharding.extendible_shards(docs, size=F.col("n_bytes"), max_bytes=SHARD_BYTES)


#: Small enough that buckets split on the smallest tables; a document that is larger has a shard of its own.
SHARD_BYTES = 64 << 10


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: (verdict, host, path): fixed values.
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document of its number: bad where its quality is 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return reputation.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def click_moment() -> F.Column:
    """ts, for some clicks moved back by whole days or to the Monday of its week, by the hash of their id."""
    ts, k = F.col("ts").cast("timestamp_ntz"), F.crc32(F.col("click_id").cast("string").cast("binary")) % 128
    back = ts - F.make_dt_interval(((k + 6) * (k + 6) * (k + 6)).cast("int"))
    monday = F.date_sub(F.to_date(ts), F.weekday(ts)).cast("timestamp_ntz")
    return F.when(k < 16, back).when(k > 111, monday).otherwise(ts)


def op13_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    old = F.col("arrived_at") < F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    return time_partitions.rewrite_by_time(clicks, moment=click_moment(), arrived=F.col("arrived_at"), ident=F.col("click_id"), old=old, limit=1 + clicks.count() // 500)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_ann": op2_ann,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_audio": op6_audio,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_url_reputation": op11_url_reputation,
    "op12_collocations": op12_collocations,
    "op13_time_partitions": op13_time_partitions,
}

ORACLES: dict[str, str] = {
    "op7_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, r, i, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
),
repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, coalesce(l.doc_id > p.first, false) AS gone FROM lines l LEFT JOIN repeated p ON l.key = p.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, r
""",
    "op9_sharding": f"""
WITH h AS (
    SELECT doc_id, strlen(text) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents
),
s AS (SELECT d, h >> (60 - d) AS prefix, CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS total FROM h, (SELECT CAST(range AS INTEGER) AS d FROM range(0, 41)) GROUP BY ALL),
p AS (SELECT h.*, s.*, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS rn FROM h, s WHERE h.h >> (60 - s.d) = s.prefix AND s.total <= {SHARD_BYTES})
SELECT doc_id, n_bytes, d AS shard_depth, prefix AS shard_prefix, 0 AS shard_page, total AS shard_bytes FROM p WHERE rn = 1
UNION ALL SELECT doc_id, n_bytes, 60, h, 1, n_bytes FROM h WHERE n_bytes > {SHARD_BYTES}
""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (
    SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST('0x' || substr(sha, CAST(1 + 5 * (k // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
    FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
""",
    "op11_url_reputation": f"""
WITH p AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
u AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM p
),
o AS (SELECT doc_id, count(*) AS n, sum(1 - quality) AS k FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (
    SELECT host, CASE WHEN compound THEN regexp_extract(host, '(?:[^.]*[.])?(?:[^.]*[.])?[^.]*$', 0) ELSE two END AS domain,
           CASE WHEN compound THEN two ELSE regexp_extract(host, '[^.]*$', 0) END AS suffix, n, k
    FROM (
        SELECT host, regexp_extract(host, '(?:[^.]*[.])?[^.]*$', 0) AS two, two IN {reputation.COMPOUND} AS compound,
               CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(k), 0) AS DOUBLE) AS k
        FROM u LEFT JOIN o ON o.doc_id = u.page_id GROUP BY host
    )
),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY suffix),
s1 AS (SELECT coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {reputation.MOST_RHO}) AS rho FROM s0),
s2 AS (SELECT suffix, (k + w * m) / (n + w) AS m FROM s0, (SELECT 1 / least({reputation.MOST_RHO}, greatest({reputation.LEAST_RHO}, rho)) - 1 AS w FROM s1)),
d0 AS (SELECT h.domain, sum(n) AS n, sum(k) AS k, any_value(s2.m) AS m FROM h JOIN s2 USING (suffix) GROUP BY h.domain),
d1 AS (SELECT coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {reputation.MOST_RHO}) AS rho FROM d0),
d2 AS (SELECT domain, (k + w * m) / (n + w) AS m FROM d0, (SELECT 1 / least({reputation.MOST_RHO}, greatest({reputation.LEAST_RHO}, rho)) - 1 AS w FROM d1)),
h0 AS (SELECT host, n, k, d2.m FROM h JOIN d2 USING (domain)),
h1 AS (SELECT coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {reputation.MOST_RHO}) AS rho FROM h0),
h2 AS (SELECT host, k + w * m AS a, n - k + w * (1 - m) AS b FROM h0, (SELECT 1 / least({reputation.MOST_RHO}, greatest({reputation.LEAST_RHO}, rho)) - 1 AS w FROM h1)),
h3 AS (SELECT host, a / (a + b) - {reputation.DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {reputation.LIMIT} AS bad FROM h2),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, host, path)),
f AS (
    SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL
)
SELECT page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN h3.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN h3 ON u.host = h3.host LEFT JOIN f ON f.host = u.host AND f.path = u.path
""",
    "op12_collocations": r"""
WITH p AS (
    SELECT lang, row_number() OVER () AS piece_id, piece
    FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
),
w AS (SELECT lang, piece_id, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p)),
g AS (SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY piece_id ORDER BY i)),
f AS (
    SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a FROM g GROUP BY ALL
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
x AS (
    SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM c JOIN (VALUES (1), (2)) v(j) ON j < c.k
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (
    SELECT lang, phrase, max(a) AS a
    FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3)
    GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank, b.phrase, b.a, l, r, n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2
WHERE i.a IS NULL OR 100 * i.a < 50 * b.a
QUALIFY rank <= 2000
""",
}
