"""The queries of this subpackage and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, katz, lines, minhash, mixing, packing, quality, substrings, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLE["op1_url_filter"] = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
tails AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM tails)
SELECT page_id, host, path,
  (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT max_by(verdict, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts"""


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
g AS (SELECT h, count(*) AS n, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY h)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, d.h AS text_sha256 FROM d JOIN g ON d.h = g.h"""


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE["op4_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5.0, 2.0, 1.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap FROM s),
levels AS (SELECT source, w, cap, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER after AS weights FROM c
  WINDOW before AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT first(rest / weights ORDER BY cap / w, source) AS level FROM levels WHERE rest / weights <= cap / w),
t AS (SELECT source, source_size, CASE WHEN cap < w * level THEN CAST(cap AS DOUBLE) ELSE w * level END AS target,
  ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 5))::BIGINT AS u FROM c, v),
r AS (SELECT d.doc_id, d.size, t.*, CAST(floor(target / source_size * 1048576) AS BIGINT) AS step,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (((u + step * (k + 1)) >> 20) - ((u + step * k) >> 20)) * size AS taken, source,
  ((u + step * (k + 1)) >> 20) - ((u + step * k) >> 20) AS copies FROM r"""


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM r, range(20) AS offsets(o)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT x.doc_id, x.i, word, c.i IS NOT NULL AS gone FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON a.doc_id = w.doc_id"""


@query
def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(spark, table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("conv_id", "part", "speaker", "text", spans.alias("mask"), "n_turns", "n_own_turns")


ORACLE["op6_chat_rotation"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS k FROM conversations),
opened AS (SELECT conv_id, min(k) AS first_other FROM t WHERE role <> 'system' GROUP BY conv_id),
people AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
parts AS (SELECT DISTINCT conv_id, k // 256 AS part FROM t),
turns AS (SELECT conv_id, k // 256 AS part, k, role, body, true AS own_part FROM t
  UNION ALL SELECT t.conv_id, parts.part, k, role, body, false FROM t JOIN opened ON t.conv_id IS NOT DISTINCT FROM opened.conv_id
    JOIN parts ON t.conv_id IS NOT DISTINCT FROM parts.conv_id WHERE k < first_other AND k < 256 AND part > 0),
x AS (SELECT turns.conv_id, part, speaker, k, own_part, role = speaker AS own, body,
    CASE WHEN role = 'system' THEN '<|system|>' WHEN role = speaker THEN '<|assistant|>' ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' END || chr(10) AS head
  FROM turns JOIN people ON turns.conv_id IS NOT DISTINCT FROM people.conv_id),
y AS (SELECT *, head || body || '<|end|>' || chr(10) AS piece FROM x),
z AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, part, speaker ORDER BY k) - length(piece) + length(head) AS low FROM y)
SELECT conv_id, part, speaker, string_agg(piece, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(low AS BIGINT) || '-' || CAST(low + length(body) + 7 AS BIGINT), ',' ORDER BY k) FILTER (WHERE own), '') AS mask,
  count(*) FILTER (WHERE own_part) AS n_turns, count(*) FILTER (WHERE own) AS n_own_turns
FROM z GROUP BY conv_id, part, speaker"""


@query
def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE["op7_host_quality"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 4], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM h, range(5) AS offsets(o) WHERE n >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM b GROUP BY source),
p AS (SELECT avg(failed / n) AS mean, var_pop(failed / n) AS v, avg(1 / n) AS inv FROM s),
q AS (SELECT mean, mean * (1 - mean) AS spread, greatest(v - mean * (1 - mean) * inv, mean * (1 - mean) * 1e-6) AS between_hosts FROM p),
k AS (SELECT mean, CASE WHEN between_hosts > 0 THEN spread / between_hosts - 1 ELSE 1 END AS strength FROM q),
v AS (SELECT source, (failed + mean * strength) / (n + strength) <= 0.5 AS host_kept FROM s, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source"""


@query
def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(spark, table(spark, sf_dir, "documents"))


@query
def op9_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(spark, table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op10_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
