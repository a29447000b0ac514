"""The opN_ queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm._common import texts
from pagelake.llm.bpe import digests
from pagelake.llm.chat import chat_digests
from pagelake.llm.packing import pack
from pagelake.llm.quality import quality_rules
from pagelake.llm.secrets import scan
from pagelake.llm.simhash import simhash_groups
from pagelake.llm.substring import substring_digests
from pagelake.llm.tokenfile import token_files
from pagelake.llm.topk import top_k
from pagelake.llm.warc import archived
from pagelake.session import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(texts(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits"
    )


OP2_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
x AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
y AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM x),
z AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM y WHERE c > 1) GROUP BY r),
m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(z.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN z ON w.r = z.r),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_words > 1000000)::BIGINT
    + 8 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT
    + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 64 * (2 * n_capitals > word_chars)::BIGINT)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & 3) <> 0 AS base_failed,
       failure_bits = 0 AS kept, failure_bits FROM b
"""



def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(texts(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "<|im_end|><|im_start|>assistant ok"
    kinds = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], kinds)
    return chat_digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS r,
         regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS x FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(x) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

OP8_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM t WHERE len(w) >= 13),
g AS (SELECT r, doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) AS h FROM s),
f AS (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS least FROM g),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM f WHERE least IS NOT NULL AND (doc_id IS NULL OR doc_id > least)),
d AS (SELECT r, list(k) AS gone FROM c GROUP BY r),
k AS (SELECT doc_id, w, list_transform(list_filter(range(1, len(w) + 1), lambda j: gone IS NULL OR NOT list_contains(gone, j)), lambda j: w[j]) AS kept
      FROM t LEFT JOIN d ON t.r = d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.page_id <> m.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id <> m.last THEN m.last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n = m.n
"""


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_packing, op4_secrets, op5_token_files, op6_top_k, op7_chat, op8_substring, op9_simhash, op10_warc)}
ORACLE = {"op2_quality_rules": OP2_SQL, "op6_top_k": OP6_SQL, "op7_chat": OP7_SQL, "op8_substring": OP8_SQL, "op10_warc": OP10_SQL}
