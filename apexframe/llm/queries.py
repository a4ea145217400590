"""The registered corpus queries, one for each operator, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexframe.llm.decontaminate import contamination
from apexframe.llm.exact_dedup import exact_dedup
from apexframe.llm.html_extract import extract_pages
from apexframe.llm.merkle import merkle_proofs
from apexframe.llm.mixing import mix_sources
from apexframe.llm.near_dup import near_classes
from apexframe.llm.quality import fit_quality, score_documents
from apexframe.llm.repair import repair_conversations
from apexframe.llm.sharding import shard_documents
from apexframe.llm.simhash import simhash_components
from apexframe.llm.substring_dedup import dedup_substrings
from apexframe.llm.tokens import count_tokens
from apexframe.llm.warc import warc_round_trip

SHARDS = 24
#: The entropy of the sources' weights lies half the way from that of their shares to the largest one.
EVEN = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("digest", "text_sha256")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), even=EVEN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit_quality(documents, table(spark, sf_dir, "labels")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_proofs(table(spark, sf_dir, "documents"), third)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_html_extraction": op10_html_extraction,
    "op11_simhash": op11_simhash,
    "op12_merkle": op12_merkle,
    "op13_conversation_repair": op13_conversation_repair,
}



def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = f"list_transform(range(0, 8 * len({text})), lambda k: CASE WHEN k % 8 = 0 THEN ord(substr({text}, k // 8 + 1, 1)) ELSE 0 END)"
    step = "CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) // 2, 3988292384) ELSE xor(a, x) // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every way to insert before a row from a state (0 nothing, 1 system, 2 user, 3 assistant): from, to, cost, letters, lines.
_INSERTS = """(0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'),
  (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')"""

ORACLES = {
    "op13_conversation_repair": rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {_crc32("key")} % 20 AS kind FROM k),
m AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended FROM o),
r AS (SELECT *, blank OR seen AS must, NOT blank AND NOT seen AND unended AS cut, substr(role, 1, 1) AS initial FROM w),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(seen AND NOT blank) AS duplicate, count_if(cut) AS truncated,
             count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
ins(q, t, cost, letters, lines) AS (VALUES {_INSERTS}),
s AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS body FROM c
  UNION ALL
  SELECT conv_id, i, q, best.cost, best.audit, best.body FROM (
    SELECT conv_id, i, q, min(struct_pack(cost := cost, audit := audit, body := body)) AS best FROM (
      SELECT s.conv_id, r.i, e.q, s.cost + ins.cost + e.cost AS cost, s.audit || ins.letters || e.letter AS audit, s.body || ins.lines || e.line AS body
      FROM s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1 JOIN ins ON ins.q = s.q,
      LATERAL (
        SELECT ins.t AS q, 2 AS cost, 'D' AS letter, '' AS line
        UNION ALL
        SELECT CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN cut THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text
        WHERE NOT must AND (initial = 's' AND ins.t = 0 OR initial = 'u' AND ins.t <> 2 OR initial = 'a' AND ins.t = 2)
        UNION ALL
        SELECT CASE WHEN ins.t = 2 THEN 3 ELSE 2 END, CASE WHEN cut THEN 6 ELSE 1 END, 'R', chr(10) || CASE WHEN ins.t = 2 THEN 'assistant:' ELSE 'user:' END || text WHERE NOT must) e)
    GROUP BY conv_id, i, q)),
g AS (SELECT s.conv_id, min(struct_pack(cost := s.cost + ins.cost, audit := audit || letters, body := body || lines)) AS best
      FROM s JOIN c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n JOIN ins ON ins.q = s.q WHERE ins.t IN (0, 3) GROUP BY s.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(substr(coalesce(best.body, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id
""",
    "op12_merkle": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field(_LOWERED)}) END AS changed
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 8, n),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS rank, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, rank AS pos, n, subroot AS digest FROM s
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8, n),
f AS (SELECT lang, level, pos // 8 AS run, string_agg(digest, '' ORDER BY pos) AS digests FROM t WHERE n > 1 GROUP BY lang, level, pos // 8),
g AS (SELECT level, pos // 8 AS run, string_agg(digest, '' ORDER BY pos) AS digests FROM u WHERE n > 1 GROUP BY level, pos // 8),
c AS (
  SELECT doc_id, lang, leaf, 0 AS level, pos, n, coalesce(changed, leaf) AS fold, '' AS proof FROM p
  UNION ALL
  SELECT doc_id, c.lang, leaf, c.level + 1, pos // 8, (n + 7) // 8, sha256(substr(digests, 1, 64 * (pos % 8)) || fold || substr(digests, 64 * (pos % 8) + 65)),
         proof || substr(digests, 1, 64 * (pos % 8)) || substr(digests, 64 * (pos % 8) + 65)
  FROM c JOIN f ON c.lang IS NOT DISTINCT FROM f.lang AND c.level = f.level AND c.pos // 8 = f.run WHERE n > 1),
e AS (
  SELECT doc_id, leaf, subroot, 0 AS level, rank AS pos, s.n, fold, proof FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang WHERE c.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, e.level + 1, pos // 8, (n + 7) // 8, sha256(substr(digests, 1, 64 * (pos % 8)) || fold || substr(digests, 64 * (pos % 8) + 65)),
         proof || substr(digests, 1, 64 * (pos % 8)) || substr(digests, 64 * (pos % 8) + 65)
  FROM e JOIN g ON e.level = g.level AND e.pos // 8 = g.run WHERE n > 1),
r AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM e, r WHERE n = 1
""",
    "op2_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
c AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
FROM d JOIN c USING (body)
""",
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS g(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
       FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS g(i) WHERE len(w) >= k),
m AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT *, octet_length(encode(body)) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < first THEN first END AS refers_to
FROM q
""",
    "op7_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(generate_series(0, n - 50)) AS x(i)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
c AS (SELECT doc_id, i FROM g JOIN f USING (s) WHERE m < doc_id),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, k),
cuts AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS lo, a AS hi FROM sp
         UNION ALL SELECT d.doc_id, coalesce(max(sp.b), 0), max(d.n) FROM d LEFT JOIN sp USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM cuts JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM sp GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
