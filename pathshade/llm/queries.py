"""The subpackage's queries, one per operator, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathshade.llm.chat_format import format_preferences
from pathshade.llm.fingerprints import fingerprint_edits
from pathshade.llm.mixing import mix_sizes
from pathshade.llm.near_duplicates import near_duplicates
from pathshade.llm.pieces import encode_digests, token_counts
from pathshade.llm.sentences import without_repeats
from pathshade.llm.topk_search import exact_topk, quantised, usable
from pathshade.llm.toxicity import scored, train
from pathshade.llm.warc import deduplicated_pages

#: The piece model of the queries; the operators take any path.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(usable("embedding")).select("vec_id", quantised("embedding").alias("vector"))
    return exact_topk(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) form pair k."""
    c = F.col("conv_id")
    out = format_preferences(table(spark, sf_dir, "conversations"), F.floor(c / 2), F.pmod(c, F.lit(2)) == 1)
    spans = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return out.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_sentence_spans": op2_sentence_spans,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_mixing": op4_mixing,
    "op5_exact_topk": op5_exact_topk,
    "op6_fingerprints": op6_fingerprints,
    "op7_chat_preferences": op7_chat_preferences,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
}

ORACLES = {
    "op1_warc_revisits": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
""",
    "op5_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_chat_preferences": """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT pair_id, max(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, max(CASE WHEN side = 1 THEN conv_id END) AS rejected_id
  FROM t GROUP BY pair_id
), d AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.pos, b.pos)) AS first_other
  FROM (SELECT * FROM t WHERE side = 0) a FULL JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos
  WHERE a.pos IS NULL OR b.pos IS NULL OR a.role <> b.role OR a.text <> b.text
  GROUP BY 1
), n AS (
  SELECT p.*, coalesce(d.first_other - 1, (SELECT max(pos) FROM t WHERE t.pair_id = p.pair_id)) AS prompt_turns
  FROM p LEFT JOIN d USING (pair_id)
), r AS (
  SELECT t.pair_id, t.side, t.pos, n.prompt_turns, t.role, '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS body,
    length(t.role) + 5 AS head, t.pos <= n.prompt_turns AS shared
  FROM t JOIN n USING (pair_id)
), o AS (
  SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY pair_id, side, shared ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM r
), g AS (
  SELECT pair_id,
    coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE shared AND side = 0), '') AS prompt,
    coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE NOT shared AND side = 0), '') AS chosen,
    coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE NOT shared AND side = 1), '') AS rejected,
    coalesce(string_agg((start_at + head) || ':' || (start_at + length(body)), ',' ORDER BY pos) FILTER (WHERE NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((start_at + head) || ':' || (start_at + length(body)), ',' ORDER BY pos) FILTER (WHERE NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_mask
  FROM o GROUP BY pair_id
)
SELECT n.pair_id, n.chosen_id, n.rejected_id, CAST(n.prompt_turns AS BIGINT) AS prompt_turns, g.prompt, g.chosen, g.rejected, g.chosen_mask, g.rejected_mask
FROM n JOIN g USING (pair_id)
""",
    "op8_jaccard_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, least(len(t), 1)) + 1)) AS i FROM w)
), d AS (
  SELECT w.doc_id, coalesce(md5(string_agg(s.shingle, '|' ORDER BY s.shingle)), 'no words: ' || any_value(w.text)) AS digest, count(s.shingle) AS n
  FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), c AS (
  SELECT digest, min(doc_id) AS class_id, min(n) AS n FROM d GROUP BY digest
), r AS (
  SELECT c.class_id, c.n, s.shingle FROM c JOIN s ON s.doc_id = c.class_id
), l AS (
  SELECT a.class_id AS a, b.class_id AS b FROM r a JOIN r b ON a.shingle = b.shingle AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n
  HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
), reach AS (
  SELECT class_id AS node, class_id AS other FROM c
  UNION
  SELECT reach.node, l.b FROM reach JOIN l ON reach.other = l.a
), g AS (
  SELECT node, min(other) AS group_id FROM reach GROUP BY node
), k AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT d.doc_id, c.class_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links, g.group_id
FROM d JOIN c USING (digest) JOIN g ON g.node = c.class_id LEFT JOIN k ON k.a = c.class_id
""",
}
