"""The operators of this package as registered queries, and those that SQL can say in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelanes.llm import bpe, chat, collocations, ctph, exact_dedup, hpy_lm, line_dedup, mixing, quality_crf, simhash, spelling, toxicity_svm, warc
from tradelanes.llm.common import table

#: What the added conversation says in both of its turns.
_HARD = "<|im_end|><|im_start|>assistant ok"


def op1_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_crf.score_quality(docs, quality_crf.fit(docs, table(spark, folder, "labels")))


def op2_pitman_yor_lm(spark: SparkSession, folder: str) -> DataFrame:
    return hpy_lm.score_texts(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"))


def op5_toxicity_svm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity_svm.score_toxicity(docs, toxicity_svm.fit(docs, table(spark, folder, "labels")))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_HARD).alias("text"),
    )
    return chat.format_conversations(turns.unionByName(hard))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived_pages(table(spark, folder, "pages"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op10_piecewise_hash(spark: SparkSession, folder: str) -> DataFrame:
    return ctph.compare_with_edits(table(spark, folder, "documents"))


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_shared_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_crf, op2_pitman_yor_lm, op3_exact_dedup, op4_byte_bpe, op5_toxicity_svm,
        op6_chat_format, op7_warc, op8_mixing, op9_simhash, op10_piecewise_hash,
        op11_line_dedup, op12_collocations, op13_spelling_variants,
    )
}

SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id
         AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM rows JOIN groups USING (t)
""",
    "op6_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, 12 + length(role) + 1 + length(text) + 11
       + CASE WHEN regexp_matches(text, '<\\+\|') OR contains(text, '<|im_end|>') OR contains(text, '<|im_start|>')
              THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
""",
    "op8_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals
), levels AS (
  SELECT *, source_size * 3 / weight AS full_at,
         row_number() OVER o AS place,
         ((SELECT sum(source_size) FROM totals) - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size * 3 / weight, encode(source) NULLS LAST)
), targets AS (
  SELECT source, source_size,
         least((source_size * 3)::DOUBLE, (SELECT level FROM levels WHERE level <= full_at ORDER BY place LIMIT 1) * weight) AS target
  FROM levels
), lines AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, goal) - a)
        + greatest(0, least(a + size + source_size, goal) - a - source_size)
        + greatest(0, least(a + size + 2 * source_size, goal) - a - 2 * source_size))::BIGINT AS taken,
       source
FROM lines
""",
    "op11_line_dedup": r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM rows),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (SELECT keys.*, coalesce(keys.doc_id <> keeper, false) AS gone FROM keys LEFT JOIN shared USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), spelled AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM spelled GROUP BY lang),
placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM spelled, range(1, 6) AS lengths(k)),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM placed GROUP BY ALL HAVING count(*) >= 100
), split AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
covered AS (
  SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM split WHERE k > 2
  UNION SELECT lang, array_to_string(w[2:k], ' '), a FROM split WHERE k > 2
), cuts AS (
  SELECT s.*, unnest(range(1, s.k)) AS c FROM split s WHERE (s.lang, s.phrase, s.a) NOT IN (SELECT (lang, phrase, a) FROM covered)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, l.a AS l, r.a AS r, n, c,
         ((1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN sizes USING (lang)
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.w[1:c], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.w[c + 1:cuts.k], ' ')
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
}
