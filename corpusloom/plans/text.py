"""Queries of cleaning, chunking, tokens and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import text as T
from corpusloom.sources import model as M


def clean_text(spark, d):
    text = F.concat(F.lit("  <|x|>\n\n\n\nï¿¾a   b\t\tc "), F.col("text"))
    return M.table(spark, d, "documents").select("doc_id", F.md5(T.clean(text)).alias("clean_md5"))


def line_filter_clean(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.md5(T.clean_lines(F.col("text"))).alias("clean_md5"))


def chunk_by_paragraph(spark, d):
    """Lines as paragraphs: number, sizes and token estimates of each document's parts."""
    parts = T.by_paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    rows = M.table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("at", "p"))
    return rows.select("doc_id", F.col("at").cast("bigint").alias("at"), F.length("p").cast("bigint").alias("chars"), F.floor(F.length("p") / 3).cast("bigint").alias("tokens"))


def chunk_recursive(spark, d):
    return T.chunked(M.table(spark, d, "documents"), "recursive").select("doc_id", "chunk_no", F.md5("content").alias("content_md5"), "token_count")


def chunk_split(spark, d):
    return T.chunked(M.table(spark, d, "documents"), "split", 500, 50).select("doc_id", "chunk_no", F.md5("content").alias("content_md5"), "token_count")


def chunk_tokens(spark, d):
    return T.chunked_by_tokens(M.table(spark, d, "documents"), 256).select("doc_id", "chunk_no", F.md5("content").alias("content_md5"), "token_count")


def sentence_split(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.size(T.by_sentences(F.col("text"))).cast("bigint").alias("sentences"))


def technical_tokens(spark, d):
    """Tokens with protected ones whole, by knowledge base."""
    rows = M.table(spark, d, "documents").select("lang", F.explode(T.technical_tokens("text")).alias("term"))
    return rows.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("tf"))


def error_classify(spark, d):
    """Made-up messages that hit every class."""
    texts = F.array(*[F.lit(x) for x in ("Request timed out", "HTTP 429 slow down", "401 Unauthorized", "Forbidden", "invalid field", "404 page", "502 Bad gateway", "???", None)])
    rows = M.table(spark, d, "events").select("event_id", F.element_at(texts, (F.col("event_id") % 9 + 1).cast("int")).alias("m"))
    return rows.select("event_id", rules.error_class(F.col("m")).alias("error_class"), rules.retryable(F.col("m")).alias("retryable"))


def route_keywords(spark, d):
    texts = F.array(*[F.lit(x) for x in ("请生成 PDF 报告", "不要生成 pdf", "总结一下制度", "如何请假", "hello", "写一份方案", "", "xyz")])
    rows = M.table(spark, d, "events").select("event_id", F.element_at(texts, (F.col("event_id") % 8 + 1).cast("int")).alias("q"), (F.col("event_id") % 3 == 0).alias("a"), (F.col("event_id") % 5 == 0).alias("k"))
    return rows.select("event_id", rules.route(F.col("q"), F.col("a"), F.col("k")).alias("r")).select("event_id", "r.route", "r.reason", "r.confidence")


def plan_steps(spark, d):
    names = F.array(*[F.lit(x) for x in (*rules.PLANS, "other")])
    rows = M.table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.element_at(names, (F.col("event_id") % 7 + 1).cast("int")).alias("route"))
    return rules.plan_steps(rows, 2)


QUERIES = {f.__name__: f for f in (clean_text, line_filter_clean, chunk_by_paragraph, chunk_recursive, chunk_split, chunk_tokens, sentence_split, technical_tokens, error_classify, route_keywords, plan_steps)}

TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
ORACLE_SQL = {
    "clean_text": "SELECT doc_id, md5(" + TRIM.format("regexp_replace(regexp_replace('  <x>' || chr(10) || chr(10) || 'a   b' || chr(9) || chr(9) || 'c ' || regexp_replace(replace(replace(text, '<|', '<'), '|>', '>'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7Fï¿¾]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[\\t\\f\\r \\x{00a0}\\x{3000}]{2,}', ' ', 'g')") + ") AS clean_md5 FROM documents",
    "line_filter_clean": "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) >= 10 AND NOT regexp_full_match(trim(l), '[0-9]+') AND NOT regexp_full_match(trim(l), 'Page\\s+\\d+\\s+of\\s+\\d+') AND NOT regexp_full_match(trim(l), '\\[\\d+\\]') AND NOT regexp_full_match(trim(l), '[ \\t.\\-_+=*#@$%^&()\\[\\]{}|,<>/?~`]*')), chr(10))) AS clean_md5 FROM documents",
    "chunk_by_paragraph": "WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: " + TRIM.format("l") + "), lambda l: l <> '') AS ps FROM documents) SELECT doc_id, at - 1 AS at, length(ps[at]) AS chars, length(ps[at]) // 3 AS tokens FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS at FROM p)".replace("at - 1 AS at, length(ps[at])", "nr - 1 AS at, length(ps[nr])").replace("length(ps[at]) //", "length(ps[nr]) //").replace("AS at FROM (SELECT doc_id, ps", "AS at FROM (SELECT doc_id, ps").replace("unnest(range(1, len(ps) + 1)) AS at", "unnest(range(1, len(ps) + 1)) AS nr"),
    "sentence_split": "SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]+'), lambda s: regexp_matches(rtrim(s, '。！？.!?'), '\\S'))) AS BIGINT) AS sentences FROM documents",
    "error_classify": "SELECT event_id, (['timeout', 'rate_limit', 'auth', 'permission', 'validation', 'not_found', 'upstream', 'unknown', 'unknown'])[event_id % 9 + 1] AS error_class, event_id % 9 NOT IN (2, 3, 4, 5) AS retryable FROM events",
    "route_keywords": (
        "WITH e AS (SELECT event_id, event_id % 8 AS q, event_id % 3 = 0 AS a, event_id % 5 = 0 AS k FROM events), r AS (SELECT event_id, CASE q WHEN 0 THEN 'pdf_generation|matched_pdf_keywords|0.98' WHEN 2 THEN 'document_summary|matched_summary_keywords|0.98' "
        "WHEN 3 THEN CASE WHEN a THEN 'rag_qa|attachments_present_with_question|0.95' WHEN k THEN 'rag_qa|active_kb_with_question|0.95' ELSE 'fallback_chat|no_rule_match|0.6' END WHEN 5 THEN 'content_generation|matched_generation_keywords|0.92' "
        "WHEN 6 THEN CASE WHEN a THEN 'document_summary|attachments_without_query|0.92' WHEN k THEN 'rag_qa|active_kb_default|0.8' ELSE 'fallback_chat|no_rule_match|0.6' END "
        "ELSE CASE WHEN q = 4 AND NOT a AND NOT k THEN 'fallback_chat|matched_fallback_keywords|0.95' WHEN k THEN 'rag_qa|active_kb_default|0.8' WHEN a THEN 'document_summary|attachments_default|0.8' ELSE 'fallback_chat|no_rule_match|0.6' END END AS s FROM e) "
        "SELECT event_id, split_part(s, '|', 1) AS route, split_part(s, '|', 2) AS reason, CAST(split_part(s, '|', 3) AS DOUBLE) AS confidence FROM r"
    ),
    "plan_steps": "WITH p AS (SELECT event_id AS query_id, ([['knowledge_retrieval', 'answer'], ['knowledge_retrieval', 'summarize'], ['knowledge_retrieval', 'draft'], ['knowledge_retrieval', 'draft'], ['knowledge_retrieval', 'draft'], ['respond'], ['execute']])[event_id % 7 + 1] AS s FROM events) SELECT query_id, n AS step_no, s[n] AS step_type FROM (SELECT query_id, s, unnest(range(1, len(s) + 1)) AS n FROM p)",
}
