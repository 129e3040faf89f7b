"""Queries of requests and answers: profiles, intents, keys, engines, proxies, caches, addresses of images and messages, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import urls as U
from corpusloom.operators import analytics as A
from corpusloom.operators import binding as B
from corpusloom.operators import serp as P
from corpusloom.plans.more import pick, sql_pick
from corpusloom.plans.search import HOST, norm
from corpusloom.sources import files as S
from corpusloom.sources import model as M
from corpusloom.streaming import streams

#: Requests that tell the kinds of content and the leave to search outside apart; several fit two kinds.
ASKS = ["整理张三的简历和培训计划", " 写一份培训大纲, 允许联网", "市场调研 2024", "采购方案", "今天天气", "", None, "外部搜索: 年度总结", "培训 课程", "公开信息里的工作背景", "网上搜索 weather"]
ASKED_ROUTES = ["rag_qa", "document_summary", "content_generation", "pdf_generation", "ppt_generation", "fallback_chat", "", None]
INTENT_NAMES = ["knowledge_query", "solution_query", "casual_chat", "small_talk"]
KINDS = [*P.RESULT_TYPES, "Organic", "banner", 'od"d', "", None]
NAMES = ["ddg", "Google", " duck", "nope", "bing ", "BAIDU", "", "yandex", "ecosia", "duckduckgo"]
ID = "event_id"
#: Seconds in which an equal request is a hit, and refill and burst of a bucket.
TTL, RATE, BURST = 3 * 86_400, 1 / 20_000, 3


def events(spark, d):
    return M.table(spark, d, "events")


def task_profiles(spark, d):
    asked = pick(ASKS, F.col(ID))
    return events(spark, d).select(ID, rules.task_profile(pick(ASKED_ROUTES, F.floor(F.col(ID) / 11)), asked).alias("p")).select(ID, "p.*")


def intents(spark, d):
    """Replies in six forms: plain, fenced, inside a sentence, with the index as text, without JSON, and with an index that is no whole number."""
    name, n = pick(INTENT_NAMES, F.floor(F.col(ID) / 6)), (F.col(ID) % 7 - 2).cast("string")
    body = F.concat(F.lit('{"intent": "'), name, F.lit('", "kb_index": '), n, F.lit("}"))
    forms = [body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Sure: "), body, F.lit(" done")), F.concat(F.lit('{"kb_index": "'), n, F.lit('", "intent": "'), name, F.lit('"}')), F.concat(F.lit("no idea {"), n), F.concat(F.lit('{"kb_index": "'), n, F.lit('th", "intent": "'), name, F.lit('"}'))]
    reply = F.element_at(F.array(*forms), (F.col(ID) % 6 + 1).cast("int"))
    return events(spark, d).select(ID, rules.intent(reply).alias("i")).select(ID, "i.*")


def result_types(spark, d):
    return events(spark, d).select(ID, P.result_type(pick(KINDS, F.col(ID))).alias("t")).select(ID, "t.*")


def resolved_engines(spark, d):
    text = F.concat_ws(",", pick(NAMES, F.col(ID)), pick(NAMES, F.floor(F.col(ID) / 10)), pick(NAMES, F.floor(F.col(ID) / 100)))
    return events(spark, d).select(ID, F.array_join(P.resolve_engines(text), ",").alias("engines"))


def checked_requests(spark, d):
    """Documents as requests: their texts, sites by language, limits and starts by length."""
    n = F.col("n_chars")
    limit, start = F.when(n % 5 > 0, n % 104 - 1), F.when(n % 3 > 0, n % 9 - 4)
    text = F.when(n % 2 == 0, F.col("text")).otherwise("")
    return M.table(spark, d, "documents").select("doc_id", P.check_request(limit, start, text, F.when(F.col("lang") == "en", "e.org"), F.when(F.col("lang") == "de", "pdf")).alias("error"))


def cache_keys(spark, d):
    """Keys of responses to events asked as queries, and whether a proxy of no known market keeps them out of the cache."""
    e = events(spark, d)
    market = {"country": pick([" US", "", None], F.col(ID)), "kind": pick(["", "Residential "], F.col(ID)), "provider": F.lit("")}
    key = U.cache_key(
        engine=pick(list(P.ENGINES), F.col(ID)), action=F.lit("search"), text=F.col("event_type"), lang=pick(["EN", "", "de "], F.floor(F.col(ID) / 3)), dates=F.lit(""), file=F.lit("pdf"), site=F.lit(None).cast("string"),
        limit=F.col(ID) % 4 * 10, start=F.col("user_id"), filtered=F.col(ID) % 2 == 0, answers=F.lit(False), **market,
    )
    return e.select(ID, key.alias("cache_key"), U.bypasses_cache(proxy=pick(["", "http://p", None, "  "], F.col(ID)), override=F.lit(""), **market).alias("bypass"))


def serp_cluster_order(spark, d):
    found = P.ranked(P.clusters(M.serp(spark, d), 6))
    seen = F.array_join(F.transform("occurrences", lambda o: F.concat_ws(":", o["engine"], o["rank"].cast("string"), o["result_id"])), ",")
    return found.select("query_id", "at", "cluster_id", "domain", seen.alias("occurrences"))


def proxies_in_turn(spark, d):
    """Suppliers as proxies of four tags, some of them failed; events take the healthy ones of their tag in turn."""
    proxies = M.table(spark, d, "supplier").select(F.concat(F.lit("http://h"), "s_suppkey").alias("url"), F.array(F.concat(F.lit("t"), F.col("s_suppkey") % 4)).alias("tags"), (F.col("s_suppkey") % 5).alias("failures"))
    asks = events(spark, d).select(F.col(ID).alias("request_id"), F.concat(F.lit("t"), F.col(ID) % 5).alias("tag"), F.col("ts").alias("at"))
    return B.next_proxy(proxies, asks)


def cached_requests(spark, d):
    """Requests of each user and kind: how many came while an equal one was remembered."""
    asks = events(spark, d).select(F.col("event_type").alias("engine"), F.col("user_id").alias("query"), F.col("ts").alias("at"))
    return B.cache_hits(asks, ttl=TTL).groupBy("engine", "query").agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))


def bucket_waits(spark, d):
    waits = streams.token_bucket(events(spark, d).select((F.col("user_id") % 50).alias("engine"), F.col("ts").alias("at")), RATE, BURST)
    return waits.groupBy("engine").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("wait") > 0).alias("waited"), F.round(F.max("wait"), 3).alias("longest"))


def image_details(spark, d):
    n = F.col("page_id")
    forms = [
        F.concat(F.lit("Height: "), n, F.lit(", Width:"), n + 1, F.lit(", Source page: "), "url", F.lit(", thumb_url: "), "url"), F.concat(n, F.lit(" x "), n + 2), F.concat(F.lit("Source: "), "url"), F.lit("Source page: ftp://e.org, thumb_url: x"),
        F.concat(F.lit("a "), n, F.lit("X"), n + 2, F.lit(" photo")), F.concat(F.lit("height "), n, F.lit(", width "), n), F.concat(F.lit("wide 7x"), n, F.lit("px")),
    ]
    return M.table(spark, d, "pages").select("page_id", P.image_description(F.element_at(F.array(*forms), (n % 7 + 1).cast("int"))).alias("i")).select("page_id", "i.*")


def platform_messages(spark, d):
    """Turns of conversations as messages of three platforms and an unknown one, some of feishu's with a text that is no JSON."""
    forms = [
        "to_json(named_struct('event', named_struct('message', named_struct('message_id', concat('m', turn), 'chat_id', string(conv_id), 'create_time', string(turn * 1500 + 1000), 'content', if(turn % 3 = 0, text, to_json(named_struct('text', concat(' ', text, ' '))))), 'sender', named_struct('sender_id', if(turn % 2 = 0, named_struct('open_id', role, 'user_id', 'x'), named_struct('open_id', '', 'user_id', role))))))",
        "to_json(named_struct('MsgId', concat('m', turn), 'FromUserName', role, 'ToUserName', string(conv_id), 'Content', text, 'CreateTime', turn + 5))", "to_json(named_struct('id', concat('m', turn), 'user_id', role, 'channel_id', string(conv_id), 'content', text, 'timestamp', string(turn + 7)))", "'{}'",
    ]
    at = F.col("conv_id") % 4
    raw = F.element_at(F.array(*[F.expr(f) for f in forms]), (at + 1).cast("int"))
    m = S.platform_message(raw, pick(["feishu", "wechat", "qq", "other"], F.col("conv_id")))
    return M.table(spark, d, "conversations").select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", "m.message_id", "m.user_id", "m.conversation_id", F.md5("m.text").alias("text_md5"), "m.at")


def drive_ids(spark, d):
    n = F.col("page_id").cast("string")
    forms = [F.concat(F.lit("https://drive.google.com/file/d/A_"), n, F.lit("-x/view")), F.concat(F.lit("https://drive.google.com/open?usp=s&id=B"), n, F.lit("&x=1")), F.col("url")]
    return M.table(spark, d, "pages").select("page_id", S.drive_id(F.element_at(F.array(*forms), (F.col("page_id") % 3 + 1).cast("int"))).alias("file_id"))


def longer_texts(spark, d):
    """Each text beside that of the document before it, as text layer and OCR."""
    docs = M.table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("ocr"))
    return docs.join(before, "doc_id").select("doc_id", F.md5(S.longer_text(F.col("text"), F.col("ocr"), least=1000)).alias("text_md5"))


def block_markdown(spark, d):
    """Documents whose lines are blocks of a JSON list, in nine kinds by place, two of them tables of the line and the document."""
    run = "named_struct('elements', array(named_struct('text_run', named_struct('content', concat(content, ' '))), named_struct('text_run', named_struct('content', 'z '))))"
    kinds = {2: "text", 3: "heading1", 8: "heading6", 12: "bullet", 13: "ordered", 14: "code", 19: "quote"}
    blocks = [f"to_json(named_struct('block_type', {n}, '{name}', {run}))" for n, name in kinds.items()]
    blocks.append("to_json(named_struct('block_type', 31, 'table', named_struct('rows', array(array(content, 'b'), array(title)))))")
    blocks.append("to_json(named_struct('block_type', 31, 'table', named_struct('cells', array(named_struct('text', content, 'row', 2, 'col_span', 2), named_struct('text', title, 'row', 0, 'col_span', 1), named_struct('text', '', 'row', 0, 'col_span', 1)))))")
    one = F.element_at(F.array(*[F.expr(b) for b in blocks], F.lit('{"block_type": 99}')), (F.col("sequence_no") % 10 + 1).cast("int"))
    rows = M.chunks(spark, d).select("document_id", "sequence_no", one.alias("block")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sequence_no", "block"))).alias("b"))
    docs = rows.select(F.col("document_id").alias("doc_id"), F.concat(F.lit("["), F.array_join(F.transform("b", lambda x: x["block"]), ","), F.lit("]")).alias("blocks"))
    return S.document_markdown(docs).select("doc_id", F.md5("markdown").alias("markdown_md5"))


def search_trend_kept(spark, d):
    """Daily requests and errors of the 35 days that end on 20 February, older counters gone."""
    daily = streams.daily_counters(events(spark, d).select("ts", "event_type"))
    return A.retained(daily, F.lit("2024-02-20"), 35).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "requests", "errors")


QUERIES = {
    f.__name__: f
    for f in (
        task_profiles, intents, result_types, resolved_engines, checked_requests, cache_keys, serp_cluster_order, proxies_in_turn, cached_requests, bucket_waits, image_details, platform_messages, drive_ids, longer_texts, block_markdown,
        search_trend_kept,
    )
}

V = M.with_views


def sql_any(words, text: str = "t") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


REFILL = round(1_000_000 / RATE)
CONTENT = "CASE " + " ".join(f"WHEN {sql_any(words)} THEN '{name}'" for name, words in rules.CONTENT_TYPES) + " ELSE 'general_content' END"
OUTSIDE = sql_any(rules.OUTSIDE)
ORACLE_SQL = {
    "task_profiles": f"SELECT event_id, CASE r WHEN 'pdf_generation' THEN 'artifact_pdf' WHEN 'ppt_generation' THEN 'artifact_ppt' WHEN 'document_summary' THEN 'structured_summary' WHEN 'content_generation' THEN 'structured_generation' ELSE 'answer' END AS goal_type, {CONTENT} AS content_type, CASE WHEN {OUTSIDE} THEN 'internal_first_external_supplement' ELSE 'internal_only' END AS evidence_policy, CASE WHEN {OUTSIDE} THEN 'focus_entities_in_materials' ELSE 'none' END AS search_focus_rule, CASE r WHEN 'pdf_generation' THEN 'pdf_export' WHEN 'ppt_generation' THEN r END AS artifact_tool, {OUTSIDE} AND r IN ('content_generation', 'pdf_generation', 'ppt_generation') AS allow_external_search, CASE r WHEN 'pdf_generation' THEN 'pdf_task_created' WHEN 'ppt_generation' THEN 'ppt_task_created' ELSE 'final_answer_ready' END AS completion_condition FROM (SELECT event_id, coalesce({sql_pick(ASKED_ROUTES, '(event_id // 11)')}, '') AS r, coalesce({sql_pick(ASKS, ID)}, '') AS t FROM events)",
    "intents": f"SELECT event_id, CASE WHEN event_id % 6 = 4 OR name = 'small_talk' THEN 'knowledge_query' ELSE name END AS intent, CASE WHEN event_id % 6 < 4 AND event_id % 7 > 2 THEN event_id % 7 - 2 END AS kb_index FROM (SELECT event_id, {sql_pick(INTENT_NAMES, '(event_id // 6)')} AS name FROM events)",
    "result_types": f"""SELECT event_id, CASE WHEN known THEN k ELSE 'organic' END AS type, CASE WHEN known THEN '' ELSE 'unknown result type "' || replace(k, '"', chr(92) || '"') || '", defaulting to organic' END AS warning FROM (SELECT event_id, k, k IN ({", ".join(repr(x) for x in P.RESULT_TYPES)}) AS known FROM (SELECT event_id, coalesce({sql_pick(KINDS, ID)}, '') AS k FROM events))""",
    "resolved_engines": f"WITH n AS (SELECT event_id, i, lower(trim(CASE i WHEN 1 THEN {sql_pick(NAMES, ID)} WHEN 2 THEN {sql_pick(NAMES, '(event_id // 10)')} ELSE {sql_pick(NAMES, '(event_id // 100)')} END)) AS e FROM events, range(1, 4) r(i)), k AS (SELECT event_id, min(i) AS i, CASE WHEN e IN ('ddg', 'duck') THEN 'duckduckgo' ELSE e END AS e FROM n GROUP BY event_id, 3), j AS (SELECT event_id, string_agg(e, ',' ORDER BY i) AS s FROM k WHERE e IN ({', '.join(repr(x) for x in P.ENGINES)}) GROUP BY 1) SELECT event_id, coalesce(s, '') AS engines FROM events LEFT JOIN j USING (event_id)",
    "checked_requests": "SELECT doc_id, CASE WHEN n_chars % 5 > 0 AND n_chars % 104 - 1 NOT BETWEEN 1 AND 100 THEN 'bad_limit' WHEN n_chars % 3 > 0 AND n_chars % 9 < 4 THEN 'bad_start' WHEN (n_chars % 2 <> 0 OR coalesce(text, '') = '') AND coalesce(lang NOT IN ('en', 'de'), true) THEN 'empty_query' END AS error FROM documents",
    "cache_keys": f"SELECT event_id, sha256(concat_ws('|', {sql_pick(list(P.ENGINES), ID)}, 'search', event_type, lang, '', 'pdf', '', event_id % 4 * 10, user_id, event_id % 2 = 0, false, CASE WHEN event_id % 3 = 0 THEN 'us' ELSE lower(trim(lang)) END, CASE WHEN event_id % 2 = 1 THEN 'residential' ELSE '' END, '')) AS cache_key, event_id % 4 = 1 AND event_id % 3 <> 0 AND event_id % 2 = 0 AS bypass FROM (SELECT *, {sql_pick(['EN', '', 'de '], '(event_id // 3)')} AS lang FROM events)",
    "serp_cluster_order": V(f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, cluster_id) AS at, cluster_id, domain, occurrences FROM (SELECT query_id, 'c_' || substring(md5(norm), 1, 16) AS cluster_id, {HOST.format('arg_min(url, (rank, engine))')} AS domain, floor(least(1.0::DOUBLE, CAST(sum(CAST(round(1.0::DOUBLE / rank, 9) AS DECIMAL(20, 9))) AS DOUBLE) / 6) * 100 + 0.5) AS score, min(rank) AS best_rank, string_agg(engine || ':' || rank || ':s_' || substring(md5(engine || '|' || norm), 1, 16), ',' ORDER BY engine, rank) AS occurrences FROM (SELECT *, {norm('url')} AS norm FROM serp) GROUP BY query_id, norm)", "serp"),
    "proxies_in_turn": "WITH p AS (SELECT 't' || s_suppkey % 4 AS tag, list('http://h' || s_suppkey ORDER BY 'http://h' || s_suppkey) AS urls FROM supplier WHERE s_suppkey % 5 < 3 GROUP BY 1), r AS (SELECT event_id, 't' || event_id % 5 AS tag, row_number() OVER (PARTITION BY event_id % 5 ORDER BY ts, event_id) - 1 AS turn FROM events) SELECT event_id AS request_id, tag, urls[turn % len(urls) + 1] AS url FROM r LEFT JOIN p USING (tag)",
    "cached_requests": f"WITH RECURSIVE o AS (SELECT event_type AS engine, user_id AS query, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS k FROM events), f AS (SELECT engine, query, k, us AS last, false AS hit FROM o WHERE k = 1 UNION ALL SELECT o.engine, o.query, o.k, CASE WHEN o.us - f.last < {TTL * 1_000_000} THEN f.last ELSE o.us END, o.us - f.last < {TTL * 1_000_000} FROM f JOIN o ON o.engine = f.engine AND o.query = f.query AND o.k = f.k + 1) SELECT engine, query, count(*) AS requests, count(*) FILTER (hit) AS hits FROM f GROUP BY ALL",
    "bucket_waits": f"WITH o AS (SELECT user_id % 50 AS engine, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts) AS k FROM events), w AS (SELECT engine, greatest(max(us - k * {REFILL}) OVER (PARTITION BY engine ORDER BY k) + (k + 1 - {BURST}) * {REFILL} - us, 0) AS wait FROM o) SELECT engine, count(*) AS requests, count(*) FILTER (wait > 0) AS waited, round(max(wait) / 1000000.0::DOUBLE, 3) AS longest FROM w GROUP BY 1",
    "image_details": "SELECT page_id, CASE WHEN page_id % 7 IN (0, 2) THEN url ELSE '' END AS page, CASE WHEN page_id % 7 = 0 THEN url ELSE '' END AS thumb, CAST(CASE page_id % 7 WHEN 0 THEN page_id + 1 WHEN 4 THEN page_id ELSE 0 END AS INT) AS width, CAST(CASE page_id % 7 WHEN 0 THEN page_id WHEN 4 THEN page_id + 2 ELSE 0 END AS INT) AS height FROM pages",
    "platform_messages": "SELECT conv_id, turn, CASE WHEN conv_id % 4 < 3 THEN 'm' || turn ELSE '' END AS message_id, CASE WHEN conv_id % 4 < 3 THEN role ELSE '' END AS user_id, CASE WHEN conv_id % 4 < 3 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS conversation_id, md5(CASE WHEN conv_id % 4 = 3 OR (conv_id % 4 = 0 AND turn % 3 = 0) THEN '' ELSE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) END) AS text_md5, CASE conv_id % 4 WHEN 0 THEN (turn * 1500 + 1000) // 1000 WHEN 1 THEN turn + 5 WHEN 2 THEN turn + 7 END AS at FROM conversations",
    "drive_ids": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'A_' || page_id || '-x' WHEN 1 THEN 'B' || page_id ELSE coalesce(nullif(regexp_extract(url, '/d/([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(url, '[?&]id=([A-Za-z0-9_-]+)', 1), '')) END AS file_id FROM pages",
    "longer_texts": "SELECT a.doc_id, md5(CASE WHEN length(trim(a.text)) < 1000 AND length(trim(b.text)) > length(trim(a.text)) THEN b.text ELSE a.text END) AS text_md5 FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1",
    "block_markdown": V("SELECT document_id AS doc_id, md5(coalesce(string_agg(CASE sequence_no % 10 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t WHEN 3 THEN '- ' || t WHEN 4 THEN '1. ' || t WHEN 5 THEN '```text' || chr(10) || t || chr(10) || '```' WHEN 6 THEN '> ' || t WHEN 7 THEN '| ' || trim(content) || ' | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || trim(title) || ' |  |' WHEN 8 THEN '[复杂表格展开]' || chr(10) || '- R3C1 (合并 1x2): ' || trim(content) || CASE WHEN trim(title) <> '' THEN chr(10) || '- R1C1: ' || trim(title) ELSE '' END END, chr(10) ORDER BY sequence_no), '')) AS markdown_md5 FROM (SELECT *, trim(content) || ' z' AS t FROM (SELECT document_id, sequence_no, content, coalesce(title, '') AS title FROM chunks)) GROUP BY 1", "chunks"),
    "search_trend_kept": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE CAST(ts AS DATE) > DATE '2024-02-20' - 35 AND CAST(ts AS DATE) <= DATE '2024-02-20' GROUP BY 1",
}
