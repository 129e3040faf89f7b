"""Queries of small rules, lookups and listings, each over a whole table, with inputs that tell their branches apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import CONFIG
from corpusloom.functions import rules
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import analytics as A
from corpusloom.operators import binding as B
from corpusloom.operators import context as C
from corpusloom.operators import lexical as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import serp as P
from corpusloom.sources import model as M


def pick(values: list, key: Column) -> Column:
    """values in turn by key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def sql_pick(values: list, key: str) -> str:
    return "([" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + f"])[{key} % {len(values)} + 1]"


STATES = [None, "ready", "pending", "indexing", "error", "gone"]
FORMATS, ACCEPTS = ["json", "Markdown", "md", "text", "ndjson", "xml", None], ["text/markdown, */*", "application/x-ndjson", "text/plain", "*/*", None]
ROUTES = ["rag_qa\nbecause", "  document_summary ", "pdf_generation", "nonsense", "", None, "ppt_generation\n", "content_generation", "RAG_QA"]
ANSWERS = ["好的", "不用了", "OK", "no thanks", "hm", "  搜搜 ", "No", "可以，不要", ""]
ERRORS = [*P.SEARCH_ERRORS, "odd", None]
SOURCES = [None, "", "local", "upload", "drive", "chat"]
KINDS = ["md", "png", "jpeg", "docx", "pdf", "txt", "gif"]
TEXT_KINDS = ["image_vision", "md_structured", "word_structured", "recursive"]


def events(spark, d):
    return M.table(spark, d, "events")


def import_outcomes(spark, d):
    rows = M.table(spark, d, "documents").select("doc_id", pick(STATES, F.col("doc_id")).alias("status"))
    return rows.select("doc_id", "status", rules.import_outcome(F.col("status")).alias("outcome"))


def backoff_schedule(spark, d):
    attempt = F.col("event_id") % 9 + 1
    return events(spark, d).select("event_id", attempt.alias("attempt"), rules.backoff(attempt).cast("double").alias("seconds"))


def followups(spark, d):
    run = M.runs(spark, d)
    return run.select("run_id", rules.followup(F.col("status"), F.col("run_id") % 4, F.lit(2)).alias("next_step"))


def known_routes(spark, d):
    raw = pick(ROUTES, F.col("event_id"))
    return events(spark, d).select("event_id", rules.known_route(raw).alias("route"))


def consents(spark, d):
    return events(spark, d).select("event_id", rules.consent(pick(ANSWERS, F.col("event_id"))).alias("agrees"))


def search_errors(spark, d):
    return events(spark, d).select("event_id", P.search_error(pick(ERRORS, F.col("event_id"))).alias("e")).select("event_id", "e.status", "e.code")


def serp_pagination(spark, d):
    found = M.serp(spark, d).groupBy("query_id", "engine").agg(F.count(F.lit(1)).alias("results"))
    start, limit = F.col("query_id") % 5 * 10, F.col("query_id") % 4 * 10
    return found.select("query_id", "engine", P.pagination(F.col("results"), start, limit).alias("p")).select("query_id", "engine", "p.page", "p.has_more", "p.next_start")


def response_formats(spark, d):
    """Formats asked for in the properties of events, an Accept header by their kind."""
    asked = pick(FORMATS, F.length("props"))
    r = P.response_format(asked, pick(ACCEPTS, F.length("event_type")))
    return events(spark, d).select("event_id", r.alias("r")).select("event_id", "r.format", "r.error")


def degrade_modes(spark, d):
    return events(spark, d).select("event_id", R.degrade_mode(F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("mode"))


def sigmoids(spark, d):
    return events(spark, d).select("event_id", F.round(R.sigmoid((F.col("event_id") % 2001 - 1000).cast("double")), 9).alias("score"))


def cosine_of_neighbours(spark, d):
    v = M.table(spark, d, "embeddings").select("vec_id", "embedding")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(R.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def query_keys(spark, d):
    """The key of each asked text, and that of the same asked of several engines."""
    q = M.table(spark, d, "benchmark")
    key = U.query_hash(F.col("text"), F.when(F.col("item_id") % 2 == 0, "e.org"), F.lit(""), F.lit("de"), F.lit(None).cast("string"))
    n = F.col("item_id")
    names = F.array(F.lit("Bing"), F.when(n % 3 == 0, "baidu ").otherwise("google"), F.lit("bing"))
    mega = U.mega_key(
        engines=names, mode=F.when(n % 5 == 0, "fast").otherwise("balanced"), merge=n % 2 == 0, dedupe=n % 3 > 0, action=F.lit("search"), text=F.col("text"), lang=F.lit("de"), dates=F.lit(""), file=F.lit(""), site=F.when(n % 2 == 0, "e.org"),
        limit=n % 4 * 10, start=F.lit(0), filtered=F.lit(True), answers=n % 7 == 0, country=F.when(n % 4 == 1, " AT"), kind=F.lit(""), provider=F.lit("P"),
    )
    return q.select("item_id", key.alias("query_key"), mega.alias("mega_key"))


def masked_proxies(spark, d):
    """Error texts that hold addresses with and without credentials, some of which no proxy has."""
    url = F.concat(pick(["http://u:p@", "SOCKS5://name@", "https://", "ftp://u:p@"], F.col("c_custkey")), F.lower("c_mktsegment"), F.lit(".e.org:80/a"), pick(["", ").", "?x=1;"], F.length("c_name")))
    return M.table(spark, d, "customer").select("c_custkey", U.mask_credentials(F.concat(F.lit("dial "), url, F.lit(" failed"))).alias("detail"))


def display_names(spark, d):
    """Documents by title, else file name, else unknown; kinds of source by language."""
    title = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("a/b/"), "source"))
    name = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("/files/"), "source", F.lit(".md")))
    kind = F.when(F.col("lang") == "en", "feishu").when(F.col("lang") == "de", "google_drive").when(F.col("lang") == "fr", "")
    return M.table(spark, d, "documents").select("doc_id", T.display_name(kind, title, name).alias("name"))


def chunk_policies(spark, d):
    kind = pick(KINDS, F.col("doc_id"))
    return M.table(spark, d, "documents").select("doc_id", T.chunk_policy(kind).alias("p")).select("doc_id", "p.size", "p.overlap", "p.kind")


def embedding_texts(spark, d):
    return M.chunks(spark, d).select("chunk_id", F.md5(T.embedding_text(F.col("content"), pick(TEXT_KINDS, F.col("chunk_id")))).alias("text_md5"))


def header_split(spark, d):
    """Documents whose lines are made headings, split at these."""
    parts = T.by_headers(F.replace(F.col("text"), F.lit("\n"), F.lit("\n# ")))
    return M.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(parts).cast("bigint").alias("parts"), F.md5(F.array_join(parts, "|")).alias("parts_md5"))


def hit_windows(spark, d):
    """Each chunk as the hit in its document, cut to 300 letters around it."""
    text = M.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    rows = M.chunks(spark, d).join(text, "document_id")
    return rows.select("chunk_id", F.md5(C.truncate_around(F.col("text"), F.col("content"), 300)).alias("window_md5"))


def chunk_pages(spark, d):
    """The second of two pages of 500 chunks in order of the key."""
    chunks = M.chunks(spark, d).select("chunk_id", "document_id")
    last = L.keyset_page(chunks, "chunk_id", None, 500).agg(F.max("chunk_id")).first()[0]
    return L.keyset_page(chunks, "chunk_id", last, 500)


def index_without_documents(spark, d):
    chunks = M.chunks(spark, d)
    left = L.delete_documents(chunks, M.documents(spark, d).where("status = 'pending'"))
    return left.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_search(spark, d):
    rows = M.chunks(spark, d).withColumn("vector", F.when(F.col("chunk_id") % 3 == 0, F.array(F.lit(1.0))))
    return A.search_chunks(rows, "THE%", "indexed").select("chunk_id").unionByName(A.search_chunks(rows, "the ", "indexed").select("chunk_id")).unionByName(A.search_chunks(rows, "m3", "error").select("chunk_id"))


def chunk_rows(spark, d):
    rows = M.chunks(spark, d)
    meta, vector = F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("m"), "chunk_id")), F.when(F.col("chunk_id") % 3 == 0, F.array(F.lit(1.0)))
    return rows.select("chunk_id", B.chunk_row(F.col("content"), F.col("chunk_id"), meta, vector).alias("r")).select("chunk_id", "r.id", "r.char_count", "r.vector_status")


def coalesced_requests(spark, d):
    return B.coalesced(M.attempts(spark, d).select("engine", F.col("query_id").alias("query")))


def proxy_stats(spark, d):
    tags = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("eu"), F.lit("fast"))).when(F.col("c_custkey") % 4 == 1, F.array(F.lit("us"))).otherwise(F.array().cast("array<string>"))
    return B.proxy_stats(M.table(spark, d, "customer").select(F.col("c_name").alias("url"), tags.alias("tags"), (F.col("c_custkey") % 5).alias("failures")))


def bound_images(spark, d):
    """Each chunk of every third document shows the image of the upload with its document's number."""
    shown = F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("![x](/files/img"), "document_id", F.lit("/file-preview)"))).otherwise("")
    chunks = M.chunks(spark, d).select("chunk_id", "document_id", F.lit(1).alias("tenant_id"), F.concat("content", shown).alias("content"))
    uploads = M.table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.lit(1).alias("tenant_id"), F.concat(F.lit("up/img"), F.col("doc_id") - F.col("doc_id") % 2, F.lit(".png")).alias("key"))
    return B.bind_images(chunks, uploads)


#: Words that name departments, one that names two, and none.
NAMING = ["系统 down", "请假", "报销 and 销售", "合同", "weather", "产品 教程"]


def base_routes(spark, d):
    """Turns of conversations, each with a word, as questions; nations as bases listed backwards, some of the departments without one."""
    bases = M.table(spark, d, "nation").select(F.col("n_nationkey").alias("kb_id"), F.when(F.col("n_nationkey") < 5, F.col("n_nationkey")).alias("department_id"), pick(["tech", "hr", "product", None], F.col("n_nationkey")).alias("department_code"), (-F.col("n_nationkey")).alias("place"))
    asked = M.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat_ws(" ", F.col("text"), pick(NAMING, F.length("text"))).alias("text"), (F.length("text") % 10).cast("bigint").alias("department_id"))
    return rules.base_route(asked, bases)


def image_links(spark, d):
    href = F.concat(F.lit("/imgres?imgurl="), F.url_encode("url"), F.lit("&imgrefurl=https%3A%2F%2Fe.org%2F"), "page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&w="), F.col("page_id") % 900, F.lit("&h=20"))).otherwise(""))
    return M.table(spark, d, "pages").select("page_id", U.image_link(href).alias("i")).select("page_id", "i.url", "i.page", "i.width", "i.height")


def stage_counts(spark, d):
    s = M.serp(spark, d)
    return R.stage_counts(found=s, top=s.where("rank <= 3"), ads=s.where("ad"))


def error_kinds(spark, d):
    """Page addresses as error texts: only those that hold a mark of a class have one."""
    text = F.concat(pick(["HTTP 429 at ", "Timed out: ", "Unauthorized ", "forbidden ", "bad: invalid ", "page Not Found ", "connection to ", "all well at "], F.col("page_id")), "url")
    return M.table(spark, d, "pages").select("page_id", rules.error_class(text).alias("kind"), rules.retryable(text).alias("retryable"))


QUERIES = {
    f.__name__: f
    for f in (
        import_outcomes, backoff_schedule, followups, known_routes, consents, search_errors, serp_pagination, response_formats, degrade_modes, sigmoids, cosine_of_neighbours, query_keys, masked_proxies, display_names, chunk_policies, embedding_texts, header_split, hit_windows, chunk_pages,
        index_without_documents, chunk_search, chunk_rows, coalesced_requests, proxy_stats, bound_images, base_routes, image_links, stage_counts, error_kinds,
    )
}

V = M.with_views
E = "event_id"
EDGE = r"'^[\s]+|[\s]+$'"


def sql_class(text: str) -> str:
    marks = " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rules.ERRORS)
    return f"CASE {marks} ELSE 'unknown' END"


NO, YES = (" OR ".join(f"contains(t, '{w}')" for w in words) for words in (rules.NO, rules.YES))
CODES = ", ".join(f"('{k}', {s}, '{c}')" for k, (s, c) in P.SEARCH_ERRORS.items())
KIND_TEXT = sql_pick(["HTTP 429 at ", "Timed out: ", "Unauthorized ", "forbidden ", "bad: invalid ", "page Not Found ", "connection to ", "all well at "], "page_id")
ORACLE_SQL = {
    "import_outcomes": f"SELECT doc_id, status, CASE WHEN status IS NULL THEN 'new' WHEN status = 'ready' THEN 'already_indexed' WHEN status IN ('pending', 'indexing') THEN 'in_progress' ELSE 'continue' END AS outcome FROM (SELECT doc_id, {sql_pick(STATES, 'doc_id')} AS status FROM documents)",
    "backoff_schedule": "SELECT event_id, event_id % 9 + 1 AS attempt, least(30.0::DOUBLE, pow(2, event_id % 9)) AS seconds FROM events",
    "followups": V("SELECT run_id, CASE WHEN status = 'failed' AND run_id % 4 < 2 THEN 'retry_decision' WHEN status = 'failed' THEN 'fallback_finalize' ELSE 'finalize_response' END AS next_step FROM runs", "runs"),
    "known_routes": f"SELECT event_id, CASE WHEN r IN ({', '.join(repr(x) for x in rules.PLANS)}) THEN r ELSE 'fallback_chat' END AS route FROM (SELECT event_id, trim(split_part(trim(coalesce(raw, '')), chr(10), 1)) AS r FROM (SELECT event_id, {sql_pick(ROUTES, E)} AS raw FROM events))",
    "consents": f"SELECT event_id, NOT ({NO}) AND ({YES}) AS agrees FROM (SELECT event_id, lower(trim({sql_pick(ANSWERS, E)})) AS t FROM events)",
    "search_errors": f"SELECT event_id, CAST(coalesce(status, 502) AS INT) AS status, coalesce(code, 'engine_internal') AS code FROM (SELECT event_id, {sql_pick(ERRORS, E)} AS kind FROM events) LEFT JOIN (VALUES {CODES}) c(kind, status, code) USING (kind)",
    "serp_pagination": V("SELECT query_id, engine, CAST(start // lim + 1 AS BIGINT) AS page, n >= lim AS has_more, CAST(start + lim AS BIGINT) AS next_start FROM (SELECT query_id, engine, count(*) AS n, query_id % 5 * 10 AS start, CASE WHEN query_id % 4 = 0 THEN 25 ELSE query_id % 4 * 10 END AS lim FROM serp GROUP BY ALL)", "serp"),
    "response_formats": f"SELECT event_id, CASE WHEN r IN ('json', 'markdown', 'text', 'ndjson') THEN r END AS format, CASE WHEN r NOT IN ('json', 'markdown', 'text', 'ndjson') THEN 'UNKNOWN_FORMAT' END AS error FROM (SELECT event_id, CASE WHEN f <> '' THEN f WHEN contains(a, 'text/markdown') THEN 'markdown' WHEN contains(a, 'text/plain') THEN 'text' WHEN contains(a, 'application/x-ndjson') THEN 'ndjson' ELSE 'json' END AS r FROM (SELECT event_id, trim(lower(coalesce({sql_pick(FORMATS, 'length(props)')}, ''))) AS f, lower(coalesce({sql_pick(ACCEPTS, 'length(event_type)')}, '')) AS a FROM events))",
    "degrade_modes": "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'both_failed' WHEN event_id % 2 = 0 THEN 'bm25_only' WHEN event_id % 3 = 0 THEN 'vector_only' ELSE 'none' END AS mode FROM events",
    "sigmoids": "SELECT event_id, round(1 / (1 + exp(-CAST(least(500, greatest(-500, event_id % 2001 - 1000)) AS DOUBLE))), 9) AS score FROM events",
    "cosine_of_neighbours": "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "query_keys": "SELECT item_id, md5(lower(trim(concat_ws('|', text, site, '', 'de', '')))) AS query_key, sha256(concat_ws('|', 'mega:' || CASE WHEN item_id % 5 = 0 THEN 'fast' ELSE 'balanced' END || ':' || (item_id % 2 = 0) || ':' || (item_id % 3 > 0) || ':' || CASE WHEN item_id % 3 = 0 THEN 'baidu,bing' ELSE 'bing,google' END, 'search', text, 'de', '', '', site, item_id % 4 * 10, 0, true, item_id % 7 = 0, CASE WHEN item_id % 4 = 1 THEN 'at' ELSE 'de' END, '', 'p')) AS mega_key FROM (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'e.org' ELSE '' END AS site FROM benchmark)",
    "masked_proxies": "SELECT c_custkey, 'dial ' || CASE c_custkey % 4 WHEN 0 THEN 'http://' || h || t WHEN 1 THEN 'socks5://' || h || t WHEN 2 THEN 'https://' || h || p || q ELSE 'invalid-proxy' || t END || ' failed' AS detail FROM (SELECT c_custkey, lower(c_mktsegment) || '.e.org:80' AS h, '/a' AS p, (['', ').', '?x=1;'])[length(c_name) % 3 + 1] AS q, (['', ').', ';'])[length(c_name) % 3 + 1] AS t FROM customer)",
    "display_names": "SELECT doc_id, CASE lang WHEN 'en' THEN '飞书文档-' WHEN 'de' THEN 'Google Drive-' ELSE '知识库-' END || CASE WHEN n_chars % 3 = 0 THEN source WHEN n_chars % 2 = 0 THEN source || '.md' ELSE '未知文档' END AS name FROM documents",
    "chunk_policies": f"SELECT doc_id, CASE WHEN k = 'md' THEN {CONFIG.chunk_md} WHEN k IN ('png', 'jpeg', 'gif') THEN {CONFIG.chunk_image} WHEN k = 'docx' THEN {CONFIG.chunk_word} ELSE {CONFIG.chunk_other} END AS size, CASE WHEN k IN ('md', 'docx') THEN 100 ELSE 50 END AS overlap, CASE WHEN k = 'md' THEN 'md_structured' WHEN k IN ('png', 'jpeg', 'gif') THEN 'image_vision' WHEN k = 'docx' THEN 'word_structured' ELSE 'recursive' END AS kind FROM (SELECT doc_id, {sql_pick(KINDS, 'doc_id')} AS k FROM documents)",
    "embedding_texts": V("SELECT chunk_id, md5(CASE chunk_id % 4 WHEN 0 THEN '图片内容检索文本：' WHEN 1 THEN 'Markdown文档片段：' WHEN 2 THEN 'Word文档片段：' ELSE '' END || trim(content)) AS text_md5 FROM chunks", "chunks"),
    "header_split": f"SELECT doc_id, CAST(len(ps) AS BIGINT) AS parts, md5(array_to_string(ps, '|')) AS parts_md5 FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || '# '), chr(10) || '# '), lambda x, i: regexp_replace(CASE WHEN i > 1 THEN '# ' ELSE '' END || x, {EDGE}, '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL)",
    "hit_windows": V(
        "WITH r AS (SELECT chunk_id, text, trim(content) AS h, length(trim(content)) AS n FROM chunks JOIN documents ON doc_id = document_id), p AS (SELECT *, CASE WHEN strpos(text, h) > 0 THEN strpos(text, h) - 1 WHEN strpos(text, substring(h, 1, 60)) > 0 THEN strpos(text, substring(h, 1, 60)) - 1 ELSE length(text) // 2 END AS at0 FROM r) "
        "SELECT chunk_id, md5(CASE WHEN length(text) <= 300 THEN text WHEN n >= 300 THEN substring(h, 1, 300) ELSE substring(text, least(greatest(at0 - CAST(floor((300 - n) / 2) AS BIGINT), 0), greatest(length(text) - 300, 0)) + 1, 300) END) AS window_md5 FROM p",
        "chunks",
    ),
    "chunk_pages": V("SELECT chunk_id, document_id FROM chunks ORDER BY chunk_id LIMIT 500 OFFSET 500", "chunks"),
    "index_without_documents": V("SELECT document_id, count(*) AS chunks FROM chunks WHERE document_id % 20 <> 0 GROUP BY 1", "chunks"),
    "chunk_search": V("SELECT chunk_id FROM chunks WHERE chunk_id % 3 = 0 AND contains(lower(content), 'the%') UNION ALL SELECT chunk_id FROM chunks WHERE chunk_id % 3 = 0 AND contains(lower(content), 'the ')", "chunks"),
    "chunk_rows": V("SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'm' || chunk_id ELSE CAST(chunk_id AS VARCHAR) END AS id, CAST(length(content) AS INT) AS char_count, CASE WHEN chunk_id % 3 = 0 THEN 'indexed' ELSE 'pending' END AS vector_status FROM chunks", "chunks"),
    "coalesced_requests": V("SELECT engine, query_id AS query, count(*) AS requests FROM attempts GROUP BY ALL", "attempts"),
    "proxy_stats": "WITH p AS (SELECT c_custkey % 5 AS f, CASE c_custkey % 4 WHEN 0 THEN ['eu', 'fast'] WHEN 1 THEN ['us'] ELSE [] END AS tags FROM customer), t AS (SELECT f, unnest(tags) AS tag FROM p UNION ALL SELECT f, NULL FROM p) SELECT tag, count(*) AS configured, count(*) FILTER (f < 3) AS healthy, count(*) FILTER (f >= 3) AS unhealthy FROM t GROUP BY 1",
    "bound_images": V("SELECT document_id, chunk_id AS segment_id, min(d.doc_id) AS attachment_id FROM chunks JOIN documents d ON d.doc_id - d.doc_id % 2 = document_id WHERE document_id % 3 = 0 GROUP BY ALL", "chunks"),
    "base_routes": f"WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text || ' ' || {sql_pick(NAMING, 'length(text)')} AS t, length(text) % 10 AS dep FROM conversations), b AS (SELECT n_nationkey AS kb, (['tech', 'hr', 'product', NULL])[n_nationkey % 4 + 1] AS code FROM nation) SELECT query_id, CASE WHEN dep < 5 THEN dep WHEN regexp_matches(t, '技术|代码|编程|开发|系统|软件') THEN (SELECT max(kb) FROM b WHERE code = 'tech') WHEN regexp_matches(t, '制度|请假|报销|薪资|人事|员工') THEN (SELECT max(kb) FROM b WHERE code = 'hr') WHEN regexp_matches(t, '产品|功能|使用|教程') THEN (SELECT max(kb) FROM b WHERE code = 'product') ELSE (SELECT max(kb) FROM b) END AS kb_id FROM q",
    "image_links": "SELECT page_id, url, 'https://e.org/' || page_id AS page, CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 900 END AS INT) AS width, CAST(CASE WHEN page_id % 2 = 0 THEN 20 END AS INT) AS height FROM pages",
    "stage_counts": V("SELECT query_id, count(*) AS found, count(*) FILTER (rank <= 3) AS top, count(*) FILTER (ad) AS ads FROM serp GROUP BY 1", "serp"),
    "error_kinds": f"SELECT page_id, kind, kind NOT IN ('auth', 'permission', 'validation', 'not_found') AS retryable FROM (SELECT page_id, {sql_class('m')} AS kind FROM (SELECT page_id, lower({KIND_TEXT} || url) AS m FROM pages))",
}
