"""Queries of what a user may see, of the page of bases, of indexing states, domain endings and tables without sequence numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions import urls as U
from corpusloom.operators import analytics as A
from corpusloom.operators import context as C
from corpusloom.operators import serp as P
from corpusloom.plans import retrieval as R
from corpusloom.plans.more import pick, sql_pick
from corpusloom.plans.search import HOST
from corpusloom.sources import model as M

#: Who asks: name, role, tenant and user; an admin sees bases en and de.
ASKERS = [("root", "super_admin", 1, 0), ("boss", "admin", 1, 0), ("one", "user", 1, 7)]
VISIBLE = ["en", "de"]
AS_OF, DAYS = "1998-08-02", 400
HOSTS = ["a.b.co.uk", "www.ck", "x.www.ck", "shop.any.ck", "any.ck", "a.city.kawasaki.jp", "a.b.kawasaki.jp", "co.uk", "localhost", "a.b.unknown", "de", "x.com.br"]
STAGES = ["started", "downloaded", "cleaned", "chunked", "stored", "other"]


def conversation_table(spark, d):
    """Customers as conversations: of three tenants, over four bases."""
    kb = pick(["en", "de", "fr", "es"], F.col("c_nationkey"))
    return M.table(spark, d, "customer").select(F.col("c_custkey").alias("conversation_id"), (F.col("c_custkey") % 3).cast("int").alias("tenant_id"), F.col("c_custkey").alias("user_id"), kb.alias("kb_id"))


def by_asker(spark, d, made):
    bases = spark.createDataFrame([(b,) for b in VISIBLE], "kb_id string")
    out = []
    for name, role, tenant, user in ASKERS:
        scope = A.conversation_scope(conversation_table(spark, d), bases, role=role, tenant=tenant, user=user)
        out.append(made(scope).withColumn("asker", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), out)


def scoped_usage(spark, d):
    """Usage of the conversations that each asker sees."""
    return by_asker(spark, d, lambda scope: A.usage_stats(A.scoped(M.messages(spark, d), scope), "2024-01-30 12:00:00"))


def _runs(spark, d):
    return M.runs(spark, d).withColumn("conversation_id", F.col("user_id"))


def scoped_agent_metrics(spark, d):
    """Agent figures of a window of days over the conversations that each asker sees."""
    return by_asker(spark, d, lambda scope: A.agent_metrics(A.scoped(_runs(spark, d), scope), M.steps(spark, d), AS_OF, DAYS))


def scoped_agent_trend(spark, d):
    return by_asker(spark, d, lambda scope: A.agent_trend(A.scoped(_runs(spark, d), scope), M.steps(spark, d), AS_OF, DAYS))


def base_page(spark, d):
    """The second page of nations as bases, regions as departments (some gone), customers as their documents."""
    bases = M.table(spark, d, "nation").select(F.col("n_nationkey").alias("kb_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_regionkey")).alias("department_id"), F.col("n_name").alias("created_at"))
    departments = M.table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("department_id"), F.col("r_name").alias("department_name"))
    docs = M.table(spark, d, "customer").where("c_nationkey % 3 > 0").select(F.col("c_nationkey").alias("kb_id"))
    return A.base_page(bases, departments, docs, 2, 7)


def indexing_states(spark, d):
    """Orders as documents in stages, with errors and tries."""
    key = F.col("o_orderkey")
    error = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return M.table(spark, d, "orders").select("o_orderkey", rules.indexing_state(pick(STAGES, key), error, key % 5).alias("s")).select("o_orderkey", "s.*")


def domain_endings(spark, d):
    """Pages' hosts, and hosts that tell the rules apart, with their endings."""
    host = F.when(F.col("page_id") % 2 == 0, U.domain(F.col("url"))).otherwise(F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (F.floor(F.col("page_id") / 2) % len(HOSTS) + 1).cast("int")))
    hosts = M.table(spark, d, "pages").select("page_id", host.alias("host"))
    return P.with_suffix(hosts, P.suffix_table(spark, P.SUFFIX_RULES)).select("page_id", "host", "tld", "sld")


def rebuilt_blocks(spark, d):
    """Blocks of a table of which half of the documents have no sequence numbers: order by chunk index, by page and offset, or by id."""
    doc, seq = F.col("document_id"), F.col("sequence_no")
    meta = F.when(doc % 4 == 2, F.to_json(F.struct(seq.alias("chunk_index")))).when(doc % 8 == 0, F.to_json(F.struct(F.floor(seq / 3).alias("page"), seq.alias("start_offset"))))
    chunks = M.chunks(spark, d).withColumn("meta", meta).withColumn("sequence_no", F.when(doc % 2 == 1, seq).otherwise(0))
    return C.rebuilt_blocks(chunks).drop("content")


def index_jobs(spark, d):
    """Customers as documents of nations as bases, whose regions are the tenants; some nations are no bases."""
    c = M.table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 5 < 3, F.lower("c_mktsegment"))
    docs = c.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"), kind.alias("source_type"), F.col("c_nationkey").alias("kb_id"))
    bases = M.table(spark, d, "nation").where("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("kb_id"), F.col("n_regionkey").alias("tenant_id"))
    return A.index_jobs(docs, bases)


QUERIES = {f.__name__: f for f in (scoped_usage, scoped_agent_metrics, scoped_agent_trend, base_page, indexing_states, domain_endings, rebuilt_blocks, index_jobs)}

CONVERSATIONS = "SELECT c_custkey AS conversation_id, c_custkey % 3 AS tenant_id, c_custkey AS user_id, (['en', 'de', 'fr', 'es'])[c_nationkey % 4 + 1] AS kb_id FROM customer"
SCOPE = {"root": "c.tenant_id = 1", "boss": "c.tenant_id = 1 AND c.kb_id IN ('en', 'de')", "one": "c.tenant_id = 1 AND c.user_id = 7"}
RECENT = "created_at >= TIMESTAMP '1998-08-02' - INTERVAL 400 DAY"


def scoped_sql(made: str, rows: str, *views: str) -> str:
    """made is SQL over rows (r) of an asker's conversations, with {who} for the asker."""
    parts = " UNION ALL ".join("(" + made.replace("{rows}", f"(SELECT r.* EXCLUDE (user_id), c.user_id FROM ({rows}) r JOIN convs c USING (conversation_id) WHERE {condition})").replace("{who}", f"'{who}'") + ")" for who, condition in SCOPE.items())
    return M.with_views(f"WITH convs AS ({CONVERSATIONS}) {parts}", *views)


ORACLE_SQL = {
    "index_jobs": "SELECT c_custkey AS document_id, c_name AS title, CASE WHEN c_custkey % 5 IN (1, 2) THEN lower(c_mktsegment) ELSE 'local' END AS source_type, c_nationkey AS kb_id, n_regionkey AS tenant_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 4 <> 3",
    "scoped_usage": scoped_sql(
        "SELECT count(*) FILTER (role = 'user') AS questions, count(*) AS messages, count(*) FILTER (role = 'user' AND created_at >= TIMESTAMP '2024-01-30') AS questions_today, count(DISTINCT user_id) FILTER (created_at >= TIMESTAMP '2024-01-30') AS users_today, "
        "CAST(coalesce(floor(avg(latency_ms) FILTER (role = 'assistant' AND latency_ms > 0)), 0) AS BIGINT) AS avg_latency_ms, CAST(coalesce(floor(avg(token_count) FILTER (token_count > 0)), 0) AS BIGINT) AS avg_tokens, {who} AS asker FROM {rows}",
        "SELECT * FROM messages", "messages",
    ),
    "scoped_agent_metrics": scoped_sql(
        "SELECT *, CASE WHEN total > 0 THEN round(completed / total, 4) ELSE 0 END AS completion_rate, CASE WHEN total > 0 THEN round(failed / total, 4) ELSE 0 END AS failure_rate, CASE WHEN retry_runs > 0 THEN round(retry_success_runs / retry_runs, 4) ELSE 0 END AS retry_success_rate, {who} AS asker FROM ("
        "SELECT count(DISTINCT run_id) AS total, count(DISTINCT run_id) FILTER (status = 'completed') AS completed, count(DISTINCT run_id) FILTER (status = 'failed') AS failed, count(DISTINCT run_id) FILTER (step_type = 'retry_decision') AS retry_runs, count(DISTINCT run_id) FILTER (step_type = 'retry_decision' AND step_status = 'success') AS retry_success_runs, "
        "round(coalesce(count(step_type) / nullif(count(DISTINCT CASE WHEN step_type IS NOT NULL THEN run_id END), 0), 0), 4) AS steps_per_run FROM (SELECT r.*, s.step_type, s.status AS step_status FROM {rows} r LEFT JOIN steps s USING (run_id)))",
        f"SELECT *, user_id AS conversation_id FROM runs WHERE {RECENT}", "runs", "steps",
    ),
    "scoped_agent_trend": scoped_sql(
        "SELECT CAST(created_at AS DATE) AS day, count(DISTINCT run_id) AS runs, count(DISTINCT run_id) FILTER (status = 'completed') AS completed, count(DISTINCT run_id) FILTER (status = 'failed') AS failed, count(DISTINCT run_id) FILTER (step_type = 'retry_decision') AS retries, {who} AS asker FROM (SELECT r.*, s.step_type FROM {rows} r LEFT JOIN steps s USING (run_id)) GROUP BY 1",
        f"SELECT *, user_id AS conversation_id FROM runs WHERE {RECENT}", "runs", "steps",
    ),
    "base_page": "SELECT n_nationkey AS kb_id, n_name AS name, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey END AS department_id, r_name AS department_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_nationkey % 3 > 0) AS documents, n_name AS created_at FROM (SELECT * FROM nation ORDER BY n_name DESC, n_nationkey LIMIT 7 OFFSET 7) LEFT JOIN region ON r_regionkey = n_regionkey AND n_nationkey % 4 > 0 AND r_regionkey <> 2",
    "indexing_states": f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN s = 'stored' THEN 'ready' WHEN s = 'other' THEN 'pending' ELSE 'indexing' END AS status, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CASE s WHEN 'started' THEN 5 WHEN 'downloaded' THEN 10 WHEN 'cleaned' THEN 30 WHEN 'chunked' THEN 80 WHEN 'stored' THEN 100 ELSE 0 END END AS progress, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 5 WHEN 0 THEN 60 WHEN 1 THEN 300 WHEN 2 THEN 600 END END AS retry_after FROM (SELECT *, {sql_pick(STAGES, 'o_orderkey')} AS s FROM orders)",
    "domain_endings": (
        f"WITH h AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {HOST.format('url')} ELSE ([{', '.join(repr(h) for h in HOSTS)}])[(page_id // 2) % {len(HOSTS)} + 1] END AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS l, len(string_split(host, '.')) AS n FROM h), "
        f"r AS (SELECT unnest([{', '.join(repr(r) for r in P.SUFFIX_RULES)}]) AS rule), e AS (SELECT page_id, n, l, unnest(range(1, n + 1)) AS k FROM p), s AS (SELECT page_id, k, array_to_string(l[n - k + 1:], '.') AS own, array_to_string(list_concat(['*'], l[n - k + 2:]), '.') AS wild FROM e), "
        "m AS (SELECT page_id, max(CASE WHEN rule = '!' || own THEN k - 1 END) AS ex, max(CASE WHEN rule IN (own, wild) THEN k END) AS len FROM s JOIN r ON rule IN (own, wild, '!' || own) GROUP BY 1), "
        "t AS (SELECT p.*, coalesce(ex, len, 1) AS k FROM p LEFT JOIN m USING (page_id)) SELECT page_id, host, array_to_string(l[n - k + 1:], '.') AS tld, CASE WHEN n = 1 THEN '' WHEN k >= n THEN l[n - 1] ELSE l[n - k] END AS sld FROM t"
    ),
    "rebuilt_blocks": f"WITH RECURSIVE raw AS ({M.VIEWS['chunks']}), chunks AS (SELECT * REPLACE (row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN document_id % 8 = 4 THEN 0 ELSE sequence_no END, CAST(chunk_id AS VARCHAR)) - 1 AS sequence_no) FROM raw), {R.BLOCKS.removeprefix('RECURSIVE ')} SELECT document_id, block_no, start_sequence, end_sequence, children, CAST(greatest(1, length(content) // 3) AS BIGINT) AS token_count, sha256('v1::' || content) AS content_hash FROM blocks",
}
