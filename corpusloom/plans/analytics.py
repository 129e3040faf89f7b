"""Queries of usage, agents, search attempts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import analytics as A
from corpusloom.sources import model as M
from corpusloom.streaming import streams as S

FIRST, LAST = "2024-01-01", "2024-01-31"


def usage_stats(spark, d):
    return A.usage_stats(M.messages(spark, d), "2024-01-30 12:00:00")


def popular_queries(spark, d):
    return A.popular_queries(M.messages(spark, d), 10)


def query_trend(spark, d):
    return A.daily_trend(M.messages(spark, d).where("role = 'user'"), "created_at", M.AS_OF, 14)


def dense_search_trend_all(spark, d):
    """dense_search_trend of all attempts."""
    return A.dense_trend(M.attempts(spark, d), "at", FIRST, LAST, requests=F.lit(True), failed=~F.col("ok"))


def dense_search_trend(spark, d):
    return A.dense_trend(M.attempts(spark, d), "at", FIRST, LAST, requests=F.lit(True), failed=~F.col("ok"))


def agent_metrics(spark, d):
    return A.agent_metrics(M.runs(spark, d), M.steps(spark, d))


def agent_trend(spark, d):
    return A.agent_trend(M.runs(spark, d), M.steps(spark, d))


def error_distribution(spark, d):
    return A.error_distribution(M.runs(spark, d))


def steps_per_run(spark, d):
    return M.steps(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 6).alias("steps_per_run"))


def latency_summary_p95(spark, d):
    return A.latency_summary(M.attempts(spark, d))


def engine_health(spark, d):
    """Each user's view of the six engines: one without a call is not there, one whose last call failed has an open breaker."""
    last = M.attempts(spark, d).groupBy("query_id", "engine").agg(F.max_by("ok", "attempt_id").alias("ok"), F.max("latency_ms").alias("most"))
    engines = last.select("query_id", "engine", (F.col("most") >= 20).alias("initialized"), F.when(F.col("ok"), "closed").otherwise("open").alias("circuit"))
    return A.engine_health(engines, ["query_id"])


def engine_stats(spark, d):
    return A.engine_stats(M.attempts(spark, d))


def fastest_engine(spark, d):
    return A.fastest_engine(M.attempts(spark, d))


def first_success(spark, d):
    return A.first_success(M.attempts(spark, d))


def document_page(spark, d):
    return A.document_page(M.documents(spark, d), page=2, size=25, q="SRC1", status="ready", sort="name_desc").select("document_id", "title", "status", "total")


def document_status_counts(spark, d):
    return A.status_counts(M.documents(spark, d))


def document_progress(spark, d):
    chunks = M.chunks(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    rows = M.documents(spark, d).join(chunks, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    status = F.when(F.col("status") == "pending", "indexing").otherwise("ready")
    return rows.select("document_id", "chunks", A.progress(status, F.lit(None).cast("bigint"), F.col("chunks")).alias("progress"))


def kb_visibility(spark, d):
    """Customers as bases of a region's tenant; the nation is the department, every fifth has none."""
    nation = M.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("tenant_id"))
    bases = M.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("kb_id"), "tenant_id", F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_nationkey")).alias("department_id"))
    seen = [A.visible_bases(bases, role, 1, department).withColumn("asker", F.lit(name)) for name, role, department in (("super", "super_admin", 2), ("admin", "admin", 2), ("user", "user", None))]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


def conversation_counts(spark, d):
    return M.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("questions"))


def latest_run(spark, d):
    return A.latest_per(M.runs(spark, d), "user_id", ["created_at", "run_id"]).select("user_id", "run_id", "status")


def recent_messages(spark, d):
    return A.recent(M.table(spark, d, "conversations"), "conv_id", ["turn"], 3).select("conv_id", "at", "turn", "role")


def oldest_messages(spark, d):
    return A.recent(M.table(spark, d, "conversations"), "conv_id", ["turn"], 3, newest=False).select("conv_id", "at", "turn", "role")


def idempotent_receipts(spark, d):
    rows = M.table(spark, d, "events").select("event_id", F.concat_ws(":", "user_id", "event_type").alias("message_key"))
    return A.new_receipts(rows, rows.where("event_id % 1000 = 7").select("message_key"), ["message_key"], ["event_id"])


def old_vector_documents(spark, d):
    """Documents that have chunks of a stale kind: a left join, a filtered count and a condition on it."""
    chunks = M.chunks(spark, d).select("document_id", (F.length("content") < 40).alias("stale"))
    per = M.documents(spark, d).join(chunks, "document_id", "left").groupBy("document_id").agg(F.count("stale").alias("chunks"), F.count_if("stale").alias("stale"))
    return per.where("stale > 0")


def migration_audit(spark, d):
    part = lambda t, name: t.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    docs = M.documents(spark, d)
    return part(docs, "all").unionByName(part(docs.where("status = 'ready'"), "ready")).unionByName(part(docs.where("status = 'pending'"), "pending"))


def run_history(spark, d):
    return rules.step_history(M.steps(spark, d))


def miss_mode(spark, d):
    rows = M.table(spark, d, "events").select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("at"), F.col("event_type").isin("view", "click").alias("hit"), (F.col("event_id") % 9 == 0).alias("bypass"))
    return rules.miss_mode(rows)


def counters_daily_stream(spark, d):
    return S.drained(S.daily_counters(S.event_stream(spark, d)), "complete", keep="last")


def receipts_stream(spark, d):
    return S.drained(S.receipts(S.event_stream(spark, d)), "append")


def breaker_batch(spark, d):
    return S.breaker_batch(M.attempts(spark, d))


def breaker_stream(spark, d):
    events = S.event_stream(spark, d)
    rows = events.select((F.col("event_id") % 6).alias("engine"), F.col("ts").alias("at"), F.col("event_id").alias("attempt_id"), (F.col("event_type") != "error").alias("ok"))
    return S.drained(S.breaker_stream(rows), "update", keep="last")


QUERIES = {
    f.__name__: f
    for f in (
        usage_stats, popular_queries, query_trend, dense_search_trend, dense_search_trend_all, agent_metrics, agent_trend, error_distribution, steps_per_run, latency_summary_p95, engine_health, engine_stats, fastest_engine, first_success, document_page, document_status_counts, document_progress, kb_visibility,
        conversation_counts, latest_run, recent_messages, oldest_messages, idempotent_receipts, old_vector_documents, migration_audit, run_history, miss_mode, counters_daily_stream, receipts_stream, breaker_batch, breaker_stream,
    )
}

V = M.with_views
RECENT = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn {0}) AS n FROM conversations) WHERE n <= 3"
HEALTH = "SELECT engine, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, round(avg(latency_ms) FILTER (ok), 4) AS avg_ok_ms FROM attempts GROUP BY 1"
ORACLE_SQL = {
    "usage_stats": V(
        "SELECT count(*) FILTER (role = 'user') AS questions, count(*) AS messages, count(*) FILTER (role = 'user' AND created_at >= TIMESTAMP '2024-01-30') AS questions_today, count(DISTINCT user_id) FILTER (created_at >= TIMESTAMP '2024-01-30') AS users_today, "
        "CAST(floor(avg(latency_ms) FILTER (role = 'assistant' AND latency_ms > 0)) AS BIGINT) AS avg_latency_ms, CAST(floor(avg(token_count) FILTER (token_count > 0)) AS BIGINT) AS avg_tokens FROM messages",
        "messages",
    ),
    "popular_queries": V("SELECT content, count(*) AS n FROM messages WHERE role = 'user' AND content <> '' GROUP BY 1 ORDER BY n DESC, content LIMIT 10", "messages"),
    "query_trend": V("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM messages WHERE role = 'user' AND created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY GROUP BY 1", "messages"),
    "dense_search_trend_all": V("SELECT CAST(s.day AS DATE) AS day, coalesce(requests, 0) AS requests, coalesce(failed, 0) AS failed FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS day) s LEFT JOIN (SELECT CAST(at_time AS DATE) AS day, count(*) AS requests, count(*) FILTER (NOT ok) AS failed FROM attempts GROUP BY 1) a ON a.day = CAST(s.day AS DATE)", "attempts"),
    "dense_search_trend": V("SELECT CAST(s.day AS DATE) AS day, coalesce(requests, 0) AS requests, coalesce(failed, 0) AS failed FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS day) s LEFT JOIN (SELECT CAST(at_time AS DATE) AS day, count(*) AS requests, count(*) FILTER (NOT ok) AS failed FROM attempts GROUP BY 1) a ON a.day = CAST(s.day AS DATE)", "attempts"),
    "agent_metrics": V(
        "WITH p AS (SELECT run_id, count(*) AS n, max(CAST(step_type = 'retry_decision' AS INT)) AS retried, max(CAST(step_type = 'retry_decision' AND status = 'success' AS INT)) AS worked FROM steps GROUP BY 1), "
        "a AS (SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (retried = 1) AS retry_runs, count(*) FILTER (worked = 1) AS retry_success_runs, round(avg(n), 4) AS steps_per_run FROM runs LEFT JOIN p USING (run_id)) "
        "SELECT *, round(completed / total, 4) AS completion_rate, round(failed / total, 4) AS failure_rate, round(retry_success_runs / retry_runs, 4) AS retry_success_rate FROM a",
        "runs", "steps",
    ),
    "agent_trend": V("SELECT day, runs, completed, failed, coalesce(retries, 0) AS retries FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1) LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(DISTINCT run_id) AS retries FROM steps JOIN runs USING (run_id) WHERE step_type = 'retry_decision' GROUP BY 1) USING (day)", "runs", "steps"),
    "error_distribution": V("SELECT CASE WHEN split_part(error, ':', 1) = '' THEN 'unknown' ELSE split_part(error, ':', 1) END AS error_type, count(*) AS n FROM runs WHERE error <> '' GROUP BY 1", "runs"),
    "steps_per_run": V("SELECT round(avg(n), 6) AS steps_per_run FROM (SELECT run_id, count(*) AS n FROM steps GROUP BY 1)", "steps"),
    "latency_summary_p95": V(
        "WITH o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS r, count(*) OVER () AS n FROM attempts WHERE ok) SELECT (SELECT count(*) FROM attempts) AS total, max(n) AS succeeded, (SELECT count(*) FROM attempts WHERE NOT ok) AS failed, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_ms, max(latency_ms) FILTER (r = greatest(0, n * 95 // 100 - 1) + 1) AS p95_ms FROM o",
        "attempts",
    ),
    "engine_health": V("SELECT query_id, count(*) AS engines, count(*) FILTER (most >= 20 AND ok) AS available, CASE WHEN count(*) FILTER (most >= 20 AND ok) = 0 THEN 'unhealthy' WHEN bool_and(most >= 20 AND ok) THEN 'healthy' ELSE 'degraded' END AS status FROM (SELECT query_id, engine, arg_max(ok, attempt_id) AS ok, max(latency_ms) AS most FROM attempts GROUP BY 1, 2) GROUP BY 1", "attempts"),
    "engine_stats": V(HEALTH, "attempts"),
    "fastest_engine": V(f"SELECT engine, avg_ok_ms FROM ({HEALTH}) WHERE avg_ok_ms IS NOT NULL ORDER BY avg_ok_ms, engine LIMIT 1", "attempts"),
    "first_success": V("SELECT query_id, min(engine) AS engine FROM attempts WHERE ok GROUP BY 1", "attempts"),
    "document_page": V("WITH m AS (SELECT * FROM kb_documents WHERE title ILIKE '%SRC1%' AND status = 'ready') SELECT document_id, title, status, (SELECT count(*) FROM m) AS total FROM m ORDER BY title DESC, document_id LIMIT 25 OFFSET 25", "kb_documents"),
    "document_status_counts": V("SELECT kb_id, count(*) AS all_documents, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status IN ('indexing', 'pending')) AS indexing, count(*) FILTER (status = 'error') AS error FROM kb_documents GROUP BY 1", "kb_documents"),
    "document_progress": V("SELECT document_id, coalesce(n, 0) AS chunks, CAST(CASE WHEN status = 'pending' THEN least(coalesce(n, 0) * 10, 90) ELSE 100 END AS BIGINT) AS progress FROM kb_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) USING (document_id)", "kb_documents", "chunks"),
    "kb_visibility": "SELECT c_custkey AS kb_id, n_regionkey AS tenant_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS department_id, asker FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (VALUES ('super'), ('admin'), ('user')) a(asker) WHERE n_regionkey = 1 AND (asker = 'super' OR c_custkey % 5 = 0 OR (asker = 'admin' AND c_nationkey = 2))",
    "conversation_counts": "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS questions FROM conversations GROUP BY 1",
    "latest_run": V("SELECT user_id, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, run_id DESC) AS n FROM runs) WHERE n = 1", "runs"),
    "recent_messages": RECENT.format("DESC"),
    "oldest_messages": RECENT.format("ASC"),
    "idempotent_receipts": "SELECT min(event_id) AS event_id, message_key FROM (SELECT event_id, user_id || ':' || event_type AS message_key FROM events) WHERE message_key NOT IN (SELECT user_id || ':' || event_type FROM events WHERE event_id % 1000 = 7) GROUP BY message_key",
    "old_vector_documents": V("SELECT document_id, count(*) AS chunks, count(*) FILTER (length(content) < 40) AS stale FROM chunks GROUP BY 1 HAVING stale > 0", "chunks"),
    "migration_audit": V("SELECT 'all' AS part, count(*) AS n FROM kb_documents UNION ALL SELECT 'ready', count(*) FILTER (status = 'ready') FROM kb_documents UNION ALL SELECT 'pending', count(*) FILTER (status = 'pending') FROM kb_documents", "kb_documents"),
    "run_history": V("SELECT run_id, string_agg(step_type, ' > ' ORDER BY step_no, step_type) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step_no DESC, step_type DESC) AS n FROM steps) WHERE n <= 5 GROUP BY 1", "steps"),
    "miss_mode": '''WITH e AS (SELECT user_id AS conversation_id, event_id AS "at", event_type IN ('view', 'click') AS hit, event_type NOT IN ('view', 'click') AND event_id % 9 <> 0 AS miss, event_type IN ('view', 'click') AS given, event_id % 9 = 0 AS bypass FROM events), i AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY conversation_id ORDER BY "at") AS isl FROM e), m AS (SELECT *, sum(CAST(miss AS INT)) OVER (PARTITION BY conversation_id, isl ORDER BY "at") AS run FROM i), o AS (SELECT *, max(CAST(run >= 3 AS INT)) OVER (PARTITION BY conversation_id ORDER BY "at") = 1 AS turned, max(CAST(miss AS INT)) OVER (PARTITION BY conversation_id ORDER BY "at") = 1 AS missed FROM m) SELECT conversation_id, "at", given AS hit, bypass, CAST(CASE WHEN turned THEN 0 ELSE run END AS BIGINT) AS misses, CASE WHEN turned THEN 'on' WHEN missed THEN 'ask_pending' ELSE 'off' END AS mode FROM o''',
    "counters_daily_stream": "SELECT CAST(ts AS DATE) AS day, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "receipts_stream": "SELECT DISTINCT user_id || ':' || event_type AS message_key FROM events",
}
