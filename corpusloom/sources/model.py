"""The engine's tables, derived from the star-schema and corpus tables in a data folder; VIEWS has the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, kb_id, title, status, chars): every twentieth document is still pending."""
    status = F.when(F.col("doc_id") % 20 == 0, "pending").otherwise("ready")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("kb_id"), F.col("source").alias("title"), status.alias("status"), "n_chars")


def lines_of(docs: DataFrame) -> DataFrame:
    """(chunk_id, document_id, kb_id, title, sequence_no, content, model): the non-blank lines of documents (doc_id, lang, source, text)."""
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    content = F.btrim("raw", F.lit(" \t\r"))
    return lines.select(
        (F.col("doc_id") * 100_000 + F.col("at")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("kb_id"), F.col("source").alias("title"), F.col("at").cast("bigint").alias("sequence_no"), content.alias("content"), F.concat(F.lit("M"), F.col("doc_id") % 7).alias("model")
    ).where("content <> ''")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents."""
    return lines_of(table(spark, sf_dir, "documents"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, kb_id, text): benchmark items, asked of the knowledge bases in turn."""
    kb = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), kb.alias("kb_id"), "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, conversation_id, user_id, role, content, latency_ms, token_count, created_at)."""
    role = F.when(F.col("event_type").isin("view", "click"), "user").otherwise("assistant")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("message_id"), F.col("user_id").alias("conversation_id"), "user_id", role.alias("role"), F.col("event_type").alias("content"), F.floor("value").cast("bigint").alias("latency_ms"), (F.col("event_id") % 50).alias("token_count"), F.col("ts").alias("created_at")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, user_id, status, error, created_at): orders as agent runs."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    key = F.col("o_orderkey")
    detail = F.concat(F.lower("o_orderpriority"), F.lit(": detail"))
    # some runs without an error text failed, some with one did not
    error = F.when(key % 11 == 0, None).when(key % 7 == 0, "").when(key % 17 == 0, ": no kind").when((F.col("o_orderstatus") == "P") | (key % 13 == 0), detail).otherwise("")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), error.alias("error"), F.col("o_orderdate").alias("created_at"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, step_no, step_type, status)."""
    kind = F.when(F.col("l_returnflag") == "R", "retry_decision").otherwise("answer")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("step_no"), kind.alias("step_type"), F.when(F.col("l_linestatus") == "F", "success").otherwise("error").alias("status"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_id, query_id, engine, ok, latency_ms, at): events as calls of six search engines."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("user_id").alias("query_id"), (F.col("event_id") % 6).alias("engine"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("bigint").alias("latency_ms"), F.col("ts").alias("at")
    )


def serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, engine, rank, url, title, ad): pages found by two of six engines each; a query is a hundred pages."""
    from pyspark.sql.window import Window

    names = F.array(*[F.lit(x) for x in ("google", "yandex", "baidu", "bing", "duckduckgo", "ecosia")])
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("e")).where("(page_id + e) % 3 = 0")
    rank = F.row_number().over(Window.partitionBy("query_id", "engine").orderBy("page_id"))
    rows = rows.select((F.col("page_id") / 100).cast("bigint").alias("query_id"), F.element_at(names, F.col("e") + 1).alias("engine"), "page_id", "url")
    return rows.select("query_id", "engine", rank.cast("bigint").alias("rank"), "url", F.concat(F.lit("page "), "page_id").alias("title"), (F.col("page_id") % 17 == 0).alias("ad"))


VIEWS = {
    "kb_documents": "SELECT doc_id AS document_id, lang AS kb_id, source AS title, CASE WHEN doc_id % 20 = 0 THEN 'pending' ELSE 'ready' END AS status, n_chars FROM documents",
    "chunks": "SELECT doc_id * 100000 + nr - 1 AS chunk_id, doc_id AS document_id, lang AS kb_id, source AS title, CAST(nr - 1 AS BIGINT) AS sequence_no, trim(parts[nr], ' ' || chr(9) || chr(13)) AS content, 'M' || (doc_id % 7) AS model, concat_ws(chr(10), nullif(source, ''), 'M' || (doc_id % 7), trim(parts[nr], ' ' || chr(9) || chr(13))) AS index_text FROM (SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS nr FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[nr], ' ' || chr(9) || chr(13)) <> ''",
    "asked": "SELECT item_id AS query_id, (['en', 'de', 'fr', 'es'])[item_id % 4 + 1] AS kb_id, text FROM benchmark",
    "messages": "SELECT event_id AS message_id, user_id AS conversation_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'user' ELSE 'assistant' END AS role, event_type AS content, CAST(floor(value) AS BIGINT) AS latency_ms, event_id % 50 AS token_count, ts AS created_at FROM events",
    "runs": "SELECT o_orderkey AS run_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN ': no kind' WHEN o_orderstatus = 'P' OR o_orderkey % 13 = 0 THEN lower(o_orderpriority) || ': detail' ELSE '' END AS error, o_orderdate AS created_at FROM orders",
    "steps": "SELECT l_orderkey AS run_id, l_linenumber AS step_no, CASE WHEN l_returnflag = 'R' THEN 'retry_decision' ELSE 'answer' END AS step_type, CASE WHEN l_linestatus = 'F' THEN 'success' ELSE 'error' END AS status FROM lineitem",
    "attempts": "SELECT event_id AS attempt_id, user_id AS query_id, event_id % 6 AS engine, event_type <> 'error' AS ok, CAST(floor(value) AS BIGINT) AS latency_ms, ts AS at_time FROM events",
    "serp": "SELECT query_id, engine, row_number() OVER (PARTITION BY query_id, engine ORDER BY page_id) AS rank, url, 'page ' || page_id AS title, page_id % 17 = 0 AS ad FROM (SELECT page_id // 100 AS query_id, (['google', 'yandex', 'baidu', 'bing', 'duckduckgo', 'ecosia'])[e + 1] AS engine, page_id, url FROM (SELECT page_id, url, unnest(range(0, 6)) AS e FROM pages) WHERE (page_id + e) % 3 = 0)",
}


def with_views(sql: str, *names: str) -> str:
    """sql behind the named views, as one statement."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
