"""Usage, agent, search and document statistics. Every time window takes as_of; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def since(column: str, as_of: str, days: int) -> Column:
    return F.col(column) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def usage_stats(messages: DataFrame, as_of: str) -> DataFrame:
    """One row, in one pass: counts, today's counts and users, and averages over positive values, cut to whole numbers: latencies of assistants, tokens of all."""
    today = F.col("created_at") >= F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    user = F.col("role") == "user"
    mean = lambda c, *of: F.coalesce(F.avg(F.when(F.col(c) > 0, F.when(of[0], F.col(c)) if of else F.col(c))), F.lit(0.0)).cast("bigint")
    return messages.agg(
        F.count_if(user).alias("questions"), F.count(F.lit(1)).alias("messages"), F.count_if(user & today).alias("questions_today"), F.count_distinct(F.when(today, F.col("user_id"))).alias("users_today"), mean("latency_ms", F.col("role") == "assistant").alias("avg_latency_ms"), mean("token_count").alias("avg_tokens")
    )


def popular_queries(messages: DataFrame, limit: int = 10) -> DataFrame:
    rows = messages.where((F.col("role") == "user") & F.col("content").isNotNull() & (F.col("content") != ""))
    return rows.groupBy("content").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "content").limit(limit)


def daily_trend(rows: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """(day, n) of days that have rows."""
    return rows.where(since(time, as_of, days)).groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def dense_trend(rows: DataFrame, time: str, first: str, last: str, **counts: Column) -> DataFrame:
    """(day, ...) for every day from first to last, zeros where nothing happened."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    per = rows.groupBy(F.to_date(time).alias("day")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return spine.join(per, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in counts])


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def conversation_scope(conversations: DataFrame, bases: DataFrame, *, role: str, tenant, user) -> DataFrame:
    """The conversations (conversation_id, tenant_id, user_id, kb_id) whose figures a user sees: of the tenant only, and of these a
    super admin all, an admin those over visible bases (kb_id), anybody else the own ones."""
    rows = conversations.where(F.col("tenant_id") == F.lit(tenant))
    if role == "super_admin":
        return rows
    if role == "admin":
        return rows.join(bases.select("kb_id").distinct(), "kb_id", "left_semi")
    return rows.where(F.col("user_id") == F.lit(user))


def scoped(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """The messages or runs of the conversations in a scope, with the user of the conversation."""
    return rows.drop("user_id").join(scope.select("conversation_id", "user_id"), "conversation_id")


def agent_metrics(runs: DataFrame, steps: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    """One row: runs by status, runs that retried and those with a retry step that was a success, rates, steps per run that has any; of the days before as_of, if it is given."""
    runs = runs if as_of is None else runs.where(since("created_at", as_of, days))
    retry = F.col("step_type") == "retry_decision"
    per = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max(retry.cast("int")).alias("retried"), F.max((retry & (F.col("status") == "success")).cast("int")).alias("worked"))
    rows = runs.join(per, "run_id", "left")
    done, bad = F.col("status") == "completed", F.col("status") == "failed"
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(bad).alias("failed"), F.count_if(F.col("retried") == 1).alias("retry_runs"), F.count_if(F.col("worked") == 1).alias("retry_success_runs"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 4).alias("steps_per_run"))
    return out.select("*", rate(F.col("completed"), F.col("total")).alias("completion_rate"), rate(F.col("failed"), F.col("total")).alias("failure_rate"), rate(F.col("retry_success_runs"), F.col("retry_runs")).alias("retry_success_rate"))


def agent_trend(runs: DataFrame, steps: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    """(day, runs, completed, failed, retries) of the days before as_of, if it is given: retries are runs with such a step, by the day of the run."""
    runs = runs if as_of is None else runs.where(since("created_at", as_of, days))
    day = F.to_date("created_at").alias("day")
    per = runs.groupBy(day).agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    retries = steps.where("step_type = 'retry_decision'").join(runs.select("run_id", day), "run_id").groupBy("day").agg(F.count_distinct("run_id").alias("retries"))
    return per.join(retries, "day", "left").withColumn("retries", F.coalesce("retries", F.lit(0)).cast("bigint"))


def error_distribution(runs: DataFrame) -> DataFrame:
    """(error_type, n) of all runs with an error text, whatever their status: what stands before the first colon, unknown if that is empty."""
    kind = F.split_part("error", F.lit(":"), F.lit(1))
    return runs.where("error is not null and error <> ''").groupBy(F.when(kind == "", "unknown").otherwise(kind).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(documents: DataFrame) -> DataFrame:
    """(kb_id, all, ready, indexing, error); pending counts as indexing, failed only in all."""
    s = F.col("status")
    return documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("all_documents"), F.count_if(s == "ready").alias("ready"), F.count_if(s.isin("indexing", "pending")).alias("indexing"), F.count_if(s == "error").alias("error"))


def progress(status: Column, stored: Column, chunks: Column) -> Column:
    return F.coalesce(stored, F.when(status == "ready", 100).when(status == "indexing", F.least(chunks * 10, F.lit(90))).otherwise(0))


def latency_summary(attempts: DataFrame) -> DataFrame:
    """One row: total, ok, failed, min, max, whole average and the p95 of sorted[max(0, int(0.95 n) - 1)], by rank."""
    ok = attempts.where("ok")
    n = ok.agg(F.count(F.lit(1)).alias("n"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.avg("latency_ms").cast("bigint").alias("avg_ms"))
    # latencies are counted by value, so no single task sorts all rows
    by_value = ok.groupBy("latency_ms").agg(F.count(F.lit(1)).alias("c"))
    upto = by_value.withColumn("upto", F.sum("c").over(Window.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.greatest(F.lit(0), F.floor(F.col("n") * 95 / 100) - 1) + 1
    p95 = upto.crossJoin(F.broadcast(n)).where(F.col("upto") >= wanted).agg(F.min("latency_ms").alias("p95_ms"))
    total = attempts.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed"))
    return total.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(p95)).select("total", F.col("n").alias("succeeded"), "failed", "min_ms", "max_ms", "avg_ms", "p95_ms")


def engine_stats(attempts: DataFrame) -> DataFrame:
    """(engine, calls, failures, avg_ok_ms)."""
    return attempts.groupBy("engine").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.avg(F.when(F.col("ok"), F.col("latency_ms"))), 4).alias("avg_ok_ms"))


def engine_state(initialized: Column, circuit: Column) -> Column:
    return F.when(circuit == "open", "circuit_open").when(~initialized, "not_initialized").otherwise("ready")


def engine_health(engines: DataFrame, keys: list[str]) -> DataFrame:
    """engines (keys, engine, initialized, circuit) -> (keys, engines, available, status): healthy if all are available, degraded if some, unhealthy if none."""
    per = engines.groupBy(*keys).agg(F.count(F.lit(1)).alias("engines"), F.count_if(engine_state(F.col("initialized"), F.col("circuit")) == "ready").alias("available"))
    return per.withColumn("status", F.when(F.col("available") == 0, "unhealthy").when(F.col("available") < F.col("engines"), "degraded").otherwise("healthy"))


def fastest_engine(attempts: DataFrame) -> DataFrame:
    """One row: the engine with the least average latency of good calls, by engine on ties."""
    return engine_stats(attempts).where("avg_ok_ms is not null").agg(F.min_by("engine", F.struct("avg_ok_ms", "engine")).alias("engine"), F.min("avg_ok_ms").alias("avg_ok_ms"))


def first_success(attempts: DataFrame, order: str = "engine") -> DataFrame:
    """(query_id, engine): fallback in engine order, the first whose call was good."""
    return attempts.where("ok").groupBy("query_id").agg(F.min(order).alias("engine"))


def latest_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recent(rows: DataFrame, key: str, order: list[str], n: int, newest: bool = True) -> DataFrame:
    """The newest (or the oldest) n rows of each key, numbered in ascending order."""
    pick = Window.partitionBy(key).orderBy(*[F.desc(c) if newest else F.asc(c) for c in order])
    kept = rows.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= n).drop("_n")
    return kept.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))


def page_size(size: int) -> int:
    return size if size in (10, 25, 50) else 100 if size > 100 else 10


SORTS = {"created_asc": (F.asc, "created_at"), "created_desc": (F.desc, "created_at"), "name_asc": (F.asc, "title"), "name_desc": (F.desc, "title")}


def document_page(documents: DataFrame, page: int = 1, size: int = 20, q: str | None = None, status: str | None = None, sort: str = "name_asc") -> DataFrame:
    """One page, with the total of rows that match; indexing includes pending, unknown states and sorts are ignored."""
    rows = documents
    if q:
        rows = rows.where(F.col("title").ilike("%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"))
    if status in ("ready", "error"):
        rows = rows.where(F.col("status") == status)
    elif status in ("indexing", "pending"):
        rows = rows.where(F.col("status").isin("indexing", "pending") if status == "indexing" else F.col("status") == "pending")
    way, column = SORTS.get(sort, SORTS["name_asc"])
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    size, page = page_size(size), max(1, page)
    part = rows.orderBy(way(column), "document_id").offset((page - 1) * size).limit(size)
    return part.crossJoin(F.broadcast(total))


def visible_bases(bases: DataFrame, role: str, tenant, department) -> DataFrame:
    """bases (kb_id, tenant_id, department_id): a super-admin sees the tenant's, all others, admins too, their department's and those of none."""
    rows = bases.where(F.col("tenant_id") == F.lit(tenant))
    if role == "super_admin":
        return rows
    free = F.col("department_id").isNull()
    return rows.where(free if department is None else free | (F.col("department_id") == F.lit(department)))


def new_receipts(rows: DataFrame, seen: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Rows not seen before, the first of each key; an empty message id is never a repeat."""
    if seen is not None:
        rows = rows.join(seen.select(*keys).distinct(), keys, "left_anti")
    empty = F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) == ""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where((F.col("_n") == 1) | empty).drop("_n")


def search_chunks(chunks: DataFrame, text: str, vector_status: str | None = None) -> DataFrame:
    """Chunks whose content or metadata holds the text in any case; the state error selects nothing."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    rows = chunks.where(F.col("content").ilike(pattern) | F.col("model").ilike(pattern))
    if vector_status == "error":
        return rows.limit(0)
    if vector_status in ("indexed", "pending"):
        return rows.where(F.col("vector").isNotNull() if vector_status == "indexed" else F.col("vector").isNull())
    return rows


def retained(counters: DataFrame, as_of: Column, days: int = 35, day: str = "day") -> DataFrame:
    """Counters of the so many days that end with as_of; older ones go."""
    last = F.to_date(as_of)
    return counters.where((F.col(day) > F.date_sub(last, days)) & (F.col(day) <= last))


def base_page(bases: DataFrame, departments: DataFrame, documents: DataFrame, page: int, size: int) -> DataFrame:
    """A page of bases (kb_id, name, department_id, created_at), the newest first, with the department's name if there is one and the number of documents, 0 for none.

    Only the page's bases meet the documents, which are counted by base first.
    """
    shown = bases.orderBy(F.desc("created_at"), "kb_id").offset((page - 1) * size).limit(size)
    counts = documents.join(F.broadcast(shown.select("kb_id")), "kb_id", "left_semi").groupBy("kb_id").agg(F.count(F.lit(1)).alias("documents"))  # a page
    named = shown.join(departments.select("department_id", "department_name"), "department_id", "left").join(counts, "kb_id", "left")
    return named.select("kb_id", "name", "department_id", "department_name", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), "created_at")


def index_jobs(documents: DataFrame, bases: DataFrame) -> DataFrame:
    """(document_id, title, source_type, kb_id, tenant_id): documents with the tenant of their base; one without a base is no job.

    A null or empty kind of source is local. bases: (kb_id, tenant_id), a row for each.
    """
    kind = F.coalesce(F.nullif("source_type", F.lit("")), F.lit("local"))
    return documents.join(bases.select("kb_id", "tenant_id"), "kb_id").select("document_id", "title", kind.alias("source_type"), "kb_id", "tenant_id")
