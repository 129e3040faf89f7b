"""Routing, classification, plans and retry rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Key words of request routes.
PDF = ("pdf", "PDF", "导出pdf", "导出 PDF", "生成pdf", "生成 PDF", "输出pdf", "输出 PDF", "下载pdf", "下载 PDF")
PPT = ("ppt", "PPT", "课件", "演示文稿", "汇报页", "幻灯片")
SUMMARY = ("总结", "概括", "摘要", "提炼", "梳理", "归纳", "总结一下", "概述")
GENERATION = ("生成", "起草", "撰写", "写一份", "帮我写", "输出一份", "拟一份", "草案", "方案")
HINT = ("什么是", "如何", "怎么", "流程", "制度", "规范", "文档", "资料", "知识库", "附件", "在哪", "谁", "多久", "要求", "规则", "说明")
SMALL_TALK = ("你好", "hi", "hello", "早上好", "晚上好", "谢谢", "thank", "在吗")
NEGATION = ("不要生成", "不需要生成", "不要输出", "别生成", "不要做PPT", "不要做pdf", "无需生成", "不需要PDF", "不需要PPT")
#: Words of refusal and of consent.
NO = ("不用", "不要", "算了", "不必", "不了", "别", "不需要", "no", "不搜", "不查", "没必要", "不用了")
YES = ("好", "可以", "嗯", "是的", "对", "搜", "查", "行", "ok", "好的", "好吧", "行吧", "搜搜", "查查", "看看", "开")
#: What marks each class of error, in order.
ERRORS = (
    ("timeout", ("timeout", "timed out")), ("rate_limit", ("rate limit", "too many requests", "429")), ("auth", ("401", "unauthorized", "api key", "auth")), ("permission", ("403", "forbidden", "permission")),
    ("validation", ("400", "validation", "invalid")), ("not_found", ("404", "not found")), ("upstream", ("500", "502", "503", "504", "service unavailable", "connection")),
)
NO_RETRY = ("auth", "permission", "validation", "not_found")
#: Steps of each route.
PLANS = {
    "rag_qa": ("knowledge_retrieval", "answer"), "document_summary": ("knowledge_retrieval", "summarize"), "content_generation": ("knowledge_retrieval", "draft", "review"),
    "pdf_generation": ("knowledge_retrieval", "draft", "pdf_export"), "ppt_generation": ("knowledge_retrieval", "draft", "ppt_generation"), "fallback_chat": ("respond",),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def route(query: Column, attachments: Column, active_kb: Column) -> Column:
    """struct(route, reason, confidence): the rule of highest confidence, the first of equals; else the defaults."""
    t = F.trim(F.coalesce(query, F.lit("")))
    make = ~has_any(t, NEGATION)
    rules = [
        (make & has_any(t, PDF), "pdf_generation", "matched_pdf_keywords", 0.98), (make & has_any(t, PPT), "ppt_generation", "matched_ppt_keywords", 0.98),
        (make & has_any(t, SUMMARY), "document_summary", "matched_summary_keywords", 0.98), (make & has_any(t, GENERATION), "content_generation", "matched_generation_keywords", 0.92),
        (attachments & has_any(t, HINT), "rag_qa", "attachments_present_with_question", 0.95), (attachments & (t == ""), "document_summary", "attachments_without_query", 0.92),
        (active_kb & has_any(t, HINT), "rag_qa", "active_kb_with_question", 0.95), (active_kb & make & has_any(t, GENERATION), "content_generation", "active_kb_with_generation_request", 0.92),
        (attachments & make & has_any(t, GENERATION), "content_generation", "attachments_with_generation_request", 0.90),
    ]
    rules.sort(key=lambda r: -r[3])  # stable
    rules += [
        (has_any(F.lower(t), SMALL_TALK) & ~attachments & ~active_kb, "fallback_chat", "matched_fallback_keywords", 0.95), (active_kb, "rag_qa", "active_kb_default", 0.80),
        (attachments, "document_summary", "attachments_default", 0.80), (F.lit(True), "fallback_chat", "no_rule_match", 0.60),
    ]
    made = lambda r: F.struct(F.lit(r[1]).alias("route"), F.lit(r[2]).alias("reason"), F.lit(r[3]).alias("confidence"))
    out = F.when(rules[0][0], made(rules[0]))
    for r in rules[1:]:
        out = out.when(r[0], made(r))
    return out


def known_route(raw: Column) -> Column:
    first = F.trim(F.substring_index(F.trim(F.coalesce(raw, F.lit(""))), "\n", 1))
    return F.when(first.isin(*PLANS), first).otherwise("fallback_chat")


#: Words of a question that name a department, departments and words in order.
DEPARTMENT_WORDS = {
    "tech": ["技术", "代码", "编程", "开发", "系统", "软件"],
    "hr": ["制度", "请假", "报销", "薪资", "人事", "员工"],
    "product": ["产品", "功能", "使用", "教程"],
    "sales": ["销售", "客户", "业绩", "合同"],
}


def base_route(queries: DataFrame, bases: DataFrame) -> DataFrame:
    """(query_id, kb_id) of queries (query_id, text, department_id): the base of the asker's own department, else that of the first department named by a word of the query that has a base, else the first.

    bases (kb_id, department_id, department_code, place) are listed in order of place; the first listed wins.
    """
    first_by = lambda rows, *by: rows.groupBy(*by).agg(F.min_by("kb_id", "place").alias("kb"))
    own = first_by(bases.where("department_id is not null"), "department_id").withColumnRenamed("kb", "own")
    text = F.lower(F.coalesce("text", F.lit("")))
    codes = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.when(has_any(text, words), F.lit(code)).alias("code")) for n, (code, words) in enumerate(DEPARTMENT_WORDS.items())]), lambda x: x["code"].isNotNull())
    coded = first_by(bases.where("department_code is not null"), "department_code").withColumnRenamed("department_code", "code")
    named = queries.select("query_id", F.explode(codes).alias("c")).select("query_id", "c.*").join(coded, "code").groupBy("query_id").agg(F.min_by("kb", "n").alias("named"))
    first = bases.agg(F.min_by("kb_id", "place").alias("first"))
    return queries.join(own, "department_id", "left").join(named, "query_id", "left").crossJoin(F.broadcast(first)).select("query_id", F.coalesce("own", "named", "first").alias("kb_id"))


def error_class(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for name, words in reversed(ERRORS):
        out = F.when(has_any(m, words), name).otherwise(out)
    return out


def retryable(message: Column) -> Column:
    return ~error_class(message).isin(*NO_RETRY)


def consent(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return ~has_any(t, NO) & has_any(t, YES)


#: Key words of kinds of content, in order, and of leave to search outside.
CONTENT_TYPES = (
    ("person_experience_summary", ("工作经历", "简历", "履历", "任职经历", "职业经历", "人物经历", "工作背景")), ("training_plan", ("培训方案", "培训计划", "培训大纲", "培训课程")), ("analysis_report", ("调研", "分析报告", "方案", "总结")),
)
OUTSIDE = ("允许联网", "联网搜索", "外部搜索", "公开信息", "网上搜索")
#: Tool, goal and end of routes that make a file; goals of the others.
ARTIFACTS = {"pdf_generation": ("pdf_export", "artifact_pdf", "pdf_task_created"), "ppt_generation": ("ppt_generation", "artifact_ppt", "ppt_task_created")}
GOALS = {"document_summary": "structured_summary", "content_generation": "structured_generation"}
INTENTS = ("knowledge_query", "solution_query", "casual_chat")


def task_profile(route_name: Column, query: Column) -> Column:
    """struct(goal_type, content_type, evidence_policy, search_focus_rule, artifact_tool, allow_external_search, completion_condition) of a request; the tool is null where no file is made."""
    text, key = F.trim(F.coalesce(query, F.lit(""))), F.coalesce(route_name, F.lit(""))
    content = F.lit("general_content")
    for name, words in reversed(CONTENT_TYPES):
        content = F.when(has_any(text, words), name).otherwise(content)
    outside = has_any(text, OUTSIDE)
    made = lambda i: F.element_at(F.create_map(*[F.lit(x) for r, v in ARTIFACTS.items() for x in (r, v[i])]), key)
    goal = F.element_at(F.create_map(*[F.lit(x) for kv in GOALS.items() for x in kv]), key)
    return F.struct(
        F.coalesce(made(1), goal, F.lit("answer")).alias("goal_type"), content.alias("content_type"), F.when(outside, "internal_first_external_supplement").otherwise("internal_only").alias("evidence_policy"),
        F.when(outside, "focus_entities_in_materials").otherwise("none").alias("search_focus_rule"), made(0).alias("artifact_tool"), (outside & key.isin("content_generation", *ARTIFACTS)).alias("allow_external_search"), F.coalesce(made(2), F.lit("final_answer_ready")).alias("completion_condition"),
    )


def intent(reply: Column) -> Column:
    """struct(intent, kb_index) of a model's JSON reply, fenced or inside other text; an unknown intent is knowledge_query, an index below 1 or no whole number is null."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"^```[^\n]*\n", ""), r"```$", ""))
    found = F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"\{[^}]+\}", 0)))
    index = F.try_variant_get(found, "$.kb_index", "variant")
    string, kind = F.try_variant_get(found, "$.kb_index", "string"), F.schema_of_variant(index)
    number = (
        F.when(kind == "STRING", F.when(string.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(string).try_cast("bigint"))).when(kind == "BOOLEAN", F.when(string == "true", 1))
        .otherwise(F.try_variant_get(found, "$.kb_index", "double").try_cast("bigint"))
    )
    name = F.try_variant_get(found, "$.intent", "string")
    return F.struct(F.when(name.isin(*INTENTS), name).otherwise("knowledge_query").alias("intent"), F.when(number >= 1, number).alias("kb_index"))


def plan_steps(rows: DataFrame, most: int = 5, key: str = "query_id") -> DataFrame:
    """(key, step_no, step_type) of rows with a column route; an unknown route has one step."""
    table = F.create_map(*[x for r, s in PLANS.items() for x in (F.lit(r), F.array(*[F.lit(t) for t in s]))])
    steps = F.slice(F.coalesce(F.element_at(table, F.col("route")), F.array(F.lit("execute"))), 1, most)
    return rows.select(key, F.posexplode(steps).alias("at", "step_type")).select(key, (F.col("at") + 1).cast("bigint").alias("step_no"), "step_type")


def followup(status: Column, retries: Column, most: Column) -> Column:
    return F.when(status == "failed", F.when(retries < most, "retry_decision").otherwise("fallback_finalize")).otherwise("finalize_response")


def backoff(attempt: Column, first: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """Seconds before the attempt (from 1), without jitter."""
    return F.least(F.lit(most), first * F.pow(F.lit(factor), attempt - 1))


def step_history(steps: DataFrame, keep: int = 5, clip: int = 500) -> DataFrame:
    """(run_id, summary): the last steps of a run in order, each clipped."""
    w = Window.partitionBy("run_id").orderBy(F.desc("step_no"), F.desc("step_type"))
    last = steps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    return last.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "step_type"))), lambda s: F.substr(s["step_type"], F.lit(1), F.lit(clip))), " > ").alias("summary"))


def miss_mode(rows: DataFrame, key: str = "conversation_id", order: str = "at", limit: int = 3) -> DataFrame:
    """rows (key, at, hit, and bypass if there is one) -> misses and mode after each: the third miss in a row turns search on for good, fewer ask first.

    A hit sets the count back and leaves the mode, with attachments (bypass) too; a miss with attachments, and any row without an
    active base (active, if there is that column), changes nothing. Misses since the last hit are a running count per island, so no
    state is carried by hand.
    """
    active = F.col("active") if "active" in rows.columns else F.lit(True)
    bypass = (F.col("bypass") if "bypass" in rows.columns else F.lit(False)) | ~active
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_miss", (~F.col("hit") & ~bypass).cast("int")).withColumn("_island", F.sum((F.col("hit") & active).cast("int")).over(w))
    rows = rows.withColumn("_run", F.sum("_miss").over(Window.partitionBy(key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    on = F.max((F.col("_run") >= limit).cast("int")).over(w) == 1
    mode = F.when(on, "on").when(F.max("_miss").over(w) == 1, "ask_pending").otherwise("off")
    return rows.withColumn("misses", F.when(on, F.lit(0)).otherwise(F.col("_run")).cast("bigint")).withColumn("mode", mode).drop("_island", "_run", "_miss")


def import_outcome(status: Column) -> Column:
    return F.when(status.isNull(), "new").when(status == "ready", "already_indexed").when(status.isin("pending", "indexing"), "in_progress").otherwise("continue")


#: Progress when a stage of indexing is done, and seconds before each further try.
STAGE_PROGRESS = {"started": 5, "downloaded": 10, "cleaned": 30, "chunked": 80, "stored": 100}
RETRY_SECONDS = [60, 300, 600]


def indexing_state(stage: Column, error: Column, tries: Column) -> Column:
    """struct(status, progress, retry_after) of a document after a stage: failed with an error, ready when it is stored, else indexing.

    A failure is tried again after the seconds for the tries so far, and not after the last of these; null stands for no further try.
    """
    bad = F.coalesce(error, F.lit("")) != ""
    known = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    progress = F.when(bad, 0).otherwise(F.coalesce(F.element_at(known, stage), F.lit(0)))
    status = F.when(bad, "failed").when(stage == "stored", "ready").when(F.element_at(known, stage).isNotNull(), "indexing").otherwise("pending")
    return F.struct(status.alias("status"), progress.alias("progress"), F.when(bad, F.get(F.array(*[F.lit(x) for x in RETRY_SECONDS]), F.coalesce(tries, F.lit(0)).cast("int"))).alias("retry_after"))
