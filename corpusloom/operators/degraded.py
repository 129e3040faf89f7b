"""Retrieval of many queries whose channels or reranker may have failed: states, finish with or without rerank, result rows, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import CONFIG, Config
from corpusloom.operators import retrieval as R
from corpusloom.sources.sinks import kept


def surviving(queries: DataFrame, vector: DataFrame, lexical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the channels that did not fail, of queries (query_id, vector_failed, bm25_failed); lexical rows need a score above 0.

    A null state is no failure. Rows of queries that are not there are left out.
    """
    fair = lambda flag: queries.where(~F.coalesce(F.col(flag), F.lit(False))).select("query_id")
    return vector.join(fair("vector_failed"), "query_id", "left_semi"), lexical.where("score > 0").join(fair("bm25_failed"), "query_id", "left_semi")


def degrade_reason(mode: Column) -> Column:
    return F.when(mode == "both_failed", "vector_error_and_bm25_error").when(mode == "bm25_only", "vector_recall_error").when(mode == "vector_only", "bm25_recall_error").otherwise("")


def channel_states(queries: DataFrame, vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, vector_status, bm25_status, vector_result_count, bm25_result_count, degraded_mode, degraded_reason, evaluated) of every query.

    vector and lexical are what surviving gives. An empty lexical result is a state of its own, an empty vector result is not; neither
    is a failure. evaluated is false where nothing is left to fuse: both channels failed, or neither did and both are empty.
    """
    count = lambda rows, name: rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    rows = queries.join(count(vector, "v"), "query_id", "left").join(count(lexical, "b"), "query_id", "left")
    v, b = F.coalesce("v", F.lit(0)), F.coalesce("b", F.lit(0))
    no_vector, no_bm25 = (F.coalesce(F.col(c), F.lit(False)) for c in ("vector_failed", "bm25_failed"))
    mode = R.degrade_mode(no_vector, no_bm25)
    return rows.select(
        "query_id", F.when(no_vector, "error").otherwise("ok").alias("vector_status"), F.when(no_bm25, "error").when(b == 0, "empty").otherwise("ok").alias("bm25_status"),
        v.alias("vector_result_count"), b.alias("bm25_result_count"), mode.alias("degraded_mode"), degrade_reason(mode).alias("degraded_reason"),
        ((mode != "both_failed") & ((mode != "none") | (v + b > 0))).alias("evaluated"),
    )


def finalize_rrf(rows: DataFrame) -> DataFrame:
    """Fused rows as they are: the score is the fused one and no threshold applies, as it says nothing about relevance."""
    return rows.select("*", F.col("rrf_score").alias("score"), F.lit("rrf").alias("score_type"), F.col("rrf_rank").alias("rank"))


def finalize_rerank(rows: DataFrame, threshold: float) -> DataFrame:
    """Fused rows in order of rerank_score; those without a finite score of the threshold or more go. rerank_rank counts before they do."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rrf_rank")).cast("bigint")
    fair = F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") < F.lit(float("inf"))) & (F.col("rerank_score") >= threshold)
    kept = rows.withColumn("rerank_rank", place).where(fair)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rerank_rank")).cast("bigint")
    return kept.select("*", F.col("rerank_score").alias("score"), F.lit("rerank").alias("score_type"), rank.alias("rank"))


def retrieve(queries: DataFrame, vector: DataFrame, lexical: DataFrame, chunks: DataFrame, threshold: float, top_k: int = 5, scorer=R.jaccard_scorer, cfg: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """Result rows and a trace per query, of queries (query_id, text, vector_failed, bm25_failed, rerank_failed).

    vector: (query_id, chunk_id, similarity, vector_rank); lexical: (query_id, chunk_id, score, matched_terms, bm25_rank); chunks:
    (chunk_id, document_id, title, content). One channel's failure leaves the other one's ranks; a reranker that fails, or is not
    asked, leaves the fused order. Rows: (query_id, chunk_id, document_id, document_title, content, score, score_type, rank,
    score_breakdown, matched_channels, matched_terms). Trace: channel_states with the decision and the counts of each step.
    A query without rows has a trace only. What the channels found, some rows a query, is written to the shared folder.
    """
    near, best = (kept(rows, "channel") for rows in surviving(queries, vector, lexical))
    states = channel_states(queries, near, best)
    fused = kept(R.rrf(near, best, cfg), "fused")
    decided = R.rerank_decision(fused, queries, cfg=cfg).join(queries.select("query_id", "text", F.coalesce("rerank_failed", F.lit(False)).alias("rerank_failed")), "query_id")
    decided = decided.withColumn("reranked", F.col("use_rerank") & ~F.col("rerank_failed"))
    parts = fused.join(near.select("query_id", "chunk_id", "similarity"), ["query_id", "chunk_id"], "left").join(best.select("query_id", "chunk_id", "matched_terms", F.col("score").alias("bm25_score")), ["query_id", "chunk_id"], "left")
    parts = kept(parts.select("query_id", "chunk_id", "rrf_score", "rrf_rank", "similarity", "vector_rank", "bm25_score", "bm25_rank", "matched_terms"), "parts")
    # at most rrf_keep rows a query, so that no text is shuffled
    rows = chunks.select("chunk_id", "document_id", F.col("title").alias("document_title"), "content").join(F.broadcast(parts), "chunk_id").join(decided.select("query_id", "text", "reranked", "candidate_k"), "query_id")
    scored = rows.where(F.col("reranked") & (F.col("rrf_rank") <= F.col("candidate_k"))).withColumn("rerank_score", F.round(scorer(F.col("text"), F.col("content")), 9))
    passed = kept(finalize_rerank(scored, threshold).unionByName(finalize_rrf(rows.where(~F.col("reranked"))), allowMissingColumns=True), "passed")
    final = R.post_process(passed, top_k, cfg)
    parts_of_score = F.struct(
        (1 - F.col("similarity")).alias("vector_distance"), F.col("similarity").alias("vector_score"), "vector_rank", "bm25_score", "bm25_rank", "rrf_score", "rrf_rank", "rerank_score", "rerank_rank",
    )
    channels = F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "bm25")))
    results = final.select("query_id", "chunk_id", "document_id", "document_title", "content", "score", "score_type", F.col("final_rank").alias("rank"), parts_of_score.alias("score_breakdown"), channels.alias("matched_channels"), "matched_terms")
    counts = R.stage_counts(rrf_candidate_count=fused, rerank_input_count=scored, threshold_passed_count=passed, final_result_count=final)
    none = ("rrf_candidate_count", "rerank_input_count", "threshold_passed_count", "final_result_count")
    trace = states.join(decided.select("query_id", "use_rerank", "candidate_k", "reason"), "query_id").join(counts, "query_id", "left").select(
        *states.columns, F.when(F.col("evaluated") & F.col("use_rerank"), "on").otherwise("off").alias("rerank_decision"), F.when(F.col("evaluated"), F.col("reason")).otherwise("not_evaluated").alias("rerank_reason"),
        F.col("candidate_k").alias("rerank_candidate_k"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in none),
    )
    return results, trace.drop("evaluated")


def citations(results: DataFrame, expanded: DataFrame, groups: DataFrame) -> DataFrame:
    """(query_id, chunk_id, document_id, document_title, score, score_type, rank, context_source, parent_block, context_group): what an answer may cite.

    A citation names the chunk that was hit, also where its context is a block; expanded and groups are what
    context.expand_with_parents and context.grouped_contexts make of the same hits.
    """
    member = groups.select("query_id", "group_id", F.explode("chunk_ids").alias("chunk_id"))
    rows = results.join(expanded.select("query_id", "chunk_id", "source", "block_no"), ["query_id", "chunk_id"], "left").join(member, ["query_id", "chunk_id"], "left")
    return rows.select("query_id", "chunk_id", "document_id", "document_title", "score", "score_type", "rank", F.col("source").alias("context_source"), F.col("block_no").alias("parent_block"), F.col("group_id").alias("context_group"))


def context_rows(groups: DataFrame, titles: DataFrame, unknown: str = "未知来源") -> DataFrame:
    """(query_id, group_rank, context_group, content, source, chunk_type): texts for the answer, one per group; titles: (document_id, title)."""
    named = groups.join(titles.select("document_id", "title"), "document_id", "left")
    source = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(unknown)
    return named.select("query_id", "group_rank", F.col("group_id").alias("context_group"), F.col("context").alias("content"), source.alias("source"), F.when(F.col("block_no").isNotNull(), "parent_context").otherwise("paragraph").alias("chunk_type"))
