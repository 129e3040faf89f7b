"""States of failing channels and both ways to finish, on rows small enough to read."""

from pyspark.sql import functions as F

from corpusloom.operators import degraded as D

QUERIES = [(1, "long enough question", False, False, False), (2, "long enough question", True, False, False), (3, "long enough question", False, True, True), (4, "long enough question", True, True, False), (5, "long enough question", None, None, None)]
NEAR = [(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 10, 0.7, 1), (3, 10, 0.6, 1), (3, 12, 0.5, 2), (4, 10, 0.4, 1), (9, 10, 0.4, 1)]
BEST = [(1, 11, 2.0, "enough", 1), (2, 12, 1.5, "long", 1), (2, 11, 1.0, "long", 2), (2, 10, 0.0, "", 3), (3, 11, 1.0, "long", 1), (4, 11, 1.0, "long", 1)]
CHUNKS = [(10, 1, "one", "long enough question"), (11, 2, "two", "enough of it"), (12, 3, "three", "nothing here")]


def tables(spark, near=NEAR, best=BEST):
    return (
        spark.createDataFrame(QUERIES, "query_id bigint, text string, vector_failed boolean, bm25_failed boolean, rerank_failed boolean"),
        spark.createDataFrame(near, "query_id bigint, chunk_id bigint, similarity double, vector_rank bigint"),
        spark.createDataFrame(best, "query_id bigint, chunk_id bigint, score double, matched_terms string, bm25_rank bigint"),
        spark.createDataFrame(CHUNKS, "chunk_id bigint, document_id bigint, title string, content string"),
    )


def test_retrieve(spark):
    rows, trace = D.retrieve(*tables(spark), threshold=0.1)
    got = {}
    for r in rows.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score_type"], list(r["matched_channels"])))
    assert got == {
        1: [(10, "rerank", ["vector"]), (11, "rerank", ["vector", "bm25"])],
        2: [(11, "rerank", ["bm25"])],  # 12 has no word of the query, so it is below the threshold; nothing fills its place
        3: [(10, "rrf", ["vector"]), (12, "rrf", ["vector"])],  # the reranker failed: no threshold
    }
    states = {r["query_id"]: r for r in trace.collect()}
    assert [(states[q]["vector_status"], states[q]["bm25_status"], states[q]["degraded_mode"]) for q in range(1, 6)] == [("ok", "ok", "none"), ("error", "ok", "bm25_only"), ("ok", "error", "vector_only"), ("error", "error", "both_failed"), ("ok", "empty", "none")]
    assert [states[q]["rerank_reason"] for q in (3, 4, 5)] == ["close_scores", "not_evaluated", "not_evaluated"]
    assert [(states[q]["rerank_input_count"], states[q]["final_result_count"]) for q in range(1, 6)] == [(2, 2), (2, 1), (0, 2), (0, 0), (0, 0)]


def test_nothing_found(spark):
    rows, trace = D.retrieve(*tables(spark, [], []), threshold=0.1)
    assert rows.count() == 0 and trace.count() == 5


def test_scores_that_are_none(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.5), (1, 2, 2, float("nan")), (1, 3, 3, None), (1, 4, 4, float("inf")), (1, 5, 5, 0.5), (1, 6, 6, 0.05)], "query_id bigint, chunk_id bigint, rrf_rank bigint, rerank_score double")
    assert [(r["chunk_id"], r["rank"]) for r in D.finalize_rerank(rows, 0.1).orderBy("rank").collect()] == [(1, 1), (5, 2)]
    fused = rows.withColumn("rrf_score", F.lit(0.01))
    assert D.finalize_rrf(fused).where("rank = rrf_rank and score_type = 'rrf'").count() == 6


def test_context_rows_without_title(spark):
    groups = spark.createDataFrame([(1, 1, "a", "text", 7, None)], "query_id bigint, group_rank bigint, group_id string, context string, document_id bigint, block_no bigint")
    titles = spark.createDataFrame([], "document_id bigint, title string")
    r = D.context_rows(groups, titles).first()
    assert (r["source"], r["chunk_type"]) == ("未知来源", "paragraph")
