"""Vector recall, fusion, rerank decisions and post-processing of ranked rows, keyed by query_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import CONFIG, Config
from corpusloom.operators.best import Best, sortable
from corpusloom.sources.sinks import kept

#: Vectors of a block, and blocks of queries that a task compares its vectors with, at most, where there are so many.
BLOCK, BLOCKS = 2048, 16
#: Words that make a query vague.
VAGUE = ("介绍", "说说", "解释", "看看", "聊聊", "讲讲", "概述")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, places: int) -> Column:
    """x to so many places as SQL engines do that scale, round and scale back; Spark's round goes by the decimal digits, which differ where a half is between two doubles."""
    scale = float(10**places)
    return F.when(F.isnan(x) | (F.abs(x) > 1e9), F.round(x, places)).otherwise(F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale)


def cosine(a: Column, b: Column) -> Column:
    """0.0 for empty vectors, unequal lengths or a zero norm."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def unit(v: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def blend(query: Column, other: Column, alpha: float = CONFIG.hyde_alpha) -> Column:
    """query * alpha + other * (1 - alpha), or query as it is if lengths differ."""
    return F.when(F.size(query) == F.size(other), F.zip_with(query, other, lambda q, h: q * alpha + h * (1 - alpha))).otherwise(query)


def packed(rows: DataFrame, key: str) -> DataFrame:
    """(size, keys array, units binary): unit vectors of rows (key, vector) in blocks of BLOCK at most of one length; vectors that are null, empty, zero or have a null entry are left out."""
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(size: int, n: int) -> pa.RecordBatch:
            keys = pa.concat_arrays([k for k, _ in held[size]])
            x = np.concatenate([x for _, x in held[size]])
            held[size] = [(keys[n:], x[n:])] if len(keys) > n else []
            keys = keys[:n]
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([x[:n].tobytes()])], names=["size", "keys", "units"])

        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.nonzero(sizes == size)[0]
                values = lists.take(pa.array(at)).flatten()
                x = values.to_numpy(zero_copy_only=False).reshape(-1, size)
                whole = ~np.asarray(values.is_null()).reshape(-1, size).any(axis=1)
                with np.errstate(all="ignore"):
                    norms = np.sqrt((x * x).sum(axis=1))
                    fair = whole & ((norms > 0) | np.isnan(norms))
                    x = x[fair] / norms[fair, None]
                held.setdefault(size, []).append((batch.column(0).take(pa.array(at[fair])), x))
                while sum(len(k) for k, _ in held[size]) >= BLOCK:
                    yield block(size, BLOCK)
        for size, rest in held.items():
            if sum(len(k) for k, _ in rest):
                yield block(size, BLOCK)

    return rows.select(key, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"size int, keys array<{key_type}>, units binary")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = CONFIG.recall_k, threshold: float | None = None) -> DataFrame:
    """(query_id, id, similarity, vector_rank): exact cosine top k of each query. queries: (query_id, vector); vectors: (id, vector).

    All queries are compared with all rows, so the time is their product; blocks of either meet in one matrix product, and a task
    keeps k rows a query. Blocks of queries are written to the shared folder; the planner sends them to every task while they are
    few, and beyond deals pairs of parts, in which no task has more than BLOCKS of them. Null, empty and zero vectors never match.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    # rebalanced, so that there are few blocks however many parts the table has
    asked = packed(queries.select("query_id", "vector").hint("rebalance"), "query_id")
    asked = kept(asked.select("size", F.col("keys").alias("query_ids"), F.col("units").alias("qs"), F.monotonically_increasing_id().alias("block")), "queries")
    many = asked.count()
    if many > BLOCKS:
        asked = asked.repartition(-(-many // BLOCKS)).hint("shuffle_replicate_nl")
    pairs = packed(vectors, "id").crossJoin(asked.withColumnRenamed("size", "query_size")).select("size", "keys", "units", "query_size", "query_ids", "qs", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # by block of queries
        kind = None
        for batch in batches:
            for i in range(batch.num_rows):
                size, query_size, block = (batch.column(c)[i].as_py() for c in (0, 3, 6))
                if size != query_size:
                    continue
                kind = batch.column(1).type.value_type
                ids, null = sortable(batch.column(1)[i].values)
                if block not in best:
                    query_ids = batch.column(4)[i].values
                    best[block] = query_ids, np.frombuffer(batch.column(5)[i].as_py()).reshape(-1, size), Best(len(query_ids), k)
                query_ids, q, found = best[block]
                scores = q @ np.frombuffer(batch.column(2)[i].as_py()).reshape(-1, size).T
                least = found.least
                if not found.full.all() and len(ids) > k:
                    # the k-th best of this block, as the first of them have no bound yet; NaN counts as the greatest
                    own = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                    least = np.maximum(least, np.where(np.isnan(own), np.inf, own))
                a, b = np.nonzero(~(scores < least[:, None] - 2e-6))
                score = scores[a, b]
                score = np.copysign(np.floor(np.abs(score) * 1e6 + 0.5) / 1e6, score)
                if threshold is not None:
                    fair = ~(score < threshold)
                    a, b, score = a[fair], b[fair], score[fair]
                found.add(a, score, ids[b], null[b])
        for query_ids, _, found in best.values():
            rows = found.settle()
            if rows is not None:
                a, score, ids, null = rows
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(a)), pa.array(ids, kind, mask=null), pa.array(score)], names=["query_id", "id", "similarity"])

    found = pairs.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("vector_rank", rank.cast("bigint")).where(F.col("vector_rank") <= k)


def rrf(vector: DataFrame, lexical: DataFrame, cfg: Config = CONFIG) -> DataFrame:
    """(query_id, chunk_id, rrf_score, rrf_rank): by rank only; ties in order of the vector rank, then of the lexical one."""
    both = vector.select("query_id", "chunk_id", "vector_rank").join(lexical.select("query_id", "chunk_id", "bm25_rank"), ["query_id", "chunk_id"], "full_outer")
    score = sum(F.coalesce(1.0 / (cfg.rrf_k + F.col(c)), F.lit(0.0)) for c in ("vector_rank", "bm25_rank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), "bm25_rank"))
    return both.withColumn("rrf_score", score).withColumn("rrf_rank", rank.cast("bigint")).where(F.col("rrf_rank") <= cfg.rrf_keep)


def degrade_mode(vector_error: Column, bm25_error: Column) -> Column:
    return F.when(vector_error & bm25_error, "both_failed").when(vector_error, "bm25_only").when(bm25_error, "vector_only").otherwise("none")


def rerank_decision(fused: DataFrame, queries: DataFrame, override: str = "auto", requested: bool = True, cfg: Config = CONFIG) -> DataFrame:
    """(query_id, use_rerank, candidate_k, reason) from the fused rows and the text of each query."""
    per = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rrf_rank") == 1, F.col("rrf_score"))).alias("one"), F.max(F.when(F.col("rrf_rank") == 2, F.col("rrf_score"))).alias("two"))
    rows = queries.select("query_id", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("plain")).join(per, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    k = F.least(F.col("n"), F.lit(cfg.rerank_candidates)).cast("bigint")
    vague = (F.length("plain") <= cfg.rerank_query_len) | F.lit(False)
    for word in VAGUE:
        vague = vague | F.contains("plain", F.lit(word))
    mode = override if override in ("auto", "on", "off") else "auto"
    reason = (
        F.when(F.col("n") <= 1, "insufficient_candidates").when(F.lit(mode == "off" or not requested), "override_off").when(F.lit(mode == "on"), "override_on").when(vague, "ambiguous_query")
        .when(F.round(F.abs(F.col("one") - F.coalesce("two", F.lit(0.0))), 12) <= cfg.rerank_gap, "close_scores").otherwise("high_confidence_skip")
    )
    out = rows.withColumn("reason", reason)
    return out.select("query_id", F.col("reason").isin("override_on", "ambiguous_query", "close_scores").alias("use_rerank"), F.when(F.col("n") <= 1, F.lit(0)).otherwise(k).cast("bigint").alias("candidate_k"), "reason")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def apply_rerank(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (query_id, chunk_id, rerank_score): no score, NaN or infinite, or one below the threshold, drops a row; nothing fills its place."""
    fair = rows.where(F.col("rerank_score").isNotNull() & ~F.isnan("rerank_score") & (F.abs("rerank_score") < F.lit(float("inf"))) & (F.col("rerank_score") >= threshold))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id"))
    return fair.withColumn("final_score", F.col("rerank_score")).withColumn("rank", rank.cast("bigint"))


def jaccard_scorer(query: Column, content: Column) -> Column:
    """The default cross-scorer: overlap of token sets; any UDF of two text columns may stand in."""
    from corpusloom.operators.lexical import tokens

    a, b = F.array_distinct(tokens(query)), F.array_distinct(tokens(content))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def post_process(rows: DataFrame, top_k: int = 5, cfg: Config = CONFIG, order: str = "rank") -> DataFrame:
    """Ranked rows (query_id, chunk_id, document_id, content, <order>) after content dedup, cap per document and top k; renumbered.

    Texts of fewer than dedup_min_len characters are only equal to themselves. The cap is skipped if a query has one document.
    """
    plain = F.trim(F.col("content"))
    key = F.when(F.length(plain) < cfg.dedup_min_len, F.concat(F.lit("id:"), F.col("chunk_id").cast("string"))).otherwise(F.lower(F.regexp_replace(plain, r"\s+", " ")))
    rows = rows.withColumn("_key", key)
    first = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(order))
    rows = rows.withColumn("_n", first).where("_n = 1")
    doc = F.when(F.col("document_id").isNull() | (F.col("document_id").cast("string") == ""), F.concat(F.lit("unknown:"), F.col("chunk_id").cast("string"))).otherwise(F.col("document_id").cast("string"))
    rows = rows.withColumn("_doc", doc)
    within = F.row_number().over(Window.partitionBy("query_id", "_doc").orderBy(order))
    one = F.min("_doc").over(Window.partitionBy("query_id")) == F.max("_doc").over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_n", within).withColumn("_one", one).where((F.col("_n") <= cfg.max_per_document) | F.col("_one"))
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    return rows.withColumn("final_rank", final.cast("bigint")).where(F.col("final_rank") <= top_k).drop("_key", "_n", "_doc", "_one")


def stage_counts(**stages: DataFrame) -> DataFrame:
    """(query_id, <stage> ...): rows of each stage, for tracing."""
    out = None
    for name, rows in stages.items():
        c = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
        out = c if out is None else out.join(c, "query_id", "full_outer")
    return out.select("query_id", *(F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in stages))
