"""Lexical index and Okapi BM25, for many queries and many knowledge bases at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.config import CONFIG, META_KEYS, Config

#: English words that are not indexed.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "as", "at", "by", "with", "from"]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words: the default segmenter, all in the JVM."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: ~t.isin(STOP_WORDS))


def query_tokens(text: Column, cfg: Config = CONFIG) -> Column:
    return F.slice(F.array_distinct(tokens(text)), 1, cfg.max_query_terms)


def index_text(title: Column, section: Column, meta: Column, content: Column) -> Column:
    """Title, section, white-listed metadata (a map) and content, one per line, empty ones left out."""
    parts = F.array(title, section, *[F.element_at(meta, k) for k in META_KEYS], content)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def text_to_index(chunks: DataFrame) -> Column:
    """index_text of the columns that chunks have: title, section, content, and the white-listed metadata by their own names."""
    have = lambda c: F.col(c).cast("string") if c in chunks.columns else F.lit(None).cast("string")
    meta = F.create_map(*[x for k in META_KEYS if k in chunks.columns for x in (F.lit(k), have(k))]) if set(META_KEYS) & set(chunks.columns) else F.create_map().cast("map<string,string>")
    return index_text(have("title"), have("section"), meta, F.col("content"))


def index_hash(text: Column, cfg: Config = CONFIG) -> Column:
    return F.sha2(F.concat(F.lit(f"{cfg.index_version}::"), F.substring(text, 1, cfg.max_text)), 256)


def capped(tokens: Column, cfg: Config = CONFIG) -> Column:
    """Tokens among the first max_terms distinct ones; a text of no more tokens than that is not looked into.

    The first ones are computed inside a lambda: in the open, Spark computes them for every text as a common subexpression.
    """
    few = F.size(tokens) <= cfg.max_terms
    among = F.transform(F.array(F.slice(F.array_distinct(tokens), 1, cfg.max_terms)), lambda first: F.filter(tokens, lambda t: F.array_contains(first, t)))
    return F.when(few, tokens).otherwise(F.element_at(among, 1))


def counted(at: DataFrame) -> DataFrame:
    """tf of each row of at (one row per token)."""
    return at.groupBy(*at.columns).agg(F.count(F.lit(1)).alias("tf"))


def counted_lists(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """rows with arrays terms and tfs (each term of a row once) in place of an array of tokens; counted where the row is, so nothing is shuffled."""
    rest = [c for c in rows.columns if c != tokens]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(rest))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            coded = lists.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + np.asarray(coded.indices, np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * width).astype(np.int32))
            arrays = pa.ListArray.from_arrays(offsets, coded.dictionary.take(pa.array(keys % width))), pa.ListArray.from_arrays(offsets, pa.array(counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *arrays], names=[*rest, "terms", "tfs"])

    return rows.select(*rest, tokens).mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in rest), "terms array<string>", "tfs array<bigint>"]))


def term_index(chunks: DataFrame, cfg: Config = CONFIG, tokens: Callable[[Column], Column] = tokens) -> DataFrame:
    """(chunk_id, document_id, kb_id, term, tf): the first max_terms distinct terms of each chunk, in order of first occurrence."""
    text = F.substring(text_to_index(chunks), 1, cfg.max_text)
    at = chunks.select("chunk_id", "document_id", "kb_id", tokens(text).alias("tokens")).select("chunk_id", "document_id", "kb_id", F.explode(capped(F.col("tokens"), cfg)).alias("term"))
    return counted(at)


def lexical_documents(chunks: DataFrame, cfg: Config = CONFIG, tokens: Callable[[Column], Column] = tokens) -> DataFrame:
    """(chunk_id, document_id, kb_id, token_count, content_hash): a row for every chunk, tokens counted after the cut."""
    text = F.substring(text_to_index(chunks), 1, cfg.max_text)
    rows = chunks.select("chunk_id", "document_id", "kb_id", tokens(text).alias("tokens"), index_hash(text_to_index(chunks), cfg).alias("content_hash"))
    return rows.select("chunk_id", "document_id", "kb_id", F.coalesce(F.size(capped(F.col("tokens"), cfg)), F.lit(0)).cast("bigint").alias("token_count"), "content_hash")


def corpus_stats(lexical: DataFrame) -> DataFrame:
    """(kb_id, n, avgdl) over all chunks of a knowledge base, whatever is filtered later."""
    return lexical.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.nullif("token_count", F.lit(0))), F.lit(0.0)).alias("avgdl"))


def bm25(queries: DataFrame, terms: DataFrame, lexical: DataFrame, allowed: DataFrame | None = None, cfg: Config = CONFIG, k: int | None = None) -> DataFrame:
    """Best chunks of each query (query_id, kb_id, terms array): (query_id, chunk_id, document_id, score, matched_terms, bm25_rank).

    allowed: chunk ids that may be returned (statistics ignore it). Query terms are the small side of the only join with the
    inverted index, so the planner broadcasts them while they are small; scores are rounded to 9 places, ties go by chunk id.
    """
    asked = queries.select("query_id", "kb_id", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = asked.select("kb_id", "term").distinct()
    posting = terms.join(wanted, ["kb_id", "term"])
    df = posting.groupBy("kb_id", "term").agg(F.count(F.lit(1)).alias("df"))  # a chunk has one row a term
    stats = corpus_stats(lexical)
    weights = asked.join(df, ["kb_id", "term"]).join(stats, "kb_id").withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    if allowed is not None:
        posting = posting.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    if "token_count" not in terms.columns:
        posting = posting.join(lexical.select("chunk_id", "token_count"), "chunk_id")
    part = weights.join(posting, ["kb_id", "term"])
    length = F.coalesce(F.col("token_count") / F.nullif("avgdl", F.lit(0.0)), F.lit(0.0))
    score = F.col("idf") * F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * length))
    scored = part.groupBy("query_id", "chunk_id", "document_id").agg(F.round(F.sum(score), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("term")), " ").alias("matched_terms")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("bm25_rank", rank.cast("bigint")).where(F.col("bm25_rank") <= (k or cfg.recall_k))


def compile_filters(filters: dict) -> tuple[dict[str, str], str | None]:
    """White-listed metadata equalities and the document id; every other key is ignored, values are only ever literals."""
    return {k: str(v) for k, v in (filters or {}).items() if k in META_KEYS}, str(filters["document_id"]) if filters and "document_id" in filters else None


def passing(chunks: DataFrame, filters: dict | None) -> Column:
    """Whether chunks pass the filters; they carry metadata columns or a JSON column meta."""
    items, document = compile_filters(filters or {})
    out = F.lit(True) if document is None else F.col("document_id").cast("string") == document
    for key, value in items.items():
        out = out & ((F.col(key) if key in chunks.columns else F.get_json_object("meta", f"$.{key}")) == F.lit(value))
    return out


def allowed_chunks(chunks: DataFrame, documents: DataFrame, filters: dict | None = None, status: str = "ready") -> DataFrame:
    """Ids of chunks of ready documents that pass the filters; chunks carry metadata columns or a JSON column meta."""
    ready = documents.where(F.col("status") == status).select("document_id")
    return chunks.join(ready, "document_id", "left_semi").where(passing(chunks, filters)).select("chunk_id")


def index_diff(chunks: DataFrame, documents: DataFrame, existing: DataFrame, cfg: Config = CONFIG, force: bool = False) -> DataFrame:
    """(document_id, action): skipped_no_chunk, indexed (nothing of the document is there yet), updated (a chunk is new or differs, or force) or skipped.

    existing: (document_id, chunk_id, content_hash) of what is indexed.
    """
    now = chunks.select("document_id", "chunk_id", index_hash(text_to_index(chunks), cfg).alias("now_hash"))
    there = existing.select("document_id", "chunk_id", F.col("content_hash").alias("old_hash"))
    both = now.join(there, ["document_id", "chunk_id"], "full_outer")
    differs = F.col("now_hash").isNotNull() & ~F.col("now_hash").eqNullSafe(F.col("old_hash"))
    per = both.groupBy("document_id").agg(F.count("now_hash").alias("chunks"), F.count("old_hash").alias("old"), F.max(differs.cast("int")).alias("differs"))
    action = F.when(F.coalesce("chunks", F.lit(0)) == 0, "skipped_no_chunk").when(F.col("old") == 0, "indexed").when(F.lit(force) | (F.col("differs") == 1), "updated").otherwise("skipped")
    return documents.join(per, "document_id", "left").select("document_id", action.alias("action"))


def delete_documents(index: DataFrame, documents: DataFrame) -> DataFrame:
    """The index without the rows of these documents; written back by partition overwrite."""
    return index.join(documents.select("document_id"), "document_id", "left_anti")


def keyset_page(rows: DataFrame, key: str, last, size: int) -> DataFrame:
    return (rows if last is None else rows.where(F.col(key) > last)).orderBy(key).limit(size)
