"""Tunables that change results; passed to operators, never read from the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # lexical index and BM25
    index_version: str = "v1"
    max_terms: int = 2000
    max_text: int = 200_000
    k1: float = 1.5
    b: float = 0.75
    max_query_terms: int = 32
    # recall, fusion, rerank
    recall_k: int = 40
    rrf_k: int = 60
    rrf_keep: int = 30
    rerank_candidates: int = 20
    rerank_gap: float = 0.03
    rerank_query_len: int = 8
    max_per_document: int = 3
    dedup_min_len: int = 50
    hyde_alpha: float = 0.5
    # chunking
    chunk_md: int = 800
    chunk_image: int = 500
    chunk_word: int = 700
    chunk_overlap: int = 100
    chunk_other: int = 500
    chunk_other_overlap: int = 50
    # context
    window: int = 1
    context_version: str = "v1"
    block_target: int = 1400
    block_max: int = 1800
    block_min_children: int = 4
    block_max_children: int = 8
    result_chars: int = 6000
    total_chars: int = 24_000


CONFIG = Config()

#: Metadata keys that may be filtered on and indexed.
META_KEYS = ("model", "model_no", "device_model", "version", "versions", "keyword", "keywords", "standard", "protocol", "protocol_no")
#: States of documents and runs.
DOCUMENT_STATUS = ("pending", "indexing", "ready", "error")
RUN_STATUS = ("running", "completed", "failed")
