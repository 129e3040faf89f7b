"""Search by scanning, the best rows of a task, exact vectors in blocks, contexts by shared spans: against plain loops and the index, and nothing large on disk."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.operators import context as C
from corpusloom.operators import lexical as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import scan
from corpusloom.operators.best import Best, sortable
from corpusloom.sources import sinks


def test_scan_gives_what_the_index_gives(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, i // 4, ("en", "de", None)[i // 4 % 3], " ".join(rng.choices(words, k=rng.choice((0, 3, 12, 40)))), f"M{i % 3}") for i in range(400)]
    rows += [(900 + i, 500, "en", "w1 w2 w3", "M1") for i in range(30)]  # ties
    chunks = spark.createDataFrame(rows, "chunk_id bigint, document_id bigint, kb_id string, content string, model string").repartition(5)
    docs = spark.createDataFrame([(i, "ready" if i % 5 else "pending") for i in {r[1] for r in rows}], "document_id bigint, status string")
    queries = spark.createDataFrame([(1, "en", ["w1", "w2", "w1"]), (2, "de", ["w3", "nowhere", "w7"]), (3, "xx", ["w1"]), (4, "en", ["nowhere"]), (5, "en", words[:30])], "query_id bigint, kb_id string, terms array<string>")
    cfg = Config(max_terms=9)
    monkeypatch.setattr(scan, "SCORES", 60)
    for filters in (None, {"model": "M1"}):
        want = L.bm25(queries, L.term_index(chunks, cfg), L.lexical_documents(chunks, cfg), L.allowed_chunks(chunks, docs, filters), cfg, 7)
        key = lambda r: (r["query_id"], r["bm25_rank"], r["chunk_id"], r["document_id"], round(r["score"], 8), r["matched_terms"])
        want = sorted(map(key, want.collect()))
        assert {w[0] for w in want} == {1, 2, 5}
        for most in (scan.ASKED, 3):  # with few terms at most they are joined
            assert sorted(map(key, scan.search(queries, chunks, docs, filters, cfg=cfg, k=7, asked_most=most).collect())) == want
    assert scan.search(queries.where("query_id = 4"), chunks).collect() == []


def test_a_search_leaves_its_result_only(spark, tmp_path, monkeypatch):
    """The table of asked terms goes, and no table of all terms is written."""
    monkeypatch.setattr(sinks, "shared_folder", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    chunks = spark.range(20_000).select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit("en").alias("kb_id"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256) for k in range(5)]).alias("content"))
    queries = spark.createDataFrame([(1, "en", [chunks.first()["content"].split()[0]])], "query_id bigint, kb_id string, terms array<string>")
    assert [r["chunk_id"] for r in scan.search(queries, chunks).collect()] == [0]
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 50_000  # texts have 6.5 MB


def test_best_rows(monkeypatch):
    from corpusloom.operators import best as B

    monkeypatch.setattr(B, "HELD", 8)
    rng = np.random.default_rng(3)
    for ids in (np.arange(3000), np.array([f"k{i:04}" for i in range(3000)], object)):
        rows = [(int(q), float(s), i) for q, s, i in zip(rng.integers(0, 4, 3000), rng.choice([0.1, 0.2, 0.3, np.nan], 3000, p=[0.5, 0.3, 0.195, 0.005]), ids[rng.permutation(3000)], strict=True)]
        b = Best(5, 20)
        for at in range(0, 3000, 70):
            q, s, i = zip(*rows[at : at + 70], strict=True)
            b.add(np.array(q), np.array(s), np.array(i, ids.dtype))
        q, s, i = b.settle()
        order = lambda r: (r[0], -(np.inf if np.isnan(r[1]) else r[1]), r[2])
        want = [r for n in range(4) for r in sorted((r for r in rows if r[0] == n), key=order)[:20]]
        assert [(a, str(b), c) for a, b, c in zip(q.tolist(), s.tolist(), i.tolist(), strict=True)] == [(a, str(b), c) for a, b, c in want]
    assert sortable(pa.array([3, None]))[1].tolist() == [False, True]


def test_vectors_in_blocks(spark, monkeypatch):
    """Several blocks of either side, equal vectors, other lengths, null and zero vectors, by both joins."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 8)).round(2)
    x[1000:1200] = x[0]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0] * 5), (5004, [1.0, None] * 4), (None, x[0].tolist())]
    queries = [(q, x[q].tolist()) for q in range(0, 3000, 10)] + [(-1, [1.0] * 5), (-2, [0.0] * 8), (-3, None)]
    v = spark.createDataFrame(vectors, "id bigint, vector array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id bigint, vector array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit[::10] @ unit.T
    scores = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores)
    want = {(n * 10, i, r + 1) for n in range(300) for r, i in enumerate(np.lexsort((np.arange(3000), -scores[n]))[:30].tolist())}
    monkeypatch.setattr(R, "BLOCK", 64)
    for blocks in (16, 2):
        monkeypatch.setattr(R, "BLOCKS", blocks)
        got = R.vector_topk(q, v.where("id is not null"), 30)
        assert ("CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()) == (blocks == 2)
        assert {(r["query_id"], r["id"], r["vector_rank"]) for r in got.collect()} == want | {(-1, 5003, 1)}
    assert {r["id"] for r in R.vector_topk(q.where("query_id = 0"), v, 30).collect()} == {None, 0, *range(1000, 1028)}
    assert all(r["similarity"] >= 0.5 for r in R.vector_topk(q, v, 30, 0.5).collect())


def test_overlap_of_columns(spark):
    rng = random.Random(2)
    rows = [(a, b) for a, b in (("".join(rng.choices("ab", k=rng.randrange(12))), "".join(rng.choices("ab", k=rng.randrange(12)))) for _ in range(300))] + [(None, "a"), ("x" * 400, "x" * 500), ("ä€", "€ü")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", C.overlap_length(F.col("a"), F.col("b"), 2).alias("n")).collect()
    for r in got:
        a, b = r["a"] or "", r["b"] or ""
        assert r["n"] == max(n for n in range(min(len(a), len(b), 6) + 1) if a[len(a) - n :] == b[:n])


def test_contexts_do_not_repeat_texts(spark):
    """Hits of one block take its texts once: the plan explodes spans, not hits."""
    chunks = spark.createDataFrame([(i, i // 8, i % 8, f"text {i} " * 40) for i in range(64)], "chunk_id bigint, document_id bigint, sequence_no bigint, content string")
    blocks = chunks.select("chunk_id", F.lit(0).alias("block_no"))
    hits = chunks.select(F.lit(1).alias("query_id"), "chunk_id", "document_id", F.col("chunk_id").alias("final_rank"))
    out = C.expand_with_parents(hits, chunks, blocks)
    assert out.count() == 64
    assert {len(r["chunk_ids"]) for r in out.collect()} == {8}


def test_kept_tables_go(spark):
    rows = sinks.kept(spark.range(3).toDF("a"), "some")
    folder = Path(rows.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    sinks.removed(rows)
    assert not folder.exists()


def test_terms_are_counted_where_they_are(spark):
    rows = [(i, [f"w{k % (i + 1)}" for k in range(2 * i)]) for i in range(40)] + [(99, None)]
    got = L.counted_lists(spark.createDataFrame(rows, "id bigint, tokens array<string>").repartition(3))
    assert "Exchange" not in L.counted_lists(spark.range(5).select("id", F.array(F.lit("a")).alias("tokens")))._jdf.queryExecution().executedPlan().toString()
    from collections import Counter

    for r in got.collect():
        want = Counter(next(t for i, t in rows if i == r["id"]) or [])
        assert dict(zip(r["terms"], r["tfs"], strict=True)) == want and len(r["terms"]) == len(want)
