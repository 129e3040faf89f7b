"""The stored index, its tokenizer, ingest, approximate search, parent contexts, platform users and embedding batches."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import embedding as E
from corpusloom.functions import text as T
from corpusloom.operators import ann, identity
from corpusloom.operators import context as C
from corpusloom.operators import index_store as I  # noqa: E741
from corpusloom.operators import lexical as L
from corpusloom.operators import retrieval as R
from corpusloom.streaming import ingest as G

WORDS = {"变压器": 50, "保护": 90, "故障": 80, "装置": 60, "通信": 40, "版本": 20, "地址": 20, "配置": 20, "距离": 5, "采用": 5, "错误码": 5}
STOP = frozenset(L.STOP_WORDS) | frozenset(T.STOP_WORDS_ZH)


def cut(text):
    return T.protected_tokens(text, T.Lattice(WORDS), STOP)


# the tokenizer


def test_technical_tokens_stay_whole():
    got = cut("RCS-931 保护装置 IEC61850 通信 故障 0x8001 103规约")
    assert {"rcs-931", "iec61850", "0x8001", "103规约", "保护", "装置", "通信", "故障"} == set(got)
    assert {"psl-621u", "v2.1.3", "192.168.1.1", "版本", "地址", "配置"} <= set(cut("PSL-621U 版本 v2.1.3 地址 192.168.1.1 配置"))
    assert list(dict.fromkeys(cut("变压器 变压器 故障 保护 故障"))) == ["变压器", "故障", "保护"]
    assert cut("RCS-931 RCS-931 故障 保护").count("rcs-931") == 2
    assert cut("RCS-931 的 是 在 装置") == ["rcs-931", "装置"]
    once = cut("装置采用 IEC61850 与 IEC-104 通信, RCS-931 保护, 地址 192.168.1.1, 版本 v2.1.3, 错误码 0x8001")
    assert all(once.count(t) == 1 for t in ("iec61850", "iec-104", "rcs-931", "192.168.1.1", "v2.1.3", "0x8001"))
    assert cut("IEC61850 通信 IEC61850").count("iec61850") == 2
    assert cut("ＩＥＣ６１８５０ Ａｂｃ") == ["iec61850", "abc"] and cut("") == [] and cut(None) == []


def test_lattice_takes_the_likeliest_path():
    rnd = random.Random(2)
    letters = "变压器保护故"
    words = {"".join(rnd.choices(letters, k=rnd.randrange(1, 4))): rnd.randrange(1, 50) for _ in range(14)}
    lattice = T.Lattice(words)
    for _ in range(150):
        run = "".join(rnd.choices(letters, k=rnd.randrange(1, 9)))
        paths = []
        for ends in itertools.product([0, 1], repeat=len(run) - 1):
            at = [0, *(i + 1 for i, e in enumerate(ends) if e), len(run)]
            parts = [run[a:b] for a, b in itertools.pairwise(at)]
            if all(len(p) == 1 or p in lattice.cost for p in parts):
                paths.append((sum(lattice.cost.get(p, lattice.rare) for p in parts), parts))
        got = lattice(run)
        assert "".join(got) == run and math.isclose(sum(lattice.cost.get(p, lattice.rare) for p in got), min(paths)[0])


def test_tokenizer_feeds_the_index(spark):
    chunks = spark.createDataFrame([(1, 1, "kb", "t", "RCS-931 差动保护 RCS-931"), (2, 1, "kb", None, None)], "chunk_id bigint, document_id bigint, kb_id string, title string, content string")
    terms = L.term_index(chunks, tokens=T.technical_tokenizer(WORDS))
    assert {(r["chunk_id"], r["term"], r["tf"]) for r in terms.collect()} == {(1, "rcs-931", 2), (1, "保护", 1), (1, "差", 1), (1, "动", 1), (1, "t", 1)}


def test_first_terms_only(spark):
    import dataclasses

    cfg = dataclasses.replace(L.CONFIG, max_terms=2)
    chunks = spark.createDataFrame([(1, 1, "kb", "b a b c a d b")], "chunk_id bigint, document_id bigint, kb_id string, content string").withColumn("content", F.regexp_replace("content", "a", "x"))
    assert {(r["term"], r["tf"]) for r in L.term_index(chunks, cfg).collect()} == {("b", 3), ("x", 2)}
    assert L.lexical_documents(chunks, cfg).first()["token_count"] == 5


# the stored index

ROWS = "chunk_id bigint, document_id bigint, kb_id string, content string"


def shown(spark, path):
    docs = {tuple(r) for r in I.documents(spark, path).select("kb_id", "document_id", "chunk_id", "token_count").collect()}
    terms = {tuple(r) for r in I.live(spark, path, "terms").select("kb_id", "chunk_id", "term", "tf").collect()}
    return docs, terms


def test_segments_replace_whole_documents(spark, tmp_path):
    path = f"{tmp_path}/index"
    I.write_segment(spark.createDataFrame([(1, 1, "7", "red fox fox"), (2, 1, "7", "blue"), (3, 2, "7", "green fox"), (4, 3, "8", "grey"), (5, 4, None, "fox")], ROWS), path, 0)
    new = spark.createDataFrame([(1, 1, "7", "red dog")], ROWS)
    for _ in range(2):
        I.write_segment(new, path, 1, spark.createDataFrame([(2,)], "document_id bigint"))
        docs, terms = shown(spark, path)
        assert docs == {("7", 1, 1, 2), ("8", 3, 4, 1), (None, 4, 5, 1)}
        assert terms == {("7", 1, "red", 1), ("7", 1, "dog", 1), ("8", 4, "grey", 1), (None, 5, "fox", 1)}
    I.delete_bases(spark, path, ["8"], 2)
    I.write_segment(spark.createDataFrame([(9, 9, "8", "late")], ROWS), path, 3)
    I.compact(spark, path, f"{tmp_path}/small")
    for p in (path, f"{tmp_path}/small"):
        assert shown(spark, p)[0] == {("7", 1, 1, 2), (None, 4, 5, 1), ("8", 9, 9, 1)}
    with pytest.raises(ValueError):
        I.documents(spark, f"{tmp_path}/none")


def test_search_opens_the_buckets_of_its_terms_and_tokenises_once(spark, tmp_path):
    path = f"{tmp_path}/index"
    rnd = random.Random(1)
    rows = [(i, i // 3, rnd.choice(["a", "b"]), " ".join(rnd.choices(["fox", "dog", "cow", "hen", "owl"], k=6))) for i in range(60)]
    chunks = spark.createDataFrame(rows, ROWS)
    I.write_segment(chunks, path, 0)
    asked = spark.createDataFrame([(1, "a", ["fox", "owl"]), (2, "b", ["hen"])], "query_id bigint, kb_id string, terms array<string>")
    found = I.search(asked, path, k=7)
    plain = L.bm25(asked, L.term_index(chunks), L.lexical_documents(chunks), k=7)
    assert sorted(found.collect()) == sorted(plain.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # no text is cut at search time
    scans = [line for line in plan.split("\n") if "PartitionFilters" in line and "term#" in line]
    assert scans and all("bucket#" in line.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in line for line in scans)


# ingest


def test_ingest_in_batches_is_one_build(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, arrived int"
    rnd = random.Random(4)
    text = lambda: "\n".join(" ".join(rnd.choices(["fox", "dog", "cow", "hen"], k=30)) for _ in range(12))
    first = [(i, text(), "en", "s", 1) for i in range(12)]
    second = [(3, text(), "en", "s", 2), (3, "last words", "en", "s", 3), (5, None, "en", "s", 2), (20, text(), "de", "s", 2)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/arrivals")
        for _ in range(2):  # nothing new the second time
            G.ingest(spark, f"{tmp_path}/arrivals", f"{tmp_path}/index", f"{tmp_path}/state", schema)
    want = {r[0]: r for r in first} | {3: second[1], 20: second[3]}
    del want[5]
    chunks = G.M.lines_of(spark.createDataFrame(list(want.values()), schema))
    assert {tuple(r) for r in I.documents(spark, f"{tmp_path}/index").collect()} == {tuple(r) for r in L.lexical_documents(chunks).select("chunk_id", "document_id", "kb_id", "token_count", "content_hash").collect()}
    columns = ("document_id", "block_no", "content_hash")
    assert {tuple(r) for r in I.live(spark, f"{tmp_path}/index", "blocks").select(*columns).collect()} == {tuple(r) for r in C.context_blocks(chunks).select(*columns).collect()}


# approximate search


def test_ann_finds_nine_tenths_and_all_with_all_cells(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in middles[i % 20] + 0.4 * rng.normal(size=16)]) for i in range(1500)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, 2.0]), (None, rows[0][1]), (2004, rows[0][1]), (2004, rows[0][1])]
    vectors = spark.createDataFrame([(*r, "z", "z") for r in rows], "id bigint, vector array<double>, cell string, block string")
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = R.vector_topk(queries, vectors.where("id is not null"), 10)
    cells = ann.fit_cells(vectors, 10, cells=40)
    assert cells.probes < 20  # clusters are told apart
    found = ann.ann_topk(queries, vectors, 10, cells)
    assert ann.recall(found, exact).first()["recall"] >= 0.9
    whole = ann.ann_topk(queries, vectors, 10, ann.Cells(cells.centres, len(cells.centres)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))
    assert ann.ann_topk(queries, vectors.limit(0), 10).count() == 0 and ann.ann_topk(queries.limit(0), vectors, 10, cells).count() == 0


def test_ann_query_recall(spark):
    from corpusloom.plans import retrieval as P
    from corpusloom.plans import store as S

    d = "/root/testdata/sf0.01"
    assert ann.recall(S.ann_topk(spark, d), P.vector_topk(spark, d)).first()["recall"] >= 0.9


# parent contexts


def contexts(spark, chunks, blocks, hits, **more):
    c = spark.createDataFrame(chunks, "chunk_id string, document_id string, sequence_no bigint, content string")
    b = spark.createDataFrame(blocks, "chunk_id string, block_no int")
    h = spark.createDataFrame(hits, "query_id bigint, chunk_id string, document_id string, final_rank bigint")
    return C.expand_with_parents(h, c, b, **more)


CHUNKS = [(f"{d}{i}", d, i, f"{d} text {i} ends\n") for d in "xy" for i in range(8)]


def test_hits_grow_to_their_blocks_and_neighbours(spark):
    rows = {r["chunk_id"]: r for r in contexts(spark, CHUNKS, [("x2", 0), ("x3", 0), ("x4", 0)], [(1, "x3", "x", 1), (1, "x7", "x", 2), (1, "y0", "y", 3), (1, "gone", "x", 4)]).collect()}
    assert rows.keys() == {"x3", "x7", "y0"}
    assert (rows["x3"]["source"], rows["x3"]["chunk_ids"], rows["x3"]["before_ids"], rows["x3"]["after_ids"]) == ("parent_adjacent", ["x1", "x2", "x3", "x4", "x5"], ["x1"], ["x5"])
    assert (rows["x7"]["source"], rows["x7"]["chunk_ids"], rows["x7"]["after_ids"]) == ("child_adjacent", ["x6", "x7"], [])
    assert rows["y0"]["context"] == "y text 0 ends\ny text 1 ends\n" and not rows["y0"]["truncated"]
    wide = contexts(spark, CHUNKS, [], [(1, "x3", "x", 1)], window=2).first()
    assert wide["before_ids"] == ["x2", "x1"] and wide["after_ids"] == ["x4", "x5"]
    alone = contexts(spark, [("a", "d", 0, "only")], [("a", 0)], [(1, "a", "d", 1)]).first()
    assert (alone["source"], alone["context"]) == ("parent", "only")


def test_context_is_cut_around_the_hit(spark):
    chunks = [(f"c{i}", "d", i, f"<{i}>" + chr(97 + i) * 97) for i in range(5)]
    row = contexts(spark, chunks, [(f"c{i}", 0) for i in range(5)], [(1, "c2", "d", 1)], most=140).first()
    assert row["truncated"] and len(row["context"]) == 140 and chunks[2][3] in row["context"] and row["context"].startswith("b" * 20)
    tight = contexts(spark, chunks, [(f"c{i}", 0) for i in range(5)], [(1, "c2", "d", 1)], most=40).first()
    assert tight["context"] == chunks[2][3][:40]


def test_groups_of_contexts(spark):
    hits = [(1, "x3", "x", 4), (1, "x2", "x", 2), (1, "y1", "y", 1), (1, "y2", "y", 3), (1, "y6", "y", 5), (2, "x0", "x", 1)]
    rows = C.grouped_contexts(contexts(spark, CHUNKS, [("x2", 0), ("x3", 0)], hits), window=1).orderBy("query_id", "group_rank").collect()
    assert [(r["query_id"], r["group_id"], r["chunk_ids"], r["best_rank"]) for r in rows] == [(1, "y:none:2", ["y1", "y2"], 1), (1, "x:0:2", ["x2", "x3"], 2), (1, "y:none:1", ["y6"], 5), (2, "x:none:1", ["x0"], 1)]
    # the second text of a group loses what the first ends with
    assert rows[0]["context"] == "".join(f"y text {i} ends\n" for i in range(4)) and rows[1]["context"].count("x text 3") == 1
    small = C.grouped_contexts(contexts(spark, CHUNKS, [("x2", 0), ("x3", 0)], hits), total=70).where("query_id = 1").orderBy("group_rank").collect()
    assert sum(len(r["context"]) for r in small) == 70 and [r["truncated"] for r in small] == [False, True, True] and small[2]["context"] == ""


# platform users


def test_users_are_made_once(spark):
    requests = spark.createDataFrame([(2, "WeChat", "u1", "Ann", 5), (1, "WeChat", "u1", "", None), (3, "QQ", "known", "K", 5), (4, "QQ", "  ", None, 6), (5, None, "x", "x", 1)], "request_id bigint, platform string, platform_user_id string, display_name string, tenant_id bigint")
    mappings = spark.createDataFrame([("QQ", "known", "k", 5, None)], "platform string, platform_user_id string, user_id string, tenant_id bigint, display_name string")
    tenants = spark.createDataFrame([(9, 2), (8, 1)], "tenant_id bigint, created_at int")
    users, new = identity.get_or_create(requests, mappings, tenants)
    got = {r["email"]: r for r in users.collect()}
    assert len(got) == 2
    ann_row = got["wechat_u1@platform.local"]
    assert (ann_row["tenant_id"], ann_row["name"], ann_row["role"]) == (8, "WeChat:u1", "user")  # the first request has no name and no tenant
    assert any(e.startswith("qq_") and len(e) == len("qq_") + 12 + len("@platform.local") for e in got)
    again, _ = identity.get_or_create(requests, mappings.unionByName(new.withColumn("tenant_id", F.col("tenant_id").cast("bigint"))), tenants)
    assert again.count() == 0
    assert {r["user_id"] for r in identity.get_or_create(requests, mappings, tenants)[0].collect()} == {r["user_id"] for r in got.values()}


# embedding batches


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_embeddings_do_not_depend_on_batches(spark, size):
    rows = [(i, None if i % 9 == 0 else f"text {i % 5} of {i}") for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    make = E.hashed_words(16)

    def watched():
        model = make()

        def call(texts):
            if not (len(texts) == 32 or len(texts) == 150 % 32):
                raise ValueError(f"a batch of {len(texts)}")
            return model(texts)

        return call

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        got = E.embedded(df, watched, "id", "text").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["id"] for r in got] == list(range(150))
    x = np.asarray(make()([t or "" for _, t in rows]))
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose([r["vector"] for r in got], x / np.where(norms > 0, norms, 1))


def test_every_text_has_a_vector(spark):
    """Texts whose words cancel, and texts without words, have norm 1 as in the SQL of embedded_documents."""
    import itertools

    import xxhash

    hashes = {w: xxhash.xxh3_64_intdigest(w) for w in (f"w{i}" for i in range(200))}
    a, b = next((a, b) for a, b in itertools.combinations(hashes, 2) if hashes[a] % 64 == hashes[b] % 64 and hashes[a] >> 63 != hashes[b] >> 63)
    df = spark.createDataFrame([(1, f"{a} {b}"), (2, ""), (3, None), (4, " \n "), (5, f"{a} {b} {a}")], "id bigint, text string")
    got = {r["id"]: r["vector"] for r in E.embedded(df, E.hashed_words(), "id", "text").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values())
    assert got[1] != got[2] == got[3] == got[4]
