"""Behaviour on small tables: ranks, dedup, caps, blocks, rules, addresses, chunkers."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.functions import rules
from corpusloom.functions import text as T
from corpusloom.functions import urls as U
from corpusloom.operators import context as C
from corpusloom.operators import lexical as L
from corpusloom.operators import retrieval as R
from corpusloom.operators import serp as P
from corpusloom.plans import search
from corpusloom.sources.files import parse_results
from corpusloom.streaming.streams import Breaker


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {v[1]}" for k, v in cells.items()) or "x int"
    return spark.createDataFrame([tuple(v[0] for v in cells.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


def test_rrf_scores_and_ties(spark):
    vec = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, vector_rank int")
    lex = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id int, bm25_rank int")
    rows = R.rrf(vec, lex).orderBy("rrf_rank").collect()
    assert [r["chunk_id"] for r in rows] == [11, 10, 12]
    assert math.isclose(rows[0]["rrf_score"], 1 / 62 + 1 / 61, abs_tol=1e-12)
    assert math.isclose(rows[1]["rrf_score"], 1 / 61, abs_tol=1e-12)


def test_rerank_drops_bad_scores_and_does_not_fill(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, float("nan")), (1, 3, None), (1, 4, float("inf")), (1, 5, 0.1)], "query_id int, chunk_id int, rerank_score double")
    assert [r["chunk_id"] for r in R.apply_rerank(rows, 0.2).collect()] == [1]


def test_post_process_dedup_then_cap(spark):
    long = "x" * 60
    data = [(1, 1, "d1", f"{long} a", 1), (1, 2, "d1", f"{long}  A", 2), (1, 3, "d1", "SAME", 3), (1, 4, "d1", "SAME", 4), (1, 5, "d2", f"{long} b", 5), (1, 6, "d1", f"{long} c", 6)]
    rows = spark.createDataFrame(data, "query_id int, chunk_id int, document_id string, content string, rank int")
    out = R.post_process(rows, 10, Config(max_per_document=2)).orderBy("final_rank").collect()
    assert [(r["chunk_id"], r["final_rank"]) for r in out] == [(1, 1), (3, 2), (5, 3)]
    single = R.post_process(rows.where("document_id = 'd1'"), 10, Config(max_per_document=2)).count()
    assert single == 4  # one document only: no cap


def test_cosine_guards(spark):
    v = lambda a, b: value(spark, R.cosine(F.col("a"), F.col("b")), a=(a, "array<float>"), b=(b, "array<float>"))
    assert v([1.0, 0.0], [1.0, 0.0]) == 1.0
    assert v([], []) == v([1.0], [1.0, 2.0]) == v([0.0], [1.0]) == 0.0


def test_filters_are_white_listed(spark):
    assert L.compile_filters({"model": "RCS-931", "x' OR 1=1": 1, "document_id": 7}) == ({"model": "RCS-931"}, "7")
    chunks = spark.createDataFrame([(1, 1, '{"model": "A"}'), (2, 1, '{"model": "B"}'), (3, 2, '{"model": "A"}')], "chunk_id int, document_id int, meta string")
    docs = spark.createDataFrame([(1, "ready"), (2, "pending")], "document_id int, status string")
    pick = lambda f: sorted(r[0] for r in L.allowed_chunks(chunks, docs, f).collect())
    assert pick({"model": "A"}) == [1] and pick({"model": "' OR 1=1"}) == [] and pick({"nope": 1}) == [1, 2]


def fold(items, cfg=Config()):
    """Plain loop of the block rule: items are (tokens, heading)."""
    out, block, n, total = [], 0, 0, 0
    for tokens, head in items:
        if n >= cfg.block_min_children and head or n >= cfg.block_max_children or n >= cfg.block_min_children and total + tokens > cfg.block_max:
            block, n, total = block + 1, 0, 0
        out.append(block)
        n, total = n + 1, total + tokens
        if total >= cfg.block_target and n >= cfg.block_min_children:
            block, n, total = block + 1, 0, 0
    return out


def test_blocks_follow_the_plain_loop(spark):
    rnd, rows, want = random.Random(1), [], []
    for doc in range(25):
        items = [(rnd.choice([30, 200, 500, 900]), rnd.random() < 0.15) for _ in range(rnd.randint(1, 30))]
        for i, (t, h) in enumerate(items):
            rows.append((doc, doc * 1000 + i, i, ("## " if h else "") + "y" * (t * 3 - 3 * h)))
        want += [(doc * 1000 + i, b) for i, b in enumerate(fold(items))]
    df = spark.createDataFrame(rows, "document_id bigint, chunk_id bigint, sequence_no bigint, content string")
    assert sorted((r["chunk_id"], r["block_no"]) for r in C.block_numbers(df).collect()) == want
    assert C.context_blocks(df).agg(F.sum("children")).first()[0] == len(rows)


def test_overlap(spark):
    cut = lambda a, b: value(spark, C.strip_overlap(F.col("a"), F.col("b")), a=(a, "string"), b=(b, "string"))
    assert cut("hello wor", "world") == "ld" and cut("a", "b") == "b" and cut("ab", "ab") == "" and cut("", "x") == "x"


def test_truncation_around_the_hit(spark):
    ctx = "a" * 50 + "HIT" + "b" * 50
    out = value(spark, C.truncate_around(F.col("c"), F.col("h"), 21), c=(ctx, "string"), h=("HIT", "string"))
    assert len(out) == 21 and "HIT" in out
    assert value(spark, C.truncate_around(F.col("c"), F.col("h"), 500), c=(ctx, "string"), h=("HIT", "string")) == ctx


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_budget_never_overruns(spark, lengths):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(lengths)], "k int, i int, chars bigint")
    got = [r["taken"] for r in C.budget(rows, ["k"], ["i"]).orderBy("i").collect()]
    assert sum(got) <= 24_000 and got == [max(0, min(n, 24_000 - sum(lengths[:i]))) for i, n in enumerate(lengths)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://Ex.org/A/?utm_source=x&b=2&a=1", "https://ex.org/A/?a=1&b=2"),
        ("http://ex.org/", "http://ex.org/"),
        ("http://ex.org/a//", "http://ex.org/a"),
        ("http://ex.org/a?ref=1#top", "http://ex.org/a#top"),
        ("", ""),
        ("https://www.bing.com/ck/a?x=1&u=a1aHR0cHM6Ly9leC5vcmcvcA", "https://ex.org/p"),
    ],
)
def test_normal_form(spark, raw, want):
    got = value(spark, U.normalize_url(F.col("u")), u=(raw, "string"))
    assert got == want
    assert value(spark, U.normalize_url(F.col("u")), u=(got, "string")) == got


def test_locale(spark):
    got = spark.createDataFrame([("de",), ("en_GB",), ("sw",), ("",)], "c string").select(U.locale(F.col("c")).alias("l")).collect()
    assert [r["l"]["tag"] for r in got] == ["de-DE", "en-GB", "sw", None]
    assert [r["l"]["accept_language"] for r in got] == ["de-DE,de;q=0.9", "en-GB,en;q=0.9", "sw", None]
    assert [r["l"]["timezone"] for r in got] == ["Europe/Berlin", "Europe/London", None, None]


def test_serp_dedup_and_clusters(spark):
    rows = spark.createDataFrame([(1, "google", 2, "http://e.org/page?utm_source=t", "t", False), (1, "bing", 1, "http://e.org/page", "u", False), (1, "bing", -1, "http://ad.org", "v", True)], "query_id int, engine string, rank int, url string, title string, ad boolean")
    assert {(r["engine"], r["rank"]) for r in P.dedup(rows).collect()} == {("bing", 1), ("bing", -1)}
    best = P.clusters(rows, 2).where("engines_count = 2").first()
    assert best["score"] == 0.75 and best["best_rank"] == 1 and best["url"] == "http://e.org/page"


def test_engines(spark):
    assert value(spark, P.resolve_engines(F.col("e")), e=(" DDG, google,duck ,nope,google", "string")) == ["duckduckgo", "google"]


def test_html_results():
    html = '<div class="ad"><a href="http://ad.org">Ad</a></div><p><a href="/x">One <b>two</b></a> text</p><a href="/x">again</a><a href="#t">no</a>'
    rows = parse_results(html, base="http://e.org/y")
    assert [(r["rank"], r["url"], r["title"]) for r in rows] == [(-1, "http://ad.org", "Ad"), (1, "http://e.org/x", "One two")]


def test_cleaning(spark):
    got = value(spark, T.clean(F.col("t"), addresses=True), t=("  a\x01b ï¿¾ <|x|>\n\n\n\nmail a@b.co http://x.y [l](http://k.z) ", "string"))
    assert got == "ab <x>\n\nmail   [l](http://k.z)"  # spaces are collapsed before addresses go


def test_sentences_drop_an_open_end(spark):
    assert value(spark, T.by_sentences(F.col("t")), t=(" One. Two!? three", "string")) == ["One.", "Two!?"]


def test_protected_tokens_stay_whole():
    assert T.protected_tokens("RCS-931 IEC61850 0x8001 103规约 v2.1.3 192.168.1.1 RCS-931") == ["0x8001", "v2.1.3", "192.168.1.1", "rcs-931", "iec61850", "rcs-931", "103规约"]


def test_recursive_chunks():
    parts = T.recursive_chunks("\n\n".join("p" * 400 for _ in range(10)), 500)
    assert all(len(p) <= 1500 + 300 for p in parts) and len(parts) > 2
    assert T.recursive_chunks("", 500) == []
    assert T._tail("abc") == "abc"  # too short for a share


def test_rules(spark):
    r = value(spark, rules.route(F.col("q"), F.lit(False), F.lit(True)), q=("如何写一份方案", "string"))
    assert (r["route"], r["reason"]) == ("rag_qa", "active_kb_with_question")
    assert value(spark, rules.consent(F.col("q")), q=("不用了，好", "string")) is False
    assert value(spark, rules.backoff(F.col("n")), n=(10, "int")) == 30.0


def test_breaker_opens_and_recovers():
    rule, s = Breaker(fails=2, wait=10, good=1), ("closed", 0, 0, 0.0)
    for now, ok, passed, name in [(0, False, True, "closed"), (1, False, True, "open"), (5, True, False, "open"), (12, True, True, "closed")]:
        s, let = rule.step(s, now, ok)
        assert (let, s[0]) == (passed, name)


def test_miss_mode(spark):
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate([False, False, True, False, False, False, False])], "conversation_id int, at int, hit boolean")
    assert [r["mode"] for r in rules.miss_mode(rows).orderBy("at").collect()] == ["ask_pending", "ask_pending", "ask_pending", "ask_pending", "ask_pending", "on", "on"]


def test_domain_details_tell_of_every_page(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    rows = search.domain_details(spark, folder).collect()
    own = {r["page_id"]: (r["tld"], r["sld"]) for r in rows if not r["given"]}
    assert own == {r["page_id"]: tuple(r["url"].split("/")[2].split(".")[:-3:-1]) for r in pages}
    assert sum(r["given"] for r in rows) == len(pages)
