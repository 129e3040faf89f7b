from pyspark.sql import functions as F

from corpusloom.operators import binding as B


def test_images_are_bound_within_the_tenant(spark):
    chunks = spark.createDataFrame([(1, 9, "t", "![a](/files/k1/file-preview) ![b](/files/k1/file-preview)"), (2, 9, "t", "none")], "chunk_id int, document_id int, tenant_id string, content string")
    uploads = spark.createDataFrame([(5, "t", "up/k1.png"), (4, "u", "up/k1.png"), (6, "t", "k1")], "id int, tenant_id string, key string")
    assert [tuple(r) for r in B.bind_images(chunks, uploads).collect()] == [(9, 1, 5)]


def test_proxies(spark):
    proxies = spark.createDataFrame([("a", ["x", "y"], 0), ("b", ["x"], 5), ("c", ["x"], 0)], "url string, tags array<string>, failures int")
    got = {r["tag"]: (r["configured"], r["healthy"], r["unhealthy"]) for r in B.proxy_stats(proxies).collect()}
    assert got == {"x": (3, 2, 1), "y": (1, 1, 0), None: (3, 2, 1)}
    asks = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, "x", 3), (4, "z", 1)], "request_id int, tag string, at int")
    assert {r["request_id"]: r["url"] for r in B.next_proxy(proxies, asks).collect()} == {1: "a", 2: "c", 3: "a", 4: None}


def test_cache_hits(spark):
    rows = spark.createDataFrame([("g", "q", t) for t in (0, 100, 179, 200, 379, 381)], "engine string, query string, s int").withColumn("at", F.timestamp_seconds("s"))
    assert [r["hit"] for r in B.cache_hits(rows).orderBy("at").collect()] == [False, True, True, False, True, False]
