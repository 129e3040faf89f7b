"""Images of chunks bound to uploads, proxy statistics and other small lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import image_ids


def bind_images(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """(document_id, segment_id, attachment_id): for each image a chunk names, the first upload of the tenant whose key holds its id.

    chunks: (chunk_id, document_id, tenant_id, content); uploads: (id, tenant_id, key). Ids are exploded first, and an upload's
    key is taken apart at its signs, so that the match is an equi-join; ids hold none of these signs.
    """
    named = chunks.select("document_id", F.col("chunk_id").alias("segment_id"), "tenant_id", F.explode(F.array_distinct(image_ids(F.col("content")))).alias("image"))
    parts = uploads.select("id", "tenant_id", F.explode(F.array_distinct(F.array_append(F.split("key", r"[/.]"), F.col("key")))).alias("image"))
    hit = named.join(parts, ["tenant_id", "image"])
    return hit.groupBy("document_id", "segment_id", "image").agg(F.min("id").alias("attachment_id")).drop("image").distinct()


def proxy_stats(proxies: DataFrame, limit: int = 3) -> DataFrame:
    """proxies (url, tags array, failures) -> (tag, configured, healthy, unhealthy); tag null is all of them."""
    bad = F.col("failures") >= limit
    row = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("configured"), F.count_if(~bad).alias("healthy"), F.count_if(bad).alias("unhealthy"))
    tagged = row(proxies.select("failures", F.explode("tags").alias("tag")), "tag")
    return tagged.unionByName(row(proxies.withColumn("tag", F.lit(None).cast("string")), "tag"))


def next_proxy(proxies: DataFrame, requests: DataFrame, limit: int = 3) -> DataFrame:
    """requests (request_id, tag, at) -> the healthy proxy of the tag in turn; null if a tag has none."""
    usable = proxies.where(F.col("failures") < limit).select("url", F.explode("tags").alias("tag"))
    per = usable.groupBy("tag").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    turn = F.row_number().over(Window.partitionBy("tag").orderBy("at", "request_id")) - 1
    rows = requests.withColumn("turn", turn).join(per, "tag", "left")
    return rows.select("request_id", "tag", F.get("urls", (F.col("turn") % F.greatest(F.size("urls"), F.lit(1))).cast("int")).alias("url"))


def chunk_row(content: Column, chunk_id: Column, meta_id: Column, vector: Column) -> Column:
    """The listing form of a chunk: id of its metadata if there is one, characters, state of its vector."""
    return F.struct(F.coalesce(meta_id, chunk_id.cast("string")).alias("id"), F.length(content).alias("char_count"), F.when(vector.isNotNull(), "indexed").otherwise("pending").alias("vector_status"))


def cache_hits(requests: DataFrame, ttl: int = 180, keys: tuple[str, ...] = ("engine", "query")) -> DataFrame:
    """requests (keys, at) with hit: an equal request that missed came less than ttl seconds before.

    A miss starts a new span of ttl seconds, so this is a fold; it runs over the sorted times of one key without other columns.
    """
    times = requests.groupBy(*keys).agg(F.array_sort(F.collect_list(F.unix_micros(F.col("at").cast("timestamp")))).alias("ts"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<struct<at:bigint,hit:boolean>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        hit = s["last"].isNotNull() & (t - s["last"] < ttl * 1_000_000)
        return F.struct(F.when(hit, s["last"]).otherwise(t).alias("last"), F.array_append(s["out"], F.struct(t.alias("at"), hit.alias("hit"))).alias("out"))

    return times.select(*keys, F.explode(F.aggregate("ts", start, step)["out"]).alias("r")).select(*keys, F.timestamp_micros("r.at").alias("at"), "r.hit")


def coalesced(requests: DataFrame, keys: tuple[str, ...] = ("engine", "query")) -> DataFrame:
    """One row for each group of equal requests of a batch, with how many it stands for."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))
