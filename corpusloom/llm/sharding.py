"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has a fixed number of slices. Each shard owns several virtual nodes, each in a slice drawn from a hash; a key belongs
to the first virtual node clockwise from its own slice. Under the law `rows` a shard takes no more rows than its share (shares
differ by one row at most and add up to all rows): rows of a slice beyond it continue clockwise to the next shard with room.
Under the law `key` no load is bounded and only key and number of shards decide.

The driver sees one count for each slice, whatever the input. Equal rows are counted, not gathered, before anything is sorted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.llm.common import written

SLICES = 4096
VNODES = 96
#: Equal rows that are written out at once.
BLOCK = 10_000
PLAN = "slice int, pieces array<struct<lo:bigint,hi:bigint,shard:int,base:bigint>>, grown_shard int"


def ring(shards: int, vnodes: int = VNODES, slices: int = SLICES) -> list[list[int]]:
    """For each slice the shards in the order met clockwise from it."""
    at: dict[int, list[int]] = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:6], "big") % slices, []).append(s)
    met: list[int] = []
    for q in [*range(slices - 1, -1, -1)]:
        met += reversed(sorted(at.get(q, [])))
    order: list[list[int]] = [[]] * slices
    now: list[int] = []
    for s in met:  # once around, to know what lies past the end
        now = [s, *(x for x in now if x != s)]
    for q in range(slices - 1, -1, -1):
        for s in reversed(sorted(at.get(q, []))):
            now = [s, *(x for x in now if x != s)]
        order[q] = list(now)
    return order


def fill(counts: dict[int, int], shards: int, law: str, vnodes: int = VNODES, slices: int = SLICES) -> list[tuple]:
    """Which ranks of each slice go to which shard, and the slot of the first of them."""
    order, total = ring(shards, vnodes, slices), sum(counts.values())
    room = [total // shards + (s < total % shards) if law == "rows" else total for s in range(shards)]
    used = [0] * shards
    grown = ring(shards + 1, vnodes, slices) if law == "key" else None
    plan = []
    for q in range(slices):
        lo, n, pieces = 0, counts.get(q, 0), []
        for s in order[q]:
            take = min(n - lo, room[s] - used[s])
            if take > 0:
                pieces.append((lo, lo + take, s, used[s]))
                used[s] += take
                lo += take
        if pieces:
            plan.append((q, pieces, grown[q][0] if grown else None))
    return plan


def consistent_shards(df: DataFrame, shards: int = 8, law: str = "rows", vnodes: int = VNODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes of the text plus 1; a null text counts as empty (its crc32 is 0). Null ids are a key like any other,
    told apart by their texts. Rows equal in id and text get neighbouring slots; rows that only share their text (a group of
    copies) are spread over the shards like any others, and no size of text matters. An empty table gives an empty result.
    """
    if law not in ("rows", "key"):
        raise ValueError(f"law {law!r}: rows or key")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = [F.col("doc_id")] if law == "key" else [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    keyed = thin.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("hash", F.xxhash64(*key)).withColumn("slice", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(SLICES)).cast("int"))
    keyed = written(keyed, "shards")
    counts = {r["slice"]: r["n"] for r in keyed.groupBy("slice").agg(F.sum("copies").alias("n")).collect()}  # SLICES rows at most
    plan = df.sparkSession.createDataFrame(fill(counts, shards, law, vnodes), PLAN)  # SLICES rows at most
    before = Window.partitionBy("slice").orderBy("hash", F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("first", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    # in blocks, so that no list is as long as a row is often repeated
    blocks = ranked.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(BLOCK))).alias("block"))
    rows = blocks.select("*", F.explode(F.sequence("block", F.least(F.col("block") + BLOCK, "copies") - 1)).alias("copy")).withColumn("rank", F.col("first") + F.col("copy"))
    placed = rows.join(F.broadcast(plan), "slice").withColumn("piece", F.element_at(F.filter("pieces", lambda p: (F.col("rank") >= p["lo"]) & (F.col("rank") < p["hi"])), 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("piece.shard").alias("shard"), (F.col("piece.base") + F.col("rank") - F.col("piece.lo")).alias("slot"), F.col("grown_shard").cast(T.IntegerType()).alias("grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8, law="rows")


QUERIES = {"op9_sharding": op9_sharding}
ORACLE_SQL: dict[str, str] = {}
