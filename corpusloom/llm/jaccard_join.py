"""N-gram Jaccard join with a token-group matrix.

Documents of equal shingle sets are one class. Classes that share a min-hash with a central class of their bucket, and are
verified to be similar to it, form groups; all others stand alone. The matrix holds, for each group, the union of its members'
leading shingles (rarest first, by a count-min sketch: any two similar sets share one of these), with bounds on size and place.
The matrix joined with itself on the shingle bounds the overlap of two groups; only pairs of groups that can hold a similar pair
are opened, and of these only members whose own bounds allow it are compared, exactly. No pair within a group is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import sketch
from corpusloom.llm.common import WordHashes, dropped, mix, slices, small_batches, tokens_of, windows_hash, written
from corpusloom.llm.components import components

WIDTH = 1 << 18
MINS, BUCKETED, AGREEING = 8, 5, 3
FACTOR = 0x9E3779B97F4A7C15
#: Ids up to so many are sent to every task (1.6 MB), more are joined.
BROADCAST_IDS = 200_000


def shingle_sets(texts: list, known: WordHashes, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, one without words none."""
    flat, n = tokens_of(texts, lower=True)
    h = known.many(flat)
    grams = windows_hash(h, words, FACTOR) if len(h) else h
    out, at = [], 0
    for k in n.tolist():
        if k >= words:
            out.append(np.unique(grams[at : at + k - words + 1]))
        elif k:
            out.append(windows_hash(h[at : at + k], k, FACTOR)[:1] ^ np.uint64(k))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def prefix_length(n: int, percent: int) -> int:
    """A set of n shares one of so many of its first shingles with any similar set."""
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, sig) of each row, and each part's sketch of shingle counts as rows (chunk, counts)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), np.zeros(WIDTH, np.uint32)
        names, id_arrow = ["doc_id", "n", "sig", "chunk", "counts"], None
        for batch in batches:
            texts, id_arrow = batch.column(1).to_pylist(), batch.column(0).type
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], known, words)
                cells = np.concatenate(sets) & np.uint64(WIDTH - 1) if sets else np.zeros(0, np.uint64)
                counts += np.bincount(cells.astype(np.int64), minlength=WIDTH).astype(np.uint32)
                sig = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                k = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, k), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        chunk, data = sketch.chunk_rows(counts)
        if chunk:
            k = len(chunk)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_arrow), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(chunk, pa.int32()), pa.array(data, pa.binary())], names=names)

    return docs.mapInArrow(run, f"doc_id {id_type}, n bigint, sig binary, chunk int, counts binary")


def leading(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, n, central, mins, prefix) of rows with shingles: min-hashes, its rarest shingles in global order, and how few of all are rare.

    A shingle is rare if it is counted less than half as often as the text's middle one. In a group of near copies those are the
    shingles of edits, so the most central text is the one closest to what all were made from, and a star around it holds most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # WIDTH counters
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], known, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                flat = np.concatenate([sets[i] for i in full])
                n = np.array([len(sets[i]) for i in full], np.int64)
                starts = np.cumsum(n) - n
                mins = np.stack([np.minimum.reduceat(mix(flat + np.uint64(0x51ED27 * (k + 1))), starts) for k in range(MINS)], axis=1).view(np.int64)
                often = counts[flat & np.uint64(WIDTH - 1)]
                order = np.lexsort((flat, often, np.repeat(np.arange(len(n)), n)))
                flat, often = flat[order].view(np.int64), often[order]
                middle = often[starts + n // 2]
                rare = np.add.reduceat((often * 2 < np.repeat(middle, n)).astype(np.int64), starts)
                long = np.array([prefix_length(int(k), percent) for k in n])
                take = np.concatenate([np.arange(s, s + p) for s, p in zip(starts, long, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(full)), pa.array(n), pa.array(-(rare * 10_000 // n)),
                        pa.FixedSizeListArray.from_arrays(pa.array(mins.ravel()), MINS).cast(pa.list_(pa.int64())),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(long)).astype(np.int32)), pa.array(flat[take])),
                    ],
                    names=["doc_id", "n", "central", "mins", "prefix"],
                )

    return docs.mapInArrow(run, f"doc_id {id_type}, n bigint, central bigint, mins array<bigint>, prefix array<bigint>")


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (x, y) of ids whose texts' shingle sets are similar. Only texts that are in a pair leave the scan."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    if pairs.count() <= BROADCAST_IDS // 2:
        ids = F.broadcast(ids)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], known, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    sets = written(docs.join(ids, "doc_id", "left_semi").mapInArrow(run, f"doc_id {id_type}, tokens array<bigint>"), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("tokens").alias("tx")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("tokens").alias("ty")), "y")
    overlap = F.size(F.array_intersect("tx", "ty")).cast("long")
    links = written(both.where(overlap * (100 + percent) >= F.lit(percent) * (F.size("tx") + F.size("ty"))).select("x", "y").distinct(), "links")
    dropped(sets)
    dropped(pairs)
    return links


def jaccard_components(df: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (doc_id, n_shingles, component_id).

    Words are lower-cased in A-Z; two documents link when 100 * intersection >= percent * union of their shingle sets.
    A text without words has no shingles, links with nothing and is its own component. Rows that repeat an id count as one
    document. A row without id links with nothing and has no component_id. Ids are whole numbers. A very long text is hashed whole
    in one task; an empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    thin = written(signatures(docs, words), "thin")
    rows = thin.where("chunk is null")
    counts = sketch.merged(thin.where("chunk is not null").select("chunk", "counts"), WIDTH)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    led = written(leading(docs, counts, words, percent).join(reps, "doc_id"), "led")

    # groups: classes verified to be similar to the most central class of a bucket
    buckets = led.select("doc_id", "n", "central", "mins", F.posexplode(F.slice("mins", 1, BUCKETED)).alias("i", "min"))
    central = buckets.groupBy("i", "min").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("key"), "doc_id", "n", "mins")).alias("c"), F.count(F.lit(1)).alias("many")).where("many > 1")
    agree = F.size(F.filter(F.zip_with("mins", "c.mins", lambda a, b: a == b), lambda x: x))
    near = buckets.join(central, ["i", "min"]).where((F.col("doc_id") != F.col("c.doc_id")) & (agree >= AGREEING) & (F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent))
    stars = verified(docs, near.select(F.col("doc_id").alias("x"), F.col("c.doc_id").alias("y")).distinct(), words, percent)
    grouped = components(stars.select(F.col("x").alias("a"), F.col("y").alias("b")))
    member = led.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("grp"), F.col("component").isNull().alias("alone"), "prefix")
    member = written(member, "member")

    # the matrix, and pairs of groups that may hold a link: 100 n - (100 + p) place >= p * size of the other
    cells = member.select("doc_id", "n", "grp", "alone", F.posexplode("prefix").alias("at", "token")).withColumn("slack", F.col("n") * 100 - F.col("at") * (100 + percent)).drop("at")
    matrix = cells.groupBy("token", "grp", "alone").agg(F.max("slack").alias("slack"), F.min("n").alias("n"))
    left, right = (matrix.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("grp", "alone", "slack", "n"))) for i in (1, 2))
    open_pairs = written(left.join(right, "token").where(f"grp1 < grp2 and slack1 >= {percent} * n2 and slack2 >= {percent} * n1").select("token", "grp1", "grp2", (F.col("alone1") & F.col("alone2")).alias("alone")), "open")
    # two documents that stand alone are their groups; of larger groups only the members that hold the shingle are compared
    pairs = open_pairs.where("alone").select(F.col("grp1").alias("x"), F.col("grp2").alias("y"))
    larger = open_pairs.where("not alone")
    involved = larger.select(F.explode(F.array("grp1", "grp2")).alias("grp")).distinct()
    wanted = larger.select("token", F.explode(F.array("grp1", "grp2")).alias("grp")).distinct()
    opened = written(cells.join(involved, "grp", "left_semi").join(wanted, ["token", "grp"]), "opened")
    x, y = (opened.select("token", F.col("grp").alias(f"grp{i}"), F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("slack").alias(f"s{k}")) for i, k in ((1, "x"), (2, "y")))
    pairs = pairs.unionByName(larger.join(x, ["token", "grp1"]).join(y, ["token", "grp2"]).where(f"sx >= {percent} * ny and sy >= {percent} * nx").select("x", "y")).where("x <> y").distinct()
    # similar sets share not only one but a number of their leading shingles, which depends on their sizes
    px, py = (member.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in "xy")
    least = f"(({percent} * (nx + ny) + {99 + percent}) div {100 + percent}) - (({percent} * greatest(nx, ny) + 99) div 100) + 1"
    pairs = pairs.join(px, "x").join(py, "y").where(F.size(F.array_intersect("px", "py")) >= F.expr(least)).select("x", "y").distinct()
    links = verified(docs, pairs, words, percent)

    whole = components(stars.unionByName(links).select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    return rows.join(named, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id"))).alias("component_id")
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
