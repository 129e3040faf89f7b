"""Document fingerprints from closed syncmers, with positional matching.

A run of K letters is a closed syncmer if the least of its inner runs of S letters lies at either edge. That depends on the run
alone, so an edit elsewhere moves no anchor. A fingerprint keeps the KEPT least anchor hashes, each with the place where it first
occurs. Two fingerprints are compared by the anchors that both would keep, as far as they agree on one shift of places.
Short texts have a second, finer set of anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, slices, small_batches, windows_hash
from corpusloom.llm.substring_dedup import sliding

#: (letters of a run, of an inner run); texts below SHORT letters have the second kind too.
COARSE, FINE, SHORT = (12, 4), (4, 2), 64
KEPT = 64
FACTOR = 0x9E3779B97F4A7C15
#: Places that differ by less than this after the common shift agree.
SLACK = 8


def syncmers(h: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of closed syncmers in the letters h, and their hashes."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = windows_hash(h, s, FACTOR)
    least = sliding(inner, k - s + 1, np.minimum)
    many = len(h) - k + 1
    at = np.flatnonzero((inner[:many] == least[:many]) | (inner[k - s : k - s + many] == least[:many]))
    return at, windows_hash(h, k, FACTOR)[at] ^ np.uint64(k)


def sketches(texts: list[str]) -> list[tuple[list, list]]:
    """For each text its anchors (hash of 32 bits, place), coarse and fine, least hashes first."""
    n = np.array([len(t) for t in texts], np.int64)
    letters = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    ends = np.cumsum(n)
    out = []
    for (k, s), wanted in ((COARSE, n >= COARSE[0]), (FINE, (n < SHORT) & (n >= FINE[0]))):
        at, hashes = syncmers(letters, k, s)
        doc = np.searchsorted(ends, at, side="right")
        fine = (at + k <= ends[doc]) & wanted[doc] if len(at) else np.zeros(0, bool)
        at, hashes, doc = at[fine], (hashes[fine] >> np.uint64(32)).astype(np.int64), doc[fine]
        order = np.lexsort((at, hashes, doc))
        at, hashes, doc = at[order], hashes[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
        at, hashes, doc = at[new], hashes[new], doc[new]
        first = np.searchsorted(doc, np.arange(len(texts)))
        stop = np.minimum(np.searchsorted(doc, np.arange(len(texts)), side="right"), first + KEPT)
        place = at - (ends - n)[doc] if len(doc) else at
        out.append([list(zip(hashes[a:b].tolist(), place[a:b].tolist(), strict=True)) for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    pairs = list(zip(*out, strict=True))
    for i in np.flatnonzero((n > 0) & (n < FINE[0])):  # too short for any run: the text itself
        pairs[i] = ([], [(int.from_bytes(hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()[:4], "big"), 0)])
    return pairs


def as_text(sketch: tuple[list, list]) -> str:
    """Anchors as hash.place in hex; a semicolon parts the coarse from the fine ones."""
    return ";".join(",".join(f"{h:08x}.{p:x}" for h, p in part) for part in sketch) if any(sketch) else ""


def from_text(text: str) -> tuple[list, list]:
    if not text:
        return [], []
    coarse, fine = ([(int(h, 16), int(p, 16)) for h, p in (x.split(".") for x in part.split(",") if x)] for part in text.split(";"))
    return coarse, fine


def likeness(a: tuple[list, list], b: tuple[list, list]) -> float:
    """0 to 1: the part of the anchors that agree in hash and, but for one common shift, in place. Two empty texts are alike."""
    kind = 1 if a[1] and b[1] else 0
    x, y = a[kind], b[kind]
    if not x or not y:
        return float(not any(a) and not any(b))
    p, q = dict(x), dict(y)
    least = sorted(p.keys() | q.keys())[:KEPT] if max(len(x), len(y)) >= KEPT else p.keys() | q.keys()
    shifts = sorted(p[h] - q[h] for h in least if h in p and h in q)
    best = start = 0
    for i, v in enumerate(shifts):  # the most shifts that lie together
        while v - shifts[start] >= SLACK:
            start += 1
        best = max(best, i - start + 1)
    jaccard = best / len(least)
    return 2 * jaccard / (1 + jaccard)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of df: (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    edited: the text with its last third replaced by the start of the next text in descending id order (null ids last, equal ids
    by text hash; after the last comes the first). A null text counts as empty; ids are whole numbers; an empty table gives an
    empty one. Rows are dealt by ranges of ids; each range also
    gets the first row of the next, so texts are shuffled once, and a task holds two texts and one batch.
    """
    spark = df.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))))
    bounds = sorted(set(rows.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    ranged = rows.withColumn("part", F.lit(len(bounds)) - F.size(F.filter(F.lit([int(b) for b in bounds]).cast("array<bigint>"), lambda b: b < F.col("key"))))  # high ids first
    heads = sorted((r["part"], r["head"]) for r in ranged.groupBy("part").agg(F.max("key").alias("head")).collect())  # one row for each range
    # the first row of a range is also a guest, at the end, of the range before
    guests = spark.createDataFrame([(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)] or [(0, -1)], "key bigint, host int")
    dealt = ranged.withColumn("guest", F.lit(0)).unionByName(ranged.join(F.broadcast(guests), "key").select("doc_id", "text", "key", F.col("host").alias("part"), F.lit(1).alias("guest")))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("key"), F.xxhash64("text")).select("doc_id", "text", "part", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        before = None

        def out(own: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
            third = [len(t) // 3 for t in texts]
            edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(texts, following, third, strict=True)]
            marks = sketches([*texts, following[-1]])
            own_marks, next_marks, edited_marks = marks[:-1], marks[1:], sketches(edited)
            return pa.RecordBatch.from_arrays(
                [
                    own, pa.array([len(t) for t in texts], pa.int64()), pa.array(edited), pa.array([as_text(m) for m in own_marks]), pa.array([as_text(m) for m in edited_marks]),
                    pa.array([likeness(a, b) for a, b in zip(own_marks, edited_marks, strict=True)]), pa.array([likeness(a, b) for a, b in zip(own_marks, next_marks, strict=True)]),
                ],
                names=names,
            )

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                piece = batch.slice(a, b - a)
                if before is not None:
                    piece = pa.Table.from_batches([before, piece]).combine_chunks().to_batches()[0]
                now, part, guest = piece.column(1).to_pylist(), piece.column(2).to_numpy(), piece.column(3).to_numpy()
                at = 0
                while at < len(now) - 1:  # stretches of neighbours in one range
                    end = at
                    while end < len(now) - 1 and part[end + 1] == part[at] and not guest[end]:
                        end += 1
                    if end > at:
                        yield out(piece.column(0).slice(at, end - at), now[at:end], now[at + 1 : end + 1])
                    at = end if end > at else at + 1
                before = piece.slice(len(now) - 1, 1)

    return dealt.mapInArrow(run, f"doc_id {id_type}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op4_fingerprint": op4_fingerprint}
ORACLE_SQL: dict[str, str] = {}
