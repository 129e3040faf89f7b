"""Removal of repeated passages: every word in a window of n words whose sequence also starts earlier.

A first pass sketches how often each window occurs. Its count is overestimated by that of its anchor, the least of the shorter
runs within it: equal windows hold equal anchors at equal places, so a repeated window has a repeated anchor. Each part sends
the cells of its anchors, sorted and coded by their gaps (about a byte each); they merge into one bit for each cell, set where
more than one anchor fell. A second pass groups exactly the windows whose cell is set, losing none, and keeps the earliest start.

Rows of equal word sequences are found before: of these only the first has windows to compare, the others are covered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, dropped, mix, release, slices, small_batches, tokens_of, windows_hash, written

#: Cells of the sketch, and chunks in which parts send theirs.
CELL_BITS, CHUNK_BITS = 28, 8
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Ids of whole copies are sent to every task up to so many, joined beyond.
BROADCAST_IDS = 200_000


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over each run of n entries from its start on, by doubling; as long as x, the last n - 1 entries mean nothing."""
    out, size = x.copy(), 1
    while size < n:
        step = min(size, n - size)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        size += step
    return out


class Windows:
    """Hashes of all windows of n words of some texts, one after the other."""

    def __init__(self, texts: list, known: WordHashes, n: int):
        self.words, self.counts = tokens_of(texts)
        h = known.many(self.words)
        self.ends = np.cumsum(self.counts)
        many = np.maximum(self.counts - n + 1, 0)
        # places of windows, and the text of each
        self.text = np.repeat(np.arange(len(self.counts)), many)
        self.at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.place = np.repeat(self.ends - self.counts, many) + self.at
        self.n, self.h = n, h

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchor of each window, and all anchors that occur, once for each place."""
        short = max(1, self.n // 2)
        if not len(self.place):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        run = windows_hash(self.h, short, FACTORS[0]) | np.uint64(1)
        width = self.n - short + 1
        least = sliding(run, width, np.minimum)
        own = least[self.place]
        # a run is an anchor if it is the least of some window that covers it
        valid = np.zeros(len(run), np.uint64)
        valid[self.place] = own
        covered = sliding(np.concatenate([np.zeros(width - 1, np.uint64), valid]), width, np.maximum)[: len(run)]
        return own, run[covered == run]

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the chosen windows' word sequences."""
        at = self.place[chosen]
        return windows_hash(self.h, self.n, FACTORS[0])[at], windows_hash(self.h ^ np.uint64(0x5851F42D4C957F2D), self.n, FACTORS[1])[at]


def coded(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps of one byte; 255 stands for 255 further cells without an entry."""
    gaps = np.diff(cells, prepend=0)
    long = gaps // 255
    out = np.full(len(cells) + int(long.sum()), 255, np.uint8)
    out[np.arange(len(cells)) + np.cumsum(long)] = gaps % 255
    return out.tobytes()


def decoded(data: np.ndarray) -> np.ndarray:
    return np.cumsum(data.astype(np.int64))[data != 255]


def repeated_cells(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """One bit for each cell: more than one anchor fell there. 2**bits / 8 bytes, whatever the input."""
    size = 1 << (bits - CHUNK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, many = WordHashes(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            cell = np.sort(np.concatenate(held))
            starts = np.searchsorted(cell, np.arange(0, (1 << bits) + 1, size))
            rows = [(i, np.unique(x), np.unique(x[1:][x[1:] == x[:-1]])) for i in range(1 << CHUNK_BITS) if len(x := cell[starts[i] : starts[i + 1]] - i * size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([coded(r[1]) for r in rows], pa.binary()), pa.array([coded(r[2]) for r in rows], pa.binary())], names=["chunk", "once", "twice"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                anchors = Windows(texts[a:b], known, n).anchors()[1]
                held.append((mix(anchors) >> np.uint64(64 - bits)).astype(np.int64))
                many += len(anchors)
                if many > 1_500_000:
                    yield from out()
                    held, many = [], 0
        if many:
            yield from out()

    def merge(table: pa.Table) -> pa.Table:
        seen, more = np.zeros(size, bool), np.zeros(size, bool)
        for once, twice in zip(table.column("once"), table.column("twice"), strict=True):
            cells = decoded(np.frombuffer(once.as_buffer(), np.uint8))
            more[cells[seen[cells]]] = True
            seen[cells] = True
            more[decoded(np.frombuffer(twice.as_buffer(), np.uint8))] = True
        row = [table.column("chunk")[0].as_py()], [coded(np.flatnonzero(seen))], [coded(np.flatnonzero(more))]
        return pa.table({"chunk": pa.array(row[0], pa.int32()), "once": pa.array(row[1], pa.binary()), "twice": pa.array(row[2], pa.binary())})

    schema = "chunk int, once binary, twice binary"
    # two levels, so that no task merges very many parts
    parts = docs.select("text").mapInArrow(run, schema).withColumn("at", F.pmod(F.xxhash64("once"), F.lit(32))).groupBy("chunk", "at").applyInArrow(merge, schema)
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.groupBy("chunk").applyInArrow(merge, schema).toLocalIterator():  # 2**CHUNK_BITS rows
        more = np.zeros(size, bool)
        more[decoded(np.frombuffer(r["twice"], np.uint8))] = True
        out[r["chunk"] * size // 8 : (r["chunk"] + 1) * size // 8] = np.packbits(more, bitorder="little")
    return out


def remove_repeats(df: DataFrame, n: int = 20, bits: int = CELL_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (doc_id, n_words, removed array<struct<start,stop>>, kept string: what is left, joined by one space).

    Earlier means smaller id, or the same row and an earlier start. A null text has no words; texts of fewer than n words stay
    whole; a very long text is worked on whole in one task; an empty table gives an empty one. Null ids come first of all. Rows that repeat an id are ordered by their words; rows that repeat id and words count as one document.
    """
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in lists], pa.int64()), pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in lists], pa.binary())], names=["doc_id", "n_words", "sig"])

    # ord: rows by id, then by words; copies of a word sequence beyond the first have no windows of their own
    thin = written(docs.mapInArrow(sign, f"doc_id {id_type}, n_words bigint, sig binary"), "signed")
    firsts = thin.where(f"n_words >= {n}").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("first"), F.count(F.lit(1)).alias("many"))
    copied = firsts.where("many > 1").select("sig", F.col("first.doc_id").alias("first_id"))
    copies = thin.join(copied, "sig").where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "sig")
    copies = written(copies, "copies")
    many_copies = copies.count()

    def with_sig(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "surrogatepass").split() if t else [])) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.binary())], names=["doc_id", "text", "sig"])

    marked = docs.mapInArrow(with_sig, f"doc_id {id_type}, text string, sig binary")
    gone = copies.distinct()
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("sig").alias("gone_sig"))
    if many_copies <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    single = marked.join(gone, (F.col("doc_id").eqNullSafe(F.col("gone_id"))) & (F.col("sig") == F.col("gone_sig")), "left_anti") if many_copies else marked
    cells = repeated_cells(single, n, bits)
    shared = spark.sparkContext.broadcast(cells)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells = WordHashes(), shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            ties = pa.array([int.from_bytes(x[:8], "big", signed=True) for x in batch.column(2).to_pylist()], pa.int64())
            for a, b in slices(texts):
                w = Windows(texts[a:b], known, n)
                cell = mix(w.anchors()[0]) >> np.uint64(64 - bits)
                chosen = np.flatnonzero(cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
                one, two = w.keys(chosen)
                row = pa.array(w.text[chosen])
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), ids.slice(a, b - a).take(row), ties.slice(a, b - a).take(row), pa.array(w.at[chosen].astype(np.int32))], names=["one", "two", "doc_id", "tie", "at"])

    found = written(single.mapInArrow(candidates, f"one bigint, two int, doc_id {id_type}, tie bigint, at int"), "windows")
    start = F.struct("doc_id", "tie", "at")  # nulls come first
    first = found.groupBy("one", "two").agg(F.min(start).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    first = written(first.select("one", "two", "first.*").toDF("one", "two", "f_id", "f_tie", "f_at"), "first")
    release(spark)
    later = found.join(first, ["one", "two"]).where(start > F.struct("f_id", "f_tie", "f_at")).groupBy("doc_id", "tie").agg(F.collect_list("at").alias("starts"))
    later = written(later, "later")
    dropped(found)
    dropped(first)
    release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, copy = batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()
            spans, kept, counts = [], [], []
            for i, t in enumerate(texts):
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                counts.append(len(words))
                if copy[i]:
                    spans.append([{"start": 0, "stop": len(words)}])
                    kept.append(b"")
                    continue
                own = np.sort(starts[i].values.to_numpy()) if starts[i].is_valid else []
                out = []
                for s in own.tolist() if len(own) else ():
                    if out and s <= out[-1]["stop"]:
                        out[-1]["stop"] = s + n
                    else:
                        out.append({"start": s, "stop": s + n})
                spans.append(out)
                left, at = [], 0
                for x in out:
                    left += words[at : x["start"]]
                    at = x["stop"]
                kept.append(b" ".join(left + words[at:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())], names=["doc_id", "n_words", "removed", "kept"])

    keyed = later.select(F.col("doc_id").alias("l_id"), F.col("tie").alias("l_tie"), "starts")
    whole = marked.join(keyed, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.conv(F.hex(F.substring("sig", 1, 8)), 16, -10).cast("bigint") == F.col("l_tie")), "left")
    gone = gone.withColumn("copy", F.lit(True))
    whole = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("sig") == F.col("gone_sig")), "left")
    return whole.select("doc_id", "text", "starts", "copy").mapInArrow(cut, f"doc_id {id_type}, n_words bigint, removed array<struct<start:int,stop:int>>, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=20)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
