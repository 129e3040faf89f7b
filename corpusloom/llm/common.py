"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches are worked on in slices of about so many characters, which bounds the memory of a Python worker.
SLICE_CHARS = 3_000_000
#: A word table of a worker is emptied when it holds so many words.
CACHE_WORDS = 250_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; one of our own only where none is set (tests)."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/corpusloom-{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/corpusloom-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again, so a lost executor costs nothing done before."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the shuffle files of finished jobs deleted now; Spark does so when nothing refers to them, once both sides have collected garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that no later step reads."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "corpusloom-" in path:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, which the JVM and the Python worker each hold as a whole.

    Spark also ends a batch at spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), so rows of very long texts are few.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


_KEPT: dict = {}


def kept(number: str, make):
    """What make() gives, kept in this Python worker for its next tasks; a worker keeps one such thing, whichever operator it is of."""
    found = _KEPT.get(number)
    if found is None:
        _KEPT.clear()
        found = _KEPT[number] = make()
    return found


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit characters each; one longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(texts) > start:
        yield start, len(texts)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash; bounded, since a full table is emptied between slices."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def many(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def tokens_of(texts: Iterable, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts, and the number of words of each; words are runs without space and \\x09-\\x0D (bytes.split() parts at just these)."""
    words: list[bytes] = []
    counts = []
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        w = (b.lower() if lower else b).split()
        words += w
        counts.append(len(w))
    return words, np.array(counts, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def windows_hash(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of each run of n entries of h, by doubling; as long as h, the last n - 1 entries mean nothing."""
    mask = (1 << 64) - 1
    out, size, done = None, 1, 0
    power = h.copy()
    left = n
    while left:
        if left & 1:
            part = np.zeros_like(h)
            if done < len(h):
                part[: len(h) - done] = power[done:]
            part *= np.uint64(pow(factor, done, 1 << 64) & mask)
            out = part if out is None else out + part
            done += size
        left >>= 1
        if left:
            grown = power.copy()
            if size < len(h):
                grown[: len(h) - size] += power[size:] * np.uint64(pow(factor, size, 1 << 64) & mask)
            power, size = grown, size * 2
    return mix(out)
