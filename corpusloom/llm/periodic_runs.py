"""Runs of periodically repeated words: block matching, then exact extension.

A run is a stretch of words with least period q, at least LEAST words and three periods long, that no neighbour extends. At scale
b (a power of two) an automaton holds the aligned blocks of b words as sequences of integers and is moved across the document. A
run with b <= q < 2b (below 16: the scale of 8) holds an aligned block that comes again q words on, so every two such places are a
seed. Seeds are extended to both sides word by word. What bounds the work:

* an aligned block of 2b words can matter only if both its halves came twice, so later scales look at repeated passages only;
* a key has eight integers at every scale: the numbers of its eighths, equal for equal eighths; the automaton is moved over the
  numbers of all places, in steps of an eighth. An automaton looks for shorter keys at each step, which longer keys would make slow;
* a block inside a known run of period p <= b/2 comes again at each p words of it. A run of longer period that is not a part of
  that run must carry the first or the last word of it to that of another run of period p, so pairs of these give the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, small_batches

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 24, 3
#: The least scale; its seeds stand for all periods below twice the scale. A key has as many integers at every scale.
FIRST = EIGHTHS = 8
#: Words are compared in stretches that double from this length.
STEP = 64


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Number of leading places at which x and y are equal."""
    done, step = 0, STEP
    while done < len(x):
        differ = x[done : done + step] != y[done : done + step]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + step, step * 2
    return len(x)


def _prime_factors(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return [*out, q] if q > 1 else out


def _least(w: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether the stretch, of two periods q or more, has no smaller period: one would divide q."""
    return not any(np.array_equal(w[start : end - q // r], w[start + q // r : end]) for r in _prime_factors(q))


def _matches(names: np.ndarray, u: int, wanted: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places marked by near at which one of the wanted blocks of EIGHTHS * u words starts, and the block's number (equal blocks have one).

    names[i] is the number of the u words from i on.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for s, key in zip(wanted.tolist(), names[wanted[:, None] + np.arange(EIGHTHS) * u].tolist(), strict=True):
        automaton.add_word(tuple(key), s)
    automaton.make_automaton()
    # places in steps of u, and a number that no key holds between what does not follow each other
    gap = int(names.max()) + 1
    rows = -(-len(names) // u) + 1
    at = np.full(rows * u, -1, np.int64)
    at[: len(names)] = np.where(near[: len(names)], np.arange(len(names)), -1)
    at = at.reshape(rows, u).T.ravel()
    at = at[(at >= 0) | np.concatenate(([True], at[:-1] >= 0))]
    found = np.array(list(automaton.iter(tuple(np.where(at >= 0, names[at], gap).tolist()))), np.int64).reshape(-1, 2)
    return at[found[:, 0] - (EIGHTHS - 1)], found[:, 1]


def _doubled(names: np.ndarray, u: int) -> np.ndarray:
    """Numbers of the 2u words from each place on."""
    pairs = names[:-u] * (int(names.max()) + 1) + names[u:]
    return np.unique(pairs, return_inverse=True)[1]


def _between(w: np.ndarray, known: np.ndarray, b: int) -> list[tuple[int, int]]:
    """Seeds (place, period) from pairs of known runs (start, end, period) with 2 * period <= b <= length."""
    known = known[np.lexsort((known[:, 0], known[:, 2]))]
    out = []
    # starts, and ends, of two such runs of one period are half a block or more apart
    for k in range(1, 5):
        one, two = known[:-k], known[k:]
        for side, back in ((0, 0), (1, b)):
            q = two[:, side] - one[:, side]
            for i in np.flatnonzero((one[:, 2] == two[:, 2]) & (q >= b) & (q < 2 * b)).tolist():
                s, d = int(one[i, side]) - back, int(q[i])
                if np.array_equal(w[s : s + b], w[s + d : s + d + b]):
                    out.append((s, d))
    return out


def _spread(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Marks the width places from each start on."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the word numbers w, by start, then period."""
    n = len(w)
    if n < LEAST:
        return []
    # each word of a run is in it three times
    often = np.bincount(w)[w] >= TIMES
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    b, u, names, near = FIRST, 1, w, often
    starts = np.arange(0, n - b + 1, b)
    starts = starts[np.add.reduceat(often[: len(starts) * b], starts) == b]
    while len(starts) and b * TIMES <= n:
        seeds: list[tuple[int, int]] = []
        again = np.zeros(n, bool)
        known = np.array([(s, s + length, p) for s, length, p in found.values() if 2 * p <= b <= length], np.int64).reshape(-1, 3)
        if len(known):
            inside = np.zeros(n + 1, np.int64)
            np.add.at(inside, known[:, 0], 1)
            np.add.at(inside, known[:, 1] - b + 1, -1)
            inside = np.cumsum(inside)[starts] > 0
            again[starts[inside]] = True
            starts = starts[~inside]
            seeds = _between(w, known, b)
        if len(starts):
            places, numbers = _matches(names, u, starts, near)
            order = np.lexsort((places, numbers))
            places, numbers = places[order], numbers[order]
            key = numbers * (n + 1) + places
            own = np.flatnonzero(np.isin(places, starts))
            low = np.searchsorted(key, key[own] + (1 if b == FIRST else b))
            # the bound stays below the key of the next block
            many = np.searchsorted(key, np.minimum(key[own] + 2 * b, (numbers[own] + 1) * (n + 1))) - low
            many = np.maximum(many, 0)
            left = np.repeat(places[own], many)
            right = places[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            seeds += zip(left.tolist(), (right - left).tolist(), strict=True)
            same = numbers[1:] == numbers[:-1]
            again[places[1:][same]] = again[places[:-1][same]] = True
        seen_q = seen_to = -1
        for q, s in sorted((q, s) for s, q in seeds):
            if q == seen_q and s < seen_to:
                continue  # in the stretch just looked at
            start = s - _agree(w[:s][::-1], w[q : s + q][::-1])
            end = s + b + q + _agree(w[s + b : n - q], w[s + b + q :])
            seen_q, seen_to = q, end - q
            if end - start >= max(LEAST, TIMES * q) and _least(w, start, end, q):
                found[start, q] = (start, end - start, q)
        # blocks of twice the size whose halves both come again
        b *= 2
        starts = np.arange(0, n - b + 1, b)
        starts = starts[again[starts] & again[starts + b // 2]]
        if len(starts):
            names, u = _doubled(names, u), u * 2
            near = _spread(n, starts, 3 * b)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def dropped_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (doc_id, runs array of (start, length, period) by start and period, collapsed string).

    Words are numbered from 0; collapsed holds the words left, joined by one space, where each run keeps its first period only.
    Null, empty and blank texts have no runs and collapse to the empty string; ids may be null or repeat, equal rows give equal
    rows, other columns are not read, whatever their names; an empty table gives an empty one. A text is worked on whole, however
    long, in one task, with memory in proportion to it. Map only: no shuffle.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    row = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                every, collapsed = [], []
                for t in texts[a:b]:
                    words = words_of(t)
                    every.append(found := runs(numbered(words)))
                    if found:
                        gone = dropped_words(len(words), found).tolist()
                        words = [x for x, g in zip(words, gone, strict=True) if not g]
                    collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                flat = np.array([r for found in every for r in found], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *map(len, every)]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(row))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat periodically from some word on in a tenth of the documents, by the crc32 of the id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n = F.size(words).cast("bigint")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
    # one expression over a struct, so that words, a and p are worked out once a text
    parts = F.array(F.struct(words.alias("words"), a.alias("a"), p.alias("p")))
    grown = F.transform(parts, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.size(s["words"]) - 1), lambda i: F.get(s["words"], F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"])).cast("int"))), " "))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.get(grown, F.lit(0))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", with_planted(F.col("text"), F.col("doc_id")).alias("text")))
    # a run beats another if its length over its period is greater, by whole numbers; the array is by start and period, so the first stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
