"""Language-model scores of whole texts: a log-bilinear model trained by noise-contrastive estimation in numpy.

Symbols are the most frequent training words, a class of spelling for every other word, and the end of a text. Two context
vectors add up to a prediction, whose product with the symbol vectors gives logits; batched matrix products give the exact
normaliser of each pair of context symbols, so token probabilities are normalised. A word outside the vocabulary has the
probability of its class times its share of the class, add-one smoothed from the counts of all training tokens.

Counts cover all training texts (one distributed aggregate). The vectors are trained in rounds of local passes over every part of
the round's share of the training texts, averaged after each round; every training text is in one round. Only tables of bounded size are
broadcast: the vocabulary, the vectors, and the counts of at most TOP_WORDS words; counts of rarer words are joined.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import kept, slices, small_batches, written

HEAD_WORDS = 1900
CLASSES = 128
END, BOS = HEAD_WORDS + CLASSES, HEAD_WORDS + CLASSES + 1
SYMBOLS = HEAD_WORDS + CLASSES + 2
DIM = 24
TOP_WORDS = 1_000_000
NOISE = 64
BATCH = 1024
#: Adagrad starts from so small a sum.
SEEN = 1e-6
#: In each round one of so many training texts is learnt from; the rounds together learn from each text once.
FRACTION = 6
ROUNDS = FRACTION
#: Tokens that one local pass should have at least.
LOCAL_TOKENS = 400_000


def spelling(word: bytes) -> int:
    """Class of a rare word, 0 to CLASSES - 1: its first two bytes, its last, and whether it is all ASCII."""
    last = word[-1]
    kind = 0 if last >= 97 or 48 <= last < 58 else 1 if last == 46 else 2 if last == 44 else 3
    return (zlib.crc32(word[:2]) % 16) * 8 + kind * 2 + (not word.isascii())


def start_vectors(counts: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    share = (counts + 0.5) / (counts + 0.5).sum()
    return {
        "near": rng.normal(0, 0.1, (SYMBOLS, DIM)).astype(np.float32),
        "far": rng.normal(0, 0.1, (SYMBOLS, DIM)).astype(np.float32),
        "out": rng.normal(0, 0.1, (SYMBOLS, DIM)).astype(np.float32),
        "bias": np.log(share).astype(np.float32),
    }


def add_rows(target: np.ndarray, seen: np.ndarray, idx: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """A row-wise Adagrad step; rows that occur more than once are summed first."""
    order = np.argsort(idx, kind="stable")
    ids, starts = np.unique(idx[order], return_index=True)
    total = np.add.reduceat(grad[order], starts, axis=0)
    seen[ids] += np.square(total).mean(axis=-1) if total.ndim > 1 else np.square(total)
    step = rate / np.sqrt(seen[ids] + 1e-8)
    target[ids] += total * (step[:, None] if total.ndim > 1 else step)


def nce_pass(v: dict[str, np.ndarray], c1: np.ndarray, c2: np.ndarray, w: np.ndarray, noise: np.ndarray, rate: float, seed: int) -> None:
    """One pass of noise-contrastive estimation over the tokens w with contexts c1 and c2, in place."""
    rng = np.random.default_rng(seed)
    cum = np.cumsum(noise)
    log_kq = np.log(NOISE * noise).astype(np.float32)
    seen = {k: np.full(SYMBOLS, SEEN, np.float32) for k in v}
    order = rng.permutation(len(w))
    for a in range(0, len(w), BATCH):
        at = order[a : a + BATCH]
        x, y, t = c1[at], c2[at], w[at]
        drawn = np.minimum(np.searchsorted(cum, rng.random(NOISE) * cum[-1]), SYMBOLS - 1)
        r = v["near"][x] + v["far"][y]
        q_t, q_n = v["out"][t], v["out"][drawn]
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", r, q_t) + v["bias"][t] - log_kq[t], -30, 30)))  # 1 - P(data)
        down = -1 / (1 + np.exp(-np.clip(r @ q_n.T + v["bias"][drawn] - log_kq[drawn], -30, 30)))  # -P(data) of noise
        g_r = up[:, None] * q_t + down @ q_n
        scale = np.float32(1 / len(at))
        add_rows(v["out"], seen["out"], np.concatenate([t, drawn]), np.concatenate([up[:, None] * r, down.T @ r]) * scale, rate)
        add_rows(v["bias"], seen["bias"], np.concatenate([t, drawn]), np.concatenate([up, down.sum(0)]) * scale, rate)
        add_rows(v["near"], seen["near"], x, g_r * scale, rate)
        add_rows(v["far"], seen["far"], y, g_r * scale, rate)


def lowered(texts: list) -> Iterator[list[bytes]]:
    for t in texts:
        yield t.encode("utf-8", "surrogatepass").lower().split() if t else []


def with_ends(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with an end after each text, both contexts, and where each text starts."""
    ends = np.cumsum(counts + 1) - 1
    w = np.empty(len(symbols) + len(counts), np.int32)
    inner = np.ones(len(w), bool)
    inner[ends] = False
    w[inner], w[ends] = symbols, END
    starts = ends - counts
    c1, c2 = np.empty_like(w), np.empty_like(w)
    c1[1:], c2[2:] = w[:-1], w[:-2]
    c1[starts], c2[starts] = BOS, BOS
    c2[starts[counts > 0] + 1] = BOS
    return w, c1, c2, starts


class Symbols(dict):
    def __init__(self, head: dict[bytes, int]):
        super().__init__(head)

    def __missing__(self, word: bytes) -> int:
        return HEAD_WORDS + spelling(word)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, class, c) of all words, counted per part first; the end is the row with a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter, ends: int) -> pa.RecordBatch:
            words = list(c)
            return pa.RecordBatch.from_arrays([pa.array([*words, *[None] * (ends > 0)], pa.binary()), pa.array([*map(spelling, words), *[CLASSES] * (ends > 0)], pa.int32()), pa.array([*c.values(), *[ends] * (ends > 0)], pa.int64())], names=["word", "class", "c"])

        c, ends = Counter(), 0
        for batch in batches:
            for words in lowered(batch.column(0).to_pylist()):
                c.update(words)
                ends += 1
                if len(c) > 300_000:
                    yield out(c, ends)
                    c, ends = Counter(), 0
        yield out(c, ends)

    return docs.select("text").mapInArrow(run, "word binary, class int, c bigint").groupBy("word", "class").agg(F.sum("c").alias("c"))


def trained(docs: DataFrame, head: dict[bytes, int], counts: np.ndarray, tokens: int) -> dict[str, np.ndarray]:
    """Rounds of local passes, each over its share of the training texts, averaged by tokens."""
    spark = docs.sparkSession
    vectors = start_vectors(counts)
    noise = np.power(counts + 1.0, 0.75)
    noise[BOS] = 1e-6
    noise /= noise.sum()
    parts = max(1, min(docs.rdd.getNumPartitions(), tokens // FRACTION // LOCAL_TOKENS))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vectors, head, noise))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            v, head, noise = shared.value
            v = {k: x.copy() for k, x in v.items()}
            known, done, parts_of = Symbols(head), 0, []
            waiting = 0

            def learn() -> int:
                symbols, counts = np.concatenate([p[0] for p in parts_of]), np.concatenate([p[1] for p in parts_of])
                w, c1, c2, _ = with_ends(symbols, counts)
                nce_pass(v, c1, c2, w, noise, 0.15 if turn == 0 else 0.08, turn * 1000)
                return len(w)

            for batch in batches:
                texts = batch.column(0).to_pylist()
                for a, b in slices(texts):
                    lists = list(lowered(texts[a:b]))
                    symbols = np.array([known[x] for words in lists for x in words], np.int32)
                    parts_of.append((symbols, np.array([len(x) for x in lists], np.int64)))
                    waiting += len(symbols)
                    if waiting > 1_000_000:
                        done += learn()
                        parts_of, waiting = [], 0
            if parts_of:
                done += learn()
            if done:
                for name, x in v.items():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([done], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["name", "tokens", "data"])

        share = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(FRACTION)) == turn).select("text")

        def merge(table: pa.Table) -> pa.Table:
            total, n = 0, 0
            table = table.sort_by([("tokens", "ascending"), ("data", "ascending")])  # sums do not depend on the order of arrival
            for d, t in zip(table.column("data"), table.column("tokens"), strict=True):
                t = t.as_py()
                total, n = total + np.frombuffer(d.as_buffer(), np.float32) * np.float64(t), n + t
            return pa.table({"name": [table.column("name")[0].as_py()], "tokens": [n], "data": [np.asarray(total / n, np.float32).tobytes()]})

        local = share.coalesce(parts).mapInArrow(run, "name string, tokens bigint, data binary")
        # two levels, so that no task merges more than a few hundred parts
        first = local.withColumn("at", F.pmod(F.xxhash64("data"), F.lit(max(1, parts // 200 + 1)))).groupBy("name", "at").applyInArrow(merge, "name string, tokens bigint, data binary")
        got = first.groupBy("name").applyInArrow(merge, "name string, tokens bigint, data binary").collect()  # four rows
        for r in got:
            vectors[r["name"]] = np.frombuffer(r["data"], np.float32).reshape(vectors[r["name"]].shape).copy()
        shared.unpersist()
    return vectors


class Scorer:
    """Log10 probabilities of tokens; normalisers of pairs of context symbols are computed once in a worker."""

    def __init__(self, v: dict[str, np.ndarray]):
        self.v = v
        self.norm = np.full(SYMBOLS * SYMBOLS, np.nan, np.float32)
        self.bias = v["bias"].copy()
        self.bias[BOS] = -np.inf  # never a token
        # the bias is the weight of a last context entry that is always one
        self.weights = np.ascontiguousarray(np.concatenate([v["out"], self.bias[:, None]], axis=1).T)
        self.ones, self.room = np.ones(SYMBOLS, np.float32), np.empty((2048, SYMBOLS), np.float32)

    def __call__(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        key = c1.astype(np.int64) * SYMBOLS + c2
        fresh = np.unique(key[np.isnan(self.norm[key])])
        for a in range(0, len(fresh), 2048):
            k = fresh[a : a + 2048]
            logits = np.concatenate([self.v["near"][k // SYMBOLS] + self.v["far"][k % SYMBOLS], np.ones((len(k), 1), np.float32)], axis=1) @ self.weights
            with np.errstate(over="ignore"):
                total = np.exp(logits, out=self.room[: len(k)]) @ self.ones
            odd = ~((total > 1e-30) & (total < 1e30))  # out of the range of single precision: from the largest on
            if odd.any():
                top = logits[odd].max(axis=1)
                self.norm[k[odd]] = np.log(np.exp(logits[odd] - top[:, None]).sum(axis=1)) + top
                total[odd], k = 1, np.where(odd, -1, k)
            self.norm[k[k >= 0]] = np.log(total[k >= 0])
        out = np.empty(len(w), np.float64)
        for a in range(0, len(w), 1 << 16):
            b = slice(a, a + (1 << 16))
            r = self.v["near"][c1[b]] + self.v["far"][c2[b]]
            out[b] = np.einsum("ij,ij->i", r, self.v["out"][w[b]]) + self.bias[w[b]] - self.norm[key[b]]
        return out / np.log(10)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo mod, is rest; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2) -> DataFrame:
    """One row per row of df: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows whose id falls in the held-out class are scored but not learnt from. A null or empty text is one end token. With no
    training rows all counts are 0 and the model stays as it starts; an empty table gives an empty one. Null and repeated ids are
    scored row by row, and texts whole, however long: a task holds the symbols of one slice of texts.
    """
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(F.col(id_col), mod, rest).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    words = written(count_words(training), "words")
    ends = sum(r["c"] for r in words.where(F.col("word").isNull()).collect())
    named = words.where(F.col("word").isNotNull())
    by_class = {r["class"]: (r["n"], r["v"]) for r in named.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_all, v_all = sum(x[0] for x in by_class.values()) + ends, sum(x[1] for x in by_class.values()) + (ends > 0)
    head_rows = named.orderBy(F.desc("c"), "word").limit(HEAD_WORDS).collect()
    head = {bytes(r["word"]): i for i, r in enumerate(head_rows)}
    counts = np.zeros(SYMBOLS)
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (n, v) in by_class.items():
        class_n[k], class_v[k] = n, v
    for i, r in enumerate(head_rows):
        counts[i] = r["c"]
        class_n[r["class"]] -= r["c"]
        class_v[r["class"]] -= 1
    counts[HEAD_WORDS : HEAD_WORDS + CLASSES], counts[END] = class_n, ends
    vectors = trained(training, head, counts, int(n_all)) if n_all else start_vectors(counts)

    # the least count of which no more than TOP_WORDS words have as many or more; from 8192 on by powers of two, so the steps are few
    # and each is over before its words are too many: so many words of so high a count would be more than all tokens
    step = F.when(F.col("c") < 8192, F.col("c")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin("c")) - 1))
    steps = sorted(((r["k"], r["n"]) for r in named.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, many = 1 << 62, 0
    for k, n in steps:
        if many + n > TOP_WORDS:
            break
        least, many = k, many + n
    top = named.where(F.col("c") >= least).select("word", "c").toArrow()
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in top.column("word").to_pylist()], np.uint64)
    order = np.argsort(hashes)
    hashes, top_c = hashes[order], np.minimum(top.column("c").to_numpy(), 2**40).astype(np.float64)[order] if len(order) else np.zeros(0)
    shared = spark.sparkContext.broadcast((vectors, head, hashes, np.log10(top_c + 1), np.log10(class_n + class_v + 1), ends))
    number = uuid.uuid4().hex
    base_log = float(np.log10(n_all + v_all + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, head, hashes, logs, class_log, ends = shared.value
        scorer = kept(number, lambda: Scorer(vectors))
        end_log = float(np.log10(ends + 1))
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                local: dict[bytes, int] = {}
                lists = list(lowered(texts[a:b]))
                n = np.array([len(x) for x in lists], np.int64)
                ids = np.array([local.setdefault(x, len(local)) for words in lists for x in words], np.int64)
                del lists
                names = list(local)
                h = np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                known = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                c_log = np.where(known, logs[at], 0.0) if len(hashes) else np.zeros(len(h))
                symbol = np.array([head.get(x, -1) for x in names], np.int32)
                rare = np.flatnonzero(symbol < 0)
                symbol[rare] = [HEAD_WORDS + spelling(names[i]) for i in rare]
                w, c1, c2, starts = with_ends(symbol[ids] if len(ids) else np.zeros(0, np.int32), n)
                token = scorer(w, c1, c2)
                own = np.zeros(len(w))  # what the counts add to the score of a token
                inner = np.ones(len(w), bool)
                inner[starts + n] = False
                base = np.empty(len(w))
                if len(ids):
                    share = np.zeros(len(names))
                    share[rare] = c_log[rare] - class_log[symbol[rare] - HEAD_WORDS]
                    own[inner], base[inner] = share[ids], c_log[ids]
                base[~inner] = end_log
                sums = lambda x: np.add.reduceat(x, starts)
                is_known = np.zeros(len(w), np.int64)
                if len(ids):
                    is_known[inner] = known[ids]
                is_known[~inner] = ends > 0
                # words whose counts are joined later
                tails: list[list] = [[] for _ in range(b - a)]
                if len(ids):
                    odd = np.flatnonzero(~known[ids])
                    doc = np.repeat(np.arange(b - a), n)[odd]
                    pair, tf = np.unique(doc * len(names) + ids[odd], return_counts=True)
                    for d, x, k in zip((pair // len(names)).tolist(), (pair % len(names)).tolist(), tf.tolist(), strict=True):
                        tails[d].append({"word": names[x], "tf": k, "rare": bool(symbol[x] >= HEAD_WORDS)})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + b - a)), batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n + 1), pa.array(sums(is_known)), pa.array(sums(base) - (n + 1) * base_log), pa.array(sums(token + own)),
                        pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32()), ("rare", pa.bool_())]))),
                    ],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
                )
                rid += b - a

    part = written(docs.select("doc_id", "text", "held_out").mapInArrow(run, f"rid bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, tail array<struct<word:binary,tf:int,rare:boolean>>"), "lm")
    tail = part.select("rid", F.explode("tail").alias("t")).select("rid", "t.*")
    more = tail.join(named.where(F.col("c") < least), "word").groupBy("rid").agg(F.sum("tf").alias("more_known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.when(F.col("rare"), F.col("tf") * F.log10(F.col("c") + 1.0))).alias("more_rare"))
    return part.drop("tail").join(more, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_rare", F.lit(0.0))).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_lm_score": op3_lm_score}
ORACLE_SQL: dict[str, str] = {}
