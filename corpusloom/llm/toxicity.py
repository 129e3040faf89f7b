"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters with a word vector and a character vector (vectors of its hashed character runs, summed). A text is cut into
overlapping windows of words; every window is scored and the highest score is the text's. Training knows labels of texts only:
each round picks the most suspicious window of every text by the model so far, and learns from it (and from others of clean texts).

The network is fitted on a bounded sample of labelled texts (TRAIN_EACH of the two labels, TRAIN_CHARS in all, both parameters)
and broadcast: its size does not depend on the data. Scoring is a map over all rows and whole texts.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import kept, slices, small_batches

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 6, 6, 8, 8
RUNS = (3, 4, 5, 6)
BUCKETS = 1 << 15
#: Bound of the training sample: texts labelled toxic and others, and characters in all.
TRAIN_EACH, TRAIN_CHARS = (1000, 2000), 12_000_000
#: A training word is known if it is in so many texts.
LEAST_TEXTS = 4
#: In each round, so many steps of BATCH windows, or one pass if that is more.
ROUNDS, STEPS, BATCH = 6, 64, 128
#: Steps of the network's weights and of word and character vectors; power of the label's probability that weighs an error, against wrong labels.
RATE, VECTOR_RATE, TRUST = 0.005, 0.0003, 0.4
#: Words whose character runs are cut and gathered at once.
BLOCK = 1 << 13
LETTERS = re.compile(r"[^\W\d_]+")


def core(word: bytes) -> bytes:
    """The word in lower case without signs around and inside it; without any letter, the word itself."""
    if word.isalpha():
        return word.lower()
    text = word.decode("utf-8", "replace")
    return ("".join(LETTERS.findall(text)).lower() or text).encode()


def runs_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character runs (bytes, with marks for both ends) of all words, and the number of runs of each. Block by block, for memory."""
    parts = [runs_of_block(words[a : a + BLOCK]) for a in range(0, len(words), BLOCK)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def runs_of_block(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"".join([b"^" + w + b"$" for w in words]), np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(joined))  # letters from here to the word's end
    found, owner = [], []
    h = np.zeros(len(joined), np.uint64)
    for n in range(1, max(RUNS) + 1):
        if n > len(joined):
            break
        h[: len(joined) - n + 1] = h[: len(joined) - n + 1] * np.uint64(0x100000001B3) + joined[n - 1 :]
        if n in RUNS:
            at = np.flatnonzero(left >= n)
            x = h[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            found.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int32))
            owner.append(word[at])
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return np.concatenate(found)[order], np.bincount(own, minlength=len(words))


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words; the last one reaches its end."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters p, and the passes through them. A word is a row of a projection table: what it adds to the gates of both directions."""

    def __init__(self, words: dict[bytes, int], p: dict[str, np.ndarray]):
        self.words, self.p = words, p

    @staticmethod
    def start(words: dict[bytes, int], word_odds: np.ndarray, run_odds: np.ndarray) -> Net:
        rng = np.random.default_rng(3)
        d = WORD_DIM + CHAR_DIM
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        p = {"word": f(len(words) + 1, WORD_DIM) * 0.1, "char": rng.normal(0, 0.05, (BUCKETS, CHAR_DIM)).astype(np.float32), "wx": f(d, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32), "uf": f(HIDDEN, 3 * HIDDEN), "ub": f(HIDDEN, 3 * HIDDEN), "wa": f(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": f(ATTEND), "wo": f(2 * HIDDEN), "bo": np.full(1, -2, np.float32)}
        p["word"][:-1, 0] += word_odds
        p["char"][:, 0] += run_odds
        return Net(words, p)

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word rows, runs and their counts, and input vectors of words already reduced to their core."""
        ids = np.array([self.words.get(w, len(self.words)) for w in words], np.int64)
        runs, n = runs_of(words)
        return ids, runs, n, self.vectors(ids, runs, n)

    def vectors(self, ids: np.ndarray, runs: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.zeros((len(ids), WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = self.p["word"][ids]
        ends = np.cumsum(n)
        for a in range(0, len(n), BLOCK):
            own = n[a : a + BLOCK]
            has = np.flatnonzero(own)
            if len(has):
                first, stop = ends[a] - own[0], ends[a + len(own) - 1]
                starts = (ends[a : a + len(own)] - own)[has] - first
                x[a + has, WORD_DIM:] = np.add.reduceat(self.p["char"][runs[first:stop]], starts, axis=0) / np.sqrt(own[has])[:, None]
        return x

    def forward(self, table: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows: at has rows of table for each step and window, -1 for none."""
        p, (steps, many) = self.p, at.shape
        real = at >= 0
        idx = np.where(real, at, 0)
        mask = real.astype(np.float32)[:, :, None]
        states = np.zeros((2, steps, many, HIDDEN), np.float32)
        saved: list[dict] = [{}, {}]
        for way, u in ((0, p["uf"]), (1, p["ub"])):
            h = np.zeros((many, HIDDEN), np.float32)
            part = table[:, way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN]
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x = part[idx[t]]
                zr = sigmoid(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                rh = r * h
                c = np.tanh(x[:, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
                if keep:
                    saved[way][t] = (h, z, r, rh, c)
                h = h + mask[t] * z * (c - h)
                states[way, t] = h
        s = np.concatenate([states[0], states[1]], axis=2)
        e = np.tanh(s @ p["wa"] + p["ba"])
        a = np.where(real, e @ p["va"], -1e9)
        a = np.exp(a - a.max(axis=0)) * real
        a = (a / np.maximum(a.sum(axis=0), 1e-9)).astype(np.float32)
        pooled = np.einsum("tb,tbh->bh", a, s)
        return pooled @ p["wo"] + p["bo"][0], {"s": s, "e": e, "a": a, "pooled": pooled, "mask": mask, "idx": idx, "saved": saved} if keep else {}

    def backward(self, k: dict, g: np.ndarray, rows: int) -> dict[str, np.ndarray]:
        """Gradients of the parameters behind the projection table, and of the table."""
        p = self.p
        s, e, a, mask, idx = k["s"], k["e"], k["a"], k["mask"], k["idx"]
        steps, many = a.shape
        out = {"wo": k["pooled"].T @ g, "bo": np.array([g.sum()])}
        d_pool = g[:, None] * p["wo"]
        d_s = a[:, :, None] * d_pool
        d_a = np.einsum("tbh,bh->tb", s, d_pool)
        d_a = a * (d_a - (a * d_a).sum(axis=0))
        d_e = d_a[:, :, None] * p["va"] * (1 - e * e)
        out["va"] = np.einsum("tb,tbk->k", d_a, e)
        out["wa"] = s.reshape(-1, 2 * HIDDEN).T @ d_e.reshape(-1, ATTEND)
        out["ba"] = d_e.sum(axis=(0, 1))
        d_s = d_s + d_e @ p["wa"].T
        d_x = np.zeros((steps, many, 6 * HIDDEN), np.float32)
        for way, name in ((0, "uf"), (1, "ub")):
            u, d_u, d_h = p[name], np.zeros_like(p[name]), np.zeros((many, HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                h, z, r, rh, c = k["saved"][way][t]
                d_h = d_h + d_s[t][:, way * HIDDEN : (way + 1) * HIDDEN]
                m = mask[t]
                d_z = d_h * m * (c - h) * z * (1 - z)
                d_c = d_h * m * z * (1 - c * c)
                d_rh = d_c @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_u[:, : 2 * HIDDEN] += h.T @ d_zr
                d_u[:, 2 * HIDDEN :] += rh.T @ d_c
                d_x[t, :, way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN] = np.concatenate([d_zr, d_c], axis=1)
                d_h = d_h * (1 - m * z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
            out[name] = d_u
        flat, grad = idx.ravel(), (d_x * mask).reshape(-1, 6 * HIDDEN)
        order = np.argsort(flat, kind="stable")
        ids, starts = np.unique(flat[order], return_index=True)
        table = np.zeros((rows, 6 * HIDDEN), np.float32)
        table[ids] = np.add.reduceat(grad[order], starts, axis=0)
        out["table"] = table
        return out


def laid_out(n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts of n words each whose table rows follow each other: (steps x windows) table rows, and the text of each window."""
    text = np.concatenate([np.full(len(s), i) for i, s in enumerate(map(window_starts, n.tolist()))])
    inside = np.concatenate([window_starts(x) for x in n.tolist()])
    first, left = (np.cumsum(n) - n)[text] + inside, n[text] - inside
    at = np.full((WINDOW, len(text)), -1, np.int32)
    for step in range(WINDOW):
        real = left > step
        at[step, real] = rows[first[real] + step]
    return at, text


def numbered(texts: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words per text, all words as numbers, and the core of each number."""
    seen: dict[bytes, int] = {}
    # text by text: the words of all of them are never held at once
    parts = [np.array([seen.setdefault(w, len(seen)) for w in t.encode("utf-8", "surrogatepass").split()] if t else [], np.int64) for t in texts]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    cores: dict[bytes, int] = {}
    to = np.array([cores.setdefault(core(w), len(cores)) for w in seen], np.int64)
    return np.array([len(x) for x in parts], np.int64), to[ids] if len(ids) else ids, list(cores)


def odds(texts: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """texts: number of clean and of toxic texts with each item. Shrunken log odds of items, and their number of texts."""
    b, a = texts
    na, nb = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    value = np.log((a + 0.1) / (na + 0.2)) - np.log((b + 0.1) / (nb + 0.2))
    return np.clip(value * (a + b) / (a + b + 6), -3, 3).astype(np.float32), a + b


def fit(texts: list[str], toxic: np.ndarray) -> Net:
    """A network fitted to labelled texts; without both labels it only knows how frequent the label is."""
    n, ids, cores = numbered(texts)
    runs, run_n = runs_of(cores) if cores else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    # texts with each word and each character run, by label
    with_word, with_run = np.zeros((2, len(cores)), np.int64), np.zeros((2, BUCKETS), np.int64)
    ends, stops = np.cumsum(run_n), np.cumsum(n)
    for label, a, b in zip(toxic.tolist(), (stops - n).tolist(), stops.tolist(), strict=True):
        if b > a:
            own = np.unique(ids[a:b])
            with_word[label, own] += 1
            with_run[label, np.unique(np.concatenate([runs[ends[c] - run_n[c] : ends[c]] for c in own]))] += 1
    value, many = odds(with_word, toxic)
    known = np.flatnonzero(many >= LEAST_TEXTS)
    words = {cores[i]: j for j, i in enumerate(known.tolist())}
    run_value, _ = odds(with_run, toxic)
    net = Net.start(words, value[known], run_value * 0.5)
    net.p["bo"][0] = np.log((toxic.sum() + 0.5) / ((1 - toxic).sum() + 2.0))
    if not len(cores) or not 0 < toxic.sum() < len(toxic):
        net.p["wo"][:] = 0
        return net
    word_ids = np.array([net.words.get(w, len(net.words)) for w in cores], np.int64)
    x = net.vectors(word_ids, runs, run_n)
    at, owner = laid_out(n, ids)
    first = np.concatenate([x[:, 0] + x[:, WORD_DIM], [-9.0]])
    score = np.full(at.shape[1], -np.inf)
    for step_rows in at:
        np.maximum(score, first[step_rows], out=score)  # before anything is learnt: the most telling word
    rng, moments, step = np.random.default_rng(5), {}, 0

    def adam(name: str, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        m, v = moments.setdefault(name, (np.zeros_like(net.p[name]), np.zeros_like(net.p[name])))
        k = slice(None) if rows is None else rows
        m[k] = 0.9 * m[k] + 0.1 * grad
        v[k] = 0.99 * v[k] + 0.01 * grad * grad
        net.p[name][k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)

    for turn in range(ROUNDS):
        order = np.lexsort((-score, owner))
        best = order[np.unique(owner[order], return_index=True)[1]]
        others = rng.permutation(np.flatnonzero(toxic[owner] == 0))[: len(best)]
        chosen = np.concatenate([best, others])
        for _ in range(max(1, round(STEPS * BATCH / len(chosen)))):
            chosen = rng.permutation(chosen)
            for a in range(0, len(chosen), BATCH):
                w = chosen[a : a + BATCH]
                step += 1
                used = np.unique(at[:, w])
                used = used[used >= 0]
                local = np.where(at[:, w] >= 0, np.searchsorted(used, at[:, w]), -1)
                spans = [np.arange(e - k, e) for e, k in zip(np.cumsum(run_n)[used], run_n[used], strict=True)]
                own_runs, own_n = runs[np.concatenate(spans)] if spans else runs[:0], run_n[used]
                x = net.vectors(word_ids[used], own_runs, own_n)
                logit, kept = net.forward(x @ net.p["wx"] + net.p["bx"], local, keep=True)
                y = toxic[owner[w]]
                p = sigmoid(logit)
                g = ((p - y) * np.where(y == 1, p, 1 - p) ** TRUST / len(w)).astype(np.float32)
                grads = net.backward(kept, g, len(used))
                d_table = grads.pop("table")
                grads |= {"wx": x.T @ d_table, "bx": d_table.sum(axis=0)}
                d_x = d_table @ net.p["wx"].T
                for name, grad in grads.items():
                    adam(name, grad.astype(np.float32), RATE)
                rows, inverse = np.unique(word_ids[used], return_inverse=True)
                total = np.zeros((len(rows), WORD_DIM), np.float32)
                np.add.at(total, inverse, d_x[:, :WORD_DIM])
                adam("word", total, VECTOR_RATE, rows)
                rows, inverse = np.unique(own_runs, return_inverse=True)
                total = np.zeros((len(rows), CHAR_DIM), np.float32)
                np.add.at(total, inverse, np.repeat(d_x[:, WORD_DIM:] / np.sqrt(np.maximum(own_n, 1))[:, None], own_n, axis=0))
                adam("char", total, VECTOR_RATE, rows)
        table = net.vectors(word_ids, runs, run_n) @ net.p["wx"] + net.p["bx"]
        score = np.concatenate([net.forward(table, at[:, a : a + 4096])[0] for a in range(0, at.shape[1], 4096)])
    return net


def score_texts(net: Net, texts: list) -> np.ndarray:
    n, ids, cores = numbered(texts)
    table = (net.inputs(cores)[3] if cores else np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)) @ net.p["wx"] + net.p["bx"]
    at, owner = laid_out(n, ids)
    logits = np.concatenate([net.forward(table, at[:, a : a + 8192])[0] for a in range(0, at.shape[1], 8192)])
    return sigmoid(np.maximum.reduceat(logits.astype(np.float64), np.unique(owner, return_index=True)[1]))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: tuple[int, int] = TRAIN_EACH, chars: int = TRAIN_CHARS) -> Net:
    """A network fitted to the first `each` (toxic, other) labelled rows in hash order, held-out rows left out.

    Null ids and labels are left out, an id labelled twice counts as toxic if one label says so; null and empty texts are texts
    without words. If the sample has more than `chars` characters, a text that would exceed them is left out and shorter ones later
    in that order still count, which bounds the memory of the one task that fits; no text is left out for its own length unless it
    has more than `chars` itself. Ids are whole numbers. Without labelled texts the network only knows that it knows nothing.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order).limit(each[0]).unionByName(known.where("toxic = 0").orderBy(order).limit(each[1]))
    ids = df.sparkSession.createDataFrame(ids.toArrow().to_pandas()[["doc_id", "toxic"]], "doc_id bigint, toxic int")  # sum(each) rows at most
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").withColumn("tie", F.xxhash64("text"))
    sizes = found.groupBy("doc_id", "tie").agg(F.any_value(F.length("text")).alias("size")).orderBy(order, "tie").limit(2 * sum(each)).collect()  # ids may repeat
    chosen, total = [], 0
    for r in sizes:
        if total + r["size"] <= chars and len(chosen) < sum(each):
            chosen.append((r["doc_id"], r["tie"]))
            total += r["size"]
    chosen = df.sparkSession.createDataFrame(chosen, "doc_id bigint, tie bigint")
    found = found.join(F.broadcast(chosen), ["doc_id", "tie"]).groupBy("doc_id", "tie", "toxic").agg(F.any_value("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        y = np.array(toxic, np.int64)
        net = fit(texts, y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.words, net.p))]), pa.array([int(y.sum())], pa.int64()), pa.array([len(y)], pa.int64())], names=["net", "toxic", "many"])

    # one task fits the bounded sample, away from the driver's memory
    small_batches(df.sparkSession)
    done = found.orderBy(order, "tie").limit(sum(each)).select("text", "toxic").mapInArrow(learn, "net binary, toxic bigint, many bigint").collect()
    if not done:
        return fit([], np.zeros(0, np.int64))
    net, positive, many = Net(*pickle.loads(done[0]["net"])), done[0]["toxic"], done[0]["many"]
    if 0 < positive < many:  # the sample holds more toxic texts than there are
        share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        net.p["bo"][0] += np.log(share[1] / share[0]) - np.log(positive / (many - positive))
    return net


def toxicity_scores(df: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: (doc_id, score 0 to 1), and the columns named in keep as they are.

    A null or empty text is one window without words and gets the score of no evidence. Ids may be null or repeat. All windows of
    a very long text are scored, block by block; an empty table gives an empty one.
    """
    spark = df.sparkSession
    small_batches(spark)
    number, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((net.words, net.p))  # bounded by the training sample
    picked = df.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("doc_id"), *keep)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = kept(number, lambda: Net(*shared.value))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, 3_000_000):
                columns = [batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score_texts(net, texts[a:b]))], names=[*batch.schema.names[1:], "score"])

    return picked.mapInArrow(run, ", ".join([*fields, "score double"]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_scores(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
