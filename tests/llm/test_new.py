"""Periodic runs, byte-level BPE and whitening against brute force, the library and plain linear algebra."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.errors import PythonException

from corpusloom.llm import byte_bpe, lm_score, periodic_runs, whitening

DATA = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeats, one long text; columns whose names the operators use inside."""
    rnd = random.Random(3)
    words = ["alpha", "Beta", "épsilon", " x", " ", "7.5", "naïve's", "漢字", "🙂"]
    base = " ".join(rnd.choices(words, k=80))
    texts = [None, "", " \t\n", "one", base, base, "go on " * 40, "\x1c".join(words), " ".join(rnd.choices(words, k=30_000)), "x" * 30_000, " " * 5000, "\r\n\x0b" * 30 + "a b " * 20 + "c"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, base, None, None, None), (None, None, None, None, None), (5, base, "en", "s", 0), (5, base, "en", "s", 0)]
    extra = ", ".join(f"{c} string" for c in ("runs", "collapsed", "token_ids", "packed_ids", "decoded", "white", "best"))
    return spark.createDataFrame([(*r, *["z"] * 7) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_byte_bpe_is_the_library_on_odd_rows(odd, library):
    rows = byte_bpe.byte_bpe(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()), key=repr)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["decoded"].decode()) for r in rows), key=repr)
    assert got == want
    for r in rows:
        assert r["token_ids"] == library.encode_ordinary(r["decoded"].decode())
        assert bytes(r["packed_ids"]) == b"".join(i.to_bytes(4, "little") for i in r["token_ids"])
    assert byte_bpe.byte_bpe(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_query_is_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in byte_bpe.op12_byte_bpe(spark, DATA).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(t))


def test_byte_bpe_on_random_code_points(library):
    encoder = byte_bpe.ByteEncoder(byte_bpe.model_bytes(byte_bpe.load_ranks(RANKS)), public_tokenizers.PATTERN, remembered=500)
    rnd = random.Random(5)
    pools = ["  \t\n\r\x0b\x0c\x1c\x85  　a1!'sS՘꟒", "".join(map(chr, range(32, 127))), None]
    for _ in range(4000):
        text = ""
        for _ in range(rnd.randrange(1, 40)):
            pool = rnd.choice(pools)
            c = rnd.choice(pool) if pool else chr(rnd.randrange(0x110000))
            text += c if not 0xD800 <= ord(c) < 0xE000 else "?"
        ids = np.frombuffer(encoder.packed([text])[0], "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_byte_bpe_keeps_entries_that_no_merge_reaches():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.ByteEncoder(byte_bpe.model_bytes(ranks), public_tokenizers.PATTERN)
    for text in ("xyz", "xyzz", "abxyz", "ab xyz"):
        assert np.frombuffer(encoder.packed([text])[0], "<u4").tolist() == own.encode_ordinary(text)


def test_ranks_with_a_gap_are_refused(tmp_path):
    file = tmp_path / "ranks"
    file.write_bytes(b"".join(base64.b64encode(bytes([b])) + f" {b * 2}\n".encode() for b in range(256)))
    with pytest.raises(ValueError):
        byte_bpe.load_ranks(str(file))


# periodic runs


def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force():
    rnd = random.Random(1)

    def piece(depth, letters):
        if depth == 0 or rnd.random() < 0.3:
            return [rnd.randrange(letters) for _ in range(rnd.randrange(1, 30))]
        x = piece(depth - 1, letters)
        y = x * rnd.randrange(1, 7)
        y = y[: len(y) - rnd.randrange(len(x))] if rnd.random() < 0.5 and len(y) > len(x) else y
        return y if rnd.random() < 0.5 else y + piece(depth - 1, letters)

    met = 0
    for _ in range(400):
        w = piece(4, rnd.choice([1, 2, 3, 5, 50]))[:500]
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = 99
        want = plain_runs(w)
        met += len(want)
        assert periodic_runs.runs(periodic_runs.numbered([str(x).encode() for x in w])) == want
    for _ in range(600):
        p = rnd.randrange(1, 40)
        base = [rnd.randrange(2) for _ in range(p)]
        w = [base[i % p] for i in range(rnd.randrange(20, 160))]
        w[rnd.randrange(len(w))] ^= rnd.randrange(2)
        assert periodic_runs.runs(np.array(w)) == plain_runs(w)
    assert met > 500


@pytest.mark.parametrize("w", [[0] * 200_000, [0, 1] * 100_000, ([0] * 300 + [1]) * 600, ([0] * 20_000 + [1]) * 10])
def test_long_repetitive_texts_end_soon(w):
    found = periodic_runs.runs(np.array(w))
    assert (0, len(w), w.index(1) + 1 if 1 in w else 1) in found


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query_is_brute_force(spark):
    got = {r["doc_id"]: r for r in periodic_runs.op11_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for r in docs:
        words = [x.decode() for x in (r["text"] or "").encode().split()]
        words = planted(words, r["doc_id"])
        # the longest texts by the operator's own core, which the test above holds against brute force
        found = plain_runs(words) if len(words) <= 700 else periodic_runs.runs(periodic_runs.numbered([x.encode() for x in words]))
        some += bool(found)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if found else None
        row = got[r["doc_id"]]
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert row["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(words) if i not in gone))
    assert some >= 10


def test_periodic_runs_of_odd_rows(odd):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["collapsed"] == by_id[1]["collapsed"] == by_id[2]["collapsed"] == "" and not by_id[0]["runs"]
    assert [tuple(x) for x in by_id[6]["runs"]] == [(0, 80, 2)] and by_id[6]["collapsed"] == "go on"
    assert [tuple(x) for x in by_id[11]["runs"]] == [(0, 40, 2)] and by_id[11]["collapsed"] == "a b c"
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


# whitening


def test_symmetric_qr_solves():
    rnd = np.random.default_rng(1)
    for a in (np.zeros((3, 3)), np.eye(5), np.diag([3.0, 1.0, 2.0]), np.array([[2.0]]), np.ones((6, 6)), *(x @ x.T for x in (rnd.normal(size=(d, d)) for d in (2, 3, 17, 64)))):
        values, q = whitening.symmetric_qr(a)
        size = max(np.abs(a).max(), 1)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size * len(a))
        assert np.allclose(a @ q, q * values, atol=1e-12 * size * len(a)) and np.allclose(q.T @ q, np.eye(len(a)), atol=1e-12)


def check_whitening(rows, vectors, components):
    """rows against plain linear algebra over (id, vector)."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, x.shape[1])
    assert len(rows) == n * k
    want = {}
    for (i, _), r in zip(vectors, x, strict=True):
        want[i] = sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True))
    white = {}
    for r in rows:
        assert r["n"] == n and r["deviation"] == want[r["vec_id"]] and r["identity_error"] <= 1e-9
        if np.trace(cov):
            assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) <= 1e-9
        else:
            assert r["explained"] is None
        white[r["vec_id"], r["component"]] = r["whitened"]
    y = np.array([[white[i, c] if white[i, c] is not None else np.nan for c in range(1, k + 1)] for i, _ in vectors])
    usable = values[:k] > 1e-9 * max(values[0], 1e-300)
    assert (np.isnan(y).all(axis=0) == ~usable).all()
    y = y[:, usable]
    # what is projected on unit eigenvectors and scaled: cov' = I, and back through the covariance of x and y
    assert np.allclose(y.T @ y / n, np.eye(y.shape[1]), atol=1e-9)
    cross = centred.T @ y / n / np.sqrt(values[:k][usable])
    assert np.allclose(cov @ cross, cross * values[:k][usable], atol=1e-7 * max(values[0], 1)) and np.allclose(np.linalg.norm(cross, axis=0), 1, atol=1e-9)


def test_whitening_query(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    out = whitening.op13_whitening(spark, DATA)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check_whitening(out.collect(), vectors, 32)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, n string, deviation string, v string, white string, at string"
    rnd = random.Random(4)
    good = [(i, [rnd.gauss(0, 1), 5.0, rnd.gauss(0, 9), 0.25]) for i in range(60)]
    good += [(i + 100, v) for i, v in good[:9]]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 2.0, 3.0]), (204, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, *["z"] * 5) for i, v in good + bad], schema)
    model = whitening.fit(df)
    check_whitening(whitening.whiten(df, model, 3).collect(), good, 3)
    check_whitening(whitening.whiten(df, model).collect(), good, 32)
    one = spark.createDataFrame([(1, [1.0, 2.0], *["z"] * 5)] * 2 + [(None, [1.0, 2.0], *["z"] * 5)], schema)
    rows = whitening.whiten(one, whitening.fit(one)).collect()
    assert len(rows) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in rows)
    for none in (df.limit(0), df.where("vec_id >= 200")):
        assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    with pytest.raises(PythonException):
        whitening.fit(spark.createDataFrame([(1, [1.0, 2.0], *["z"] * 5), (2, [1.0], *["z"] * 5)], schema).coalesce(1))


def test_whitening_is_exact_where_64_bits_do_not_do(spark):
    rows = [(i, [float(i % 7) * 2**40, float(-i) * 2**39]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    check_whitening(whitening.whiten(df, whitening.fit(df)).collect(), rows, 32)


# the language model's score


def test_lm_score_is_a_plain_loop(spark, monkeypatch):
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(30)]
    texts = [None, "", "One", *(" ".join(rnd.choices(common, k=40) + [f"W{i}x{j}" for j in range(90)]) for i in range(30)), "c1 c2 unseen, W3x4 W3x4"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = {}
    trained = lm_score.trained

    def kept(docs, head, counts, tokens):
        made.update(head=head, v=trained(docs, head, counts, tokens))
        return made["v"]

    monkeypatch.setattr(lm_score, "trained", kept)
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs).collect()}
    words = [(t or "").lower().encode().split() for t in texts]
    counts = Counter(w for i, ws in enumerate(words) if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    head, v = made["head"], {k: x.astype(np.float64) for k, x in made["v"].items()}
    assert len(head) == lm_score.HEAD_WORDS < len(counts)
    rare = Counter()
    kinds = Counter()
    for w, c in counts.items():
        if w not in head:
            rare[lm_score.spelling(w)] += c
            kinds[lm_score.spelling(w)] += 1
    possible = [k for k in range(lm_score.SYMBOLS) if k != lm_score.BOS]
    for i, ws in enumerate(words):
        total, before, last = 0.0, lm_score.BOS, lm_score.BOS
        for w in [*ws, None]:
            s = lm_score.END if w is None else head.get(w, lm_score.HEAD_WORDS + lm_score.spelling(w))
            r = v["near"][last] + v["far"][before]
            logits = v["out"] @ r + v["bias"]
            total += (logits[s] - np.log(np.exp(logits[possible]).sum())) / np.log(10)
            if w is not None and w not in head:
                k = lm_score.spelling(w)
                total += math.log10((counts[w] + 1) / (rare[k] + kinds[k] + 1))
            before, last = last, s
        assert abs(got[i]["score"] - total) <= 1e-4 * (1 + abs(total)), i


def test_lm_top_words_stay_bounded_whatever_the_counts(spark, monkeypatch):
    texts = [(i, " ".join(f"w{j % 12} " * 900 for j in range(12))) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in lm_score.lm_scores(docs).collect()}
    monkeypatch.setattr(lm_score, "TOP_WORDS", 3)  # all twelve words are more frequent than the last exact step
    part = {r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in lm_score.lm_scores(docs).collect()}
    assert part == whole
