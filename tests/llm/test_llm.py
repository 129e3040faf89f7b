"""The training-data operators against brute force on small tables with nulls, ties, repeats, empty and long texts and extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpusloom.llm as llm
from corpusloom.llm import bpe, chat_format, decontaminate, fingerprint, jaccard_join, line_dedup, lm_score, sharding, substring_dedup, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ["alpha", "beta", "Gamma", "delta.", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeats, one long text; columns whose names the operators use inside."""
    rnd = random.Random(3)
    base = [" ".join(rnd.choices(WORDS, k=60)) for _ in range(4)]
    texts = [None, "", " ", "one", "one two", *base, *base, base[0] + " end", "\n".join([base[1]] * 3), " ".join(rnd.choices(WORDS, k=6000)), "x" * 5000]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, base[2], None, None, None), (None, None, None, None, None), (5, base[0], "en", "s", 0), (5, base[0], "en", "s", 0)]
    extra = "sig string, n string, tie string, at string, key string, component string, grp string"
    return spark.createDataFrame([(*r, *["z"] * 7) for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# toxicity


def test_toxicity_learns_and_scores_every_row(spark, odd, empty):
    rnd = random.Random(1)
    rows, marks = [], []
    for i in range(240):
        words = rnd.choices(WORDS, k=rnd.choice([5, 40, 120]))
        bad = i % 4 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["grumble", "Grumble!", "ogre"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs, labels = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    net = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, net).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert len(got) == 240 and right >= 0.9 * len(held)
    scores = toxicity.toxicity_scores(odd, net).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.toxicity_scores(empty, net).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert len({r["score"] for r in toxicity.toxicity_scores(docs, none).collect()}) == 1


def test_toxicity_learns_from_long_texts_and_scores_all_windows(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(WORDS, k=30)) + (" ogre" if i % 3 == 0 else "")) for i in range(60)] + [(60, None), (61, ""), (62, " ".join(rnd.choices(WORDS, k=70_000)))]
    marks = [(i, int(i % 3 == 0)) for i in range(63)] + [(1, 1), (1, None), (None, 1)]
    assert len(rows[62][1]) > 300_000
    net = toxicity.train(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    small = toxicity.train(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id bigint, toxic int"), chars=1000)
    assert net.words and len(small.words) <= len(net.words)
    # the highest score of single windows, one at a time
    texts = [r[1] for r in rows[:8]] + [" ".join(rnd.choices([*WORDS, "ogre"], k=k)) for k in (1, 31, 32, 33, 48, 49, 200)]
    for text, got in zip(texts, toxicity.score_texts(net, texts), strict=True):
        words, best = text.split(), 0.0
        starts = sorted({*range(0, max(1, len(words) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)})
        for a in starts:
            x = net.inputs([toxicity.core(w.encode()) for w in words[a : a + toxicity.WINDOW]])[3] @ net.p["wx"] + net.p["bx"]
            at = np.append(np.arange(len(x)), np.full(toxicity.WINDOW - len(x), -1))[:, None]
            best = max(best, float(toxicity.sigmoid(net.forward(x, at)[0])[0]))
        assert abs(best - got) < 1e-5


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Net.start({b"a": 0}, np.ones(1, np.float32), np.zeros(toxicity.BUCKETS, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    table = rng.normal(size=(5, 6 * toxicity.HIDDEN))
    at = np.array([[0, 1], [2, -1], [3, -1]])
    _, kept = net.forward(table, at, keep=True)
    grads = net.backward(kept, np.ones(2), 5)
    for name in ("uf", "ub", "wa", "va", "wo", "ba"):
        x, flat = net.p[name], grads[name].ravel()
        for j in rng.choice(x.size, 3):
            old = x.ravel()[j]
            ends = []
            for e in (1e-3, -1e-3):
                x.ravel()[j] = old + e
                ends.append(net.forward(table, at)[0].sum())
            x.ravel()[j] = old
            assert abs((ends[0] - ends[1]) / 2e-3 - flat[j]) < 2e-3


# n-gram Jaccard join


def jaccard_brute(rows, k, p):
    sets = defaultdict(set)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] |= {frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])}
    group = {i: i for i in sets if i is not None}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(group)
    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= p * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = sorted((top(a), top(b)))
                group[v] = u
    return {i: top(i) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, words, percent):
    rnd, rows = random.Random(words), []
    for b in range(6):
        base = rnd.choices([f"w{x}" for x in range(80)], k=rnd.choice([4, 30, 90]))
        for _ in range(9):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(["New", "w1", "x"])
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs_of(spark, rows), words, percent).collect()}
    assert got == jaccard_brute(rows, words, percent)


def test_jaccard_odd_rows(spark, odd, empty):
    out = jaccard_join.jaccard_components(odd).collect()
    assert len(out) == odd.count()
    want = jaccard_brute([(r["doc_id"], r["text"]) for r in odd.collect()], 3, 90)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in out)
    assert jaccard_join.jaccard_components(empty).count() == 0


# language model


def test_lm_base_scores_are_exact(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    counts, ends = defaultdict(int), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ends += 1
            for w in (t or "").encode().lower().split():
                counts[w] += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: np.log10((c + 1) / (n + v + 1))
    got = {r["doc_id"]: r for r in llm.queries()["op3_lm_score"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        assert got[i]["n_tokens"] == len(w) + 1 and got[i]["train_tokens"] == n
        assert got[i]["n_known"] == sum(x in counts for x in w) + 1
        assert abs(got[i]["base_score"] - sum(log(counts.get(x, 0)) for x in w) - log(ends)) < 1e-6


def test_lm_probabilities_add_up():
    v = lm_score.start_vectors(np.ones(lm_score.SYMBOLS))
    every = np.array([x for x in range(lm_score.SYMBOLS) if x != lm_score.BOS], np.int32)
    lp = lm_score.Scorer(v)(every, np.full(len(every), 7, np.int32), np.full(len(every), 9, np.int32))
    assert abs((10**lp).sum() - 1) < 1e-4


def test_lm_learns_from_every_text_once(spark, monkeypatch, tmp_path):
    """Each training text is one token of its own, so the tokens of all passes are the training texts."""

    def note(v, c1, c2, w, *rest):
        (tmp_path / str(time.time_ns())).write_text(" ".join(map(str, w.tolist())))

    docs = docs_of(spark, [(i, f"w{i}") for i in range(300)])
    head = {f"w{i}".encode(): i for i in range(300)}
    counts = np.zeros(lm_score.SYMBOLS)
    counts[:300], counts[lm_score.END] = 1, 300
    monkeypatch.setattr(lm_score, "nce_pass", note)
    lm_score.trained(docs, head, counts, 600)
    seen = [int(x) for p in tmp_path.iterdir() for x in p.read_text().split()]
    assert sorted(x for x in seen if x < 300) == list(range(300))


def test_lm_odd_rows(odd, empty):
    out = lm_score.lm_scores(odd).collect()
    assert len(out) == odd.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in out)
    assert lm_score.lm_scores(empty).count() == 0


def test_lm_rare_words_are_joined(spark, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choices(WORDS, k=20)) + f" only{i % 9}") for i in range(40)]
    whole = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in lm_score.lm_scores(docs_of(spark, rows)).collect()}
    monkeypatch.setattr(lm_score, "TOP_WORDS", 4)
    part = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in lm_score.lm_scores(docs_of(spark, rows)).collect()}
    assert {k: v[0] for k, v in whole.items()} == {k: v[0] for k, v in part.items()}
    assert all(abs(whole[k][1] - part[k][1]) < 1e-9 for k in whole)


# fingerprints


def test_fingerprints_follow_the_order(spark, odd, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()]
    rows.sort(reverse=True)
    nxt = [t for _, t in rows[1:] + rows[:1]]
    want = {i: t[: len(t) - len(t) // 3] + n[: len(t) // 3] for (i, t), n in zip(rows, nxt, strict=True)}
    for parts in (1, 3, 7):
        got = fingerprint.fingerprints(docs_of(spark, rows), parts=parts).collect()
        assert {r["doc_id"]: r["edited"] for r in got} == want and len(got) == len(rows)
    by_text = defaultdict(set)
    for r in got:
        by_text[dict(rows)[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint.fingerprints(odd).count() == odd.count() and fingerprint.fingerprints(empty).count() == 0


def test_fingerprint_likeness():
    rnd = random.Random(1)
    a = "".join(rnd.choices("abcdefgh ", k=3000))
    b = "".join(rnd.choices("abcdefgh ", k=3000))
    sa, sb, sc, sd = fingerprint.sketches([a, b, a[:2000] + b[:1000], "shift " + a])
    assert fingerprint.likeness(sa, sa) == 1 and fingerprint.likeness(sa, sb) < 0.05
    assert 0.5 < fingerprint.likeness(sa, sc) < 0.85 and fingerprint.likeness(sa, sd) > 0.9
    assert fingerprint.from_text(fingerprint.as_text(sa)) == sa
    # closed syncmers by definition
    letters = np.array([ord(c) for c in a[:200]], np.uint64)
    at, _ = fingerprint.syncmers(letters, 6, 3)
    inner = fingerprint.windows_hash(letters, 3, fingerprint.FACTOR)
    assert at.tolist() == [i for i in range(195) if min(inner[i : i + 4]) in (inner[i], inner[i + 3])]


# decontamination


def test_decontamination_sees_through_new_figures(spark):
    item = "A train leaves Boston at 3.5 km per hour and then Alice walks to Boston in 20 minutes flat today"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "item_id bigint, text string")
    rows = [
        (1, "Before. A train leaves London at 7 km per hour and then Bob walks to London in 31 minutes flat today after"),
        (2, "A train leaves London at 7 km per hour and then Bob walks to Paris in 31 minutes flat today"),  # one name, two values
        (3, item), (4, None), (5, ""), (6, "nothing of the kind " * 30), (None, item), (3, item),
    ]
    got = decontaminate.contaminated(docs_of(spark, rows), bench).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == [(1, 1), (3, 1), (None, 1)]
    assert decontaminate.contaminated(docs_of(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_finds_every_literal_window(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    index = defaultdict(set)
    for r in bench.collect():
        w = words(r["text"])
        for j in range(len(w) - 9):
            index[tuple(w[j : j + 10])].add(r["item_id"])
    want = {(r["doc_id"], k) for r in docs.collect() for w in [words(r["text"])] for j in range(len(w) - 9) for k in index.get(tuple(w[j : j + 10]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want <= got


def test_decontamination_of_short_items_and_starts(spark):
    items = ["Who discovered penicillin in 1928?", "Who wrote the novel Dracula in 1897?", "What is the boiling point of pure water in kelvin?", "Alice sells seven red apples at the weekly market"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [
        (0, "Notes. Who discovered penicillin in 1928? Done."), (1, "Notes\nWho wrote the novel Dracula in 1897?"), (2, f"Quiz night item {items[2]}"), (3, "Carol sells seven red apples at the weekly market"),
        (4, "Who discovered penicillin in 1929?"), (5, "Who wrote the novel Emma in 1815?"),  # too few literals: word for word only
        (6, "Once Carol sells seven red apples at the weekly market"),
    ]
    got = decontaminate.contaminated(docs_of(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (6, 3)]


# line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def changed(rnd, a, most):
    b = list(a)
    for _ in range(rnd.randint(0, most)):
        i, k = rnd.randrange(len(b) + 1), rnd.random()
        if k < 0.4 and i < len(b):
            b[i] = rnd.choice("abcd")
        elif k < 0.7:
            b.insert(i, rnd.choice("abcd"))
        elif i < len(b):
            del b[i]
    return "".join(b)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance_and_keys(spark, edits):
    rnd = random.Random(edits)
    pairs = []
    for _ in range(250):
        a = "".join(rnd.choices("abcé", k=rnd.randint(0, 16)))
        pairs.append(tuple(sorted((a, changed(rnd, a, edits + 1)), key=len)))
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", line_dedup.within_edits(a, b, edits).alias("w"), line_dedup.near(a, b, edits).alias("n"), *[F.arrays_overlap(line_dedup.index_keys(a, F.length(a), edits + c, c), F.concat(line_dedup.index_keys(b, F.length(b), edits + c, c), line_dedup.probe_keys(b, F.length(b), edits, edits + c, c))).alias(f"k{c}") for c in line_dedup.LEVELS], line_dedup.alike(line_dedup.mask_of(a), line_dedup.mask_of(b), edits).alias("m")).collect()
    for r in rows:
        close = edit_distance(r["a"], r["b"]) <= edits
        assert r["w"] == r["n"] == close
        assert r["m"] or not close
        if close and len(r["a"]) >= edits + 1:
            assert r["k1"]
        if close and len(r["a"]) >= edits + 4:
            assert r["k4"]


def lines_brute(rows, edits, least):
    first, out = {}, {}
    spots = []
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n") if t is not None else []):
            s = line.strip(" \t\r")
            if len(s) >= least:
                spots.append((i, at, s))
                first.setdefault(s, (i, at))
    for i, t in rows:
        gone = set()
        for j, at, s in spots:
            if j == i and (first[s] < (i, at) or any(p < first[s] and abs(len(o) - len(s)) <= edits and edit_distance(o, s) <= edits for o, p in first.items())):
                gone.add(at)
        out[i] = None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone)
    return out


@pytest.mark.parametrize("crowd", [0, 1, 32])
def test_lines(spark, odd, empty, crowd, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rnd = random.Random(2)
    pool = ["".join(rnd.choices("abcdefgh ", k=rnd.randint(8, 20))).strip() + "xyz" for _ in range(12)]
    rows = [(i, "\n".join(changed(rnd, rnd.choice(pool), 1) if rnd.random() < 0.7 else rnd.choice(["", "  ", "a", pool[0] + " "]) for _ in range(rnd.randint(1, 6)))) for i in range(30)] + [(30, None), (31, "")]
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(docs_of(spark, rows), 1, 8).collect()}
    assert got == lines_brute(rows, 1, 8)
    assert line_dedup.dedup_lines(odd, keep=("lang",)).count() == odd.count() and line_dedup.dedup_lines(empty).count() == 0


def test_lines_are_compared_in_letters(spark):
    import duckdb

    line = "éine zeile mit mehr als dreißig buchstaben, größer"
    rows = [(1, line), (2, line.replace("é", "e").replace("ö", "o")), (3, line.replace("é", "x").replace("ö", "o").replace("ß", "s")), (4, None), (5, "kurz\nkurz")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[2] for r in con.execute(line_dedup.SQL).fetchall()}
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs_of(spark, rows), exact_chars=1).collect()}
    assert got == want | {4: 0} and [got[i] for i in (1, 2, 3, 5)] == [0, 1, 0, 1]


def test_short_lines_go_if_equal(spark):
    import corpus_pipeline

    long = "a line of more than thirty letters, to be compared"
    rows = [(1, f"menu\n{long}\n\nx\nend", "en", "s", 0), (2, f"Menu\n menu \n{long}!\n\nx", "en", "s", 0), (3, "menu\nx", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {1: rows[0][1], 2: "Menu\n", 3: ""}
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(docs, exact_chars=1).collect()}
    assert got == want
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, DATA).collect()}
    assert staged == {1: want[1], 2: want[2]}  # a document that keeps no word goes


# BPE


def test_bpe_as_the_library(spark, odd, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.load_vocabulary(path))
    rnd = random.Random(5)
    pool = [chr(c) for c in range(1, 0x250)] + ["<|endoftext|>", "'s", "'RE", "ΑΣ", "İ", "ﬁ", "😀", "한", "é", "  "]
    texts = ["".join(rnd.choices(pool, k=30)) for _ in range(2000)] + [r["text"] or "" for r in odd.collect()]
    for t, y in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, text = ours.encode(t)
        assert ids == y.ids and text == theirs.decode(y.ids, skip_special_tokens=False) == ours.decode(ids)
    assert bpe.bpe_encode_decode(odd, path).count() == odd.count() and bpe.bpe_encode_decode(empty, path).count() == 0


# substring dedup


def windows_brute(rows, n):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = (t or "").encode().split(), set()
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            if k in seen:
                gone.update(range(j, j + n))
            seen.add(k)
        out[i] = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
    return out


@pytest.mark.parametrize("bits", [12, 22])
def test_substring_dedup(spark, odd, empty, bits):
    rnd = random.Random(6)
    parts = [" ".join(rnd.choices(WORDS, k=12)) for _ in range(6)]
    rows = [(i, " ".join([*rnd.choices(WORDS, k=rnd.randint(0, 9)), *rnd.choices(parts, k=rnd.randint(0, 3))])) for i in range(40)] + [(40, None), (41, "")]
    rows += [(42, rows[3][1]), (43, rows[3][1])]
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(docs_of(spark, rows), 8, bits).collect()}
    assert got == windows_brute(rows, 8)
    assert substring_dedup.remove_repeats(odd, 20, bits).count() == odd.count() and substring_dedup.remove_repeats(empty, 20, bits).count() == 0


# sharding


@pytest.mark.parametrize("law", ["rows", "key"])
def test_shards(spark, odd, empty, law):
    rows = sharding.consistent_shards(odd.unionByName(odd), 4, law).collect()
    assert len(rows) == 2 * odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    if law == "rows":
        assert len(by) == 4 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
        assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    assert sharding.consistent_shards(empty, 4, law).count() == 0


# chat formatting


def cheapest(roles):
    best = {0: 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for t in (1, 2, 3):
                change = c + (chat_format.RELABEL if chat_format.STATES[t] != role else 0)
                ways = [change + chat_format.MERGE] * (s == t) + [change] * (t in chat_format.LEGAL[s]) + [change + chat_format.INSERT for a in chat_format.LEGAL[s] if t in chat_format.LEGAL[a]]
                for w in ways:
                    new[t] = min(new.get(t, w), w)
        best = new
    return min(c + chat_format.final_cost(s)[0] for s, c in best.items())


def test_chats_are_legal_and_cheapest(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 4)
    rnd, rows = random.Random(7), []
    for c in range(30):
        for t in range(rnd.choice([1, 2, 5, 30])):
            rows.append((c, t, rnd.choice(["user", "assistant", "system", "User ", None, "tool"]), f"t{t}"))
    rows += [(None, None, None, None), (None, None, "user", ""), (77, 5, "user", "a"), (77, 5, "user", "a")]
    out = chat_format.repair_and_render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(out) == len(rows)
    convs = defaultdict(list)
    for r in out:
        convs[r["conv_id"]].append(r)
    for turns in convs.values():
        turns.sort(key=lambda r: r["place"])
        assert [r["place"] for r in turns] == list(range(len(turns)))
        text = "".join(r["piece"] for r in turns)
        made = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in made) == text
        state = 0
        for role, _ in made:
            assert chat_format.STATES.index(role) in chat_format.LEGAL[state]
            state = chat_format.STATES.index(role)
        assert state == 3
        known = [r["role"].lower().strip() if r["role"] and r["role"].lower().strip() in chat_format.ROLES else None for r in turns]
        assert {r["cost"] for r in turns} == {cheapest(known)}
    assert chat_format.repair_and_render(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in cp.STAGES][:1] == ["toxicity"] and len(cp.STAGES) == 5
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = cp.written(stage(spark, before, DATA), "test")
        assert tuple(after.columns) == cp.COLUMNS, name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            assert {r["doc_id"] for r in after.collect()} == set(jaccard_brute(rows, 5, 80).values())
        before = after
    last = cp.STAGES[-1][1](spark, before, DATA)
    assert last.count() == before.count() > 0.5 * docs.count()


def test_pipeline_keeps_texts_that_share_an_id(spark):
    import corpus_pipeline as cp

    rnd = random.Random(4)
    a, b, c = (" ".join(rnd.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (3, c), (None, c), (None, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in cp.drop_near_copies(spark, docs, DATA).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (None, c), (None, None), (4, None), (4, "")], key=str)


def test_pipeline_handles_empty_and_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (empty, odd):
        now = rows
        for _, stage in cp.STAGES:
            now = cp.written(stage(spark, now, str(tmp_path)), "test")
        assert (now.count() > 0) == (rows is odd)


def test_digests_of_queries(spark):
    row = spark.createDataFrame([([3, 14, 15],)], "ids array<int>").select(bpe.ids_digest(F.col("ids")).alias("d")).first()
    assert row["d"] == hashlib.sha256(b"3 14 15").hexdigest()
