"""Whole results of operators against plain loops: contaminated pairs, places on the ring, likeness of fingerprints."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate as D
from corpusloom.llm import fingerprint, line_dedup, sharding, toxicity

COMMON = "the of a train walks from market to river and sells red apples every day near old bridge".split()
NAMES = ["Alice", "Bob", "Carol", "Boston", "Paris"]


def sentence(rnd, n):
    """Words with names, figures, units after figures and ends of sentences."""
    out = []
    while len(out) < n:
        x = rnd.random()
        if x < 0.12:
            out.append(rnd.choice(NAMES))
        elif x < 0.2:
            out += [str(rnd.randrange(1, 30)), rnd.choice(["km", "minutes", "of"])]
        else:
            out.append(rnd.choice(COMMON) + (". The" if rnd.random() < 0.05 else ""))
    return " ".join(out)


def altered(rnd, text):
    """The same with other names and figures, each value for one and the same or (now and then) not."""
    swap = {n: rnd.choice(NAMES) for n in NAMES}
    return " ".join(swap.get(w, w) if rnd.random() < 0.97 else rnd.choice(NAMES) if w in swap else w for w in text.split(" "))


def in_form(word, form):
    if form == D.PLAIN:
        return "".join(c for c in word if c not in D.MARKS)
    name = word[0] in (D.NAME + D.START if form == D.CAPITALS else D.NAME)
    return D.NAME if name else word[0] if word[0] in D.NUMBER + D.UNIT else word if form == D.CAPITALS else word.replace(D.START, "")


def pair_by_loops(doc, item, window):
    """(n_windows, n_slots) of the best fair alignment of two lists of marked words, or nothing."""
    size, bare = min(len(item), window), lambda w: in_form(w, D.PLAIN)
    found = defaultdict(list)
    for form in (D.PLAIN, D.NAMED, D.CAPITALS):
        d_form, i_form = [in_form(w, form) for w in doc], [in_form(w, form) for w in item]
        for i in range(len(item) - size + 1):
            slots = [w[0] in D.NAME + D.NUMBER + D.UNIT for w in item[i : i + size]]
            if form != D.PLAIN and (len(item) < D.LEAST_WORDS or size - sum(slots) < min(D.LITERALS, size)):
                continue
            for d in range(len(doc) - size + 1):
                if d_form[d : d + size] != i_form[i : i + size]:
                    continue
                both = list(zip(doc[d : d + size], item[i : i + size], slots, strict=True))
                same = sum(not s and (w[0] != D.START or bare(v) == bare(w)) for v, w, s in both)
                if form == D.CAPITALS and same < min(D.LITERALS, size):
                    continue
                found[form, d - i].append((d, {(bare(w), bare(v)) for v, w, s in both if s or (form == D.CAPITALS and w[0] == D.START)}))
    fair = []
    for hits in found.values():
        pairs = set().union(*(p for _, p in hits))
        if len({i for i, _ in pairs}) == len(pairs):
            fair.append((len({d for d, _ in hits}), len(pairs)))
    return max(fair, default=None)


def test_decontamination_finds_nothing_else(spark):
    rnd = random.Random(4)
    items = [sentence(rnd, rnd.choice([1, 3, 6, 8, 12, 20])) for _ in range(14)] + ["", None]
    texts = [sentence(rnd, rnd.choice([4, 30, 60])) for _ in range(12)]
    for item in [x for x in items if x]:
        texts += [f"{sentence(rnd, 12)} {x} {sentence(rnd, 9)}" for x in (item, altered(rnd, item), altered(rnd, item))]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"]) for r in D.contaminated(docs, bench).collect()}
    parsed = lambda df, key: {r[0]: r[1] for r in df.where("text is not null").select(key, D.words_of(F.col("text"))).collect()}
    own, wanted = parsed(docs, "doc_id"), parsed(bench, "item_id")
    want = {(d, i): p for d, x in own.items() for i, y in wanted.items() if y and (p := pair_by_loops(x, y, D.WINDOW))}
    assert got == want and len(want) > 30


def test_tokens_follow_words_whatever_the_marks(spark):
    """Tokens of a text are those of its words in a row, so a text that holds words holds their tokens."""
    rnd = random.Random(7)
    pieces = [*"aZéßΣσςİ§№¤¶.,:/-!? \n\t_'5٣½", "Foo", "BAR", "ΟΔΟΣ", "3.5", "1,000", "12:30", "km", " 5 km ", ". The ", "x9.Y", "e\u0301", "ꟲ", "𝐀𝐛", "Ǆa", "中文"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 40))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    flat = F.flatten(F.transform(D.words_of(F.col("text")), lambda w: D.tokens_of(D.plain(w))))
    some = lambda c: F.filter(c, lambda t: t != "")
    assert rows.where(some(flat) != some(D.tokens_of(F.col("text")))).collect() == []


def test_decontamination_anchors_of_odd_windows(spark):
    """Windows of starts of sentences only, of one letter, of figures, and of words that end in a sigma before a mark."""
    items = ["Red. Green. Blue. White. Black. Pink. Brown. Grey. Gold. Teal.", "Σ", "1 2.5 3,000 4 5 6 7 8 9 10", "ΟΔΟΣ.Red and seven more old words that stand here"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [
        "Say. Red. Green. Xa. Xb. Black. Pink. Xc. Grey. Gold. Xd. End", "Red. Xa. Blue. Xb. Black. Xc. Brown. Xd. Gold. Teal.", "Red. Xa. Blue. Xb. Black. Xc. Brown. Xd. Gold. Xe.", "a ς b", "so 1 2.5 3,000 4 5 6 7 8 9 10 so", "ΟΔΟΣ.Red and seven more old words that stand here", "οδοσ.red and seven more old words that stand here",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"]) for r in D.contaminated(docs, bench).collect()}
    parsed = lambda df, key: {r[0]: r[1] for r in df.select(key, D.words_of(F.col("text"))).collect()}
    own, wanted = parsed(docs, "doc_id"), parsed(bench, "item_id")
    assert got == {(d, i): p for d, x in own.items() for i, y in wanted.items() if (p := pair_by_loops(x, y, D.WINDOW))}
    assert {(0, 0), (1, 0), (4, 2)} <= set(got) and (2, 0) not in got


def test_decontamination_parses_only_texts_with_tokens_in_a_row(spark):
    """A text that shares the pattern of placeholders of a window but no literals in a row is left out before it is parsed."""
    docs = spark.createDataFrame([(0, "so 4 km 5 km 6 km so"), (1, "the old 4 km 5 km 6 km red mill stands by a river bank")], "doc_id bigint, text string").withColumn("tie", F.lit(0).cast("bigint"))
    items = spark.createDataFrame([(0, "the old 1 km 2 km red mill stands by a river bank")], "item_id bigint, text string").select("item_id", D.words_of(F.col("text")).alias("words"))
    index = D.index_of(items, D.WINDOW).where(F.col("form") != D.PLAIN)
    assert [r["doc_id"] for r in D.with_anchors(docs, index).collect()] == [1]
    assert all(len(r["anchors"]) == 1 and r["anchors"][0]["run"] == D.ANCHOR for r in index.collect())



@pytest.mark.parametrize("law", ["rows", "key"])
def test_every_row_is_where_a_walk_on_the_ring_ends(spark, law):
    rnd, shards = random.Random(2), 5
    data = [(i % 350 if i % 50 else None, "x" * rnd.randrange(9) if i % 7 else None) for i in range(700)] + [(3, "same")] * 60
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    text = F.coalesce("text", F.lit(""))
    thin = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = ["doc_id"] if law == "key" else ["doc_id", "size", "text_crc32"]
    rows = thin.withColumn("hash", F.xxhash64(*keys)).withColumn("slice", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(sharding.SLICES))).collect()
    rows.sort(key=lambda r: (r["slice"], r["hash"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]))

    def nodes(n):
        place = lambda s, v: int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:6], "big") % sharding.SLICES
        return sorted((place(s, v), s) for s in range(n) for v in range(sharding.VNODES))

    def walk(n, at):
        around = nodes(n)
        return [s for q, s in around if q >= at] + [s for q, s in around if q < at]

    room = [len(rows) // shards + (s < len(rows) % shards) if law == "rows" else len(rows) for s in range(shards)]
    used, want = [0] * shards, []
    for r in rows:
        shard = next(s for s in walk(shards, r["slice"]) if used[s] < room[s])
        want.append((r["doc_id"], r["size"], r["text_crc32"], shard, used[shard], walk(shards + 1, r["slice"])[0] if law == "key" else None))
        used[shard] += 1
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["grown_shard"]) for r in sharding.consistent_shards(docs, shards, law).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    by_key = sharding.consistent_shards(docs, 8, "key")
    assert 0.06 < by_key.where("shard <> grown_shard").count() / 6000 < 0.17  # a ninth would be 0.11
    before, after = (sharding.consistent_shards(docs, n, "rows").select("doc_id", F.col("shard").alias(f"s{n}")) for n in (8, 9))
    moved = before.join(after, "doc_id").where("s8 <> s9").count() / 6000
    print("moved under rows:", moved)
    assert moved < 0.4  # at least a ninth has to


def like_by_loops(a, b):
    kind = 1 if a[1] and b[1] else 0
    if not a[kind] or not b[kind]:
        return float(a == b == ([], []))
    p, q = dict(a[kind]), dict(b[kind])
    union = sorted({*p, *q})
    if len(p) == fingerprint.KEPT or len(q) == fingerprint.KEPT:
        union = union[: fingerprint.KEPT]
    shifts = [p[h] - q[h] for h in union if h in p and h in q]
    best = max((sum(s <= x < s + fingerprint.SLACK for x in shifts) for s in shifts), default=0)
    return 2 * (best / len(union)) / (1 + best / len(union))


def test_likeness_of_rows_by_loops(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choices("abcde ", k=k)) for k in (1500, 400, 90, 63, 40, 5, 3, 0)]
    texts = [t for b in base for t in (b, b[: len(b) // 2] + "Zz" + b[len(b) // 2 :], b[7:])]
    rows = sorted(enumerate(texts), reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), parts=3).collect()}
    mark = {i: fingerprint.from_text(r["fingerprint"]) for i, r in got.items()}
    assert len(got) == len(rows)
    for (i, _), (j, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        assert got[i]["near_next"] == pytest.approx(like_by_loops(mark[i], mark[j]))
        assert got[i]["near_edited"] == pytest.approx(like_by_loops(mark[i], fingerprint.from_text(got[i]["edited_fingerprint"])))


def text_logit(net, words):
    """The highest logit of a text's windows, one window and one word at a time."""
    p, out, n = net.p, [], len(words)
    starts = [0] if n <= toxicity.WINDOW else [*range(0, n - toxicity.WINDOW, toxicity.STRIDE), n - toxicity.WINDOW]
    gates, size = 2 * toxicity.HIDDEN, 3 * toxicity.HIDDEN
    for start in starts:
        rows = []
        for w in words[start : start + toxicity.WINDOW]:
            w = toxicity.core(w)
            runs, _ = toxicity.runs_of_block([w])
            x = np.concatenate([p["word"][net.words.get(w, len(net.words))], p["char"][runs].sum(axis=0) / np.sqrt(len(runs))])
            rows.append(x @ p["wx"] + p["bx"])
        states = []
        for way, u in ((0, p["uf"]), (1, p["ub"])):
            h, seen = np.zeros(toxicity.HIDDEN), []
            for row in rows if way == 0 else rows[::-1]:
                x = row[way * size : (way + 1) * size]
                z, r = np.split(1 / (1 + np.exp(-(x[:gates] + h @ u[:, :gates]))), 2)
                h = h + z * (np.tanh(x[gates:] + (r * h) @ u[:, gates:]) - h)
                seen.append(h)
            states.append(seen if way == 0 else seen[::-1])
        if not rows:
            out.append(float(p["bo"][0]))
            continue
        s = np.array([np.concatenate(x) for x in zip(*states, strict=True)])
        a = np.exp(np.tanh(s @ p["wa"] + p["ba"]) @ p["va"])
        out.append(float((a / a.sum()) @ s @ p["wo"] + p["bo"][0]))
    return max(out)


@pytest.mark.parametrize("block", [1, 3, 1 << 13])
def test_scores_are_the_highest_of_all_windows(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rnd, rng = random.Random(6), np.random.default_rng(6)
    words = {w.encode(): i for i, w in enumerate(COMMON)}
    net = toxicity.Net.start(words, rng.normal(0, 1, len(words)).astype(np.float32), rng.normal(0, 0.5, toxicity.BUCKETS).astype(np.float32))
    texts = [sentence(rnd, n) for n in (1, 5, 31, 32, 33, 48, 49, 200)] + ["", None, "?!", "A" * 3000]
    got = toxicity.score_texts(net, texts)
    want = [1 / (1 + np.exp(-text_logit(net, (t or "").encode().split()))) for t in texts]
    assert got == pytest.approx(want, abs=1e-5) and np.ptp(got) > 0.01


def test_no_labels_and_one_label():
    for texts, marks in (([], []), (["a b", None], [1, 1]), (["", ""], [0, 1])):
        net = toxicity.fit(texts, np.array(marks, np.int64))
        assert len(set(toxicity.score_texts(net, ["", "x y", None]).tolist())) == 1


# lines of a crowd


def within_two(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1] <= 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crowded_lines_go_as_loops_say(spark, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("ab", k=rnd.choice([0, 4, 6, 12]))) for _ in range(3)]
    lines = set()
    for _ in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            x, way = rnd.randrange(len(w) + 1), rnd.randrange(3)
            if way == 0:
                w.insert(x, rnd.choice("abc"))
            elif x < len(w):
                w[x : x + 1] = [] if way == 1 else [rnd.choice("abc")]
        lines.add("".join(w))
    lines = sorted(lines, key=lambda _: rnd.random())
    df = spark.createDataFrame(list(enumerate(lines)), "h1 bigint, line string").selectExpr("h1", "line", "struct(h1 AS doc_id) AS first")
    want = {i for i, x in enumerate(lines) if any(within_two(x, y) for y in lines[:i])}
    assert {r["h1"] for r in line_dedup.crowded_repeats(df).collect()} == want and 0 < len(want) < len(lines)


def test_rows_of_one_template(spark):
    lines = [f"row {i} of a table that is here twice {i * 7919}" for i in range(400)]
    text = "\n".join(lines)
    old = line_dedup.SECOND_CROWD
    line_dedup.SECOND_CROWD = 40  # so that few lines are a crowd
    try:
        got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string"), exact_chars=1).orderBy("doc_id").collect()
    finally:
        line_dedup.SECOND_CROWD = old
    kept = [x for i, x in enumerate(lines) if not any(within_two(x, y) for y in lines[:i])]
    assert got[0]["kept"].split("\n") == kept and got[1]["n_removed"] == 400 and got[1]["kept"] == ""


def test_op6_keys_of_several_segments(spark):
    """The keys made from a table of numbers are those of the single expressions, and their plan is small."""
    from corpusloom.llm import line_dedup as D

    df = spark.createDataFrame([("".join(chr(97 + (i * k) % 26) for i in range(20 + k)) + "äß€"[: k % 4],) for k in range(30)], "line string").withColumn("length", F.length("line"))
    line, length = F.col("line"), F.col("length")
    for own, single in ((True, D.index_keys(line, length, 6, 4)), (False, D.probe_keys(line, length, 2, 6, 4))):
        pieces, table = D.pieces_of(line, length, 2, 6, 4, own)
        made = df.select("line", "length", pieces.alias("pieces")).select("line", D.keys_of_pieces(length, F.col("pieces"), table, 4).alias("keys"))
        assert {r["line"]: r["keys"] for r in made.collect()} == {r["line"]: r["keys"] for r in df.select("line", single.alias("keys")).collect()}
    whole = len(df.select(single)._jdf.queryExecution().optimizedPlan().toJSON())
    assert 2 * len(made._jdf.queryExecution().optimizedPlan().toJSON()) < whole
