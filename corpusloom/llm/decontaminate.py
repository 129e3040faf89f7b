"""Benchmark decontamination by templates, in DataFrame operations.

Numbers, names and units of measure become typed placeholders, so that a question whose figures or people were changed keeps its
template. Windows of template words are hashed and joined with those of the benchmark; then the slots are compared: along one
alignment, each value of the benchmark must stand for one and the same value in the document.

There are three forms, each compared with itself only. PLAIN: the words as they are, so every literal window is found, and every
item as a whole if it is shorter than a window, however short. NAMED: a name is a capitalised word that no end of a sentence
stands before. CAPITALS: every capitalised word is a name, so what stands before an item does not matter; words at starts
of sentences that agree count as literals. The two templates need LEAST_WORDS and LITERALS.

Texts are first looked through for anchors, which need no marks and so one plain split of the text: runs of tokens (letters and
digits) in a window of the benchmark that a text with this window must hold, as no placeholder is among them. Only texts with an
anchor are parsed and have their windows built.

The index of the benchmark is broadcast only up to INDEX_ROWS windows (its rows are counted), and joined by shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import written

WINDOW = 10
#: Words of a window that must not be placeholders.
LITERALS = 6
#: Items of fewer words are matched word for word only; those shorter than a window are matched whole.
LEAST_WORDS = 7
#: Tokens of an anchor, fewer in windows without so many in a row.
ANCHOR = 4
INDEX_ROWS = 500_000
DOC_KEYS = 200_000
#: START marks a capitalised word that is no name by what stands before it.
NAME, NUMBER, UNIT, START = "§", "№", "¤", "¶"
MARKS = NAME + NUMBER + UNIT + START
PLAIN, NAMED, CAPITALS = 0, 1, 2
#: Form of tokens, which have no marks.
TOKENS = 3
RUNS = tuple(range(1, ANCHOR + 1))
UNITS = "kilograms?|kilometers?|kilometres?|meters?|metres?|centimeters?|liters?|litres?|hours?|minutes?|seconds?|days?|weeks?|years?|miles?|pounds?|dollars?|euros?|cents?|percent|kg|km|cm|mm|mg|ml|mph|ft|lb|oz|kwh|ghz|mhz"


def words_of(text: Column) -> Column:
    """Words in lower case, with a mark before each name, number, unit after a number, and other capitalised word.

    A name is a capitalised word that no end of a sentence stands before. Points and commas between digits stay in a number.
    """
    clean = F.translate(text, MARKS, " " * len(MARKS))
    named = F.regexp_replace(clean, r"(?<=[^.!?:\s]\s)(\p{Lu}\p{Ll}+)", f"{NAME}$1")
    counted = F.regexp_replace(named, r"(?<![\p{L}\p{N}])(\p{N}+(?:[.,:/]\p{N}+)*)", f"{NUMBER}$1")
    counted = F.regexp_replace(counted, rf"(?i)({NUMBER}\S+\s)({UNITS})(?!\p{{L}})", f"$1{UNIT}$2")
    marked = F.when(clean.rlike(r"\p{N}"), counted).otherwise(named)
    marked = F.regexp_replace(marked, rf"(?<![\p{{L}}\p{{N}}{MARKS}])(\p{{Lu}}\p{{Ll}}+)", f"{START}$1")
    return F.filter(F.split(F.lower(marked), rf"(?:(?![.,:/]\p{{N}})[^\p{{L}}\p{{N}}{MARKS}])+"), lambda w: w != "")


def plain(word: Column) -> Column:
    return F.translate(word, MARKS, "")


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits in lower case, perhaps with an empty one at either end.

    Those of a text are those of its words_of() in a row, since marks stand before tokens only. Which small sigma lower() writes
    depends on what follows, a mark included, so the two are one here.
    """
    return F.split(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), r"[^\p{L}\p{N}]+")


def is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NAME, NUMBER, UNIT)


def form_hashes(words: Column, form: int) -> Column:
    """Hash of each word in the form."""
    if form == TOKENS:
        return F.transform(words, lambda w: F.xxhash64(w))
    if form == PLAIN:
        return F.transform(words, lambda w: F.xxhash64(plain(w)))

    def placeholder(w: Column) -> Column:
        name = w.startswith(NAME) | w.startswith(START) if form == CAPITALS else w.startswith(NAME)
        return F.when(name, NAME).when(w.startswith(NUMBER), NUMBER).when(w.startswith(UNIT), UNIT).otherwise(w if form == CAPITALS else F.translate(w, START, ""))

    return F.transform(words, lambda w: F.xxhash64(placeholder(w)))


def with_windows(rows: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """rows (with words) and a column windows: for each kind (size, form) the hashes of all windows of size words in the form, in order.

    Hashes of runs of 1, 2, 4, ... words come from two of half the length, each in a projection of its own, so that each list is
    built once for all sizes; a window is put together from the runs that its size is made of.
    """
    forms, n = sorted({form for _, form in kinds}), F.size("words")
    out = rows.select("*", *(form_hashes(F.col("words"), form).alias(f"run1_{form}") for form in forms))
    run = 1
    while 2 * run <= max((size for size, _ in kinds), default=0):
        out = out.select("*", *(followed_by(F.col(f"run{run}_{form}"), F.col(f"run{run}_{form}"), run).alias(f"run{2 * run}_{form}") for form in forms))
        run *= 2

    def list_of(size: int, form: int) -> Column:
        whole, done = None, 0
        for k in range(run.bit_length() - 1, -1, -1):
            if size >> k & 1:
                part = F.col(f"run{1 << k}_{form}")
                whole, done = part if whole is None else followed_by(whole, part, done), done + (1 << k)
        return F.slice(whole, F.lit(1), F.greatest(n - size + 1, F.lit(0)))

    lists = [list_of(size, form) for size, form in kinds] or [F.array().cast("array<bigint>")]
    return out.select(*rows.columns, F.array(*lists).alias("windows"))


def followed_by(runs: Column, others: Column, after: int) -> Column:
    """Hashes of each run and the other one that starts `after` words later; those near the end, which have none, mean nothing."""
    return F.zip_with(runs, F.slice(others, F.lit(after + 1), F.greatest(F.size(others) - after, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def index_of(items: DataFrame, window: int) -> DataFrame:
    """(kind, hash, item_id, i_at, size, form, anchors) of all windows of the benchmark word for word, and as templates of those with enough words that are no placeholders.

    kind numbers the pairs of size and form that occur. Sizes are those of the window and of shorter items, so they are few. anchors
    are runs of tokens, one of which is in every text that holds the window.
    """
    n = F.size("words")
    items = items.where(n > 0).withColumn("size", F.least(n, F.lit(window)))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # `window` rows at most
    kinds = [(size, form) for size in sizes for form in (PLAIN, NAMED, CAPITALS)]
    rows = [(i, size, form) for i, (size, form) in enumerate(kinds)]
    named = items.sparkSession.createDataFrame(rows, "kind int, kind_size int, form int")
    both = with_windows(items, kinds).select("item_id", "words", "size", "windows")
    each = both.select("item_id", "words", "size", F.posexplode("windows").alias("kind", "hashes")).join(F.broadcast(named), "kind").where("size = kind_size")
    at = each.select("kind", "item_id", "words", "size", "form", F.posexplode("hashes").alias("place", "hash")).withColumn("i_at", F.col("place") + 1)
    own = F.slice("words", F.col("i_at"), F.col("size"))
    literal = F.size(F.filter(own, lambda w: ~is_slot(w)))
    enough = (n >= LEAST_WORDS) & (literal >= F.least(F.lit(LITERALS), F.col("size")))
    at = at.where((F.col("form") == PLAIN) | enough).withColumn("own", own)
    return with_own_anchors(at).select("kind", "hash", "item_id", "i_at", "size", "form", "anchors")


def with_own_anchors(windows: DataFrame) -> DataFrame:
    """windows (own: its words, size, form) and a column anchors, structs (run, hash): its longest run of tokens of words that are literals in the form, of ANCHOR tokens at most.

    A window in CAPITALS may have nothing but starts of sentences beside its slots. Of those, as many as LITERALS have to agree, so two
    neighbours do if these are enough: its anchors are all pairs of tokens then, or all tokens.
    """

    def unbroken(kept: Callable[[Column], Column]) -> Column:
        """Tokens of the words that are kept, with an empty one for any other word."""
        tokens = lambda w: F.filter(tokens_of(plain(w)), lambda t: t != "")
        return F.flatten(F.transform("own", lambda w: F.when((F.col("form") == PLAIN) | kept(w), tokens(w)).otherwise(F.array(F.lit("")))))

    def runs(rows: DataFrame, name: str) -> DataFrame:
        """rows (with words) and a column of that name: structs (run, n_chars, hash) of all runs of words none of which is empty."""
        hashed = with_windows(rows, [(run, TOKENS) for run in RUNS])

        def of(k: int, run: int) -> Column:
            def one(h: Column, i: Column) -> Column:
                inside = F.slice("words", i + 1, run)
                return F.when(~F.array_contains(inside, ""), F.struct(F.lit(run).alias("run"), F.length(F.array_join(inside, "")).alias("n_chars"), h.alias("hash")))

            return F.transform(F.get("windows", k), one)

        parts = [of(k, run) for k, run in enumerate(RUNS)]
        return hashed.select(*(c for c in rows.columns if c != "words"), F.filter(F.concat(*parts), lambda x: x.isNotNull()).alias(name))

    out = runs(windows.drop("words").withColumn("words", unbroken(lambda w: ~is_slot(w) & ((F.col("form") != CAPITALS) | ~w.startswith(START)))), "sure")
    out = runs(out.withColumn("words", unbroken(lambda w: ~is_slot(w))), "perhaps")
    least = F.when(2 * F.least(F.lit(LITERALS), F.col("size")) > F.col("size") + 1, 2).otherwise(1)
    any_of = F.transform(F.filter("perhaps", lambda x: x["run"] == least), lambda x: x.dropFields("n_chars"))
    return out.withColumn("anchors", F.when(F.size("sure") > 0, F.array(F.array_max("sure").dropFields("n_chars"))).otherwise(any_of))


def with_anchors(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, tie) of the docs (doc_id, tie, text) that hold an anchor of the index."""
    anchors = written(index.select(F.inline("anchors")).distinct(), "anchors")
    runs = [r["run"] for r in anchors.select("run").distinct().orderBy("run").collect()]  # as many rows as RUNS
    anchors = anchors.select("hash").distinct()
    if anchors.count() <= INDEX_ROWS:
        anchors = F.broadcast(anchors)
    parsed = with_windows(docs.select("doc_id", "tie", tokens_of(F.col("text")).alias("words")), [(run, TOKENS) for run in runs])
    at = parsed.select("doc_id", "tie", F.explode_outer("windows").alias("hashes")).select("doc_id", "tie", F.explode_outer("hashes").alias("hash"))
    return at.join(anchors, "hash", "left_semi").select("doc_id", "tie").distinct()


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The docs of the keys (doc_id, tie), which are broadcast up to DOC_KEYS of them."""
    keys = keys.select(F.col("doc_id").alias("k_id"), F.col("tie").alias("k_tie"))
    if keys.count() <= DOC_KEYS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie")), "left_semi")


def contaminated(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, tie, item_id, n_windows, n_slots) of documents that hold a benchmark item's words, figures and names aside.

    tie is the hash of the document's text: rows that repeat id and text count as one document, a null id is an id like any
    other. Null and empty texts and items match nothing, nor does anything in or with an empty table; a very long text is parsed
    whole, in one row. Of several alignments and forms of a pair the one with most windows is
    reported; a pair none of whose alignments has consistent slots is left out.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text).cast("string")).alias("words")).where("words is not null")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("tie", F.xxhash64("text"))
    index = written(index_of(items, window), "index")
    kinds = [(r["size"], r["form"]) for r in index.select("kind", "size", "form").distinct().orderBy("kind").collect()]  # as many rows as sizes and forms
    numbers = [r["kind"] for r in index.select("kind").distinct().orderBy("kind").collect()]
    windows = index.select("kind", "hash", "item_id", "i_at", "size", "form")
    own = F.broadcast(windows) if index.count() <= INDEX_ROWS else windows
    # outer explodes, since a plain one adds a filter that parses every text once more
    parsed = with_windows(texts_of(docs, written(with_anchors(docs, index), "candidates")).select("doc_id", "tie", words_of(F.col("text")).alias("words")), kinds)
    at = parsed.select("doc_id", "tie", F.posexplode_outer("windows").alias("list", "hashes")).select("doc_id", "tie", F.get(F.lit(numbers or [0]), F.col("list")).alias("kind"), F.posexplode_outer("hashes").alias("d_at", "hash"))
    hits = at.join(own, ["hash", "kind"]).select("doc_id", "tie", "item_id", (F.col("d_at") + 1).alias("d_at"), "i_at", "size", "form")
    hits = written(hits.distinct(), "hits")

    # the slots: only texts with a hit are looked at again
    texts = texts_of(docs, hits.select("doc_id", "tie").distinct()).distinct()
    texts = texts.select(F.col("doc_id").alias("t_id"), F.col("tie").alias("t_tie"), words_of(F.col("text")).alias("d_words"))
    own_items = items.select(F.col("item_id").alias("own_id"), "words").distinct()
    aligned = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("tie") == F.col("t_tie"))).join(own_items, F.col("item_id").eqNullSafe(F.col("own_id")))
    both = F.zip_with(F.slice("d_words", F.col("d_at"), F.col("size")), F.slice("words", F.col("i_at"), F.col("size")), lambda d, i: F.struct(plain(d).alias("d"), plain(i).alias("i"), F.substring(i, 1, 1).alias("mark")))
    aligned = aligned.select("doc_id", "tie", "item_id", "form", (F.col("d_at") - F.col("i_at")).alias("shift"), "d_at", "size", both.alias("both"))
    # at a start of a sentence, a word counts if it is the same
    literal = F.size(F.filter("both", lambda p: ~p["mark"].isin(NAME, NUMBER, UNIT) & ((p["mark"] != START) | (p["d"] == p["i"]))))
    aligned = aligned.where((F.col("form") != CAPITALS) | (literal >= F.least(F.lit(LITERALS), F.col("size"))))
    pairs = F.filter("both", lambda p: p["mark"].isin(NAME, NUMBER, UNIT) | ((F.col("form") == CAPITALS) & (p["mark"] == START)))
    aligned = written(aligned.select("doc_id", "tie", "item_id", "form", "shift", "d_at", pairs.alias("pairs")), "aligned")
    along = ("doc_id", "tie", "item_id", "form", "shift")
    slots = aligned.select(*along, F.explode("pairs").alias("p")).groupBy(*along, "p.i").agg(F.countDistinct("p.d").alias("values"))
    slots = slots.groupBy(*along).agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(F.col("values") > 1).alias("odd"))
    whole = aligned.groupBy(*along).agg(F.countDistinct("d_at").alias("n_windows"))
    slots = slots.select(*(F.col(c).alias(f"s_{c}") for c in along), "n_slots", "odd")
    same = (F.col("tie") == F.col("s_tie")) & (F.col("form") == F.col("s_form")) & (F.col("shift") == F.col("s_shift"))
    fair = whole.join(slots, F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & F.col("item_id").eqNullSafe(F.col("s_item_id")) & same, "left").where("odd is null or odd = 0")
    best = fair.groupBy("doc_id", "tie", "item_id").agg(F.max(F.struct("n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))).alias("best"))
    return best.select("doc_id", "tie", "item_id", "best.n_windows", "best.n_slots")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tie")


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE_SQL: dict[str, str] = {}
