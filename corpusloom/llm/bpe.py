"""BPE encoding and decoding with a public vocabulary.

A word's symbols form a doubly linked list; a priority queue holds the ranks of mergeable neighbours. Popped entries whose
symbols have since changed are stale and skipped. Decoding joins the vocabulary strings as the library does without a decoder.
Words (runs without ASCII white space) are encoded once per worker and then looked up: no step of normalising, splitting or
merging reaches across ASCII white space.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import kept, slices, small_batches

#: Code points that newer Unicode versions made letters or numbers, and that the library still takes for symbols.
NEWER_LETTERS = [(0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F)]
#: Lower case of capital letters newer than this Python's tables: (first, last, first of the lower case).
NEWER_CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
#: Most words, and most pieces of words, that a worker remembers.
REMEMBERED = 600_000
#: A word longer than this is encoded anew each time.
LONGEST_REMEMBERED = 128


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def load_vocabulary(path: str) -> dict:
    """The parts of a tokenizers file that encoding needs; read on the driver only."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"vocab": model["vocab"], "merges": merges, "suffix": model.get("end_of_word_suffix") or "", "pattern": pattern, "special": special}


#: Links of short words, copied for each.
BEFORE, AFTER = list(range(-1, 63)), list(range(1, 65))


def packed(ids: list[int]) -> bytes:
    """Ids, of which there are fewer than 65536, as two bytes each: a list would hold an object for every one of millions."""
    return array("H", ids).tobytes()


class Encoder:
    def __init__(self, spec: dict, remembered: int = REMEMBERED):
        self.remembered = remembered
        vocab = spec["vocab"]
        self.suffix, self.special = spec["suffix"], spec["special"]
        letters = byte_letters()
        self.inner, self.last = [vocab.get(x) for x in letters], [vocab.get(x + self.suffix) for x in letters]
        self.string = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        if max(self.string) >= 1 << 16:
            raise ValueError("ids of two bytes only")
        self.merges = {vocab[a] << 16 | vocab[b]: rank << 16 | vocab[a + b] for rank, (a, b) in enumerate(spec["merges"])}
        self.pieces = regex.compile(spec["pattern"], regex.V0)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = {c: 0x378 for a, b in NEWER_LETTERS for c in range(a, b + 1)}
        self.capitals = {a + i: c + i for a, b, c in NEWER_CAPITALS for i in range(b - a + 1)} | {0x3A3: 0x3C3}
        # the same pattern for ASCII, where the classes are plain
        self.ascii_pieces = re.compile(spec["pattern"].replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.known_pieces: dict[str, tuple[list[int], str]] = {}
        self.words: dict[bytes, tuple[bytes, str]] = {}
        self.again: set[bytes] = set()

    def merged(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals. A queue entry is rank, merged id and place in one integer."""
        n = len(ids)
        shift, get = n.bit_length(), self.merges.get
        place = (1 << shift) - 1
        queue = [m << shift | i for i in range(n - 1) if (m := get(ids[i] << 16 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        if n < len(BEFORE):
            prev, nxt = BEFORE[:n], AFTER[:n]
        else:
            prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        nxt[-1] = -1
        while queue:
            entry = heapq.heappop(queue)
            i, m = entry & place, entry >> shift
            j = nxt[i]
            if j < 0 or ids[i] < 0 or get(ids[i] << 16 | ids[j]) != m:
                continue  # stale: one of the two was merged since
            ids[i], ids[j] = m & 0xFFFF, -1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if (m := get(ids[i] << 16 | ids[k])) is not None:
                    heapq.heappush(queue, m << shift | i)
            k = prev[i]
            if k >= 0 and (m := get(ids[k] << 16 | ids[i])) is not None:
                heapq.heappush(queue, m << shift | k)
        return [x for x in ids if x >= 0]

    def made(self, piece: str) -> tuple[bytes, str]:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        ids = self.merged([i for i in ids if i is not None])
        return packed(ids), " ".join([self.string[i] for i in ids])

    def piece(self, piece: str) -> tuple[bytes, str]:
        """made(), remembered: pieces of words with signs are mostly signs and words."""
        found = self.known_pieces.get(piece)
        if found is None:
            found = self.made(piece)
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.known_pieces) >= self.remembered:
                    self.known_pieces.clear()
                self.known_pieces[piece] = found
        return found

    def word(self, raw: bytes) -> tuple[bytes, str]:
        """Packed ids of a word, and their strings joined by a space."""
        text = raw.decode("utf-8", "surrogatepass")
        if text.isascii() and text.isalpha():
            return self.made(text.lower())
        ids = b""
        strings: list[str] = []
        for part in self.marks.split(text) if self.marks and "<" in text else [text]:
            if part in self.special:
                ids += packed([self.special[part]])
                strings.append(part)
                continue
            if part.isascii():
                plain = part.lower()
                pieces = [plain] if plain.isalpha() else self.ascii_pieces.findall(plain)
            else:
                # a final sigma is lowered like any other
                plain = unicodedata.normalize("NFC", part).translate(self.capitals).lower()
                pieces = [plain[m.start() : m.end()] for m in self.pieces.finditer(plain.translate(self.symbols))]
            for p in pieces:
                if p:
                    own, string = self.piece(p)
                    ids += own
                    strings.append(string)
        return ids, " ".join(strings)

    def packed(self, texts: list) -> list[tuple[bytes, str]]:
        """Packed ids of each text, and what they decode to; words are remembered."""
        lists = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        if len(self.words) >= self.remembered:
            self.forget()
        known, here = self.words.get, {}
        for raw, n in Counter(chain.from_iterable(lists)).items():
            found = known(raw)
            if found is None:
                found = self.word(raw)
                if len(raw) <= LONGEST_REMEMBERED:
                    self.words[raw] = found
                    if n > 1:
                        self.again.add(raw)
            else:
                self.again.add(raw)
            here[raw] = found
        out = []
        for words in lists:
            found = [here[raw] for raw in words]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])))
        return out

    def forget(self) -> None:
        """Drops the words met only once, which are most, and those not met since the last time: an idle worker holds little."""
        self.words, self.again = {raw: self.words[raw] for raw in self.again}, set()

    def encode(self, text: str | None) -> tuple[list[int], str]:
        ids, decoded = self.packed([text])[0]
        return np.frombuffer(ids, np.uint16).tolist(), decoded

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.string[i] for i in ids)


def bpe_encode_decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row per row of df: (doc_id, token_ids array<int>, decoded string).

    A null or empty text has no tokens and decodes to the empty string; ids may be null or repeat, other columns are not read.
    remembered bounds the words that a Python worker keeps from task to task: fewer take less memory and more time. An empty table
    gives an empty result. Map only: no shuffle, one text at a time in a Python worker.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))  # a fixed file of about 2 MB
    number = uuid.uuid4().hex
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(number, lambda: Encoder(shared.value, remembered))  # with the words it knows
        gc.disable()  # the tables of known words hold no cycles, and scanning them time and again costs a seventh of the run
        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in slices(texts, 1_000_000):
                    done = encoder.packed(texts[a:b])
                    ends = np.cumsum([0, *(len(d[0]) // 2 for d in done)]).astype(np.int32)
                    ids = np.frombuffer(b"".join([d[0] for d in done]), np.uint16).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array([d[1] for d in done], pa.string())],
                        names=["doc_id", "token_ids", "decoded"],
                    )
        finally:
            encoder.forget()
            gc.enable()

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, token_ids array<int>, decoded string")


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe_encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), ids_digest(F.col("token_ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
