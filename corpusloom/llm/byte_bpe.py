"""Byte-level BPE encoding and decoding through a sentencepiece BPE model that is serialised straight from a rank file.

Each entry of the vocabulary becomes a piece whose letters stand for its bytes, scored by its negative rank, so the best-scored
merge is the one of lowest rank; normalisation is the identity. Texts are split by the pattern of the vocabulary, the pieces of a
text are encoded each by itself, and ids are decoded through the inverse of the byte letters.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import NEWER_LETTERS, byte_letters
from corpusloom.llm.common import kept, slices, small_batches

#: Two more code points that this Python's tables call letters and the library's do not.
NEWER_SMALL = [(0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4)]
#: Most pre-tokens that a worker remembers, and the longest one of them.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 64
#: Stands for what has no letters of its own, at the end of the vocabulary.
UNKNOWN = "\u2047"


def load_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, which must run from 0 without a gap and hold every single byte; read on the driver only."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2, ... and hold all bytes")
    return ranks


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a protocol buffer: a string or message, a float, or a whole number."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece i is the entry of rank i, scored -i; the identity as normalisation, no space added, dropped or escaped."""
    if len(ranks) >= 1 << 24:
        raise ValueError("a score of single precision tells 16 million ranks apart")
    table = dict(enumerate(byte_letters()))
    pieces = sorted((r, b.decode("latin-1").translate(table)) for b, r in ranks.items())
    out = [_field(1, _field(1, p.encode()) + _field(2, float(-r)) + _field(3, 1)) for r, p in pieces]
    out.append(_field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2)))
    bpe, none = 2, (1 << 64) - 1
    out.append(_field(2, _field(3, bpe) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteEncoder:
    """Encodes and decodes in one Python worker."""

    def __init__(self, model: bytes, pattern: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        self.to_letters = dict(enumerate(letters))
        self.to_bytes = {ord(x): b for b, x in enumerate(letters)}
        self.size = self.model.get_piece_size() - 1
        strings = self.model.id_to_piece(list(range(self.size)))
        self.raw = [s.translate(self.to_bytes).encode("latin-1") for s in strings]
        # an entry that its own merges do not reach still stands for a pre-token equal to it
        self.whole = {s: [i] for i, (s, ids) in enumerate(zip(strings, self.model.encode(strings, num_threads=1), strict=True)) if ids != [i]}
        self.pieces = regex.compile(pattern, regex.V0)
        self.ascii_pieces = re.compile(pattern.replace(r"^\s\p{L}\p{N}", r"^\sa-zA-Z0-9").replace(r"\p{L}", "[a-zA-Z]").replace(r"\p{N}", "[0-9]"), re.ASCII) if set(re.findall(r"\\p\{\w+\}", pattern)) <= {r"\p{L}", r"\p{N}"} else None
        self.symbols = {c: 0x378 for a, b in NEWER_LETTERS + NEWER_SMALL for c in range(a, b + 1)}
        self.high = re.compile(f"[{chr(min(self.symbols))}-{chr(max(self.symbols))}]")
        self.remembered = remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() and self.ascii_pieces:
            return self.ascii_pieces.findall(text)
        if self.high.search(text) and (seen := text.translate(self.symbols)) != text:  # one letter for one
            return [text[m.start() : m.end()] for m in self.pieces.finditer(seen)]
        return self.pieces.findall(text)

    def packed(self, texts: list) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        lists = [self.split(t) if t else [] for t in texts]
        if len(self.young) > self.remembered // 2:
            self.young, self.old = {}, self.young  # what is not met again until the next time goes
        here: dict[str, bytes] = {}
        new = []
        for p in set(chain.from_iterable(lists)):
            found = self.young.get(p)
            if found is None:
                found = self.old.get(p)
                if found is None:
                    new.append(p)
                    continue
                self.young[p] = found
            here[p] = found
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_letters) for p in new]
        for p, m, ids in zip(new, mapped, self.model.encode(mapped, num_threads=1), strict=True):
            here[p] = found = np.array(self.whole.get(m, ids), "<u4").tobytes()
            if len(p) <= LONGEST_REMEMBERED:
                self.young[p] = found
        return [b"".join(map(here.__getitem__, pieces)) for pieces in lists]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


def byte_bpe(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row per row of df: (doc_id, token_ids array<int>, packed_ids binary of little-endian 32-bit ids, decoded binary).

    Each match of the pattern is encoded by itself; special tokens are plain text. Null and empty texts have no tokens and decode to
    nothing; very long texts and very long pre-tokens are encoded whole; ids may be null or repeat, equal rows give equal rows, other
    columns are not read, whatever their names; an empty table gives an empty one. remembered bounds the pre-tokens that a Python
    worker keeps. Map only: no shuffle.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(load_ranks(ranks_path)))  # as large as the fixed file
    number = uuid.uuid4().hex
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(number, lambda: ByteEncoder(shared.value, pattern, remembered))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1_000_000):
                packed = encoder.packed(texts[a:b])
                ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                decoded = [encoder.decode(ids[s:e].tolist()) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())],
                    names=["doc_id", "token_ids", "packed_ids", "decoded"],
                )

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, token_ids array<int>, packed_ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = byte_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_byte_bpe": op12_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
