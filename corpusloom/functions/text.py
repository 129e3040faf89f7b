"""Text cleaning, splitting and chunking."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import CONFIG, Config

SPACES = r"[\t\f\r   ᠎ -   　]{2,}"
EDGES = r"^[\s\u001c-\u001f\u0085   -     　]+|[\s\u001c-\u001f\u0085   -     　]+$"


def clean(text: Column, spaces: bool = True, addresses: bool = False) -> Column:
    """Chat marks opened, control characters (and, as ever, the letters ï ¿ ¾) gone, spaces collapsed, addresses removed on demand."""
    out = F.replace(F.replace(text, F.lit("<|"), F.lit("<")), F.lit("|>"), F.lit(">"))
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7Fï¿¾￾]", "")
    if spaces:
        out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), SPACES, " ")
    if addresses:
        # a markdown link or image is matched first and kept
        out = F.regexp_replace(out, r"(!?\[[^\]]*\]\(https?://[^)]+\))|[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+|https?://\S+", "$1")
    return F.regexp_replace(out, EDGES, "")


def keep_line(line: Column) -> Column:
    t = F.regexp_replace(line, EDGES, "")
    signs = r"^[ \t.\-_+=*#@$%^&()\[\]{}|,<>/?~`]*$"
    return (F.length(t) >= 10) & ~t.rlike(r"^\p{Nd}+$") & ~t.rlike(signs) & ~t.rlike(r"^Page\s+\d+\s+of\s+\d+$") & ~t.rlike(r"^\[\d+\]$")


def clean_lines(text: Column) -> Column:
    """Without blank, numeric, sign-only and short lines, page numbers and footnote marks."""
    return F.array_join(F.filter(F.split(text, "\n"), keep_line), "\n")


def stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, EDGES, "")), lambda p: p != "")


def by_headers(text: Column) -> Column:
    return stripped(F.split(text, r"\n(?=#\s+)"))


def by_paragraphs(text: Column) -> Column:
    return stripped(F.split(text, "\n\n"))


def by_sentences(text: Column) -> Column:
    """Sentences with their ends; what follows the last end is dropped."""
    ends, blank = "。！？.!?", " \t\r\n\f"

    def tidy(s: Column) -> Column:
        body = F.rtrim(s, F.lit(ends))
        return F.concat(F.btrim(body, F.lit(blank)), F.substr(s, F.length(body) + 1, F.length(s)))

    parts = F.filter(F.split(text, f"(?<=[{ends}])(?![{ends}])"), lambda s: s.rlike(f"[{ends}]$"))
    return F.filter(F.transform(parts, tidy), lambda s: F.rtrim(s, F.lit(ends)) != "")


def image_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(/files/([^/)]+)/file-preview\)"), F.lit(1))


def display_name(source_type: Column, *names: Column) -> Column:
    """The last part of the first name that is not empty (title, document title, file name, source file), behind the kind of source."""
    some = F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit("未知文档"))
    label = F.when(source_type == "feishu", "飞书文档").when(source_type == "google_drive", "Google Drive").otherwise("知识库")
    return F.concat(label, F.lit("-"), F.substring_index(some, "/", -1))


def chunk_policy(extension: Column, cfg: Config = CONFIG) -> Column:
    """struct(size, overlap, kind) by file type."""
    pick = lambda size, overlap, kind: F.struct(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.lit(kind).alias("kind"))
    return (
        F.when(extension == "md", pick(cfg.chunk_md, cfg.chunk_overlap, "md_structured")).when(extension.isin("png", "jpg", "jpeg", "webp", "bmp", "gif"), pick(cfg.chunk_image, min(50, cfg.chunk_overlap), "image_vision"))
        .when(extension.isin("doc", "docx"), pick(cfg.chunk_word, cfg.chunk_overlap, "word_structured")).otherwise(pick(cfg.chunk_other, cfg.chunk_other_overlap, "recursive"))
    )


def embedding_text(content: Column, kind: Column) -> Column:
    return F.concat(F.when(kind == "image_vision", "图片内容检索文本：").when(kind == "md_structured", "Markdown文档片段：").when(kind == "word_structured", "Word文档片段：").otherwise(""), F.trim(content))


# Python below: folds over one text, in Arrow batches


def _tail(text: str) -> str:
    """The last 15 percent; all of a text too short for that."""
    n = int(len(text) * 0.15)
    return text[-n:] if n else text


def _sentences(text: str) -> Iterator[str]:
    for m in re.finditer(r"([^。！？.!?]*)([。！？.!?]+)", text):
        if m[1].strip():
            yield m[1].strip() + m[2]


class Unit(NamedTuple):
    """A piece that is never cut further: its text, what joins it to the piece before, and the least length at which it may close a chunk."""

    text: str
    glue: str
    least: int


#: Closes what is open; nothing of it is handed on.
BREAK = Unit("", "", 0)


def units(text: str, most: int) -> list[Unit]:
    """Paragraphs, or the sentences of those over `most` letters behind a BREAK. Paragraphs may close a chunk that is half full, sentences any."""
    out = []
    for section in re.split(r"\n(?=#\s+)", text):
        for para in filter(None, map(str.strip, section.strip().split("\n\n"))):
            out += [Unit(para, "\n\n", most // 2)] if len(para) <= most else [BREAK, *(Unit(s, "", 0) for s in _sentences(para))]
    return out


def chunk_spans(pieces: list[Unit], most: int, share: float = 0.15) -> list[tuple[int, int, int]]:
    """(first, last, carried) of chunks in order, from lengths alone: pieces first to last, behind that many letters of the chunk before.

    A sentence over `most` letters is a chunk of its own and comes before the one that is open. Only paragraphs are handed a part of
    the chunk before, all of it if the part would be no letter.
    """
    out: list[tuple[int, int, int]] = []
    start, size, carried = 0, 0, 0
    for i, piece in enumerate(pieces):
        n = len(piece.text)
        if n > most:
            out.append((i, i + 1, 0))
            # the open chunk goes on behind it
            pieces[i] = BREAK._replace(least=-1)
            continue
        full = piece is BREAK or (size >= piece.least and size + n > most)
        if full and size:
            out.append((start, i, carried))
        if full or not size:
            carried = (int(size * share) or size) if full and piece.glue else 0
            start, size = i, carried
        size += (len(piece.glue) if size else 0) + n
    return [*out, (start, len(pieces), carried)] if size else out


def recursive_chunks(text: str, size: int = 500) -> list[str]:
    """Chunks of up to 3 * size letters of paragraphs, or of the sentences of longer ones; an overfull chunk hands its last 15 percent on."""
    most, out = size * 3, []
    pieces = units(text, most)
    texts = [p.text for p in pieces]
    whole = ""
    for first, last, carried in chunk_spans(pieces, most):
        if last == first + 1 and len(texts[first]) > most:
            out.append(texts[first][:most])
            continue
        kept = [p for p in pieces[first:last] if p.text]
        body = "".join(p.glue * bool(i) + p.text for i, p in enumerate(kept))
        whole = whole[len(whole) - carried :] + kept[0].glue + body if carried else body
        out.append(whole.strip())
    return [c[:10_000] for c in out]


def split_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n## ", "\n### ", "\n\n", "\n", "。", ". ", " ", "")) -> list[str]:
    """Our own splitter by a hierarchy of separators: pieces that are too long are split by the next separator, then packed with overlap."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s and s in text), "")
    pieces = [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]] if sep else [text[i : i + size] for i in range(0, len(text), size)]
    rest = separators[separators.index(sep) + 1 :] if sep else ("",)
    out, now = [], ""
    for piece in pieces:
        for p in split_chunks(piece, size, 0, rest) if len(piece) > size else [piece]:
            if now and len(now) + len(p) > size:
                out.append(now)
                now = now[-overlap:] if overlap and len(now[-overlap:]) + len(p) <= size else ""
            now += p
    if now.strip():
        out.append(now)
    return [c.strip() for c in out if c.strip()]


def chunked(df: DataFrame, how: str = "recursive", size: int = 500, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, content, token_count) of each text; one text at a time in a worker."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, c, len(c) // 3) for i, t in zip(batch["id"], batch["text"], strict=True) for n, c in enumerate(recursive_chunks(t or "", size) if how == "recursive" else split_chunks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "content", "token_count"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {id_type}, chunk_no bigint, content string, token_count bigint")


def chunked_by_tokens(df: DataFrame, tokens: int = 256, overlap: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunked by separators with room for that many tokens, at four letters each."""
    return chunked(df, "split", 4 * tokens, overlap, id_col, text_col)


def semantic_chunks(paragraphs: DataFrame, size: int = 500, threshold: float = 0.3) -> DataFrame:
    """paragraphs (doc_id, at, text, vector) -> (doc_id, chunk_no, content): a new chunk where the chunk's first paragraph and the next differ."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out, now, first = [], None, None
        for text, vector in pdf.sort_values("at")[["text", "vector"]].itertuples(index=False):
            v = np.asarray(vector, float)
            if now is None:
                now, first = text, v
                continue
            norm = np.linalg.norm(first) * np.linalg.norm(v) if len(first) == len(v) else 0
            alike = float(first @ v / norm) if norm else 0.0
            if alike < threshold or len(now) + len(text) > size * 4.5:
                out.append(now[:10_000])
                now, first = f"{_tail(now)}\n\n{text}", v
            else:
                now = f"{now}\n\n{text}"
        if now and now.strip():
            out.append(now[:10_000])
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "chunk_no": range(len(out)), "content": out})

    return paragraphs.groupBy("doc_id").applyInPandas(fold, "doc_id bigint, chunk_no bigint, content string")


#: Patterns of tokens that stay whole, in order of priority.
PROTECTED = (r"0x[0-9a-fA-F]+", r"[a-zA-Z]?\d+\.\d+\.\d+(?:\.\d+)?", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"[A-Za-z]{1,6}-?\d{2,5}[A-Za-z]?", r"IEC[-\s]?\d{2,5}", r"\d{2,4}规约")


def protected_tokens(text: str, segment=None, stop=frozenset()) -> list[str]:
    """NFKC and lower case; tokens that stay whole first, a place only once; then the segments of the rest, glued together."""
    text = unicodedata.normalize("NFKC", text or "").lower()
    taken = bytearray(len(text))
    whole = []
    for pattern in PROTECTED:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            a, b = m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                whole.append(m[0].lower())
    rest = "".join(c for c, t in zip(text, taken, strict=True) if not t)
    words = (segment or (lambda s: re.findall(r"[^\W_]+", s)))(rest)
    return whole + [w for w in (x.strip().lower() for x in words) if w and w not in stop and re.search(r"\w", w)]


#: Chinese words that are not indexed.
STOP_WORDS_ZH = ["的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "那", "与", "及", "或", "等", "被", "把", "让", "向", "从", "对", "为", "以", "于", "而", "之", "其", "此", "该", "各", "由", "将", "已", "并", "但", "若", "如", "且", "这个", "那个", "什么", "怎么", "如何"]


class Lattice:
    """Cuts runs of Han letters into the words of a dictionary (word: count) along the most likely path; other runs are letters and digits.

    A path's likelihood is the product of its words' shares of all counts; a single letter that is no word counts as rarest. Of
    paths that are equally likely the one with the longer first word is taken.
    """

    def __init__(self, words: dict[str, int]):
        total = sum(words.values()) or 1
        self.cost = {w: math.log(total) - math.log(n) for w, n in words.items() if n > 0}
        self.rare = math.log(total) + 1e-9
        self.longest = max(map(len, self.cost), default=1)
        self.runs = re.compile(r"[\u4e00-\u9fff]+|[^\W_\u4e00-\u9fff]+")

    def han(self, run: str) -> list[str]:
        n = len(run)
        best, to = [0.0] * (n + 1), [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i], to[i] = self.cost.get(run[i], self.rare) + best[i + 1], i + 1
            for j in range(i + 2, min(n, i + self.longest) + 1):
                cost = self.cost.get(run[i:j])
                if cost is not None and cost + best[j] <= best[i]:
                    best[i], to[i] = cost + best[j], j
        out, i = [], 0
        while i < n:
            out.append(run[i : to[i]])
            i = to[i]
        return out

    def __call__(self, text: str) -> list[str]:
        return [w for run in self.runs.findall(text) for w in (self.han(run) if "\u4e00" <= run[0] <= "\u9fff" else [run])]


def technical_tokenizer(words: dict[str, int] | None = None):
    """A function of a column of texts to its tokens, in order and with repeats, for lexical.term_index and index_store.

    NFKC and lower case, technical tokens whole, the rest by the dictionary, no stop words. The dictionary goes to the workers once.
    """
    from corpusloom.operators.lexical import STOP_WORDS

    stop, segment = frozenset(STOP_WORDS) | frozenset(STOP_WORDS_ZH), Lattice(words or {})

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else protected_tokens(t, segment, stop))

    return tokens


@F.pandas_udf(T.ArrayType(T.StringType()))
def technical_tokens(texts: pd.Series) -> pd.Series:
    from corpusloom.operators.lexical import STOP_WORDS

    stop = frozenset(STOP_WORDS)
    return texts.map(lambda t: protected_tokens(t, stop=stop))


@F.pandas_udf(T.StringType())
def nfkc_lower(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())
