"""Files, messages and pages into rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import EDGES

#: Types that may be uploaded, and the largest size.
UPLOAD_TYPES = ("pdf", "doc", "docx", "md", "txt", "xlsx", "png", "jpg", "jpeg", "webp")
UPLOAD_BYTES = 100 * 1024 * 1024


def uploads(spark: SparkSession, path: str, kb_id: str, existing: DataFrame | None = None) -> DataFrame:
    """(kb_id, name, file_type, size, file_hash, content) of files of known types that the base does not hold yet, by MD5."""
    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    rows = files.select(F.lit(kb_id).alias("kb_id"), name.alias("name"), F.lower(F.substring_index(name, ".", -1)).alias("file_type"), F.col("length").alias("size"), F.md5("content").alias("file_hash"), "content")
    rows = rows.where(F.col("file_type").isin(*UPLOAD_TYPES) & (F.col("size") <= UPLOAD_BYTES))
    return rows if existing is None else rows.join(existing.select("kb_id", "file_hash"), ["kb_id", "file_hash"], "left_anti")


def text_of(content: Column, file_type: Column) -> Column:
    """Text of plain files; other types need a parser that is given as a UDF."""
    return F.when(file_type.isin("pdf", "doc", "docx", "png", "jpg", "jpeg", "webp"), F.lit(None)).otherwise(F.decode(content, "UTF-8"))


def longer_text(raw: Column, ocr: Column, least: int = 50) -> Column:
    """OCR is kept only where the text layer is short and OCR found more."""
    return F.when((F.length(F.trim(raw)) < least) & (F.length(F.trim(ocr)) > F.length(F.trim(raw))), ocr).otherwise(raw)


def drive_id(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1), F.lit("")))


def platform_message(message: Column, platform: Column) -> Column:
    """struct(message_id, user_id, conversation_id, text, at in seconds) of a JSON message of feishu, wechat or qq; missing fields are empty, a missing time is null.

    A feishu message's text is inside a JSON text of its own and is empty if that is none. Of other platforms all is empty.
    """
    return F.get(F.transform(F.array(message), lambda raw: _platform_message(raw, platform)), F.lit(0))  # the message is worked out once


def _platform_message(raw: Column, platform: Column) -> Column:
    def get(*paths: str) -> Column:
        return F.coalesce(*[F.nullif(F.nullif(F.get_json_object(raw, p), F.lit("")), F.lit("0")) for p in paths], F.lit(""))

    def made(message: Column, user: Column, conversation: Column, text: Column, at: Column) -> Column:
        return F.struct(message.alias("message_id"), user.alias("user_id"), conversation.alias("conversation_id"), F.regexp_replace(text, EDGES, "").alias("text"), at.alias("at"))

    seconds = lambda *paths: F.nullif(get(*paths), F.lit("")).cast("double").cast("bigint")
    message = "$.event.message."
    inner = F.coalesce(F.get_json_object(F.get_json_object(raw, message + "content"), "$.text"), F.lit(""))
    feishu = made(F.coalesce(F.get_json_object(raw, message + "message_id"), F.lit("")), get("$.event.sender.sender_id.open_id", "$.event.sender.sender_id.user_id"), F.coalesce(F.get_json_object(raw, message + "chat_id"), F.lit("")), inner, F.floor(F.nullif(get(message + "create_time"), F.lit("")).cast("bigint") / 1000))
    wechat = made(get("$.message_id", "$.MsgId"), get("$.from_user", "$.FromUserName"), get("$.conversation_id", "$.ToUserName"), get("$.content", "$.Content"), seconds("$.timestamp", "$.CreateTime"))
    qq = made(get("$.message_id", "$.id"), get("$.user_id"), get("$.group_id", "$.channel_id", "$.conversation_id"), get("$.content"), seconds("$.timestamp"))
    none = made(*[F.lit("")] * 4, F.lit(None).cast("bigint"))
    return F.when(platform == "feishu", feishu).when(platform == "wechat", wechat).when(platform == "qq", qq).otherwise(none)


#: Shape of a document's blocks: texts are runs, a table has rows of cells or cells with places.
TEXT_SHAPE = "STRUCT<elements: ARRAY<STRUCT<text_run: STRUCT<content: STRING>, mention_user: STRUCT<text: STRING>, mention_doc: STRUCT<text: STRING>, equation: STRUCT<content: STRING>>>>"
BLOCK_SHAPE = "ARRAY<STRUCT<block_type: INT, " + ", ".join(f"{k}: {TEXT_SHAPE}" for k in ("text", "heading1", "heading2", "heading3", "heading4", "heading5", "heading6", "bullet", "ordered", "code", "quote")) + ", table: STRUCT<rows: ARRAY<ARRAY<STRING>>, cells: ARRAY<STRING>, table_cells: ARRAY<STRING>>>>"


def _runs(text: Column) -> Column:
    """The runs, mentions and equations of a text joined, without spaces around; null for none."""
    some = lambda e: [F.nullif(e[kind][field], F.lit("")) for kind, field in (("text_run", "content"), ("mention_user", "text"), ("mention_doc", "text"), ("equation", "content"))]
    runs = F.transform(text["elements"], lambda e: F.coalesce(*some(e), F.lit("")))
    return F.regexp_replace(F.array_join(runs, ""), EDGES, "")


def _grid(rows: Column) -> Column:
    """Rows of cells as a table, a line of dashes below the first, short rows filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.coalesce(F.size(r), F.lit(0))))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    filled = F.transform(rows, lambda r: line(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.regexp_replace(F.coalesce(F.get(r, i), F.lit("")), EDGES, ""))))
    dashes = line(F.array_repeat(F.lit("---"), width))
    return F.when(width > 0, F.array_join(F.concat(F.slice(filled, 1, 1), F.array(dashes), F.slice(filled, F.lit(2), F.size(filled))), "\n"))


def _placed(cells: Column) -> Column:
    """Cells that name their places, one line each; a cell's text may be a text, an object or a list of both."""
    first = lambda j, *names: F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{n}"), F.lit("")) for n in names], F.lit(""))

    def text(cell: Column) -> Column:
        value = first(cell, "text", "content", "display", "value")
        parts = F.transform(F.from_json(value, "ARRAY<STRING>"), lambda v: F.regexp_replace(F.when(v.startswith("{"), first(v, "text", "content", "value")).otherwise(v), EDGES, ""))
        joined = F.array_join(F.filter(parts, lambda x: x != ""), " ")
        return F.when(value.startswith("["), joined).when(value.startswith("{"), F.regexp_replace(first(value, "text", "content", "value"), EDGES, "")).otherwise(F.regexp_replace(value, EDGES, ""))

    def line(cell: Column, i: Column) -> Column:
        number = lambda default, *names: F.coalesce(*[F.get_json_object(cell, f"$.{n}").try_cast("int") for n in names], default)
        high, wide = number(F.lit(1), "row_span"), number(F.lit(1), "col_span")
        span = F.when((high > 1) | (wide > 1), F.format_string(" (合并 %dx%d)", high, wide)).otherwise("")
        shown = text(cell)
        return F.when(shown != "", F.concat(F.format_string("- R%dC%d", number(i, "row_index", "row") + 1, number(F.lit(0), "col_index", "col") + 1), span, F.lit(": "), shown))

    lines = F.filter(F.transform(cells, line), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.concat(F.lit("[复杂表格展开]\n"), F.array_join(lines, "\n")))


def document_markdown(docs: DataFrame, id_col: str = "doc_id", blocks_col: str = "blocks") -> DataFrame:
    """(doc_id, markdown) of documents whose blocks are a JSON list: headings and texts as they are, lists, code, quotes and tables marked.

    Blocks without a text and of unknown types are left out; a document without any, or whose JSON cannot be read, is empty.
    """

    def line(block: Column) -> Column:
        kind, table = block["block_type"], block["table"]
        heading = F.coalesce(*[block[f"heading{i}"] for i in range(1, 7)])
        marked = lambda before, name, after="": F.when(_runs(block[name]) != "", F.concat(F.lit(before), _runs(block[name]), F.lit(after)))
        cells = F.coalesce(table["cells"], table["table_cells"])
        return (
            F.when(kind.between(3, 8), _runs(heading)).when(kind == 2, _runs(block["text"])).when(kind == 12, marked("- ", "bullet")).when(kind == 13, marked("1. ", "ordered")).when(kind == 14, marked("```text\n", "code", "\n```"))
            .when(kind == 19, marked("> ", "quote")).when(kind == 31, F.when(F.size(table["rows"]) > 0, _grid(table["rows"])).otherwise(_placed(cells)))
        )

    lines = F.filter(F.transform(F.from_json(blocks_col, BLOCK_SHAPE), line), lambda x: F.coalesce(x, F.lit("")) != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("markdown"))


class Results(HTMLParser):
    """Links with their texts, in order, inside elements of the given classes (of the whole page if none is given), and the text after each."""

    def __init__(self, classes: tuple[str, ...] = (), ads: tuple[str, ...] = ("ad", "ads", "b_ad", "result--ad"), base: str = ""):
        super().__init__(convert_charrefs=True)
        self.classes, self.ads, self.base = classes, ads, base
        self.rows: list[dict] = []
        self.stack: list[tuple[str, bool, bool]] = []
        self.link: dict | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = set((a.get("class") or "").split())
        inside = (self.stack[-1][1] if self.stack else not self.classes) or bool(names & set(self.classes))
        ad = (self.stack[-1][2] if self.stack else False) or bool(names & set(self.ads))
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "a" and inside and (a.get("href") or "#")[0] != "#":
            url = urljoin(self.base, a["href"])
            if url.startswith(("http://", "https://")):
                self.link = {"url": url, "title": "", "text": "", "ad": ad}
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.stack.append((tag, inside, ad))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.link:
            if self.link["title"].strip():
                self.rows.append(self.link)
            self.link = None
        while self.stack:
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if self.skip:
            return
        if self.link is not None:
            self.link["title"] += data
        elif self.rows:
            self.rows[-1]["text"] += data


#: Classes of the elements that hold results, per engine.
CONTAINERS = {"google": ("g", "tF2Cxc"), "bing": ("b_algo",), "duckduckgo": ("result", "result__body"), "baidu": ("result", "c-container"), "yandex": ("serp-item", "organic"), "ecosia": ("result", "mainline__result-wrapper")}


def parse_results(html: str, engine: str | None = None, base: str = "") -> list[dict]:
    """Rows (rank, url, title, text, ad) of a page: each address once, ads of rank -1, the rest counted from 1."""
    parser = Results(CONTAINERS.get(engine or "", ()), base=base or "")
    parser.feed(html or "")
    out, seen, rank = [], set(), 0
    for r in parser.rows:
        if r["url"] in seen:
            continue
        seen.add(r["url"])
        rank += not r["ad"]
        out.append({"rank": -1 if r["ad"] else rank, "url": r["url"], "title": " ".join(r["title"].split()), "text": " ".join(r["text"].split()), "ad": r["ad"]})
    return out


def page_results(pages: DataFrame, engine: str | None = None) -> DataFrame:
    """(page_id, rank, url, title, text, ad) of pages (page_id, url, html), in Arrow batches; links are resolved against the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": i, **r} for i, u, h in zip(batch["page_id"], batch["url"], batch["html"], strict=True) for r in parse_results(h, engine, u)]
            yield pd.DataFrame(rows, columns=["page_id", "rank", "url", "title", "text", "ad"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, rank bigint, url string, title string, text string, ad boolean")
