"""Result pages of six search engines as rows: where each engine keeps links, titles and descriptions, and one reader for all.

A layout lists, for each part of a result, ways that are tried in order. A way is a selector inside the result, or one of the
named moves below. Pages come in a column and are read in Arrow batches; no page is looked at twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.functions.markup import Page

AROUND_TITLE, BESIDE_TITLE, REST = "link around the title", "first block after the title", "what is left without the title"


@dataclass(frozen=True)
class Layout:
    #: Selectors of results; the first that gives rows counts, or with `by_match` the first that matches at all.
    results: tuple[str, ...]
    link: tuple[str, ...]
    title: tuple[str, ...]
    text: tuple[str, ...] = ()
    by_match: bool = False
    #: A result without this is none.
    needs: str | None = None
    #: All matches make up the title (and the text of these selectors), not the first one only.
    joined: tuple[str, ...] = ()
    badges: tuple[str, ...] = ()
    ads: Layout | None = None
    title_required: bool = True
    trimmed: bool = True
    #: The description is that of the first way that leads somewhere, as it stands; else of the first with a text, trimmed.
    as_is: bool = False
    no_links: tuple[str, ...] = ("", "#")
    scripts: bool = False
    is_captcha: Callable[[Page], bool] = lambda page: False
    is_empty: Callable[[Page], bool] = lambda page: False


def _there(*selectors: str) -> Callable[[Page], bool]:
    return lambda page: any(page.find(s) for s in selectors)


def _said(*words: str) -> Callable[[Page], bool]:
    return lambda page: any(w in page.all_text().lower() for w in words)


#: Selectors and phrases of the engines' pages.
LAYOUTS = {
    "google": Layout(
        ("div[data-hveid][data-ved]",), (AROUND_TITLE,), ("h3",), ("div[data-sncf='1'] div", "div.VwiC3b", BESIDE_TITLE), needs="h3", joined=("h3", "div.VwiC3b"), title_required=False, trimmed=False, as_is=True, scripts=True,
        is_captcha=_there("div[data-sitekey]"), is_empty=_said("did not match any documents", "about 0 results"),
    ),
    "bing": Layout(
        ("li.b_algo",), ("h2 a",), ("h2 a",), ("div.b_caption p", "div.b_caption div", "p", REST), needs="h2 a", trimmed=False, scripts=True,
        ads=Layout(("li.b_ad",), ("h2 a",), ("h2 a",), ("p",), needs="h2 a", title_required=False, trimmed=False, as_is=True, no_links=("",), scripts=True),
    ),
    "baidu": Layout(
        ("#content_left div.result.c-container", "#content_left div.result-op.c-container", "div.c-container.new-pmd"), ("h3 a[href]", AROUND_TITLE, "a"), ("h3",), ("div.c-abstract", ".content-right_8Zs40", ".summary-gap_3Jb4I", REST),
        is_captcha=_there("div.passMod_dialog-wrapper", "button.timeout-button"), is_empty=_there("div.content_none", "div.nors"),
    ),
    "duckduckgo": Layout(
        ("article[data-testid='result']", "li[data-layout='organic']", "div[data-testid='result']", "div.result"), ("a[data-testid='result-title-a']", "a.result__a", "h2 a", "h3 a"), ("h2", ".result__title", ".result__a"),
        ("div[data-result='snippet']", ".result__snippet", ".result__body"), by_match=True, badges=("[data-testid='ad-badge']", ".ad-badge", ".result--ad"),
        is_captcha=lambda page: bool(page.find("form[action*='anomaly'], input[name='challenge'], div[id*='anomaly'], div[class*='captcha']")) or _said("bots user", "bots use duckduckgo too", "human verification", "unusual traffic", "anomaly")(page),
        is_empty=_there("div[class*='no-results']", "[data-testid='no-results']", "div[data-result='no-results']"),
    ),
    "yandex": Layout(
        ("li[data-fast], li.serp-item",), ("a.OrganicTitle-Link", AROUND_TITLE, "a"), ("h2",), ("span.OrganicTextContentSpan", "div.OrganicText"), needs="h2",
        is_captcha=_there("div.CheckboxCaptcha"), is_empty=_there("div.EmptySearchResults"),
    ),
    "ecosia": Layout(
        ("[data-test-id='mainline-result-web']",), ("[data-test-id='result-link']", "a[href]"), ("[data-test-id='result-title']", "h2, h3"), ("[data-test-id='result-description']",), title_required=False, no_links=("",),
        ads=Layout(("[data-test-id='mainline-result-ad']",), ("[data-test-id='result-link']", "a[href]"), ("[data-test-id='result-title']", "h2, h3"), ("[data-test-id='result-description']",), title_required=False, no_links=("",)),
        is_captcha=_said("captcha"),
        is_empty=lambda page: bool(page.find("[data-test-id='web-no-results']")) or bool(page.find("[data-test-id='mainline']")) and not page.find("[data-test-id='mainline-result-web'], [data-test-id='mainline-result-ad']"),
    ),
}


def _text_of(page: Page, item: int, way: str, layout: Layout, title: str = "") -> str | None:
    """Text of the way; none if it leads nowhere."""
    if way == REST:
        return page.text(item).replace(title, "", 1)
    if way == BESIDE_TITLE:
        head = page.first(item, layout.title[0])
        above = page.parents[head] if head is not None else -1
        for _ in range(2 if above >= 0 and page.tags[above] == "a" else 0):
            above = page.parents[above] if above >= 0 else -1
        beside = page.after(above) if above >= 0 else None
        found = [page.first(beside, "div")] if beside is not None else []
    else:
        found = page.inside(item, way) if way in layout.joined else [page.first(item, way)]
    texts = [page.text(i) for i in found if i is not None]
    return "".join(texts) if texts else None


def _link_of(page: Page, item: int, way: str, layout: Layout) -> int | None:
    if way != AROUND_TITLE:
        return page.first(item, way)
    heads = page.inside(item, layout.title[0])
    around = (page.closest(head, "a") for head in (heads if layout.joined else heads[:1]))
    return next((i for i in around if i is not None), None)


def _read(page: Page, item: int, layout: Layout) -> dict | None:
    if layout.needs and page.first(item, layout.needs) is None:
        return None
    trim = str.strip if layout.trimmed else str
    if layout.by_match:  # the first link that is not empty
        links = [page.first(item, way) for way in layout.link]
        url = next((u for u in (page.attrs[i].get("href", "") for i in links if i is not None) if u), "").strip()
        link = None
    else:
        link = next((i for i in (_link_of(page, item, way, layout) for way in layout.link) if i is not None), None)
        url = page.attrs[link].get("href", "") if link is not None else ""
        url = url.strip() if layout.trimmed else url.strip(" ") if layout.joined else url
    if url in layout.no_links or (not layout.scripts and url.startswith("javascript:")):
        return None
    title = next((t for t in (trim(_text_of(page, item, way, layout) or "") for way in layout.title) if t), "")
    if not title and link is not None and layout.title_required and layout.trimmed and not layout.needs:
        title = page.text(link).strip()
    if not title and layout.title_required:
        return None
    ways = (_text_of(page, item, way, layout, title) for way in layout.text)
    text = next((t for t in ways if t is not None and (layout.as_is or t.strip())), "")
    ad = any(page.first(item, badge) is not None for badge in layout.badges)
    return {"url": url, "title": title, "text": text if layout.as_is else text.strip(), "ad": ad}


def _rows(page: Page, layout: Layout) -> list[dict]:
    for selector in layout.results:
        items = page.find(selector)
        rows = [r for r in (_read(page, i, layout) for i in items) if r]
        if rows or (layout.by_match and items):
            return rows
    return []


def read_results(html: str | None, engine: str, start: int = 0) -> list[dict]:
    """(rank, url, title, text, ad) of an engine's page: ads first, of rank -1, then results from start + 1 on; each address once, where it is first.

    Results that repeat an address of one before take no rank if start is given or the engine is baidu; otherwise they leave a gap.
    An engine that is not known, and a page that is null or empty, has no rows.
    """
    layout = LAYOUTS.get(engine)
    if layout is None or not html:
        return []
    page = Page(html)
    rows, n = _rows(page, layout), 0
    for r in rows:
        n += not r["ad"]
        r["rank"] = -1 if r["ad"] else n
    if layout.ads:
        rows += [{**r, "ad": True, "rank": -1} for r in _rows(page, layout.ads)]
    once: dict[str, dict] = {}
    for r in rows:
        once.setdefault(r["url"], r)
    out = sorted(once.values(), key=lambda r: r["rank"])
    if engine == "baidu" or start > 0:
        first = start // 10 * 10 if engine == "ecosia" else start  # its pages are numbered, not its results
        for i, r in enumerate(r for r in out if not r["ad"]):
            r["rank"] = first + i + 1
    return out


def page_state(html: str | None, engine: str) -> str:
    """captcha, empty, ok, or parser where nothing could be read from a page that does not say it is empty."""
    layout = LAYOUTS.get(engine)
    page = Page(html)
    if layout is None:
        return "parser"
    if layout.is_captcha(page):
        return "captcha"
    if layout.is_empty(page):
        return "empty"
    return "ok" if _rows(page, layout) or layout.ads and _rows(page, layout.ads) else "parser"


def engine_results(pages: DataFrame) -> DataFrame:
    """(page_id, engine, rank, url, title, text, ad) of pages (page_id, engine, start, html); a null start is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": i, "engine": e, **r} for i, e, s, h in zip(b["page_id"], b["engine"], b["start"], b["html"], strict=True) for r in read_results(h, e, 0 if pd.isna(s) else int(s))]
            yield pd.DataFrame(rows, columns=["page_id", "engine", "rank", "url", "title", "text", "ad"])

    return pages.select("page_id", "engine", "start", "html").mapInPandas(run, "page_id bigint, engine string, rank bigint, url string, title string, text string, ad boolean")


def engine_states(pages: DataFrame) -> DataFrame:
    """(page_id, engine, state) of pages (page_id, engine, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "engine": b["engine"], "state": [page_state(h, e) for h, e in zip(b["html"], b["engine"], strict=True)]})

    return pages.select("page_id", "engine", "html").mapInPandas(run, "page_id bigint, engine string, state string")
