"""Pages of six engines, each with its fallbacks, against the rows they hold."""

import pytest

from corpusloom.functions.markup import Page, steps_of
from corpusloom.sources.engines import LAYOUTS, page_state, read_results


def rows(html, engine, start=0):
    return [(r["rank"], r["url"], r["title"], r["text"]) for r in read_results(html, engine, start)]


PAGES = {
    "google": (
        "<div data-hveid=1 data-ved=2><a href=' http://a '><h3>A <b>one</b></h3></a><div data-sncf='1'><div> first </div></div></div>"
        "<div data-hveid=1 data-ved=2><a href='http://b'>no heading</a></div>"
        "<div data-hveid=1 data-ved=2><div><a href='http://c'><span><h3>C</h3></span></a></div><div class='VwiC3b'>x</div><div class='VwiC3b'>y</div></div>"
        "<div data-hveid=1 data-ved=2><div><div><a href='http://d'><h3>D</h3></a></div></div><p><div>far</div></div>"
        "<div data-hveid=1 data-ved=2><a href='http://a'><h3>again</h3></a></div><div data-hveid=1 data-ved=2><a href='#'><h3>none</h3></a></div><div data-hveid=1><a href='http://x'><h3>no result</h3></a></div>"
        "<div data-hveid=1 data-ved=2><a href='http://e'><h3>E</h3></a></div>",
        [(1, "http://a", "A one", " first "), (2, "http://c", "C", "xy"), (3, "http://d", "D", ""), (5, "http://e", "E", "")],
    ),
    "bing": (
        "<ol><li class='b_algo'><h2><a href='http://a?x=1&amp;y=2'>A</a></h2><div class='b_caption'><p> text </p></div><li class=b_algo><h2><a href='http://b'>B</a></h2><p>plain"
        "<li class=b_algo><h2><a href='http://c'>C</a></h2> rest of C<li class=b_algo><h2><a href='http://d'></a></h2><li class='b_algo'><h2>no link</h2>"
        "<li class=b_ad><h2><a href='http://ad'>Ad</a></h2><p>buy</p></ol>",
        [(-1, "http://ad", "Ad", "buy"), (1, "http://a?x=1&y=2", "A", "text"), (2, "http://b", "B", "plain"), (3, "http://c", "C", "rest of C")],
    ),
    "baidu": (
        "<div id=content_left><div class='result c-container'><h3> A </h3><a href='http://a'>link</a> more</div><div class='result c-container'><a href='http://b'>only a link</a></div>"
        "<div class='result c-container'><a href='http://a'><h3>copy</h3></a></div><div class='result c-container'><h3><a href='javascript:void(0)'>x</a></h3></div>"
        "<div class='result c-container'><a href='http://c'><h3>C</h3></a><div class='c-abstract'>what C is</div></div></div>",
        [(1, "http://a", "A", "link more"), (2, "http://b", "only a link", ""), (3, "http://c", "C", "what C is")],
    ),
    "duckduckgo": (
        "<div class='result'>not read, as there are articles</div><article data-testid='result'><h2><a href='http://a'>A</a></h2><span class='result__snippet'>s</span></article>"
        "<article data-testid='result'><span data-testid='ad-badge'></span><h2><a href='http://ad'>Ad</a></h2></article><article data-testid='result'><a data-testid='result-title-a' href=''></a><h3><a href='http://b'>x</a></h3><i class='result__title'>B</i></article>"
        "<article data-testid='result'><h2>no link</h2></article>",
        [(-1, "http://ad", "Ad", ""), (1, "http://a", "A", "s"), (2, "http://b", "B", "")],
    ),
    "yandex": (
        "<ul><li data-fast=1><h2>A</h2><a href='http://other'>o</a><a class='x OrganicTitle-Link' href='http://a'>t</a><span class=OrganicTextContentSpan> </span><div class=OrganicText>why</div>"
        "<li class=serp-item><a href='http://b'><h2>B</h2></a><li class=serp-item><a href='http://c'>no heading</a><li class='serp-item'><h2>D</h2> <a href='http://d'>d</a><li class=serp-item><h2>no link</h2></ul>",
        [(1, "http://a", "A", "why"), (2, "http://b", "B", ""), (3, "http://d", "D", "")],
    ),
    "ecosia": (
        "<div data-test-id='mainline'><p data-test-id='mainline-result-web'><a href='http://a'>x</a><b data-test-id='result-title'> A </b></p><div data-test-id='mainline-result-ad'><a href='http://ad'><h3>Ad</h3></a></div>"
        "<section data-test-id='mainline-result-web'><a data-test-id='result-link' href='http://b'></a><i data-test-id='result-description'>b</i></section><section data-test-id='mainline-result-web'>no link</section></div>",
        [(-1, "http://ad", "Ad", ""), (1, "http://a", "A", ""), (2, "http://b", "", "b")],
    ),
}


@pytest.mark.parametrize("engine", PAGES)
def test_pages(engine):
    html, want = PAGES[engine]
    assert rows(html, engine) == want
    assert page_state(html, engine) == "ok"
    moved = read_results(html, engine, 25)
    first = 20 if engine == "ecosia" else 25
    assert [r["rank"] for r in moved if not r["ad"]] == list(range(first + 1, first + 1 + sum(r[0] > 0 for r in want)))
    assert read_results("", engine) == read_results(None, engine) == read_results("<p>text", engine) == []


def test_baidu_takes_the_first_layout_with_rows():
    html = "<div id='content_left'><div class='result c-container'><h3></h3></div><div class='result-op c-container'><h3><a href='http://a'>A</a></h3><div class='summary-gap_3Jb4I'>d</div></div></div><div class='c-container new-pmd'><h3><a href='http://b'>B</a></h3></div>"
    assert rows(html, "baidu") == [(1, "http://a", "A", "d")]
    assert rows(html.replace("result-op", "other"), "baidu") == [(1, "http://b", "B", "")]


@pytest.mark.parametrize(
    "engine, html, state",
    [
        ("google", "<div data-sitekey='k'>", "captcha"), ("google", "<p>Your search did <b>not match any documents</b>", "empty"), ("baidu", "<button class='timeout-button'>", "captcha"), ("baidu", "<div class=nors>", "empty"),
        ("yandex", "<div class=CheckboxCaptcha>", "captcha"), ("yandex", "<div class=EmptySearchResults>", "empty"), ("ecosia", "<p>Captcha", "captcha"), ("ecosia", "<div data-test-id='mainline'>", "empty"), ("ecosia", "<p>x", "parser"),
        ("duckduckgo", "<form action='/anomaly.js'>", "captcha"), ("duckduckgo", "<div class='x no-results-y'>", "empty"), ("bing", "", "parser"), ("nobody", "<p>x", "parser"),
    ],
)
def test_states(engine, html, state):
    assert page_state(html, engine) == state


def test_trees():
    page = Page("<p>one<p id=x class='k l'>two <b>three</b><br>four<div>five</div></section>six<table><tr><td>a<td>b<tr><td>c</table>")
    assert [page.text(i) for i in page.find("p")] == ["one", "two threefour"]
    assert [page.text(i) for i in page.find("td")] == ["a", "b", "c"] and [page.text(i) for i in page.find("tr")] == ["ab", "c"]
    assert page.find("#x.k b, p[class*='l'] b") == [2] and page.find("div b") == []
    assert read_results("<div>" * 20000 + "<li class=b_algo><h2><a href='http://a'>A</a></h2>", "bing")[0]["url"] == "http://a"
    with pytest.raises(ValueError):
        steps_of("p > b")
    for layout in LAYOUTS.values():
        assert all(steps_of(s) for s in layout.results)
