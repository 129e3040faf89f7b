"""Result pages in each engine's markup, made by Spark from the pages found, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import engines as G
from corpusloom.sources import model as M

#: A result (1) and an ad (2) of each engine with {u}rl, {t}itle and {d}escription; the parts of a result differ by rank mod 3.
MARKUP = {
    "google": ("<div data-hveid='a' data-ved='b'><div><div><a href='{u}'><h3>{t}</h3></a></div></div>{d}</div>", ("<div data-sncf='1'><div>{d}</div></div>", "<div class='VwiC3b x'>{d}</div>", "<section><div>{d}</div></section>"), "<div data-hveid='a' data-ved='b'><a href='{u}'>{t}</a></div>"),
    "bing": ("<li class='b_algo x'><h2><a href='{u}'>{t}</a></h2>{d}", ("<div class='b_caption'><p>{d}</div>", "<div class='b_caption'><div>{d}</div></div>", "<span>{d}</span>"), "<li class='b_ad'><h2><a href='{u}'>{t}</a></h2><p>{d}</p></li>"),
    "baidu": ("<div class='result c-container'><h3><a href='{u}'> {t}</a></h3>{d}</div>", ("<div class='c-abstract'>{d}</div>", "<p class='summary-gap_3Jb4I'>{d}</p>", "<i>{d}</i>"), "<div class='result'><h3><a href='{u}'>{t}</a></h3></div>"),
    "duckduckgo": ("<article data-testid='result'><h2><a href='{u}'>{t}<br></a></h2>{d}</article>", ("<div data-result='snippet'>{d}</div>", "<b class='result__snippet'>{d}</b>", "<div class='result__body'>{d}</div>"), "<article data-testid='result'><span class='ad-badge'>Ad</span><h2><a href='{u}'>{t}</a></h2><div class='result__body'>{d}</div></article>"),
    "yandex": ("<li class='serp-item'><a class='OrganicTitle-Link' href='{u}'><h2>{t}</h2></a>{d}", ("<span class='OrganicTextContentSpan'>{d}</span>", "<div class='OrganicText'>{d}</div>", ""), "<li class='serp-item'><a href='{u}'>{t}</a>"),
    "ecosia": ("<article data-test-id='mainline-result-web'><a data-test-id='result-link' href='{u}'><h2>{t}</h2></a>{d}</article>", ("<p data-test-id='result-description'>{d}</p>", "<p data-test-id='result-description'>{d}", ""), "<div data-test-id='mainline-result-ad'><a href='{u}'><h3>{t}</h3></a><p data-test-id='result-description'>{d}</p></div>"),
}
AROUND = {"baidu": ("<div id='content_left'>", "</div>"), "bing": ("<ol>", "</ol>"), "yandex": ("<ul>", "</ul>")}


def engine_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, engine, start, html): what M.serp says each engine found for a query, as that engine shows it; every seventh query found nothing."""
    rows = M.serp(spark, d).where("query_id % 7 <> 6")
    url, title = F.replace("url", F.lit("&"), F.lit("&amp;")), F.col("title")
    text = F.concat(F.lit("about "), "title")

    def filled(template: str) -> Column:
        out = F.lit(template)
        for mark, value in (("{u}", url), ("{t}", title), ("{d}", text)):
            out = F.replace(out, F.lit(mark), value)
        return out

    shown = None
    for name, (result, texts, ad) in MARKUP.items():
        own = F.when(F.col("ad"), filled(ad))
        for i, t in enumerate(texts):
            own = own.when(F.col("rank") % 3 == i, filled(result.replace("{d}", t)))
        shown = F.when(F.col("engine") == name, own) if shown is None else shown.when(F.col("engine") == name, own)
    parts = rows.groupBy("query_id", "engine").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("x")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["x"]), "\n")
    start, end = (F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in AROUND.items() for x in (k, v[i])]), F.col("engine")), F.lit("")) for i in (0, 1))
    html = F.concat(F.lit("<!doctype html><html><body>"), start, body, end, F.lit("</body></html>"))
    return parts.select(F.col("query_id").alias("page_id"), "engine", (F.col("query_id") % 3 * 15).alias("start"), html.alias("html"))


def engine_results(spark, d):
    return G.engine_results(engine_pages(spark, d))


QUERIES = {"engine_results": engine_results}

ORACLE_SQL = {
    "engine_results": M.with_views(
        "WITH own AS (SELECT query_id, query_id % 3 * 15 AS start, engine, rank AS pos, url, title, ad, CASE WHEN ad OR rank % 3 < 2 OR engine NOT IN ('yandex', 'ecosia') THEN 'about ' || title ELSE '' END AS text FROM serp WHERE query_id % 7 <> 6 AND NOT (ad AND engine IN ('google', 'baidu', 'yandex'))), "
        "counted AS (SELECT *, count(*) FILTER (WHERE NOT ad) OVER (PARTITION BY query_id, engine ORDER BY pos) AS n, row_number() OVER (PARTITION BY query_id, engine, url ORDER BY ad AND engine IN ('bing', 'ecosia'), pos) AS copy FROM own), "
        "kept AS (SELECT *, count(*) FILTER (WHERE NOT ad) OVER (PARTITION BY query_id, engine ORDER BY pos) AS place FROM counted WHERE copy = 1) "
        "SELECT query_id AS page_id, engine, CAST(CASE WHEN ad THEN -1 WHEN engine = 'baidu' OR start > 0 THEN CASE WHEN engine = 'ecosia' THEN start // 10 * 10 ELSE start END + place ELSE n END AS BIGINT) AS rank, url, title, text, ad FROM kept",
        "serp",
    )
}
