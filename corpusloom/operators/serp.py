"""Search results of several engines: enrichment, merging, dedup and clusters. Rows: (query_id, engine, rank, url, title, ad)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.urls import cluster_id, display_url, domain, lookup, normalize_url, result_id

#: What some domains are known for.
SOURCE_HINTS = {
    "wikipedia.org": "encyclopedia", "en.wikipedia.org": "encyclopedia", "github.com": "code_repository", "gitlab.com": "code_repository", "stackoverflow.com": "qa_forum", "stackexchange.com": "qa_forum",
    "reddit.com": "social_forum", "nytimes.com": "news", "bbc.com": "news", "bbc.co.uk": "news", "reuters.com": "news", "theguardian.com": "news", "washingtonpost.com": "news", "forbes.com": "news",
    "techcrunch.com": "news", "medium.com": "blog_platform", "scholar.google.com": "academic", "arxiv.org": "academic", "pubmed.ncbi.nlm.nih.gov": "academic", "amazon.com": "marketplace", "ebay.com": "marketplace",
    "etsy.com": "marketplace", "docs.google.com": "document", "youtube.com": "video_platform", "vimeo.com": "video_platform", "twitter.com": "social_media", "x.com": "social_media", "facebook.com": "social_media",
    "linkedin.com": "professional_network", "instagram.com": "social_media",
}
#: Domains of news, forums, marketplaces and social media.
NEWS = ["nytimes.com", "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com", "theguardian.com", "washingtonpost.com", "forbes.com", "techcrunch.com", "wired.com", "bloomberg.com", "cnn.com", "nbcnews.com", "cbsnews.com", "abcnews.go.com", "foxnews.com", "theverge.com", "engadget.com", "arstechnica.com", "zdnet.com", "venturebeat.com", "axios.com", "politico.com", "theatlantic.com", "economist.com", "ft.com", "wsj.com", "usatoday.com", "latimes.com", "nypost.com"]
FORUMS = ["reddit.com", "news.ycombinator.com", "stackoverflow.com", "stackexchange.com", "superuser.com", "serverfault.com", "quora.com", "discourse.org", "boards.4chan.org", "hackernews.com"]
MARKETS = ["amazon.com", "amazon.co.uk", "amazon.de", "ebay.com", "etsy.com", "walmart.com", "target.com", "bestbuy.com", "newegg.com", "aliexpress.com", "alibaba.com", "shopify.com"]
SOCIAL = ["twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com", "snapchat.com", "pinterest.com", "tumblr.com", "linkedin.com", "youtube.com", "twitch.tv", "discord.com"]
#: Public suffixes of two labels; all others are the last label.
DOUBLE_SUFFIXES = ("co.uk", "ac.uk", "gov.uk", "org.uk", "com.au", "co.jp", "com.br", "com.cn", "co.in", "co.nz", "com.mx", "com.tr")
#: Kinds of results.
RESULT_TYPES = ("organic", "ad", "answer_box", "featured_snippet", "knowledge_panel", "people_also_ask", "image", "video", "news", "shopping", "local")
ENGINES = ("google", "yandex", "baidu", "bing", "duckduckgo", "ecosia")
ALIASES = {"duck": "duckduckgo", "ddg": "duckduckgo"}


def content_type(url: Column) -> Column:
    """Kind of page by the address; the first rule that fits."""
    u = F.lower(url)
    has = lambda *xs: u.rlike("|".join(f"(?:{x})" for x in xs))
    return (
        F.when(has("/wiki/"), "article").when(u.endswith(".pdf") | has(r"\.pdf\?"), "document").when(has(r"/watch\?v=", "/videos?/"), "video")
        .when(has("/forum/", "/thread/", "/discussion/", "/t/", "/questions/", "/q/"), "forum_thread").when(has("/blog/", "/post/", "/article/", "/news/"), "article").otherwise("webpage")
    )


def source_hint(host: Column) -> Column:
    return F.coalesce(lookup(SOURCE_HINTS, host), F.lit(""))


def domain_info(host: Column) -> Column:
    """struct(tld, sld, is_gov, is_edu, is_mil, is_news, is_forum, is_marketplace, is_social)."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last_two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    double = last_two.isin(*DOUBLE_SUFFIXES) & (n > 2)
    tld = F.when(double, last_two).otherwise(F.element_at(labels, -1))
    sld = F.coalesce(F.get(labels, n - F.when(double, 3).otherwise(2)), F.lit(""))
    return F.struct(
        tld.alias("tld"), F.when(n > 1, sld).otherwise("").alias("sld"), ((tld == "gov") | host.endswith(".gov")).alias("is_gov"), ((tld == "edu") | (tld == "ac.uk") | host.endswith(".edu") | host.endswith(".ac.uk")).alias("is_edu"), (tld == "mil").alias("is_mil"),
        host.isin(*NEWS).alias("is_news"), host.isin(*FORUMS).alias("is_forum"), host.isin(*MARKETS).alias("is_marketplace"), host.isin(*SOCIAL).alias("is_social"),
    )


def enrich(rows: DataFrame, start: int = 0, limit: int = 10) -> DataFrame:
    """Adds id, normalised address, domain, display form, type, page and positions, kind of page, hint."""
    rank = F.col("rank")
    normal = normalize_url(F.col("url"))
    absolute = F.when(rank <= 0, 0).when((F.lit(start) > 0) & (rank > start), rank).otherwise(rank + start).cast("bigint")
    on_page = F.when(rank <= 0, 0).when((F.lit(start) > 0) & (rank > start), rank - start).otherwise(rank).cast("bigint")
    host = domain(F.col("url"))
    return rows.select(
        "query_id", "engine", "rank", "url", "title", "ad", result_id(F.col("engine"), normal).alias("result_id"), normal.alias("normalized"), host.alias("domain"), display_url(F.col("url")).alias("display_url"),
        F.when(F.col("ad"), "ad").when(rank <= 0, "answer_box").otherwise("organic").alias("type"), F.lit(start // max(limit, 1) + 1).cast("bigint").alias("page"), absolute.alias("absolute"), on_page.alias("on_page"),
        content_type(F.col("url")).alias("content_type"), source_hint(host).alias("source_hint"), F.concat(F.lit("https://www.google.com/s2/favicons?domain="), host).alias("favicon"),
    )


def image_description(text: Column) -> Column:
    """struct(page, thumb, width, height) from a description like "Height:1, Width:2, Source page: .., thumb_url: .."."""
    web = lambda c: F.when(c.rlike("^https?://"), c).otherwise("")
    page = F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)source page:\s*([^,]*)", 1), F.lit("")), F.regexp_extract(text, r"(?is)^\s*source:\s*(.*)$", 1)))
    page = F.when(F.lower(text).contains("source page:"), F.trim(F.regexp_extract(text, r"(?is)source page:([^,]*)", 1))).otherwise(page)
    thumb = F.trim(F.regexp_extract(text, r"(?i)thumb_url:\s*([^,]*)", 1))
    tall = [F.regexp_extract(text, r"(?i)height:\s*(\d+),\s*width:\s*(\d+)", i) for i in (1, 2)]
    wide = [F.regexp_extract(text, r"(?i)\b(\d+)x(\d+)\b", i) for i in (1, 2)]
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    return F.struct(web(page).alias("page"), web(thumb).alias("thumb"), F.coalesce(number(tall[1]), number(wide[0]), F.lit(0)).alias("width"), F.coalesce(number(tall[0]), number(wide[1]), F.lit(0)).alias("height"))


def first_of_url(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each address within one engine's page."""
    w = Window.partitionBy("query_id", "url").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedup(rows: DataFrame) -> DataFrame:
    """One row per normalised address and query: a positive rank first, then the lower rank, then the engine; numbered by rank, engine, address."""
    keyed = rows.withColumn("normalized", normalize_url(F.col("url"))).where("normalized <> ''")
    w = Window.partitionBy("query_id", "normalized").orderBy((F.col("rank") <= 0).cast("int"), "rank", "engine", "url")
    kept = keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy("rank", "engine", "url")
    return kept.withColumn("at", F.row_number().over(order).cast("bigint"))


def clusters(rows: DataFrame, engines_queried: int) -> DataFrame:
    """(query_id, cluster_id, url, domain, title, score, engines_count, best_rank, occurrences array<struct<engine,rank,result_id>>).

    score is the capped sum of 1 / rank by the number of engines asked, half up to 2 places; ranked() numbers the clusters of a query.
    """
    keyed = rows.withColumn("normalized", normalize_url(F.col("url"))).where("normalized <> ''")
    best = F.struct((F.col("rank") <= 0).cast("int").alias("late"), "rank", "engine")
    # summed as whole parts of a common denominator, so that the order of the sum does not matter
    part = F.round(1.0 / F.greatest("rank", F.lit(1)), 9).cast("decimal(20,9)")
    out = keyed.groupBy("query_id", "normalized").agg(F.sum(part).cast("double").alias("total"), F.count(F.lit(1)).alias("engines_count"), F.min_by("url", best).alias("url"), F.min_by("title", best).alias("title"), F.min_by("rank", best).alias("best_rank"),
        F.array_sort(F.collect_list(F.struct("engine", "rank", result_id(F.col("engine"), F.col("normalized")).alias("result_id")))).alias("occurrences"))
    score = F.floor(F.least(F.lit(1.0), F.col("total") / max(1, engines_queried)) * 100 + 0.5) / 100
    return out.select("query_id", cluster_id(F.col("normalized")).alias("cluster_id"), "url", domain(F.col("url")).alias("domain"), "title", score.alias("score"), "engines_count", "best_rank", "occurrences")


def ranked(found: DataFrame) -> DataFrame:
    """Clusters of each query numbered (at) by score, best rank and, among equals, id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "cluster_id")
    return found.withColumn("at", F.row_number().over(order).cast("bigint"))


def result_type(kind: Column) -> Column:
    """struct(type, warning): an unknown kind of result is organic, with a warning; else the warning is empty."""
    known = F.coalesce(kind.isin(*RESULT_TYPES), F.lit(False))
    return F.struct(F.when(known, kind).otherwise("organic").alias("type"), F.when(known, "").otherwise(F.concat(F.lit("unknown result type "), quoted(F.coalesce(kind, F.lit(""))), F.lit(", defaulting to organic"))).alias("warning"))


def merge_policy(rows: DataFrame, requested: list[str]) -> DataFrame:
    """Without merging: only the rows of the first requested engine that has any."""
    order = F.array_position(F.array(*[F.lit(e) for e in requested]), F.col("engine"))
    first = F.min(F.when(order > 0, order)).over(Window.partitionBy("query_id"))
    return rows.withColumn("_o", order).withColumn("_f", first).where("_o = _f").drop("_o", "_f")


def resolve_engines(text: Column) -> Column:
    """Known engines of a comma-separated list, aliases resolved, each once, in order."""
    names = F.transform(F.split(text, ","), lambda e: F.lower(F.trim(e)))
    full = F.transform(names, lambda e: F.coalesce(lookup(ALIASES, e), e))
    return F.array_distinct(F.filter(full, lambda e: e.isin(*ENGINES)))


def check_request(limit: Column, start: Column, text: Column, site: Column | None = None, file_type: Column | None = None) -> Column:
    """Error code of a request, null if it is fine: limit (null means 25), then start, then whether text, site and file type are all empty."""
    nothing = F.concat_ws("", text, *(c for c in (site, file_type) if c is not None)) == ""
    return F.when((F.coalesce(limit, F.lit(25)) < 1) | (F.coalesce(limit, F.lit(25)) > 100), "bad_limit").when(F.coalesce(start, F.lit(0)) < 0, "bad_start").when(nothing, "empty_query")


def page_class(html: Column) -> Column:
    """captcha, blocked, empty or ok."""
    h = F.lower(html)
    return F.when(h.rlike("captcha|unusual traffic|smartcaptcha|verify you are human"), "captcha").when(h.rlike("access denied|403 forbidden|too many requests"), "blocked").when(h.rlike("did not match any documents|no results|ничего не найдено|没有找到"), "empty").otherwise("ok")


#: Status and code of each kind of failure.
SEARCH_ERRORS = {
    "captcha": (429, "captcha_detected"), "blocked": (403, "blocked"), "rate_limited": (429, "rate_limited"), "search_timeout": (504, "search_timeout"), "proxy_auth": (503, "proxy_auth"), "proxy_connect": (503, "proxy_connect"), "proxy_timeout": (503, "proxy_timeout"),
    "proxy_unavailable": (503, "proxy_unavailable"), "parser": (502, "parser_failure"), "engine_internal": (502, "engine_internal"), "all_engines_failed": (502, "all_engines_failed"), "circuit_open": (503, "circuit_open"), "deadline_exceeded": (504, "request_timeout"), "canceled": (503, "request_canceled"),
}


def search_error(kind: Column) -> Column:
    """struct(status, code) of a kind of failure; any other kind is internal to the engine."""
    known = F.create_map(*[x for k, (s, c) in SEARCH_ERRORS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("status"), F.lit(c).alias("code")))])
    return F.coalesce(F.element_at(known, F.coalesce(kind, F.lit(""))), F.struct(F.lit(502).alias("status"), F.lit("engine_internal").alias("code")))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([*_`\[\]])", r"\\$1")


def render(rows: DataFrame, form: str = "markdown") -> DataFrame:
    """(query_id, body): the results of a query in order, as markdown, text, ndjson or json. rows are enriched and carry at."""
    if form in ("json", "ndjson"):
        line = F.to_json(F.struct(*[c for c in rows.columns if c != "query_id"]))
    elif form == "text":
        line = F.format_string("[%d] %s (%s)\nURL: %s\n", F.col("at"), F.col("title"), F.col("domain"), F.col("url"))
    else:
        line = F.format_string("## %d. %s\n\n**%s** · %s\n\n→ %s\n", F.col("at"), escape_markdown(F.col("title")), F.col("display_url"), F.col("type"), F.col("url"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"])
    body = F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")) if form == "json" else F.array_join(parts, "\n")
    return rows.groupBy("query_id").agg(body.alias("body"))


def response_format(asked: Column, accept: Column) -> Column:
    """struct(format, error): what was asked for by name, else by the Accept header, else json; any other name is an error."""
    name = F.trim(F.lower(F.coalesce(asked, F.lit(""))))
    a = F.lower(F.coalesce(accept, F.lit("")))
    name = F.when(name != "", name).when(a.contains("text/markdown"), "markdown").when(a.contains("text/plain"), "text").when(a.contains("application/x-ndjson"), "ndjson").otherwise("json")
    known = name.isin("json", "markdown", "text", "ndjson")
    return F.struct(F.when(known, name).alias("format"), F.when(~known, "UNKNOWN_FORMAT").alias("error"))


def pagination(results: Column, start: Column, limit: Column) -> Column:
    """struct(page, has_more, next_start) of so many results: there may be more if the page is full; a limit below 1 stands for 25."""
    limit = F.when(limit > 0, limit).otherwise(25)
    return F.struct((F.floor(start / limit) + 1).cast("bigint").alias("page"), (results >= limit).alias("has_more"), (start + limit).cast("bigint").alias("next_start"))


def quoted(text: Column) -> Column:
    """The text in double quotes, with those and backslashes inside escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def render_text(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, body): heads and rows as for render_markdown, in plain text: the query, engines asked and failed if any, then the results in order."""
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat("snippet", F.lit("\n"))).otherwise("")
    line = F.concat(F.lit("["), F.col("at").cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("domain"), F.lit(")\n"), snippet, F.lit("URL: "), F.col("url"), F.lit("\n\n"))
    body = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "").alias("results"))
    listed = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ", "), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("Search: "), F.col("text"), F.lit("\n"), listed("Engines: ", F.col("engines")), listed("Failed: ", F.col("failed")), F.lit("\n"))
    return heads.join(body, "query_id", "left").select("query_id", F.concat(head, F.coalesce("results", F.lit(""))).alias("body"))


def render_markdown(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, body) of heads (query_id, text, engines array, took_ms, failed array) and rows (query_id, at, title, display_url, type, ad, snippet, url).

    A heading, the engines that failed if any did, and the results in order; a query without results has its heading only.
    """
    kind = F.when(F.col("ad"), "ad").otherwise(F.col("type"))
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat("snippet", F.lit("\n\n"))).otherwise("")
    line = F.concat(F.lit("## "), F.col("at").cast("string"), F.lit(". "), escape_markdown(F.col("title")), F.lit("\n\n**"), F.col("display_url"), F.lit("** · "), kind, F.lit("\n\n"), snippet, F.lit("→ "), F.col("url"), F.lit("\n\n"))
    body = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "").alias("results"))
    head = F.concat(F.lit("# Search results for "), quoted(F.col("text")), F.lit("\n\n**Query:** "), F.col("text"), F.lit(" · **Engines:** "), F.array_join("engines", ", "), F.lit(" · **Took:** "), F.col("took_ms").cast("string"), F.lit("ms\n\n"))
    failed = F.when(F.size("failed") > 0, F.concat(F.lit("> ⚠️ Engines that failed: "), F.array_join("failed", ", "), F.lit("\n\n"))).otherwise("")
    return heads.join(body, "query_id", "left").select("query_id", F.concat(head, failed, F.coalesce("results", F.lit(""))).alias("body"))


#: Some rules of the public list of domain endings; * stands for any label, ! makes an exception.
SUFFIX_RULES = ["com", "org", "net", "edu", "gov", "mil", "de", "fr", "es", "uk", "co.uk", "ac.uk", "gov.uk", "org.uk", "jp", "co.jp", "kawasaki.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "br", "com.br", "au", "com.au"]


def suffix_table(spark, rules: list[str]) -> DataFrame:
    """(base, kind) of rules in the form of the public list."""
    rows = [(r.removeprefix("!").removeprefix("*."), "except" if r.startswith("!") else "wild" if r.startswith("*.") else "exact") for r in rules]
    return spark.createDataFrame(rows, "base string, kind string")


def with_suffix(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host) with tld, the longest ending that a rule (base, kind) names, and sld, the label before it.

    Endings are exploded and meet the rules by an equi-join; an exception goes before all others, and its ending is a label shorter.
    Without a rule the last label is the ending. A host that is itself an ending has the label before its last one as sld. Rules
    for which the table is small are sent to all tasks by the planner.
    """
    distinct = hosts.select("host").where("host is not null").distinct()
    labels = F.split("host", r"\.")
    ends = distinct.select("host", F.size(labels).alias("n"), F.posexplode(labels).alias("i", "_l")).select("host", "n", "i", F.array_join(F.slice(labels, F.col("i") + 1, F.col("n")), ".").alias("base"))
    met = ends.join(rules, "base")
    size = F.col("n") - F.col("i") + F.when(F.col("kind") == "wild", 1).when(F.col("kind") == "except", -1).otherwise(0)
    best = met.where((F.col("kind") != "wild") | (F.col("i") > 0)).groupBy("host").agg(F.max(F.when(F.col("kind") == "except", size)).alias("out"), F.max(size).alias("longest"))
    rows = hosts.join(best, "host", "left")
    n = F.size(labels)
    taken = F.coalesce("out", "longest", F.lit(1))
    before = n - F.when(taken >= n, 2).otherwise(taken + 1)
    return rows.withColumn("tld", F.array_join(F.slice(labels, n - taken + 1, taken), ".")).withColumn("sld", F.when(n > 1, F.get(labels, before)).otherwise("")).drop("out", "longest")
