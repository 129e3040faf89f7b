"""Queries over search-result rows and raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.operators import serp as P
from corpusloom.sources import model as M
from corpusloom.sources.files import page_results


HOSTS = ["irs.gov", "a.b.co.uk", "ox.ac.uk", "mit.edu", "army.mil", "bbc.co.uk", "x.com", "localhost", "co.uk", "health.gov.uk", "reddit.com", "amazon.de", "wsj.com", "a.b.c.example"]


def url_normalize(spark, d):
    """Page addresses with a tracking parameter, mixed case and a trailing slash put on."""
    url = F.regexp_replace("url", "#.*$", "")
    dirty = F.concat(F.when(F.col("page_id") % 2 == 0, F.regexp_replace(url, "^https?", "HTTPS")).otherwise(url), F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x&b=2&a=1"))
    return M.table(spark, d, "pages").select("page_id", U.normalize_url(dirty).alias("normalized"), U.domain(dirty).alias("domain"))


def serp_enrich(spark, d):
    return P.enrich(M.serp(spark, d), start=10, limit=10).select("query_id", "engine", "rank", "result_id", "domain", "type", "page", "absolute", "on_page", "content_type", "source_hint")


def serp_dedup(spark, d):
    return P.dedup(M.serp(spark, d)).select("query_id", "engine", "rank", "url", "at")


def serp_clusters(spark, d):
    return P.clusters(M.serp(spark, d), 6).drop("domain", "occurrences")


def serp_merge_policy(spark, d):
    rows = M.serp(spark, d).where("not (engine = 'baidu' and query_id % 2 = 0)")
    return P.merge_policy(rows, ["baidu", "google", "bing"]).select("query_id", "engine", "rank", "url")


def serp_first_url(spark, d):
    return P.first_of_url(M.serp(spark, d), ["rank", "engine"]).select("query_id", "engine", "rank", "url")


def placed(spark, d):
    return P.enrich(P.dedup(M.serp(spark, d)).drop("at", "normalized")).join(P.dedup(M.serp(spark, d)).select("query_id", "engine", "url", "at"), ["query_id", "engine", "url"])


def serp_markdown(spark, d):
    rows = placed(spark, d).withColumn("snippet", F.when(F.col("at") % 2 == 0, F.concat(F.lit("found by "), "engine")))
    heads = M.serp(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("engine")).alias("engines")).withColumn("text", F.concat(F.lit('say "'), F.col("query_id").cast("string"), F.lit('"')))
    heads = heads.withColumn("took_ms", F.col("query_id") * 7).withColumn("failed", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("bing"), F.lit("baidu"))).otherwise(F.array().cast("array<string>")))
    return P.render_markdown(rows, heads).select("query_id", F.md5("body").alias("body_md5"))


def serp_text(spark, d):
    rows = placed(spark, d).withColumn("snippet", F.when(F.col("at") % 2 == 0, F.concat(F.lit("found by "), "engine")))
    heads = M.serp(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("engine")).alias("engines")).withColumn("text", F.concat(F.lit("q "), F.col("query_id").cast("string")))
    heads = heads.withColumn("failed", F.when(F.col("query_id") % 2 == 0, F.array(F.lit("bing"), F.lit("baidu"))).otherwise(F.array().cast("array<string>")))
    return P.render_text(rows, heads).select("query_id", F.md5("body").alias("body_md5"))


def content_type_classify(spark, d):
    paths = F.array(*[F.lit(x) for x in ("/wiki/a", "/x.pdf?v", "/watch?v=1", "/t/5", "/blog/b", "/a")])
    url = F.concat(F.lit("https://e.org"), F.element_at(paths, (F.col("page_id") % 6 + 1).cast("int")))
    return M.table(spark, d, "pages").select("page_id", P.content_type(url).alias("kind"), P.content_type(F.col("url")).alias("own_kind"))


def domain_details(spark, d):
    """Every page by its own host, and once more by a given host, which tells the kinds apart."""
    hosts = F.array(*[F.lit(h) for h in HOSTS])
    given = F.element_at(hosts, (F.floor(F.col("page_id") / 2) % len(HOSTS) + 1).cast("int"))
    both = F.array(F.struct(F.lit(False).alias("given"), U.domain(F.col("url")).alias("host")), F.struct(F.lit(True).alias("given"), given.alias("host")))
    return M.table(spark, d, "pages").select("page_id", F.inline(both)).select("page_id", "given", P.domain_info(F.col("host")).alias("i")).select("page_id", "given", "i.*")


#: Languages and windows of requests, some of which no engine knows or takes.
LANGS = ["de", "en-GB", "", "pt", "zz", "fr_CA", "uk"]
WINDOWS = ["20240101..20240102", "", "20240105..20240101", "20240101..20240131", "", "20240101..20241301", "20240101"]


def _requests(spark, d):
    """Benchmark items as requests: text with dates in some, site, file type, language, start, limit and window by number."""
    n = F.col("item_id")
    given = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    text = F.concat(F.when(n % 5 == 4, "").otherwise(F.col("text")), F.when(n % 6 == 0, F.lit(" after:2024-01-01 Before:2024-01-31")).when(n % 6 == 1, F.lit(" before:2024-02-01 x")).otherwise(""))
    return M.table(spark, d, "benchmark").select(
        "item_id", text.alias("text"), F.when(n % 2 == 0, "e.org").otherwise("").alias("site"), F.when(n % 3 == 0, "pdf").when(n % 3 == 1, " Photo").otherwise("").alias("file"), given(LANGS).alias("lang"), (n % 4 * 10 - 10).alias("start"), (n % 3 * 10).alias("lim"), given(WINDOWS).alias("win"), (n % 2 == 0).alias("filtered")
    )


def search_urls(spark, d):
    """The address of each engine's result page for every request."""
    c = F.col
    cols = [U.search_url(e, c("text"), c("site"), c("file"), c("lang"), c("start"), c("lim"), c("win"), c("filtered")).alias(e) for e in P.ENGINES]
    return _requests(spark, d).select("item_id", *cols)


def image_addresses(spark, d):
    """The address of each engine's image page for every request."""
    c = F.col
    cols = [U.image_url(e, c("text"), c("site"), c("file"), c("lang"), c("lim"), c("win"), F.floor(F.greatest(c("start"), F.lit(0)) / 10)).alias(e) for e in P.ENGINES]
    return _requests(spark, d).select("item_id", *cols)


def page_classes(spark, d):
    return M.table(spark, d, "pages").select("page_id", P.page_class(F.col("html")).alias("class"))


def html_results(spark, d):
    return page_results(M.table(spark, d, "pages"))


QUERIES = {f.__name__: f for f in (url_normalize, serp_enrich, serp_dedup, serp_clusters, serp_merge_policy, serp_first_url, serp_markdown, serp_text, content_type_classify, domain_details, search_urls, image_addresses, page_classes, html_results)}

V = M.with_views
HOST = "regexp_replace(lower(regexp_extract({0}, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
KIND = (
    "CASE WHEN {0} LIKE '%/wiki/%' THEN 'article' WHEN {0} LIKE '%.pdf' OR {0} LIKE '%.pdf?%' THEN 'document' WHEN {0} LIKE '%/watch?v=%' OR {0} LIKE '%/video/%' OR {0} LIKE '%/videos/%' THEN 'video' "
    "WHEN {0} LIKE '%/forum/%' OR {0} LIKE '%/thread/%' OR {0} LIKE '%/discussion/%' OR {0} LIKE '%/t/%' OR {0} LIKE '%/questions/%' OR {0} LIKE '%/q/%' THEN 'forum_thread' WHEN {0} LIKE '%/blog/%' OR {0} LIKE '%/post/%' OR {0} LIKE '%/article/%' OR {0} LIKE '%/news/%' THEN 'article' ELSE 'webpage' END"
)
TRACKING = ", ".join(f"'{x}'" for x in U.TRACKING)


def norm(url: str, more: str = "[]") -> str:
    """Normal form of addresses without capitals and fragments: parameters sorted, tracking ones gone, no slash at the end."""
    kept = f"list_sort(list_filter(string_split(split_part({url}, '?', 2), '&') || {more}, lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ({TRACKING})))"
    whole = f"split_part({url}, '?', 1) || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    return f"(CASE WHEN regexp_matches({url}, '^[a-z]+://[^/?]+/([?]|$)') THEN {whole} ELSE regexp_replace({whole}, '/+$', '') END)"


HINTS = "CASE " + " ".join(f"WHEN h = '{k}' THEN '{v}'" for k, v in P.SOURCE_HINTS.items()) + " ELSE '' END"
#: Domain and parts of the path, cut to 60 letters.
CRUMB = f"(SELECT CASE WHEN length(c) > 60 THEN substring(c, 1, 59) || '…' ELSE c END FROM (SELECT array_to_string([{HOST.format('url')}] || list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> ''), ' › ') AS c))"
FIRST = f"SELECT query_id, engine, rank, url, title, ad, row_number() OVER (PARTITION BY query_id ORDER BY rank, engine, url) AS nr FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {norm('url')} ORDER BY CAST(rank <= 0 AS INT), rank, engine, url) AS n FROM serp) WHERE n = 1"


def _sql_map(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _sql_values(base: str, good: str, **values: str) -> str:
    """An address from the rules of its engine: names in order, a null value left out."""
    parts = ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '{k}=' || replace(url_encode({v}), '%20', '+') END" for k, v in sorted(values.items()))
    return f"CASE WHEN {good} THEN {base} || concat_ws('&', {parts}) END"


def _addresses() -> tuple[str, str]:
    """SQL of search_urls and image_addresses."""
    lists = {"LANGS": LANGS, "WINDOWS": WINDOWS}
    given = lambda name: "([" + ", ".join(f"'{v}'" for v in lists[name]) + f"])[item_id % {len(lists[name])} + 1]"
    r = (
        "r0 AS (SELECT item_id, CASE WHEN item_id % 5 = 4 THEN '' ELSE text END || CASE item_id % 6 WHEN 0 THEN ' after:2024-01-01 Before:2024-01-31' WHEN 1 THEN ' before:2024-02-01 x' ELSE '' END AS t, "
        "CASE WHEN item_id % 5 = 4 THEN '' ELSE CASE WHEN item_id % 6 < 2 THEN array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') ELSE text END END || CASE WHEN item_id % 6 = 1 AND item_id % 5 <> 4 THEN ' x' WHEN item_id % 6 = 1 THEN 'x' ELSE '' END AS bt, "
        "CASE WHEN item_id % 2 = 0 THEN ' site:e.org' ELSE '' END AS s, CASE item_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN ' Photo' ELSE '' END AS f, "
        f"lower(split_part(replace({given('LANGS')}, '_', '-'), '-', 1)) AS la, upper(split_part(replace({given('LANGS')}, '_', '-'), '-', 2)) AS co, item_id % 4 * 10 - 10 AS st, item_id % 3 * 10 AS li, {given('WINDOWS')} AS w FROM benchmark), "
        "r1 AS (SELECT *, t || s || CASE WHEN f <> '' THEN ' filetype:' || f ELSE '' END AS q, bt || s || CASE WHEN f <> '' THEN ' filetype:' || f ELSE '' END AS bq, nullif(la, '') AS l, w <> '' AS g, "
        "try_cast(try_strptime(split_part(w, '..', 1), '%Y%m%d') AS DATE) AS d1, try_cast(try_strptime(split_part(w, '..', 2), '%Y%m%d') AS DATE) AS d2 FROM r0), "
        f"r2 AS (SELECT *, CASE WHEN l IS NULL THEN NULL WHEN co <> '' THEN lower(co) ELSE coalesce({_sql_map('l', U.GOOGLE_COUNTRY)}, CASE WHEN {_sql_map('l', U.GOOGLE_PAGES)} IS NOT NULL THEN l END, 'us') END AS gc, CASE WHEN l IS NULL THEN NULL WHEN co <> '' THEN co ELSE coalesce({_sql_map('l', U.BING_COUNTRY)}, 'US') END AS bc, "
        f"coalesce({_sql_map("l || '-' || lower(co)", U.DUCK_REGIONS)}, {_sql_map('l', U.DUCK_REGIONS)}) AS kl, d1 IS NOT NULL AND d2 IS NOT NULL AS ok, d1 <= d2 AS fwd, CASE WHEN NOT g THEN NULL WHEN d2 - d1 <= 1 THEN 'day' WHEN d2 - d1 <= 7 THEN 'week' WHEN d2 - d1 <= 31 THEN 'month' END AS fr FROM r1)"
    )
    google = f"'https://www.google.' || coalesce({_sql_map('gc', U.GOOGLE_PAGES)}, {_sql_map('l', U.GOOGLE_PAGES)}, 'com') || '/search?'"
    two = "(NOT g OR contains(w, '..'))"
    tbs = "CASE WHEN g THEN 'cdr:1,cd_min:' || split_part(w, '..', 1) || ',cd_max:' || split_part(w, '..', 2) END"
    num = "CASE WHEN li <> 0 THEN CAST(li AS VARCHAR) END"
    start = "CASE WHEN st > 0 THEN CAST(st AS VARCHAR) END"
    iso = "CASE WHEN g THEN strftime(d1, '%Y-%m-%d') || '..' || strftime(d2, '%Y-%m-%d') END"
    days = "CASE WHEN g THEN 'ex1:\"ez5_' || (d1 - DATE '1970-01-01') || '_' || (d2 - DATE '1970-01-01') || '\"' WHEN item_id % 6 = 0 THEN 'ex1:\"ez5_19723_19753\"' END"
    market = {"setlang": "l", "cc": "bc", "mkt": "l || '-' || bc"}
    gl = {"hl": "l", "gl": "gc", "lr": "'lang_' || l", "pws": "'0'", "nfpr": "'1'"}
    web = {
        "google": _sql_values(google, f"q <> '' AND st >= 0 AND {two}", q="q", oq="q", tbs=tbs, num=num, start=start, filter="CASE WHEN item_id % 2 = 1 THEN '0' END", sourceid="'chrome'", ie="'UTF-8'", **gl),
        "yandex": _sql_values("'https://www.yandex.com/search/?'", "q <> '' AND st >= 0", text="t || s || CASE WHEN f <> '' THEN ' mime:' || f ELSE '' END || CASE WHEN g THEN ' date:' || w ELSE '' END || coalesce(' lang:' || l, '')", p="CAST(st // 10 AS VARCHAR)"),
        "baidu": _sql_values("'https://www.baidu.com/s?'", "q <> '' AND st >= 0 AND (NOT g OR ok)", wd="q", gpc="CASE WHEN g THEN 'stf=' || (d1 - DATE '1970-01-01') * 86400 || ',' || (d2 - DATE '1970-01-01') * 86400 || '|stftype=2' END", rn=num, pn=start, f="'8'", ie="'utf-8'"),
        "bing": _sql_values("'https://www.bing.com/search?'", "bq <> '' AND st >= 0 AND (NOT g OR (ok AND fwd))", q="bq", pq="bq", first="CASE WHEN st > 0 THEN CAST(st + 1 AS VARCHAR) END", count="CASE WHEN st <= 0 AND li > 0 THEN CAST(li AS VARCHAR) END", filters=days, form="'QBLH'", qs="'HS'", sp="'-1'", **market),
        "duckduckgo": _sql_values("'https://duckduckgo.com?'", "q <> '' AND (NOT g OR ok)", q="q", df=iso, kl="kl", t="'h'", ia="'web'"),
        "ecosia": _sql_values("'https://www.ecosia.org/search?'", "trim(q) <> '' AND st >= 0 AND (NOT g OR (ok AND fwd))", method="'index'", q="q", freshness="fr", p="CASE WHEN st >= 10 THEN CAST(st // 10 AS VARCHAR) END"),
    }
    page = "greatest(st, 0) // 10"
    image = {
        "google": _sql_values(google, f"q <> '' AND {two}", tbm="'isch'", q="q", oq="q", tbs=tbs, num=num, **gl),
        "yandex": _sql_values("'https://www.yandex.com/images/search/?'", "t <> ''", text="t || CASE WHEN g THEN ' date:' || w ELSE '' END", p=f"CAST({page} AS VARCHAR)", site="CASE WHEN s <> '' THEN 'e.org' END", itype="nullif(f, '')"),
        "baidu": _sql_values("'https://image.baidu.com/search/acjson?'", "t <> ''", tn="'resultjson_com'", cl="'2'", word="t", rn="CASE WHEN li <> 0 THEN '30' END", pn=f"CASE WHEN li <> 0 THEN CAST({page} * 30 AS VARCHAR) END", fp="'result'", ipn="'rj'", ie="'utf-8'", oe="'utf-8'"),
        "bing": _sql_values("'https://www.bing.com/images/search?'", "t || s <> ''", q="t || s", form="'HDRSC2'", first="'1'", scenario="'ImageBasicHover'", **market),
        "duckduckgo": _sql_values("'https://duckduckgo.com?'", "q <> '' AND (NOT g OR ok)", t="'h'", iax="'images'", ia="'images'", q="q", df=iso, kl="kl"),
        "ecosia": _sql_values("'https://www.ecosia.org/images?'", "trim(t || s) <> '' AND (NOT g OR (ok AND fwd)) AND f <> 'pdf'", q="t || s", freshness="fr", imageType="CASE WHEN f <> '' THEN 'photo' END", p=f"CASE WHEN {page} > 0 THEN CAST({page} AS VARCHAR) END"),
    }
    return tuple(f"WITH {r} SELECT item_id, " + ", ".join(f"{sql} AS {engine}" for engine, sql in kind.items()) + " FROM r2" for kind in (web, image))


SEARCH_SQL, IMAGE_SQL = _addresses()
ORACLE_SQL = {
    "search_urls": SEARCH_SQL,
    "image_addresses": IMAGE_SQL,
    "serp_markdown": V(
        f"WITH f AS ({FIRST}), r AS (SELECT query_id, string_agg('## ' || nr || '. ' || title || chr(10) || chr(10) || '**' || {CRUMB} || '** · ' || CASE WHEN ad THEN 'ad' ELSE 'organic' END || chr(10) || chr(10) || CASE WHEN nr % 2 = 0 THEN 'found by ' || engine || chr(10) || chr(10) ELSE '' END || '→ ' || url || chr(10) || chr(10), '' ORDER BY nr) AS results FROM f GROUP BY 1), "
        "h AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT engine)), ', ') AS engines FROM serp GROUP BY 1) "
        "SELECT query_id, md5('# Search results for \"say \\\"' || query_id || '\\\"\"' || chr(10) || chr(10) || '**Query:** say \"' || query_id || '\" · **Engines:** ' || engines || ' · **Took:** ' || query_id * 7 || 'ms' || chr(10) || chr(10) || CASE WHEN query_id % 2 = 0 THEN '> ⚠️ Engines that failed: bing, baidu' || chr(10) || chr(10) ELSE '' END || results) AS body_md5 FROM h JOIN r USING (query_id)",
        "serp",
    ),
    "serp_text": V(f"WITH f AS ({FIRST}), r AS (SELECT query_id, string_agg('[' || nr || '] ' || title || ' (' || {HOST.format('url')} || ')' || chr(10) || CASE WHEN nr % 2 = 0 THEN 'found by ' || engine || chr(10) ELSE '' END || 'URL: ' || url || chr(10) || chr(10), '' ORDER BY nr) AS results FROM f GROUP BY 1), h AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT engine)), ', ') AS engines FROM serp GROUP BY 1) SELECT query_id, md5('Search: q ' || query_id || chr(10) || 'Engines: ' || engines || chr(10) || CASE WHEN query_id % 2 = 0 THEN 'Failed: bing, baidu' || chr(10) ELSE '' END || chr(10) || results) AS body_md5 FROM h JOIN r USING (query_id)", "serp"),
    "url_normalize": f"SELECT page_id, regexp_replace({norm("regexp_replace(url, '#.*$', '')", "['b=2', 'a=1']")}, '^http:', CASE WHEN page_id % 2 = 0 THEN 'https:' ELSE 'http:' END) AS normalized, {HOST.format('url')} AS domain FROM pages",
    "serp_enrich": V(f"WITH s AS (SELECT *, {norm('url')} AS norm, {HOST.format('url')} AS h FROM serp) SELECT query_id, engine, rank, 's_' || substring(md5(engine || '|' || norm), 1, 16) AS result_id, h AS domain, CASE WHEN ad THEN 'ad' ELSE 'organic' END AS type, CAST(2 AS BIGINT) AS page, CASE WHEN rank > 10 THEN rank ELSE rank + 10 END AS absolute, CASE WHEN rank > 10 THEN rank - 10 ELSE rank END AS on_page, {KIND.format('lower(url)')} AS content_type, {HINTS} AS source_hint FROM s", "serp"),
    "serp_dedup": V(f"SELECT query_id, engine, rank, url, row_number() OVER (PARTITION BY query_id ORDER BY rank, engine, url) AS at FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {norm('url')} ORDER BY CAST(rank <= 0 AS INT), rank, engine, url) AS n FROM serp) WHERE n = 1", "serp"),
    "domain_details": f"WITH h AS (SELECT page_id, false AS given, {HOST.format('url')} AS host FROM pages UNION ALL SELECT page_id, true AS given, ([{', '.join(repr(h) for h in HOSTS)}])[(page_id // 2) % {len(HOSTS)} + 1] AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS p, len(string_split(host, '.')) AS n FROM h), k AS (SELECT *, n > 2 AND p[n - 1] || '.' || p[n] IN ({', '.join(repr(x) for x in P.DOUBLE_SUFFIXES)}) AS dbl FROM l), t AS (SELECT page_id, given, host, CASE WHEN dbl THEN p[n - 1] || '.' || p[n] ELSE p[n] END AS tld, CASE WHEN n = 1 THEN '' WHEN dbl THEN p[n - 2] ELSE p[n - 1] END AS sld FROM k) SELECT page_id, given, tld, sld, (tld = 'gov' OR suffix(host, '.gov')) AS is_gov, (tld IN ('edu', 'ac.uk') OR suffix(host, '.edu') OR suffix(host, '.ac.uk')) AS is_edu, tld = 'mil' AS is_mil, {', '.join(f"host IN ({', '.join(repr(x) for x in names)}) AS is_{kind}" for kind, names in (('news', P.NEWS), ('forum', P.FORUMS), ('marketplace', P.MARKETS), ('social', P.SOCIAL)))} FROM t",
    "serp_clusters": V(f"WITH s AS (SELECT *, {norm('url')} AS norm FROM serp), g AS (SELECT query_id, norm, sum(CAST(round(1.0::DOUBLE / greatest(rank, 1), 9) AS DECIMAL(20, 9))) AS total, count(*) AS engines_count, arg_min(url, (rank, engine)) AS url, arg_min(title, (rank, engine)) AS title, min(rank) AS best_rank FROM s GROUP BY 1, 2) SELECT query_id, 'c_' || substring(md5(norm), 1, 16) AS cluster_id, url, title, floor(least(1.0::DOUBLE, CAST(total AS DOUBLE) / 6) * 100 + 0.5) / 100 AS score, engines_count, best_rank FROM g", "serp"),
    "serp_merge_policy": V("WITH s AS (SELECT *, CASE engine WHEN 'baidu' THEN 1 WHEN 'google' THEN 2 WHEN 'bing' THEN 3 END AS o FROM serp WHERE NOT (engine = 'baidu' AND query_id % 2 = 0)) SELECT query_id, engine, rank, url FROM (SELECT *, min(o) OVER (PARTITION BY query_id) AS f FROM s) WHERE o = f", "serp"),
    "serp_first_url": V("SELECT query_id, engine, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank, engine) AS n FROM serp) WHERE n = 1", "serp"),
    "content_type_classify": f"SELECT page_id, {KIND.format('u')} AS kind, {KIND.format('lower(url)')} AS own_kind FROM (SELECT page_id, url, 'https://e.org' || (['/wiki/a', '/x.pdf?v', '/watch?v=1', '/t/5', '/blog/b', '/a'])[page_id % 6 + 1] AS u FROM pages)",
    "page_classes": "SELECT page_id, CASE WHEN regexp_matches(lower(html), 'captcha|unusual traffic|smartcaptcha|verify you are human') THEN 'captcha' WHEN regexp_matches(lower(html), 'access denied|403 forbidden|too many requests') THEN 'blocked' WHEN regexp_matches(lower(html), 'did not match any documents|no results|ничего не найдено|没有找到') THEN 'empty' ELSE 'ok' END AS class FROM pages",
}
