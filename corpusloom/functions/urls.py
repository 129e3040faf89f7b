"""URL columns: normalising, domains, display forms and identifiers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "_ga")
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def unwrap_redirect(url: Column) -> Column:
    """The target of a click redirect (u=a1<base64url>) if it is an http(s) address, else the address itself."""
    code = F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]*)", 1)
    plain = F.translate(code, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), (F.lit(4) - F.length(plain) % 4) % 4))
    target = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(F.contains(url, F.lit("bing.com/ck/a")) & (code != "") & target.rlike("^https?://"), target).otherwise(url)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, tracking parameters gone, the rest sorted by name, no trailing slash but the root's."""
    u = unwrap_redirect(url)
    scheme, host, path, query, fragment = (part(u, i) for i in range(1, 6))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.substring_index(p, "=", 1).isin(*TRACKING))
    # by name, and values of one name in their order
    named = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p"))))
    joined = F.array_join(F.transform(named, lambda s: s["p"]), "&")
    out = F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(F.contains(u, F.lit("//")) & (host != ""), F.concat(F.lit("//"), F.lower(host))).otherwise(""), path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(url == "", url).when((path != "/") & out.endswith("/"), F.regexp_replace(out, "/+$", "")).otherwise(out)


def domain(url: Column) -> Column:
    """Host without user, port and a leading www."""
    host = F.regexp_extract(part(url, 2), r"(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def display_url(url: Column, most: int = 60) -> Column:
    """domain › path › parts, cut to most letters (letters, not bytes) with an ellipsis."""
    parts = F.filter(F.split(part(url, 3), "/"), lambda p: p != "")
    crumb = F.concat_ws(" › ", F.concat(F.array(domain(url)), parts))
    return F.when(F.length(crumb) > most, F.concat(F.substring(crumb, 1, most - 1), F.lit("…"))).otherwise(crumb)


def result_id(engine: Column, normalized: Column) -> Column:
    return F.concat(F.lit("s_"), F.substring(F.md5(F.concat(engine, F.lit("|"), normalized)), 1, 16))


def cluster_id(normalized: Column) -> Column:
    return F.concat(F.lit("c_"), F.substring(F.md5(normalized), 1, 16))


def mask_credentials(text: Column) -> Column:
    """Addresses with credentials in a text become scheme and host, or invalid-proxy if no proxy has such an address; signs after an address stay."""
    marked = F.regexp_replace(text, r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/@]+(?::[^\s/@]*)?@[^\s]+", "\x00$0\x00")

    def masked(piece: Column) -> Column:
        plain = F.regexp_replace(piece, r"[.,;)\]}]+$", "")
        scheme, host = F.lower(F.regexp_extract(plain, "^([^:]*)://", 1)), F.regexp_extract(plain, r"://(?:[^/?#]*@)?([^/?#@]*)", 1)
        good = scheme.isin("http", "https", "socks5", "socks5h") & (host != "")
        return F.concat(F.when(good, F.concat(scheme, F.lit("://"), host)).otherwise("invalid-proxy"), F.substr(piece, F.length(plain) + 1, F.length(piece)))

    # every second piece is an address
    return F.array_join(F.transform(F.split(marked, "\x00"), lambda p, i: F.when(i % 2 == 1, masked(p)).otherwise(p)), "")


def query_hash(text: Column, site: Column, file: Column, lang: Column, date: Column) -> Column:
    return F.md5(F.lower(F.trim(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (text, site, file, lang, date))))))


def cache_key(*, engine: Column, action: Column, text: Column, lang: Column, dates: Column, file: Column, site: Column, limit: Column, start: Column, filtered: Column, answers: Column, country: Column, kind: Column, provider: Column) -> Column:
    """The key of a response: all that changes it, in this order. Without a proxy's country the language stands for its market."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    market = [F.coalesce(F.nullif(plain(country), F.lit("")), plain(lang)), plain(kind), plain(provider)]
    fields = [engine, action, text, lang, dates, file, site, limit, start, filtered, answers]
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in fields], *market), 256)


def mega_key(*, engines: Column, mode: Column, merge: Column, dedupe: Column, **request: Column) -> Column:
    """cache_key of a request to several engines: how they are asked and merged, and their names, each once and in order, stand for the engine."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(engines, lambda e: F.lower(F.trim(e))))), ",")
    return cache_key(engine=F.concat_ws(":", F.lit("mega"), mode, merge.cast("string"), dedupe.cast("string"), names), **request)


def bypasses_cache(*, proxy: Column, override: Column, country: Column, kind: Column, provider: Column) -> Column:
    """A proxy is named, but nothing tells its market."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return ~(empty(proxy) & empty(override)) & empty(country) & empty(kind) & empty(provider)


#: The country a bare language stands for.
COUNTRY = {"en": "US", "de": "DE", "fr": "FR", "es": "ES", "it": "IT", "ru": "RU", "pt": "BR", "ja": "JP", "zh": "CN", "ko": "KR", "hi": "IN", "pl": "PL", "nl": "NL", "tr": "TR", "ar": "SA", "uk": "UA", "kk": "KZ"}
#: Time zones of countries.
ZONES = {
    "US": "America/New_York", "GB": "Europe/London", "DE": "Europe/Berlin", "FR": "Europe/Paris", "ES": "Europe/Madrid", "IT": "Europe/Rome", "RU": "Europe/Moscow", "BR": "America/Sao_Paulo",
    "JP": "Asia/Tokyo", "CN": "Asia/Shanghai", "KR": "Asia/Seoul", "IN": "Asia/Kolkata", "AU": "Australia/Sydney", "CA": "America/Toronto", "MX": "America/Mexico_City", "PL": "Europe/Warsaw",
    "NL": "Europe/Amsterdam", "TR": "Europe/Istanbul", "AR": "America/Argentina/Buenos_Aires", "SA": "Asia/Riyadh", "BE": "Europe/Brussels", "KZ": "Asia/Almaty", "UA": "Europe/Kyiv",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def locale(code: Column) -> Column:
    """struct(language, country, tag, timezone, accept_language) of a code like de, de_AT or pt-BR; nulls where nothing is known."""
    bits = F.split(F.replace(F.trim(code), F.lit("_"), F.lit("-")), "-")
    language = F.nullif(F.lower(F.trim(F.get(bits, F.lit(0)))), F.lit(""))
    country = F.nullif(F.upper(F.trim(F.get(bits, F.lit(1)))), F.lit(""))
    full = F.coalesce(country, lookup(COUNTRY, language))
    tag = F.when(full.isNull(), language).otherwise(F.concat_ws("-", language, full))
    accept = F.when(full.isNull(), language).otherwise(F.concat(tag, F.lit(","), language, F.lit(";q=0.9")))
    zone = F.coalesce(lookup(ZONES, country), lookup(ZONES, lookup(COUNTRY, language)))
    return F.struct(language.alias("language"), country.alias("country"), tag.alias("tag"), zone.alias("timezone"), accept.alias("accept_language"))


#: Countries whose pages Google has below com and below co; it has those of all others in COUNTRY_PAGES below their code.
BELOW_COM = ["af", "ag", "ai", "ar", "au", "bd", "bh", "bn", "bo", "br", "bz", "kh", "co", "cu", "cy", "do", "ec", "eg", "et", "fj", "gh", "gi", "gt", "hk", "jm", "kw", "lb", "lc", "ly", "mm", "mt", "mx", "my", "na", "nf", "ng", "ni", "np", "om", "pa", "pe", "ph", "pk", "pg", "pr", "py", "qa", "sa", "sb", "sg", "sl", "sv", "tj", "tr", "tw", "ua", "uy", "vc", "vn"]
BELOW_CO = ["ao", "bw", "ck", "cr", "id", "il", "in", "jp", "ke", "kr", "ls", "ma", "mz", "nz", "th", "tz", "ug", "uk", "uz", "ve", "vi", "za", "zm", "zw"]
COUNTRY_PAGES = [
    "ac", "ad", "ae", "al", "am", "as", "at", "az", "ba", "be", "bf", "bg", "bi", "bj", "bs", "bt", "by", "ca", "cc", "cd", "cf", "cat", "cg", "ch", "ci", "cl", "cm", "cn", "cv", "cz", "de", "dj", "dk", "dm", "dz", "ee", "es", "fi", "fm", "fr", "ga", "ge", "gf", "gg", "gl", "gm", "gp", "gr", "gy", "hn", "hr", "ht", "hu",
    "iq", "ie", "im", "io", "is", "it", "je", "jo", "ki", "kg", "kz", "la", "li", "lk", "lt", "lu", "lv", "md", "me", "mg", "mk", "ml", "mn", "ms", "mu", "mv", "mw", "ne", "nl", "no", "nr", "nu", "pl", "pn", "ps", "pt", "ro", "rs", "ru", "rw", "sc", "se", "sh", "si", "sk", "sn", "sm", "so", "st", "td", "tg", "tk", "tl", "tm", "to", "tn", "tt", "vg", "vu", "ws",
]
GOOGLE_PAGES = {c: c for c in COUNTRY_PAGES} | {c: f"com.{c}" for c in BELOW_COM} | {c: f"co.{c}" for c in BELOW_CO} | {"en": "com", "gb": "co.uk"}
#: Countries that Google, and Bing, take for a bare language.
GOOGLE_COUNTRY = {"en": "us", "pt": "br", "zh": "cn", "ja": "jp", "ko": "kr"}
BING_COUNTRY = {"en": "US", "de": "DE", "ru": "RU", "fr": "FR", "es": "ES", "it": "IT", "pt": "BR", "zh": "CN", "ja": "JP", "ko": "KR", "nl": "NL", "pl": "PL", "tr": "TR", "ar": "SA"}
#: DuckDuckGo's regions.
DUCK_REGIONS = {
    "en": "us-en", "en-us": "us-en", "en-gb": "uk-en", "en-au": "au-en", "en-ca": "ca-en", "de": "de-de", "de-at": "at-de", "de-ch": "ch-de", "fr": "fr-fr", "fr-ca": "ca-fr", "fr-be": "be-fr", "fr-ch": "ch-fr", "es": "es-es", "es-mx": "mx-es", "es-ar": "ar-es", "it": "it-it", "nl": "nl-nl", "nl-be": "be-nl", "pt": "pt-pt", "pt-br": "br-pt",
    "ru": "ru-ru", "pl": "pl-pl", "cs": "cz-cs", "sk": "sk-sk", "hu": "hu-hu", "ro": "ro-ro", "da": "dk-da", "sv": "se-sv", "no": "no-no", "fi": "fi-fi", "tr": "tr-tr", "el": "gr-el", "he": "il-he", "ar": "xa-ar", "zh": "cn-zh", "zh-cn": "cn-zh", "zh-tw": "tw-zh", "ja": "jp-ja", "ko": "kr-ko",
}
#: Ecosia's kinds of images.
ECOSIA_IMAGES = ["clipart", "photo", "line", "animatedgif", "transparent"]
#: Results on a page of engines that count pages.
PAGE_SIZE = 10


def encoded(**values: Column) -> Column:
    """name=value of the non-null ones in order of names, percent-encoded with + for a space, joined by &."""
    escaped = lambda v: F.replace(F.replace(F.url_encode(v), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat_ws("&", *[F.when(values[k].isNotNull(), F.concat(F.lit(f"{k}="), escaped(values[k]))) for k in sorted(values)])


def with_operators(text: Column, site: Column, file: Column, file_operator: str = "filetype:") -> Column:
    """The text with its operators, a space before each."""
    return F.concat(F.coalesce(text, F.lit("")), F.when(site != "", F.concat(F.lit(" site:"), site)).otherwise(""), F.when(file != "", F.concat(F.lit(f" {file_operator}"), file)).otherwise(""))


def window_days(window: Column) -> Column:
    """struct(given, parts, first, last, ok) of YYYYMMDD..YYYYMMDD: ok if both are days."""
    bits = F.split(F.coalesce(window, F.lit("")), r"\.\.")
    day = lambda i: F.try_to_timestamp(F.when(F.get(bits, F.lit(i)).rlike(r"^\d{8}$"), F.get(bits, F.lit(i))), F.lit("yyyyMMdd")).cast("date")
    first, last = day(0), day(1)
    return F.struct((F.coalesce(window, F.lit("")) != "").alias("given"), F.size(bits).alias("parts"), first.alias("first"), last.alias("last"), (first.isNotNull() & last.isNotNull() & (F.size(bits) == 2)).alias("ok"))


def freshness(w: Column) -> Column:
    span = F.datediff(w["last"], w["first"])
    return F.when(w["given"], F.when(span <= 1, "day").when(span <= 7, "week").when(span <= 31, "month"))


def google_locale(lang: Column) -> tuple[Column, Column, Column]:
    """Language, country and the ending of Google's address for it."""
    own = locale(lang)
    language = own["language"]
    country = F.coalesce(F.lower(own["country"]), lookup(GOOGLE_COUNTRY, language), F.when(lookup(GOOGLE_PAGES, language).isNotNull(), language), F.when(language.isNotNull(), F.lit("us")))
    return language, country, F.coalesce(lookup(GOOGLE_PAGES, country), lookup(GOOGLE_PAGES, language), F.lit("com"))


def duck_region(lang: Column) -> Column:
    own = locale(lang)
    return F.coalesce(lookup(DUCK_REGIONS, F.concat_ws("-", own["language"], F.lower(own["country"]))), lookup(DUCK_REGIONS, own["language"]))


def bing_market(lang: Column) -> dict[str, Column]:
    own = locale(lang)
    language = own["language"]
    country = F.coalesce(own["country"], F.when(language.isNotNull(), F.coalesce(lookup(BING_COUNTRY, language), F.lit("US"))))
    return {"setlang": language, "cc": country, "mkt": F.when(language.isNotNull(), F.concat(language, F.lit("-"), country))}


def search_url(engine: str, text: Column, site: Column, file: Column, lang: Column, start: Column, limit: Column, window: Column, filtered: Column | None = None) -> Column:
    """Address of a result page of one engine; null if there is nothing to ask for, the start is negative or the window (YYYYMMDD..YYYYMMDD or empty) is none.

    A limit of 0 is left out; filtered false asks for similar results too, where an engine can.
    """
    w = window_days(window)
    # the parts of the window are worked out once
    return F.get(F.transform(F.array(w), lambda v: _search_url(engine, text, site, file, lang, start, limit, v, window, filtered)), F.lit(0))


def _search_url(engine: str, text: Column, site: Column, file: Column, lang: Column, start: Column, limit: Column, w: Column, window: Column, filtered: Column | None) -> Column:
    asked = with_operators(text, site, file)
    at, many = F.when(start > 0, start.cast("string")), F.when(limit != 0, limit.cast("string"))
    good = (asked != "") & (start >= 0)
    ordered = ~w["given"] | (w["ok"] & (w["first"] <= w["last"]))
    if engine == "google":
        language, country, ending = google_locale(lang)
        dates = F.when(w["given"], F.concat(F.lit("cdr:1,cd_min:"), F.split_part(window, F.lit(".."), F.lit(1)), F.lit(",cd_max:"), F.split_part(window, F.lit(".."), F.lit(2))))
        similar = F.lit(None).cast("string") if filtered is None else F.when(~filtered, "0")
        values = encoded(q=asked, oq=asked, tbs=dates, num=many, start=at, filter=similar, hl=language, gl=country, lr=F.concat(F.lit("lang_"), language), pws=F.lit("0"), nfpr=F.lit("1"), sourceid=F.lit("chrome"), ie=F.lit("UTF-8"))
        return F.when(good & (~w["given"] | (w["parts"] == 2)), F.concat(F.lit("https://www.google."), ending, F.lit("/search?"), values))
    if engine == "bing":
        # dates inside the text are taken out; both ends are needed to be a window, and one of its own wins
        marks = lambda name: F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(rf"(?i)\b{name}:(\d{{4}}-\d{{2}}-\d{{2}})\b"), F.lit(1))), -1)
        dated = text.rlike(r"(?i)\b(?:after|before):\d{4}-\d{2}-\d{2}\b")
        plain = F.when(dated, F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\b(?:after|before):\d{4}-\d{2}-\d{2}\b", ""), r"\s+", " "))).otherwise(F.coalesce(text, F.lit("")))
        both = F.when((marks("after") != "") & (marks("before") != ""), F.concat(F.replace(marks("after"), F.lit("-")), F.lit(".."), F.replace(marks("before"), F.lit("-"))))
        inside = window_days(both)
        own = F.when(w["given"], w).otherwise(inside)
        dates = F.when(own["given"], F.concat(F.lit('ex1:"ez5_'), F.unix_date(own["first"]), F.lit("_"), F.unix_date(own["last"]), F.lit('"')))
        fine = lambda v: ~v["given"] | (v["ok"] & (v["first"] <= v["last"]))
        full = with_operators(plain, site, file)
        values = encoded(q=full, pq=full, **bing_market(lang), first=F.when(start > 0, (start + 1).cast("string")), count=F.when((start <= 0) & (limit > 0), limit.cast("string")), filters=dates, form=F.lit("QBLH"), qs=F.lit("HS"), sp=F.lit("-1"))
        return F.when((full != "") & (start >= 0) & fine(inside) & fine(own), F.concat(F.lit("https://www.bing.com/search?"), values))
    if engine == "baidu":
        day = lambda d: F.unix_date(d).cast("bigint") * 86_400
        dates = F.when(w["given"], F.concat(F.lit("stf="), day(w["first"]), F.lit(","), day(w["last"]), F.lit("|stftype=2")))
        return F.when(good & (~w["given"] | w["ok"]), F.concat(F.lit("https://www.baidu.com/s?"), encoded(wd=asked, gpc=dates, rn=many, pn=at, f=F.lit("8"), ie=F.lit("utf-8"))))
    page = F.floor(start / PAGE_SIZE).cast("string")
    if engine == "yandex":
        words = F.concat(with_operators(text, site, file, "mime:"), F.when(w["given"], F.concat(F.lit(" date:"), window)).otherwise(""), F.coalesce(F.concat(F.lit(" lang:"), locale(lang)["language"]), F.lit("")))
        return F.when(good, F.concat(F.lit("https://www.yandex.com/search/?"), encoded(text=words, p=page)))
    if engine == "duckduckgo":
        dates = F.when(w["given"], F.concat(F.date_format(w["first"], "yyyy-MM-dd"), F.lit(".."), F.date_format(w["last"], "yyyy-MM-dd")))
        return F.when((asked != "") & (~w["given"] | w["ok"]), F.concat(F.lit("https://duckduckgo.com?"), encoded(q=asked, df=dates, kl=duck_region(lang), t=F.lit("h"), ia=F.lit("web"))))
    if engine == "ecosia":
        return F.when((F.trim(asked) != "") & (start >= 0) & ordered, F.concat(F.lit("https://www.ecosia.org/search?"), encoded(method=F.lit("index"), q=asked, freshness=freshness(w), p=F.when(start >= PAGE_SIZE, page))))
    raise ValueError(engine)


def image_url(engine: str, text: Column, site: Column, file: Column, lang: Column, limit: Column, window: Column, page: Column) -> Column:
    """Address of an image result page of one engine, null where search_url is; pages count from 0."""
    return F.get(F.transform(F.array(window_days(window)), lambda w: _image_url(engine, text, site, file, lang, limit, w, window, page)), F.lit(0))


def _image_url(engine: str, text: Column, site: Column, file: Column, lang: Column, limit: Column, w: Column, window: Column, page: Column) -> Column:
    asked = with_operators(text, site, file)
    nothing = F.lit("")
    if engine == "google":
        language, country, ending = google_locale(lang)
        dates = F.when(w["given"], F.concat(F.lit("cdr:1,cd_min:"), F.split_part(window, F.lit(".."), F.lit(1)), F.lit(",cd_max:"), F.split_part(window, F.lit(".."), F.lit(2))))
        values = encoded(tbm=F.lit("isch"), q=asked, oq=asked, tbs=dates, num=F.when(limit != 0, limit.cast("string")), hl=language, gl=country, lr=F.concat(F.lit("lang_"), language), pws=F.lit("0"), nfpr=F.lit("1"))
        return F.when((asked != "") & (~w["given"] | (w["parts"] == 2)), F.concat(F.lit("https://www.google."), ending, F.lit("/search?"), values))
    if engine == "bing":
        words = with_operators(text, site, nothing)
        return F.when(words != "", F.concat(F.lit("https://www.bing.com/images/search?"), encoded(q=words, **bing_market(lang), form=F.lit("HDRSC2"), first=F.lit("1"), scenario=F.lit("ImageBasicHover"))))
    if engine == "baidu":
        some = limit != 0
        values = encoded(tn=F.lit("resultjson_com"), cl=F.lit("2"), word=text, rn=F.when(some, "30"), pn=F.when(some, (page * 30).cast("string")), fp=F.lit("result"), ipn=F.lit("rj"), ie=F.lit("utf-8"), oe=F.lit("utf-8"))
        return F.when(text != "", F.concat(F.lit("https://image.baidu.com/search/acjson?"), values))
    if engine == "yandex":
        words = F.concat(text, F.when(w["given"], F.concat(F.lit(" date:"), window)).otherwise(""))
        return F.when(text != "", F.concat(F.lit("https://www.yandex.com/images/search/?"), encoded(text=words, p=page.cast("string"), site=F.when(site != "", site), itype=F.when(file != "", file))))
    if engine == "duckduckgo":
        dates = F.when(w["given"], F.concat(F.date_format(w["first"], "yyyy-MM-dd"), F.lit(".."), F.date_format(w["last"], "yyyy-MM-dd")))
        return F.when((asked != "") & (~w["given"] | w["ok"]), F.concat(F.lit("https://duckduckgo.com?"), encoded(t=F.lit("h"), iax=F.lit("images"), ia=F.lit("images"), q=asked, df=dates, kl=duck_region(lang))))
    if engine == "ecosia":
        words = with_operators(text, site, nothing)
        kind = F.lower(F.trim(file))
        good = (F.trim(words) != "") & (~w["given"] | (w["ok"] & (w["first"] <= w["last"]))) & ((F.coalesce(file, nothing) == "") | kind.isin(*ECOSIA_IMAGES))
        return F.when(good, F.concat(F.lit("https://www.ecosia.org/images?"), encoded(q=words, freshness=freshness(w), imageType=F.when(file != "", kind), p=F.when(page > 0, page.cast("string")))))
    raise ValueError(engine)


def image_link(href: Column) -> Column:
    """struct(url, page, width, height) of an image result link with imgurl, imgrefurl, w and h."""
    get = lambda k: F.url_decode(F.regexp_extract(href, rf"[?&]{k}=([^&]*)", 1))
    return F.struct(get("imgurl").alias("url"), get("imgrefurl").alias("page"), F.try_to_number(F.nullif(get("w"), F.lit("")), F.lit("99999")).cast("int").alias("width"), F.try_to_number(F.nullif(get("h"), F.lit("")), F.lit("99999")).cast("int").alias("height"))
