"""Stored web pages to listings and links."""

from __future__ import annotations

import html.parser
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelweave import fixed_values as fv
from reelweave.functions import identity as idn
from reelweave.functions import regex as rx

_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""  # quoted either way or bare
_ITEM = r"(?is)(<h4[^>]*\bipsDataItem_title\b[^>]*>.*?)(?=<h4[^>]*\bipsDataItem_title\b|\z)"
_ANCHOR = rf"(?is)<span[^>]*\bipsType_break\b[^>]*>\s*<a\b[^>]*?\bhref\s*=\s*{_VALUE}[^>]*>(.*?)</a>"
_TIME = rf"(?is)<time\b[^>]*?\bdatetime\s*=\s*{_VALUE}"
#: Bytes of pages that a Python worker is given at once.
BYTES_AT_ONCE = 4 << 20
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def attribute(html: Column, pattern: str) -> Column:
    """The value a pattern ending in ``_VALUE`` finds first, '' when there is none."""
    return F.concat(*[F.regexp_extract(html, pattern, g) for g in (1, 2, 3)])


def text_of(html: Column) -> Column:
    """Markup removed, the common entities read."""
    s = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return rx.trim_space(s)


def flag_blocked_pages(pages: DataFrame) -> DataFrame:
    sign = F.lit(False)
    for text in fv.BLOCK_SIGNS:
        sign = sign | F.contains("html", F.lit(text))
    return pages.withColumn("is_blocked", F.contains("html", F.lit(fv.BLOCK_MARK)) & sign)


def route_pages(pages: DataFrame, routes: list[tuple[str, str, str]]) -> DataFrame:
    """Media type and catalog by URL prefix; a later route overrides an earlier one.

    Routes are configuration, a handful of prefixes, so they become one expression.
    """
    base = F.regexp_replace("url", r"/\z", "")
    route = None
    for prefix, kind, catalog in reversed(routes):
        cond = F.startswith(base, F.lit(prefix.rstrip("/")))
        value = F.struct(F.lit(kind).alias("type"), F.lit(catalog).alias("catalog"))
        route = F.when(cond, value) if route is None else route.when(cond, value)
    default = F.struct(F.lit("movie").alias("type"), F.lit(fv.CATALOGS["hd"]).alias("catalog"))
    return pages.withColumn("_r", default if route is None else route.otherwise(default)).select("*", "_r.type", "_r.catalog").drop("_r")


def absolute_url(href: Column, page_url: Column) -> Column:
    """``href`` against the page it stands on."""
    origin = F.regexp_extract(page_url, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(page_url, r"^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (F.when(F.regexp_like(href, F.lit(r"^[a-zA-Z][\w+.-]*:")), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(page_url, r"^([a-zA-Z][\w+.-]*:)", 1), href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
            .otherwise(F.concat(folder, href)))


def extract_listings(pages: DataFrame, default_origin: str = idn.DEFAULT_ORIGIN) -> DataFrame:
    """Every listed topic: canonical URL, title text and the date next to it."""
    rest = [c for c in pages.columns if c != "html"]
    items = pages.select(*rest, F.posexplode(F.regexp_extract_all("html", F.lit(_ITEM), F.lit(1))).alias("item_no", "_item"))
    items = items.withColumns({
        "_href": F.replace(attribute(F.col("_item"), _ANCHOR), F.lit("&amp;"), F.lit("&")),
        "raw_title": text_of(F.regexp_extract("_item", _ANCHOR, 4)),
        "_time": attribute(F.col("_item"), _TIME),
    }).filter((F.col("_href") != "") & (F.col("raw_title") != ""))
    full = items.withColumn("_abs", absolute_url(F.col("_href"), F.col("url")))
    return full.select(*rest, "item_no", "raw_title", idn.canonical_url(F.col("_abs"), default_origin).alias("topic_url"),
                       F.try_to_timestamp(F.nullif("_time", F.lit(""))).alias("posted_at"))


def page_title(html: Column, site_suffix: str = "") -> Column:
    head = text_of(F.regexp_extract(html, r'(?is)<h1[^>]*\bipsType_pageTitle\b[^>]*>(.*?)</h1>', 1))
    title = text_of(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    if site_suffix:
        title = rx.trim_space(F.replace(title, F.lit(site_suffix), F.lit("")))
    return F.coalesce(rx.non_empty(head), rx.non_empty(title), F.lit(fv.UNKNOWN_PAGE_TITLE))


# Markup as nearly all of it is written.  A page that holds anything else is read by the library's parser.
_ATTRIBUTE = r"""[ \t\r\n\f]+([a-zA-Z][a-zA-Z0-9_:.-]*)(?:=(?:"([^"<>]*)"|'([^'<>]*)'))?(?![^ \t\r\n\f/>])"""
_ATTRIBUTES = f"(?:{re.sub(r'\((?!\?)', '(?:', _ATTRIBUTE)})*"
_NO_MARKUP_IN = "script|style|title|textarea|iframe|noembed|noframes|noscript|xmp|plaintext"
_TOKEN = re.compile(
    rf"[^<]*<(?:(?!(?i:{_NO_MARKUP_IN})[ \t\r\n\f/>])(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>{_ATTRIBUTES})[ \t\r\n\f]*(?P<empty>/?)>"
    r"|/(?P<end>[a-zA-Z][a-zA-Z0-9]*)>"
    r"|!--(?!-?>)(?:[^-]|-(?!-))*-->"
    r"|!(?i:doctype) [a-zA-Z]+>"
    rf"|(?P<code>script|style){_ATTRIBUTES}>(?:[^<]|<(?![/!]))*</(?P=code)>"
    rf"|(?P<plain>title|textarea){_ATTRIBUTES}>[^<]*</(?P=plain)>)")
_EACH_ATTRIBUTE = re.compile(_ATTRIBUTE)
_unescape = getattr(html.parser, "_unescape_attrvalue", html.parser.unescape)


class _Links(html.parser.HTMLParser):
    """Links of a scheme and the blocks that they stand in."""

    def __init__(self, scheme: str):
        super().__init__(convert_charrefs=True)
        self.scheme = scheme
        self.open: list[tuple[str, int, str]] = []  # tag, number, mark
        self.blocks = 0
        self.found: list[tuple[str, list[tuple[int, str]]]] = []  # link, enclosing blocks from the outside in

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        href = values.get("href") or ""
        if tag == "a" and href.startswith(self.scheme):
            self.found.append((href, [(n, mark) for _, n, mark in self.open]))
        if tag not in _VOID:
            classes = (values.get("class") or "").split()
            mark = next((c for c in ("ipsPad", "ipsType_normal") if c in classes), "article" if tag == "article" else "")
            self.blocks += 1
            self.open.append((tag, self.blocks, mark))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def read(self, page: str) -> list[str]:
        if not self._read_plain(page):
            self.__init__(self.scheme)
            self.feed(page)
            self.close()
        return self.inside()

    def _read_plain(self, page: str) -> bool:
        """The page's tags in one pass; False where something is not plainly written."""
        at = 0
        while token := _TOKEN.match(page, at):
            at = token.end()
            tag, attrs, empty, end, code, plain = token.groups()
            if tag:
                values = [(name.lower(), _unescape(double or single)) for name, double, single in _EACH_ATTRIBUTE.findall(attrs)] if attrs else []
                (self.handle_startendtag if empty else self.handle_starttag)(tag.lower(), values)
            elif end:
                self.handle_endtag(end.lower())
            elif code or plain:
                self.handle_startendtag(code or plain, [])
        return "<" not in page[at:]

    def inside(self) -> list[str]:
        """Distinct links in page order within the closest marked block of the first link that has one, else two levels up."""
        for mark in ("ipsPad", "ipsType_normal", "article"):
            around = next((blocks for _, blocks in self.found if any(m == mark for _, m in blocks)), None)
            if around is not None:
                block = [n for n, m in around if m == mark][-1]
                break
        else:
            if not self.found:
                return []
            around = self.found[0][1]
            block = around[-2][0] if len(around) > 1 else around[-1][0] if around else None
        return list(dict.fromkeys(link for link, blocks in self.found if block is None or any(n == block for n, _ in blocks)))


def few_pages_at_once(spark: SparkSession) -> None:
    """Arrow batches of few bytes for this session, if it has no smaller ones: pages are long, and a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now <= 0 or now > BYTES_AT_ONCE:
        spark.conf.set(name, BYTES_AT_ONCE)


def _links_of(scheme: str):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def links(html: pd.Series) -> pd.Series:
        out = []
        for page in html:
            out.append(_Links(scheme).read(page or ""))
        return pd.Series(out, dtype=object)
    return links


def extract_links(pages: DataFrame, scheme: str = "magnet:?", site_suffix: str = "", as_of: Column | None = None) -> DataFrame:
    """One row per page that holds links of a scheme: title, links in page order, date."""
    # nested blocks need a real walk, so the links are read with a parser; pages without the scheme are left out before
    few_pages_at_once(pages.sparkSession)
    pages = pages.filter(F.contains("html", F.lit(scheme)))
    links = _links_of(scheme)(F.col("html"))
    posted = F.try_to_timestamp(F.nullif(attribute(F.col("html"), _TIME), F.lit("")))
    rest = [c for c in pages.columns if c != "html"]
    read = pages.select(*rest, page_title(F.col("html"), site_suffix).alias("raw_title"), links.alias("magnet_uris"),
                        (posted if as_of is None else F.coalesce(posted, as_of)).alias("posted_at"))
    return read.filter(F.size("magnet_uris") > 0)
