"""Addresses, links and markup of web pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sparkdesk.functions import text as X
from sparkdesk.functions.text import trimmed

# fixed values: what prose may carry
ALLOWED_TAGS = """
p br hr span div blockquote pre code strong em b i u s del ins mark sub sup h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
table thead tbody tfoot tr th td caption a img
""".split()
ALLOWED_ATTRIBUTES = "href title alt src colspan rowspan lang dir start".split()
ALLOWED_LINK = r"(?i)^(?:https?:|[^a-z]|[a-z+.-]+(?:[^a-z+.:-]|$))"
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()

MAX_PAGE_BYTES = 2 * 1024 * 1024
MAX_DEPTH = 512
MAX_LABEL = 80


def address_problem(url: Column, schemes: tuple[str, ...] = ("https",), pinned_host: str | None = None) -> Column:
    """Why an address may not be offered as a link, or null when it may.

    The scheme is allowed, a host is named, no credentials are carried; where a
    host is pinned it must be that one and no port may be given.
    """
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    user = F.try_parse_url(url, F.lit("USERINFO"))
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    checks = (
        F.when(scheme.isNull(), "is not a valid address")
        .when(~scheme.isin(*schemes), F.lit("not " + " or ".join(schemes)))
        .when(user.isNotNull(), "carries credentials")
        .when(host.isNull() | (host == ""), "names no host")
    )
    if pinned_host is not None:
        checks = checks.when(F.lower(host) != pinned_host.lower(), "names another host").when(
            authority.rlike(":[0-9]*$"), "names a port"
        )
    return checks


def vetted(links: DataFrame, url: str, **rules) -> DataFrame:
    return links.withColumn("problem", address_problem(trimmed(F.col(url)), **rules))


_ABSOLUTE = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)"
_OTHER = r"(?i)^[a-z][a-z0-9+.-]*:(?!//)([^?#]*)"


def _encoded(path: Column) -> Column:
    """A path as browsers show it: characters outside the address alphabet percent-encoded."""
    odd = r"[^\x{21}-\x{7E}]|[\"<>`{}^]"
    chars = F.regexp_extract_all(path, F.lit(r"(?s)."), F.lit(0))
    spaced = F.transform(chars, lambda c: F.when(c == " ", "%20").when(F.rlike(c, F.lit(odd)), F.url_encode(c)).otherwise(c))
    return F.when(F.rlike(path, F.lit(odd)), F.array_join(spaced, "")).otherwise(path)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, host, path, label, allowed) of every anchor.

    The label says where the link leads; an address that is not absolute has none.
    """
    hrefs = F.regexp_extract_all("html", F.lit(r'(?is)<a\s(?:[^>]*\s)?href\s*=\s*"([^"]*)"'), F.lit(1))
    h = F.col("href")
    scheme = F.lower(F.regexp_extract(h, _ABSOLUTE, 1))
    port = F.when(scheme == "https", ":443$").otherwise(":80$")
    host = F.when(scheme != "", F.regexp_replace(F.lower(F.regexp_extract(h, _ABSOLUTE, 2)), port, ""))
    other = F.rlike(h, F.lit(_OTHER))
    path = F.when(scheme != "", _encoded(F.coalesce(F.nullif(F.regexp_extract(h, _ABSOLUTE, 3), F.lit("")), F.lit("/")))).when(
        other, F.regexp_extract(h, _OTHER, 1)
    )
    where = F.concat(F.coalesce("host", F.lit("")), F.when(F.col("path") == "/", "").otherwise(F.col("path")))
    shown = F.when(F.length(where) > MAX_LABEL, F.concat(F.left(where, F.lit(MAX_LABEL)), F.lit("…"))).otherwise(where)
    return (
        pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))
        .withColumns({"host": host, "path": path})
        .withColumn("label", F.concat(F.lit("Opens "), shown))
        .withColumn("allowed", F.rlike(h, F.lit(ALLOWED_LINK)))
    )


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it.

    The optimizer puts an expression in place of every name for it, so texts made
    of texts would be computed many times over; a lambda's variable stays one.
    """
    return F.transform(F.array(value), then)[0]


def _markup_only(html: Column) -> Column:
    """Markup without comments and without what scripts and styles hold."""
    return bound(_without_comments(html), lambda h: _without(h, "script|style", "$1"))


# Every pattern below runs only up to the last mark that could end it, so each match it begins it also ends,
# and a page of begun tags is read once.
def _without_comments(html: Column) -> Column:
    return X.upto_last(html, "-->", lambda head: F.regexp_replace(head, r"(?s)<!--.*?-->", ""))


def _without(html: Column, names: str, put: str) -> Column:
    """Markup without what the named elements hold."""
    def cleaned(head: Column) -> Column:
        clean = F.regexp_replace(head, rf"(?is)(<(?:{names})\b[^>]*>).*?</(?:{names})\s*+>", put)
        return F.concat(clean, F.substr(html, F.length(head) + 1))

    return bound(F.regexp_extract(html, rf"(?is)\A(.*</(?:{names})\s*+>)", 1), cleaned)


def _tags(html: Column, pattern: str) -> Column:
    head = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))
    return F.regexp_extract_all(head, F.lit(pattern), F.lit(0))


def disallowed_markup(pages: DataFrame) -> DataFrame:
    """(page_id, kind, name, count) of tags and attributes outside the lists."""
    opening = bound(_markup_only(F.col("html")), lambda h: _tags(h, r"<[a-zA-Z][^>]*>"))
    tags = pages.select("page_id", F.explode(opening).alias("tag"))
    bare = F.regexp_replace("tag", r"\"[^\"]*\"|'[^']*'", "")
    names = F.concat(
        F.array(F.struct(F.lit("tag").alias("kind"), F.lower(F.regexp_extract("tag", r"^<([a-zA-Z][a-zA-Z0-9:-]*)", 1)).alias("name"))),
        F.transform(
            F.regexp_extract_all(bare, F.lit(r"[\s/]([a-zA-Z_:@][^\s=/>]*)"), F.lit(1)),
            lambda a: F.struct(F.lit("attribute").alias("kind"), F.lower(a).alias("name")),
        ),
    )
    listed = F.when(F.col("kind") == "tag", F.col("name").isin(ALLOWED_TAGS)).otherwise(F.col("name").isin(ALLOWED_ATTRIBUTES))
    return (
        tags.select("page_id", F.inline(names)).where(~listed)
        .groupBy("page_id", "kind", "name").agg(F.count(F.lit(1)).alias("count"))
    )


def nesting_depth(html: Column) -> Column:
    """The deepest nesting that counting opening and closing tags gives."""
    tags = bound(_markup_only(html), lambda h: _tags(h, r"</?[a-zA-Z][^>]*>"))

    def step(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, r"^</?([a-zA-Z0-9]+)", 1))
        return (
            F.when(tag.startswith("</"), -1)
            .when(name.isin(VOID_TAGS) | tag.endswith("/>"), 0)
            .otherwise(1)
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("deepest"))

    def move(acc: Column, d: Column) -> Column:
        at = F.greatest(F.lit(0), acc["at"] + d)
        return F.struct(at.alias("at"), F.greatest(acc["deepest"], at).alias("deepest"))

    return F.aggregate(F.transform(tags, step), start, move, lambda acc: acc["deepest"])


_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """What a page reads as: blocks on their own lines, no markup, spaces collapsed."""
    body = bound(_without_comments(html), lambda h: _without(h, "script|style|head", ""))
    block = r"(?i)<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|nav|footer|section|header))\b[^>]*>"
    plain = lambda head: F.regexp_replace(F.regexp_replace(head, block, "\n"), r"<[a-zA-Z/!][^>]*>", "")
    body = bound(body, lambda h: X.upto_last(h, ">", plain))
    for entity, char in _ENTITIES:
        body = F.replace(body, F.lit(entity), F.lit(char))
    body = F.regexp_replace(body, r"[ \t\r]+", " ")
    return trimmed(F.regexp_replace(body, r" ?\n[ \n]*", "\n"))


def readable_pages(pages: DataFrame, max_bytes: int = MAX_PAGE_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(page_id, text, refused): pages too large, or nested too deep, are refused before they are converted."""
    depth = F.when(F.octet_length("html") <= max_bytes, nesting_depth(F.col("html")))
    return (
        pages.select("page_id", "html", depth.alias("depth"))
        .withColumn(
            "refused",
            F.when(F.col("depth").isNull(), "too large").when(F.col("depth") > max_depth, "nested too deep"),
        )
        .select("page_id", F.when(F.col("refused").isNull(), page_text(F.col("html"))).alias("text"), "refused")
    )
