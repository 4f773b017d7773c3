"""URL filters whose decisions follow redirects and canonical links, in DataFrame functions alone.

A rule names a host and the start of a path. Urls that redirect to each other, or
name each other as canonical, are one thing under several addresses: the connected
components of those edges. An address without a rule of its own takes the decision
that its component has: allow where a rule allows any of it, else block where a rule
blocks any of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.components import components
from lodeframe.llm.shared import written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Query parameters that only track where a visit came from.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|msclkid)"
_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical["'\s/>])[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh["'\s/>])[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<name, verdict> of the longest rule that fits, else null. A later one of equal names doesn't count."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted({r.name: r for r in reversed(rules)}.values(), key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """A url as a node: no scheme, fragment, port 80 or 443, or tracking parameters; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), f"&{TRACKING}=[^&]*", ""), "^&+", "")
    at = F.regexp_replace(host(url), ":(?:80|443)$", "")
    whole = F.concat(F.lit("//"), at, F.when(path(url) == "", "/").otherwise(path(url)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(at != "", whole)


def without_dots(path: Column) -> Column:
    """A path from the root without its . and .. segments."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    step = lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s)))
    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(left, F.array(F.lit("")))).otherwise(left)
    return F.concat(F.lit("/"), F.array_join(ended, "/"))


def target(url: Column, link: Column) -> Column:
    """The absolute url of a link on a page; null for a fragment of the page itself and for other schemes than http.

    A link may be absolute, without a scheme, from the host's root, from the page's folder, or a query alone.
    """
    link = F.regexp_replace(link, "&amp;", "&")
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.concat(scheme, F.lit("://"), host(url))
    at, rest = F.regexp_extract(link, "(?s)^[^?#]*", 0), F.regexp_extract(link, "(?s)[?#].*$", 0)
    folder = F.regexp_replace(path(url), "(?s)[^/]*$", "")
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, without_dots(at), rest))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path(url), link))
        .otherwise(F.concat(root, without_dots(F.concat(folder, at)), rest))
    )


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b) addresses: a page and each one that a canonical link or a refresh of it names."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    links = F.concat(*(F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in (_LINK, _REFRESH)))
    found = pages.select(url.alias("url"), F.explode(links).alias("link")).select("url", target(F.col("url"), F.col("link")).alias("to")).where("to IS NOT NULL")
    return found.select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages.

    ``redirects`` may hold more edges, as urls in its first two columns. A page with a
    rule has that rule's verdict; one without has its component's: allow if a rule
    allows any address of it, else block if one blocks any, else allow. A null url, or
    one without ://, has an empty host and path, fits no rule and is allowed. Repeated
    rows are each judged; a null html has no links. No rows give no rows.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        a, b = redirects.columns[:2]
        more = redirects.select(address(F.col(f"`{a}`")).alias("a"), address(F.col(f"`{b}`")).alias("b"))
        edges = edges.unionByName(more.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"))
    edges = written(edges.distinct(), "url-edges")
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`"), host(url).alias("host"), path(url).alias("path"), address(url).alias("address"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        rows = rows.withColumn("shared", F.lit(None).cast("string"))
    else:
        known = written(components(edges), "url-components")
        at = F.concat(F.lit("http:"), F.col("node"))
        own = rule_of(host(at), path(at), rules)["verdict"]
        # Over strings the least is allow: it goes before block, and before none.
        decided = known.withColumn("v", own).groupBy("component").agg(F.min("v").alias("shared"))
        aliases = known.join(decided.where("shared IS NOT NULL"), "component").select(F.col("node").alias("address"), "shared")
        rows = rows.join(aliases, "address", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.col("shared"), F.lit("allow"))
    return rows.select(F.col(f"`{id_col}`"), "host", "path", F.col("own.name").alias("rule"), verdict.alias("verdict"))
