"""URL rules spread over redirects and canonical links.

A rule names a host and the beginning of a path; it fits the host and its
subdomains, and the longest fitting rule decides a URL. URLs that redirect to
each other or name each other as canonical are aliases: the connected
components over these edges are found by joins, and a block anywhere in a
component holds for every alias that no rule decides itself. An explicit rule,
so also an explicit allow, always precedes what is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import connected_components, stored

#: (verdict, host, beginning of the path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules are part of the expression, so their number is limited.
MOST_RULES = 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ``host`` is what lies between :// and the first of / ? #.
_PARTS = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)([^#]*)"
_TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query: the URL without scheme and fragment; NULL without ://."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, _PARTS, 3)))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """struct(size, allows, rule, verdict) of the longest fitting rule, NULL if none fits; of equals, allow."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,allows:int,rule:string,verdict:string>")
    fitting = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(int(v == "allow")).alias("allows"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fitting))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) from a page's node to where it redirects or what it names as canonical.

    Reads ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh
    content="...url=...">``; a target without host is taken on the page's own.
    """
    tag = F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0)))
    tags = pages.select("url", tag.alias("tag"))
    href = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(
        F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _URL, 1))
    found = tags.select("url", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("to")).filter("to <> ''")
    to, own = F.col("to"), F.col("url")
    full = F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(
        to.startswith("/"), F.concat(F.lit("http://"), host_of(own), to))
    return found.select(node_of(own).alias("a"), node_of(full).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judged(
    pages: DataFrame, edges: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, node) of every row.

    ``edges`` (a, b) holds further redirects as nodes, such as those of a crawl
    log. A NULL URL or one without :// has empty host and path and no aliases,
    so it gets ``default``; rows that repeat a URL agree; NULL html has no
    links; other columns are ignored.
    """
    url = F.col("url")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    base = base.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    links = link_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    groups = stored(connected_components(links), "url-aliases")
    marked = F.concat(F.lit("://"), F.col("node"))
    sources = groups.filter(best_rule(host_of(marked), path_of(marked), rules)["verdict"] == "block").select("root").distinct()
    spread = groups.join(sources, "root", "left_semi").select("node").distinct().withColumn("spread", F.lit("block"))
    return base.join(spread, "node", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.col("spread"), F.lit(default)).alias("verdict"), "node")
