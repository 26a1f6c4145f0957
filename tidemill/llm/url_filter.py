"""Block and allow decisions for pages, with propagation over redirects and canonical links.

DataFrame functions only. A rule names a host and a path prefix and fits the host and its subdomains;
the longest fitting rule decides. A page that no rule fits takes over a block from any page it is
equivalent to: redirect and canonical-link targets of pages are edges between addresses, and their
connected components are the classes. A page's own allow rule comes before any block of its class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemill.llm.components import components
from tidemill.llm.tables import checkpointed

#: (action, host, path prefix)
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A link or meta tag with the attribute that makes it an alias, and the address in it.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""

BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
#: A scheme at the start of a link.
SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as host and path, action) of the longest fitting rule; nulls where none fits.

    The rules are part of the plan, and each page tries them from the longest on: for rule lists of
    at most some hundreds.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(set(rules), key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def undotted(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``; the latter take the segment before them away."""
    parts = F.split(F.regexp_replace(path, r"\A/", ""), "/")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))
    # Only whole segments count, so most paths stay as they are.
    plain = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), plain).otherwise(path)


def address(url: Column) -> Column:
    """One form for the same resource: no fragment or dot segments, host in small letters, no slash at the end of the path."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(url.contains("://"), F.concat(host(url), F.regexp_replace(undotted(path(url)), r"/+\z", ""), query))


def resolved(link: Column, url: Column) -> Column:
    """An absolute address for ``link`` found on page ``url``; null for an empty link, one of another
    scheme without ``//``, and a relative one on a page without an address."""
    origin = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*", 0)
    scheme = F.regexp_extract(url, r"(?s)\A.*?://", 0)
    folder = F.regexp_extract(path(url), r"(?s)\A.*/", 0)
    clean = F.replace(link, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(clean.rlike(SCHEME + "//"), clean)
        .when((clean == "") | clean.rlike(SCHEME) | (origin == ""), None)
        .when(clean.startswith("//"), F.concat(F.replace(scheme, F.lit("//"), F.lit("")), clean))
        .when(clean.startswith("/"), F.concat(origin, clean))
        .when(clean.startswith("?"), F.concat(origin, path(url), clean))
        .when(clean.startswith("#"), url)
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), clean))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (``a``, ``b``) from each page's address to its canonical and refresh targets, relative to its ``base`` if it has one."""
    own = pages.select(pages[url].cast("string").alias("u"), pages[html].cast("string").alias("h")).where("u is not null and h is not null")
    found = own.select("u", "h", F.explode(F.concat(F.regexp_extract_all("h", F.lit(CANONICAL), 1), F.regexp_extract_all("h", F.lit(REFRESH), 1))).alias("link"))
    found = found.withColumn("base", F.coalesce(resolved(F.regexp_extract("h", BASE, 1), F.col("u")), "u"))
    return found.select(address(F.col("u")).alias("a"), address(resolved(F.col("link"), F.col("base"))).alias("b")).where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``component``.

    ``redirects`` may add edges, urls in columns ``from_url`` and ``to_url``. A page without an
    address (null url or no ``://``) fits no rule with a host, belongs to no class and is allowed.
    A class is blocked if any of its addresses is: a page's, or only a link's target. Repeated pages
    are judged alike.
    """
    own = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"))
    own = own.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("*", name.alias("rule"), action.alias("action"))
    edges = page_links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("from_url").cast("string")).alias("a"), address(F.col("to_url").cast("string")).alias("b")))
    edges = checkpointed(edges.where("a is not null and b is not null").distinct())
    if not edges.limit(1).count():
        return own.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.col("address").alias("component"))
    classes = components(edges)
    # The host and path of an address are those of a url with any scheme.
    as_url = F.concat(F.lit("x://"), F.col("node"))
    at = classes.select("node", "component", rule_of(host(as_url), path(as_url), rules)[1].alias("action"))
    blocked = at.groupBy("component").agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked"))
    known = checkpointed(classes.join(blocked, "component"))
    out = own.join(known, own["address"] == known["node"], "left")
    verdict = F.coalesce("action", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "address").alias("component"))
