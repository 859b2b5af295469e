"""URL block lists that reach all aliases of an address.

Host and path rules decide first.  All other pages are judged through their
aliases: redirects, canonical links and refreshes are edges between urls, and the
connected components of that graph share a verdict; urls known from links only count
too.  An explicit allow anywhere in a component goes before a block.  No verdict passes
without an edge, unless ``normal`` is asked for: then urls that differ in scheme,
``www.``, default port, fragment, tracking parameters, their order, and trailing slash
are one.

Only DataFrame operations are used.  Pages without an edge never enter the
graph; verdicts are or-ed before the shuffle, so one address held by very many
rows is no hot key.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule and has no alias, so it is allowed.  Repeated rows are judged alike.
An empty table stays empty; a page of any length is read whole; columns other than
page_id, url and html take no part, whatever their names.
Ties between rules of equal length go to the first in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .graph import components

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column, normal: bool = True) -> Column:
    """The node of a URL: itself, or with ``normal`` the form in which its trivial aliases are equal; null if it has no ``://``."""
    if not normal:
        return F.when(F.contains(url, F.lit("://")), url)
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(?:utm_[^=]*|ref|gclid|fbclid)(?:=|$)")))
    place = F.concat(F.regexp_replace(host(url), r"^www\.|:(?:80|443)$", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.contains(url, F.lit("://")), F.concat(place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def fitting_rule(h: Column, p: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null.  ``rules`` is a list given by the caller, one branch each."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rh + rp).alias("rule"))).otherwise(out)
    return out


def _without_dots(place: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments."""
    parts = F.split(place, "/")
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve(base: Column, target: Column) -> Column:
    """The absolute form of a link's target on a page; null if it is empty, or relative to a page without ``://``."""
    target = F.regexp_replace(target, r"(?s)\A\s+|\s+\z", "")
    origin = F.regexp_extract(base, r"(?s)\A[^:/?#]+://[^/?#]*", 0)
    here = F.regexp_extract(base, r"(?s)\A[^:/?#]+://[^/?#]*([^?#]*)", 1)
    place, rest = F.regexp_extract(target, r"(?s)\A[^?#]*", 0), F.regexp_extract(target, r"(?s)\A[^?#]*(.*)", 1)
    rest = F.when(F.startswith(target, F.lit("#")), F.concat(F.regexp_extract(base, r"(?s)\A[^?#]*(\?[^#]*)", 1), rest)).otherwise(rest)
    folder = F.when(here == "", F.lit("/")).otherwise(F.regexp_extract(here, r"(?s)\A.*/", 0))
    moved = F.when(place == "", here).when(F.startswith(place, F.lit("/")), _without_dots(place)).otherwise(_without_dots(F.concat(folder, place)))
    relative = F.when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"\A[^:/?#]+:", 0), target)).otherwise(F.concat(origin, moved, rest))
    return F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), target).when((target != "") & (origin != ""), relative)


def _attribute(tag: Column, name: str) -> Column:
    """Its value, quoted or not, with ``&amp;`` decoded; empty if there is none."""
    shape = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
    return F.regexp_replace(F.concat(*[F.regexp_extract(tag, shape, i) for i in (1, 2, 3)]), r"(?i)&(?:amp|#38|#x26);", "&")


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of what the pages themselves state: canonical links and refreshes, resolved against the page or its ``<base>``."""
    hit = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    stated = resolve(F.col("url"), _attribute(F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0), "href"))
    tags = hit.select("url", F.coalesce(stated, "url").alias("base"), F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    timed = F.regexp_extract(_attribute(tag, "content"), r"(?is)\A\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?\s*([^\"']*)", 1)
    loose = F.regexp_replace(F.regexp_extract(tag, r"(?is)url\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), r"(?i)&(?:amp|#38|#x26);", "&")
    refresh = F.when(timed.rlike(r"\S"), timed).otherwise(loose)
    canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    to = F.when(canonical, _attribute(tag, "href")).when(F.trim(F.lower(_attribute(tag, "http-equiv"))) == "refresh", refresh)
    return tags.select(F.col("url").alias("from_url"), resolve(F.col("base"), to).alias("to_url"))


def judge(pages: DataFrame, scratch: Scratch, rules=RULES, redirects: DataFrame | None = None, normal: bool = False) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.  ``redirects`` (from_url, to_url) adds edges seen by a crawler."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", resolve(F.col("from_url"), F.col("to_url")).alias("to_url")))
    links = links.select(*[F.struct(address(F.col(u), normal).alias("addr"), fitting_rule(host(F.col(u)), path(F.col(u)), rules)["verdict"].alias("own")).alias(e) for u, e in (("from_url", "a"), ("to_url", "b"))])
    links = scratch.save(links.where("a.addr is not null and b.addr is not null and a.addr != b.addr").distinct(), "links")
    edges = links.select(F.col("a.addr").alias("a"), F.col("b.addr").alias("b"))
    part = scratch.save(components(edges, scratch), "components") if not edges.isEmpty() else None

    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url"), normal).alias("addr"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "addr", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("own"))
    # One row an address, summed before the shuffle; then one a component.
    # Both ends of a link count, also where no page of that address is in the table.
    ends = links.select(F.explode(F.array("a", "b")).alias("e")).select("e.addr", "e.own")
    said = rows.select("addr", "own").unionByName(ends).where("addr is not null and own is not null").groupBy("addr").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    if part is not None:
        ends = part.select(F.col("id").alias("addr"), "component")
        said = said.join(ends, "addr", "left").withColumn("component", F.coalesce("component", "addr"))
        shared = said.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        members = ends.join(shared, "component").select("addr", "allowed", "blocked")
        said = members.unionByName(said.join(ends.select("addr"), "addr", "left_anti").select("addr", "allowed", "blocked"))
    # Only addresses with a verdict to pass on, and only pages that have none of their own, are joined.
    open_rows = rows.where("own is null and addr is not null").join(said, "addr", "left")
    judged = open_rows.select("page_id", "host", "path", "rule", F.when(F.col("blocked") & ~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    sure = rows.where("own is not null or addr is null").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    return sure.unionByName(judged)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Scratch(spark, "urls"))
