"""URL block lists with redirect equivalence.

A url gets the verdict of its longest matching rule. Urls without a rule take
the decision of their aliases: pages joined by redirects (``meta refresh`` or a
given redirect table) and canonical links form components, and inside one an
explicit allow comes before a block. Everything is DataFrame operations; hosts
meet rules by an equality join on host suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import let, stage
from tidewater.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): production parameters of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LINK_TAG = r"(?i)<link\s[^>]*>"
META_TAG = r"(?i)<meta\s[^>]*>"
IS_CANONICAL = r"""(?i)\srel\s*=\s*["']?[^"'>]*\bcanonical\b"""
IS_REFRESH = r"""(?i)\shttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)"""
HINT = r"(?i)canonical|refresh"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def scheme_of(url: Column) -> Column:
    return F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments, ``/`` if it is empty. Only
    paths that have such segments are taken apart."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.regexp_replace(done, r"/[^/]*\z", "")).otherwise(F.concat(done, F.lit("/"), part))

    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    walked = F.aggregate(parts, F.lit(""), step)
    dotted = F.concat(walked, F.when(path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit("")))
    whole = F.when(path.rlike(r"/\.\.?(?:/|\z)"), dotted).otherwise(path)
    return F.when(whole == "", F.lit("/")).otherwise(whole)


def node_of(url: Column) -> Column:
    """What a redirect identifies: scheme, host, path and query; no fragment.
    An empty path is ``/`` and dot segments are resolved. Null for a null url
    and for one without ``://``."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme_of(url), F.lit("://"), host_of(url), let(path_of(url), without_dots), query))


def resolved(base: Column, href: Column) -> Column:
    """An href as an absolute url."""
    root = F.concat(scheme_of(base), F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (F.when(href.rlike(ABSOLUTE), href)
            .when(href.startswith("//"), F.concat(scheme_of(base), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, href))
            .when(href.startswith("?") | href.startswith("#"), F.concat(root, path_of(base), href))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href)))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of all canonical links and refresh redirects."""
    url, html = pages["url"].cast("string"), pages["html"].cast("string")
    hinted = pages.where(html.rlike(HINT) & (F.instr(url, "://") > 0)).select(url.alias("url"), html.alias("html"))
    links = F.transform(F.filter(F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)), lambda t: t.rlike(IS_CANONICAL)), lambda t: F.regexp_extract(t, HREF, 1))
    metas = F.transform(F.filter(F.regexp_extract_all("html", F.lit(META_TAG), F.lit(0)), lambda t: t.rlike(IS_REFRESH)), lambda t: F.regexp_extract(t, REFRESH_URL, 1))
    found = hinted.select("url", F.explode(F.concat(links, metas)).alias("href")).where("href <> ''")
    target = F.replace(F.col("href"), F.lit("&amp;"), F.lit("&"))
    ends = found.select(node_of(F.col("url")).alias("src"), let(resolved(F.col("url"), target), node_of).alias("dst"))
    return ends.where("src <> dst").distinct()


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for those rows of ``urls`` (distinct host,
    path) that a rule fits: the longest rule; of equally long ones an allow,
    then the last in code point order. A host offers only suffixes of as many
    labels as some rule has, so a host of many labels costs no more."""
    size = lambda host: F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    sizes = sorted(r[0] for r in rules.select(size(F.col("rule_host"))).where("rule_host IS NOT NULL").distinct().collect())
    if not sizes:
        return urls.sparkSession.createDataFrame([], "host string, path string, rule string, verdict string")
    suffixes = F.array_compact(F.array(*[F.when(size(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sizes]))
    offered = urls.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
    rule = F.concat("rule_host", "rule_path")
    fits = offered.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("size"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"))).alias("b"))
    return best.select("host", "path", "b.rule", F.when(F.col("b.allow"), "allow").otherwise("block").alias("verdict"))


def judge_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``redirects`` (src, dst urls) adds links. A page's own rule decides; without
    one, its component does: allow if any alias is explicitly allowed, else
    block if any is blocked, else allow. Null urls and urls without ``://``
    have empty host and path, no aliases, and are allowed; null html has no
    links, nor do pages without canonical links and refresh redirects (then no
    component is built). Repeated rows repeat their verdict; an empty table gives no rows.
    """
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    parsed = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    ruled = match_rules(parsed.select("host", "path").distinct(), rules).withColumnsRenamed({"host": "h", "path": "p", "verdict": "own"})
    judged = parsed.join(ruled, (parsed["host"] == ruled["h"]) & (parsed["path"] == ruled["p"]), "left").select("page_id", "host", "path", "node", "rule", "own")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst")))).where("src <> dst")
    edges = stage(edges, "url-links")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    parts = stage(connected_components(edges), "url-components")
    ends = parts.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    known = match_rules(ends.select("host", "path").distinct(), rules).select("host", "path", "verdict")
    # max: a component with an allow has true, one with blocks alone false.
    votes = ends.join(known, ["host", "path"]).groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"))
    aliases = ends.join(votes, "component").select(F.col("node").alias("alias"), F.when(F.col("allowed"), "allow").otherwise("block").alias("passed_on"))
    out = judged.join(aliases, judged["node"] == aliases["alias"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "passed_on", F.lit("allow")).alias("verdict"))
