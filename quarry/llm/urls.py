"""Judging URLs by host and path rules, and by redirects and canonical links that make URLs aliases of each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import names_apart
from quarry.operators.components import connected_components
from quarry.runtime import BROADCAST_ROWS, broadcast_if_small, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    action: str


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rules(places: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """(host, path, rule, action) of those (host, path) that a rule fits: the longest one, block before allow for the same rule.

    Rules may be as many as URLs: a host's suffixes meet the lengths of the paths that rules have for them, and host and prefix
    then meet the rule itself, so both joins are by equality and no URL meets all rules of its host. Null rules are passed over.
    """
    if isinstance(rules, DataFrame):
        named = rules.select("host", "path", "action").where("host is not null and path is not null").distinct()
        rules, small = materialize(named, "rules"), broadcast_if_small
        most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    else:
        rows = list(dict.fromkeys((r.host, r.path, r.action) for r in rules))
        small = F.broadcast if len(rows) <= BROADCAST_ROWS else broadcast_if_small
        most = max((r[0].count(".") + 1 for r in rows), default=1)
        rules = places.sparkSession.createDataFrame(rows, "host string, path string, action string")
    parts = F.split("host", r"\.")
    # no more suffixes than the longest rule has parts, however long a URL's host is
    first = F.greatest(F.lit(1), F.size(parts) - most + 1)
    suffixes = F.transform(F.sequence(first, F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    lengths = rules.select(F.col("host").alias("suffix"), F.length("path").alias("n")).distinct()
    near = places.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    near = near.join(small(lengths), "suffix").where("length(path) >= n").withColumn("prefix", F.expr("substring(path, 1, n)"))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "action").withColumn("rule", F.concat("suffix", "prefix"))
    hits = near.join(small(named), ["suffix", "prefix"])
    order = F.struct((-F.length("rule")).alias("n"), F.col("rule").alias("r"), (F.col("action") != "block").alias("b"))
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), order).alias("best"))
    return materialize(best.select("host", "path", "best.rule", "best.action"), "matched")


def without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its segments ``.`` and ``..``; ``..`` takes the segment before it away."""
    parts = F.split(path, "/")

    def add(kept: Column, part: Column) -> Column:
        above = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", above).when(part == ".", kept).otherwise(F.array_append(kept, part))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), add)
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL's identity among aliases: scheme and host lower-cased, fragment and dot segments dropped, an empty path written as ``/``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(without_dots(path_of(url)))
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), path, query))


def resolve(target: Column, base: Column) -> Column:
    """A link's target as an absolute URL, relative to the page's URL; null if empty or without a page URL."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when((target == "") | target.isNull() | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), target))
        .when(folder.endswith("/"), F.concat(folder, target))
        .otherwise(F.concat(folder, F.lit("/"), target))
    )


#: Tags of a page that may name another URL for it, and the names and values of a tag's attributes.
LINK = r"""(?is)<link\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
META = r"""(?is)<meta\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""(?s)([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
REFRESH_URL = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes; null if there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower)
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2)
    at = F.array_position(names, name)
    return F.when(at > 0, F.trim(F.regexp_replace(F.get(values, (at - 1).cast("int")), r"""^["']|["']\z""", "")))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): nodes that canonical links and refresh redirects of pages declare to be the same resource.

    All such tags of a page count but those in comments; ``rel`` may hold further words.
    """
    url, html = F.col(url_col), F.regexp_replace(F.col(html_col), COMMENT, "")

    def targets(word: str, tag: str, wanted: Callable[[Column], Column], target: Callable[[Column], Column]) -> Column:
        # a page without such a word is passed over by a search for a fixed string
        kept = F.filter(F.transform(F.regexp_extract_all(html, F.lit(tag), 0), lambda x: F.when(wanted(x), target(x))), lambda x: x.isNotNull())
        return F.when(F.contains(F.lower(html_col), F.lit(word)), kept).otherwise(F.array().cast("array<string>"))

    def canonical(tag: Column) -> Column:
        return F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")

    def refresh(tag: Column) -> Column:
        return F.lower(attribute(tag, "http-equiv")) == "refresh"

    named = F.concat(
        targets("canonical", LINK, canonical, lambda tag: attribute(tag, "href")),
        targets("refresh", META, refresh, lambda tag: F.regexp_extract(attribute(tag, "content"), REFRESH_URL, 1)),
    )
    found = pages.select(url.alias("url"), F.explode(named).alias("target")).where("target <> ''")
    edges = found.select(node_of(F.col("url")).alias("src"), node_of(resolve(F.col("target"), F.col("url"))).alias("dst"))
    return edges.where("src is not null and dst is not null and src <> dst")


@names_apart
def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    redirects: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``rules`` is a list, or a table (host, path, action) of any size. A URL that a rule fits gets the rule's action. Others are
    judged by their aliases, the URLs that canonical links, refresh redirects and rows (src, dst) of ``redirects`` connect
    them to, whether crawled or not: blocked if an alias is blocked by a rule and none is allowed by one (explicit allows
    take precedence); else ``default``.

    Null URLs and URLs without ``://`` have an empty host and path, no alias, and get ``default`` unless a rule fits. Repeated
    rows are judged alike, hosts and paths may be of any length; input columns named like the added ones are replaced. No rows
    give no rows.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        known = redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
        edges = edges.union(known.where("src is not null and dst is not null and src <> dst"))
    components = materialize(connected_components(edges), "aliases")
    placed = components.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
    own = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    matched = matching_rules(own.union(placed.select("host", "path")), rules)
    judged = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    fits = matched.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("rule").alias("__rule"), F.col("action").alias("__action"))
    judged = judged.join(broadcast_if_small(fits), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    if components.isEmpty():
        judged = judged.withColumn("__blocked", F.lit(False))
    else:
        votes = placed.join(broadcast_if_small(matched), ["host", "path"]).groupBy("component").agg(
            F.max((F.col("action") == "block").cast("int")).alias("blocked"), F.max((F.col("action") == "allow").cast("int")).alias("allowed")
        )
        decided = materialize(votes.where("blocked = 1 and allowed = 0").select("component"), "decided")
        blocked = components.join(broadcast_if_small(decided), "component").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked"))
        # URLs without a node must not meet at a null key: theirs is a number, which no node is
        spread = F.monotonically_increasing_id().cast("string")
        judged = judged.withColumn("__node", F.coalesce(node_of(F.col(url_col)), spread))
        judged = judged.join(broadcast_if_small(materialize(blocked, "blocked")), "__node", "left")
    alias = F.when(F.col("__blocked"), F.lit("block")).otherwise(F.lit(default))
    judged = judged.withColumns({"rule": F.col("__rule"), "verdict": F.coalesce("__action", alias)})
    return judged.drop("__node", "__host", "__path", "__rule", "__action", "__blocked")
