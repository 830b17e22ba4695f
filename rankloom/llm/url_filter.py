"""URL block lists over redirect equivalence.

Pages name other addresses of themselves: canonical links, meta refreshes, both resolved against the page's address as
RFC 3986 has it, and the plain form that servers redirect variants to (no scheme, www. or m., fragment, tracking query,
closing slash or .html). These are edges; connected
components are classes of aliases. A block rule that hits any member blocks the class; an explicit allow rule
takes precedence for each address that it hits itself, and only for that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import spread
from .common import cut
from .components import components

#: Rows of rules up to which they are sent to every executor; more are joined by shuffle.
SENT_RULES = 100_000


#: Query fields that say where a visitor came from, not which page it is.
TRACKING = ("utm_[a-z]+", "fbclid", "gclid", "msclkid", "igshid", "mc_[ce]id")
LINK, REFRESH = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL, IS_REFRESH = r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF, TARGET = r"(?is)[\s\"']href\s*=\s*[\"']?([^\"'\s>]+)", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
ORIGIN, PATH = r"(?i)^((?:[a-z][a-z0-9+.-]*:)?(?://)?[^/?#]*)", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)"


def tracked(tracking: tuple[str, ...]) -> str:
    return f"(?i)^(?:{'|'.join(tracking)})(?:=|$)"


def plain(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """The form of an address that its usual variants share; null for null and for what has no host."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?:]*)", 1))
    host = F.regexp_replace(host, r"^(?:(?:www|m)\.)+|\.$", "")
    path = F.regexp_extract(u, r"^[^/?]*(/[^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)(?:/index)?\.html?$", ""), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracked(tracking)))) if tracking else F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.concat_ws("&", kept))).otherwise("")))


def resolved(base: Column, target: Column) -> Column:
    """The address that a reference in a page means; null for other schemes than those with a host."""
    t = F.regexp_replace(target, "&amp;", "&")
    origin, path = F.regexp_extract(base, ORIGIN, 1), F.regexp_extract(base, PATH, 1)
    parent = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    full = (
        F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), t)
        .when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(t.startswith("//"), F.concat(F.lit("http:"), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when((t == "") | t.startswith("#"), F.regexp_extract(base, "^([^#]*)", 1))
        .when(t.startswith("?"), F.concat(origin, path, t))
        .otherwise(F.concat(origin, parent, t))
    )
    steps = F.split(F.regexp_extract(full, PATH, 1), "/")
    walked = F.aggregate(F.slice(steps, 2, F.size(steps)), F.lit(""), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), x)))
    return F.concat(F.regexp_extract(full, ORIGIN, 1), walked, F.regexp_extract(full, r"^[^?#]*(\?[^#]*)?", 1))


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", tracking: tuple[str, ...] = TRACKING) -> DataFrame:
    """(src, dst): each address with its plain form, and with the plain forms of all canonical and refresh targets in its page."""
    rows = spread(pages.select(pages[url_col].cast("string").alias("src"), pages[html_col].cast("string").alias("html")).where("src is not null"))
    html = F.col("html")

    def targets(tag: str, mark: str, part: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(mark) & t.rlike(part))
        return F.coalesce(F.transform(tags, lambda t: F.regexp_extract(t, part, 1)), F.array().cast("array<string>"))

    named = rows.select("src", F.concat(targets(LINK, CANONICAL, HREF), targets(REFRESH, IS_REFRESH, TARGET)).alias("found"))
    full = F.concat(F.array("src"), F.transform("found", lambda t: resolved(F.col("src"), t)))
    return named.select("src", F.explode(F.array_distinct(full)).alias("at")).select("src", plain(F.col("at"), tracking).alias("dst")).where("dst is not null").distinct()


def _hit(addresses: DataFrame, rules: DataFrame, tracking: tuple[str, ...]) -> DataFrame:
    """Of addresses (node, form): those whose host, a parent domain of it, or a whole leading part of the path is a rule."""
    rules = rules.select(plain(F.col("rule"), tracking).alias("part")).where("part is not null").distinct()
    form = F.col("form")
    host = F.regexp_extract(form, r"^([^/?]*)", 1)
    rest = F.regexp_extract(form, r"^[^/?]*(/[^?]*)", 1)
    labels, steps = F.split(host, r"\."), F.split(rest, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.array_join(F.slice(steps, 1, i), "/")))
    parts = addresses.select("node", F.explode(F.array_distinct(F.concat(domains, paths, F.array(form)))).alias("part"))
    n = rules.limit(SENT_RULES + 1).count()
    return parts.join(F.broadcast(rules) if n <= SENT_RULES else rules, "part", "left_semi").select("node").distinct()


def decided(pages: DataFrame, block: DataFrame, allow: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tracking: tuple[str, ...] = TRACKING) -> DataFrame:
    """(page_id, url, alias_root, decision) of every page row; decision is block, allow or none.

    block and allow have a column `rule`: a domain, which covers its subdomains, or an address, which covers what lies
    below it. alias_root is the least address of the class. Rows with a null or hostless url are classes of their own
    with decision none and, if null, a null root; repeated rows keep their number, null html adds no edge, very long
    html is read whole. An address that several rows hold has the links of all of them. A page that an allow and a block
    rule both hit is allowed. tracking: patterns of query fields that don't count.
    """
    links = cut(edges(pages, url_col, html_col, tracking))
    classes = components(links)
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(classes, "node", "left").select("node", F.coalesce("root", "node").alias("root"), plain(F.col("node"), tracking).alias("form"))
    nodes = cut(nodes)
    blocked = nodes.join(_hit(nodes, block, tracking), "node", "left_semi").select("root").distinct().withColumn("blocked", F.lit(True))
    allowed = _hit(nodes, allow, tracking).withColumn("allowed", F.lit(True))
    verdict = nodes.join(blocked, "root", "left").join(allowed, "node", "left").select(F.col("node").alias("_node"), "root", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("none").alias("verdict"))
    rows = pages.select(pages[id_col].try_cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
    return rows.join(verdict, F.col("url") == F.col("_node"), "left").select("page_id", "url", F.coalesce("root", "url").alias("alias_root"), F.coalesce("verdict", F.lit("none")).alias("decision"))


def sql(block: tuple[str, ...], allow: tuple[str, ...], tracking: tuple[str, ...] = TRACKING) -> str:
    """DuckDB SQL of decided() over pages; the rules are given in their plain forms."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def hit(rules: tuple[str, ...]) -> str:
        one = lambda r: f"hp = '{r}' OR starts_with(hp, '{r}/') OR form = '{r}'" if "/" in r else f"host = '{r}' OR ends_with(host, '.{r}')"
        return " OR ".join(one(r) for r in rules) or "false"

    def formed(source: str, name: str) -> str:
        return rf"""
{name}1 AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?', '') AS u FROM {source}),
{name}2 AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^([^/?:]*)', 1)), '^(?:(?:www|m)\.)+|\.$', '', 'g') AS host,
  regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*(/[^?]*)', 1), '(?i)(?:/index)?\.html?$', ''), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, {quoted(tracked(tracking))}))) AS kept FROM {name}1),
{name} AS (SELECT *, host || path AS hp, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS form FROM {name}2 WHERE host <> '')"""

    tag = lambda name, mark, part: f"SELECT url, replace(regexp_extract(t, {quoted(part)}, 1), '&amp;', '&') AS t FROM (SELECT url, unnest(regexp_extract_all(html, {quoted(name)})) AS t FROM pages) WHERE regexp_matches(t, {quoted(mark)}) AND regexp_matches(t, {quoted(part)})"
    return rf"""
WITH RECURSIVE tags AS ({tag(LINK, CANONICAL, HREF)} UNION ALL {tag(REFRESH, IS_REFRESH, TARGET)}),
based AS (SELECT url, t, regexp_extract(url, {quoted(ORIGIN)}, 1) AS origin, regexp_extract(url, {quoted(PATH)}, 1) AS way FROM tags WHERE url IS NOT NULL),
whole AS (SELECT url, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
  WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN origin || t WHEN t = '' OR starts_with(t, '#') THEN regexp_extract(url, '^([^#]*)', 1)
  WHEN starts_with(t, '?') THEN origin || way || t ELSE origin || CASE WHEN way = '' THEN '/' ELSE regexp_replace(way, '[^/]*$', '') END || t END AS f FROM based),
walked AS (SELECT url, regexp_extract(f, {quoted(ORIGIN)}, 1) || list_reduce(string_split(regexp_extract(f, {quoted(PATH)}, 1), '/')[2:], lambda acc, x:
  CASE x WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END, '') || regexp_extract(f, '^[^?#]*(\?[^#]*)?', 1) AS raw FROM whole),
addr AS (SELECT url AS src, url AS raw FROM pages WHERE url IS NOT NULL UNION SELECT url, raw FROM walked),
{formed("addr", "f")},
e AS (SELECT src AS a, form AS b FROM f UNION SELECT form, src FROM f),
nodes AS (SELECT DISTINCT a AS node FROM e),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
raws AS (SELECT node, node AS raw FROM nodes),
{formed("raws", "g")},
bad AS (SELECT DISTINCT root FROM g JOIN root USING (node) WHERE {hit(block)}),
good AS (SELECT node FROM g WHERE {hit(allow)})
SELECT page_id, url, coalesce(root.root, url) AS alias_root,
  CASE WHEN url IN (SELECT node FROM good) THEN 'allow' WHEN root.root IN (SELECT root FROM bad) THEN 'block' ELSE 'none' END AS decision
FROM pages LEFT JOIN root ON url = node
"""
