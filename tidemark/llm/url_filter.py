"""Operator 1: URL filters with redirect equivalence (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.spread import join_facts
from tidemark.llm.text import LOWER, UPPER, ascii_lower
from tidemark.tables import cut, small, table

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK_TAG = r"(?is)<link\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*(\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)"
META_TAG = r"(?is)<meta\b[^>]*>"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
TRACKING = r"(^|&)(utm_[a-z]*|ref|gclid|fbclid)=[^&]*"
#: A url's scheme and host, its folder, and itself without query and fragment.
ROOT, FOLDER, BARE = r"(?s)^(.*?://[^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*/)", r"(?s)^([^?#]*)"
MAX_BROADCAST_RULES = 100_000


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def alias_key(url: Column) -> Column:
    """Host, path without its last slashes and the query without tracking parameters; no scheme or fragment. '' without a host."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), TRACKING, "")
    key = F.concat_ws("?", F.concat(host(url), F.rtrim(path(url), F.lit("/"))), F.nullif(F.ltrim(query, F.lit("&")), F.lit("")))
    return F.when(host(url) == "", "").otherwise(key)


def absolute(base: Column, target: Column) -> Column:
    """``target`` of a link on page ``base``: with scheme, from the host's root, from the page's folder, or another query
    of the page. Null: another scheme than one with ://, a fragment, or a base without a host."""
    root = F.regexp_extract(base, ROOT, 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(base, FOLDER, 1), F.lit("")), F.lit("/"))
    # one fold over the path: a step up takes the last part away, however many there are
    parts = F.slice(F.split(F.concat(folder, F.regexp_extract(target, BARE, 1)), "/"), F.lit(2), F.lit(1_000_000))
    walked = F.aggregate(parts, F.lit(""), lambda at, p: F.when(p == "..", F.regexp_replace(at, "/[^/]*$", "")).when(p == ".", at).otherwise(F.concat(at, F.lit("/"), p)))
    resolved = F.concat(root, F.coalesce(F.nullif(walked, F.lit("")), F.lit("/")), F.regexp_replace(target, BARE, ""))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((root == "") | target.rlike("^#|^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(F.regexp_extract(base, BARE, 1), target))
        .otherwise(resolved)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url): all canonical links and meta refreshes of the pages' html, made absolute; see ``absolute``."""
    all_of = lambda tag, kind: F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
    targets = F.concat(
        F.transform(all_of(LINK_TAG, CANONICAL), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(all_of(META_TAG, REFRESH), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
    )
    found = pages.select(F.col("url").alias("from_url"), F.explode(targets).alias("to")).where("to <> ''")
    return found.select("from_url", absolute(F.col("from_url"), F.replace("to", F.lit("&amp;"), F.lit("&"))).alias("to_url")).where("to_url is not null")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, action) of the longest fitting rule; urls that none fits are left out.

    Every suffix of the host is joined to the rules' hosts, so the rules may be a long list:
    it is broadcast up to MAX_BROADCAST_RULES rows and shuffled beyond that.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fits = urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(small(rules, MAX_BROADCAST_RULES), "rule_host").where(
        F.col("path").startswith(F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    return fits.groupBy("url").agg(
        F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), rule.alias("rule"), "action")).alias("best")
    ).select("url", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule, verdict and component.

    rules: action (allow/block), rule_host, rule_path. links: (from_url, to_url) of redirects
    and canonical links. A url's own rule decides. A url without one shares the decision of
    its aliases: urls that differ in scheme, fragment, last slash or tracking parameters only
    count as linked with the form they share, and aliases are what links connect. There an
    explicit allow outranks any block, and a component without rules is allowed. Components
    take the edges of forms that several urls share or a link names; a group of aliases is a
    star, reduced by min and max, never gathered.

    Null urls and urls without '://' have empty host and path and no aliases and are allowed,
    as are those with an empty host. Repeated rows are judged alike, each keeping its row.
    Clashing extra columns are replaced by the new ones. Null link ends are ignored; an empty
    table gives an empty result.
    """
    links = links.where("from_url is not null and to_url is not null").select("from_url", "to_url").distinct()
    known = pages.select("url").union(links.select("from_url")).union(links.select("to_url")).where("url is not null").distinct()
    known = known.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), alias_key(F.col("url")).alias("key"))
    ruled = cut(known.join(match_rules(known, rules), "url", "left"), "urls")
    node = lambda key: F.concat(F.lit("alias "), key)
    linked = links.select(alias_key(F.col("from_url")).alias("u"), alias_key(F.col("to_url")).alias("v")).where("u <> '' and v <> ''")
    named = ruled.where("key <> ''")
    several = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    several = several.union(linked.select("u")).union(linked.select("v")).distinct()
    aliases = named.join(several, "key", "left_semi").select(F.col("url").alias("u"), node(F.col("key")).alias("v"))
    groups = connected_components(aliases.union(linked.select(node(F.col("u")), node(F.col("v")))))
    member = ruled.join(groups, ruled["url"] == groups["node"], "left").select(
        "url", "rule", "action", F.coalesce("component", "url").alias("component"),
    )
    shared = member.groupBy("component").agg(
        F.count("*").alias("urls"), F.max(F.col("action") == "allow").alias("any_allow"), F.max(F.col("action") == "block").alias("any_block")
    )
    verdict = (
        F.when(F.col("action").isNotNull(), F.col("action"))
        .when(F.coalesce("any_allow", F.lit(False)), "allow").when(F.coalesce("any_block", F.lit(False)), "block").otherwise("allow")
    )
    # one canonical target may have a third of all urls
    judged = join_facts(member, shared, "component", "urls", ruled.count(), "url").select(F.col("url").alias("u"), "rule", verdict.alias("verdict"), "component")
    new = ("host", "path", "rule", "verdict", "component")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col("url").alias("page_url"))
    # null urls are spread by a key that no url has
    asked = rows.withColumn("asked", F.coalesce("page_url", F.concat(F.lit("\x00"), F.xxhash64("row").cast("string"))))
    return asked.join(judged, F.col("asked") == F.col("u"), "left").select(
        *[F.col("row").getField(c).alias(c) for c in pages.columns if c not in new],
        host(F.col("page_url")).alias("host"), path(F.col("page_url")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "component",
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "action string, rule_host string, rule_path string")
    return judge_urls(pages.select("page_id", "url"), rules, page_links(pages)).select("page_id", "host", "path", "rule", "verdict")


def _key(u: str) -> str:
    host_ = f"translate(regexp_extract({u}, '{SPLIT}', 1), '{UPPER}', '{LOWER}')"
    query = f"ltrim(regexp_replace(regexp_extract({u}, '(?s)^[^?#]*\\?([^#]*)', 1), '{TRACKING}', '', 'g'), '&')"
    return f"CASE WHEN {host_} = '' THEN '' ELSE concat_ws('?', {host_} || rtrim(regexp_extract({u}, '{SPLIT}', 2), '/'), nullif({query}, '')) END"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _resolved() -> str:
    parts = f"string_split(coalesce(nullif(regexp_extract(url, '{FOLDER}', 1), ''), '/') || regexp_extract(t, '{BARE}', 1), '/')[2:]"
    walked = f"list_reduce(list_concat([''], {parts}), lambda a, p: CASE WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN p = '.' THEN a ELSE a || '/' || p END)"
    return f"regexp_extract(url, '{ROOT}', 1) || coalesce(nullif({walked}, ''), '/') || regexp_replace(t, '{BARE}', '')"


ORACLE = f"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES {', '.join(str(r) for r in RULES)}),
tags AS (
  SELECT url, 1 AS kind, unnest(regexp_extract_all(html, '{_quoted(LINK_TAG)}')) AS tag FROM pages
  UNION ALL
  SELECT url, 2, unnest(regexp_extract_all(html, '{_quoted(META_TAG)}')) FROM pages),
targets AS (SELECT url, replace(CASE kind WHEN 1 THEN regexp_extract(tag, '{_quoted(HREF)}', 1) ELSE regexp_extract(tag, '{_quoted(REFRESH_URL)}', 1) END, '&amp;', '&') AS t
  FROM tags WHERE regexp_matches(tag, CASE kind WHEN 1 THEN '{_quoted(CANONICAL)}' ELSE '{_quoted(REFRESH)}' END)),
links AS (SELECT DISTINCT url AS from_url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
    WHEN regexp_extract(url, '{ROOT}', 1) = '' OR regexp_matches(t, '^#|^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN t LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t
    WHEN t LIKE '/%' THEN regexp_extract(url, '{ROOT}', 1) || t
    WHEN t LIKE '?%' THEN regexp_extract(url, '{BARE}', 1) || t
    ELSE {_resolved()} END AS to_url
  FROM targets WHERE t <> ''),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT to_url FROM links WHERE to_url IS NOT NULL),
parts AS (SELECT url, translate(regexp_extract(url, '{SPLIT}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '{SPLIT}', 2) AS path, {_key('url')} AS key FROM urls),
fits AS (SELECT p.url, r.rule_host || r.rule_path AS rule, r.action,
    row_number() OVER (PARTITION BY p.url ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)),
ruled AS (SELECT p.*, f.rule, f.action FROM parts p LEFT JOIN fits f ON p.url = f.url AND f.n = 1),
edges AS (SELECT {_key('from_url')} AS u, {_key('to_url')} AS v FROM links WHERE from_url IS NOT NULL AND to_url IS NOT NULL),
both_ways AS (SELECT u, v FROM edges WHERE u <> '' AND v <> '' UNION SELECT v, u FROM edges WHERE u <> '' AND v <> ''),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
comps AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
member AS (SELECT r.url, r.host, r.path, r.rule, r.action, CASE WHEN r.key = '' THEN '://' || r.url ELSE coalesce(c.component, r.key) END AS component
  FROM ruled r LEFT JOIN comps c ON r.key = c.node),
shared AS (SELECT component, bool_or(action = 'allow') AS a, bool_or(action = 'block') AS b FROM member GROUP BY component)
SELECT p.page_id, coalesce(m.host, '') AS host, coalesce(m.path, '') AS path, m.rule,
  CASE WHEN m.action IS NOT NULL THEN m.action WHEN coalesce(s.a, false) THEN 'allow' WHEN coalesce(s.b, false) THEN 'block' ELSE 'allow' END AS verdict
FROM pages p LEFT JOIN member m ON p.url = m.url LEFT JOIN shared s ON m.component = s.component
"""
