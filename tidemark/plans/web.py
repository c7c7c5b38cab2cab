"""Queries over raw pages: sections, links, entities, labelled fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import html as H
from tidemark.operators import sections as S
from tidemark.plans.names import NORM
from tidemark.tables import table


def _q(x: str) -> str:
    return x.replace("'", "''")


def _decoded(x: str) -> str:
    for name, char in H.ENTITIES.items():
        x = f"replace({x}, '&{name};', '{_q(char)}')"
    return x


def _clean(x: str) -> str:
    plain = f"regexp_replace(regexp_replace(regexp_replace({x}, '{H.NOISE}', ' ', 'g'), '{H.BLOCKS}', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({_decoded(plain)}, '[ \\t\\x{{a0}}\\r\\x0b\\x0c]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


#: How deep menus within a page's main part are nested, by its id; every fourth page has a footer that is never closed.
DEEPEST = 50


def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the pages below /en or /fr, without one page, with another; menus and empty headings are put into the pages first."""
    pages = table(spark, sf, "pages").withColumn("path", F.regexp_extract("url", r"//[^/]*(/[^?#]*)", 1))
    deep = F.col("page_id") % DEEPEST + 1
    menu = F.concat(F.expr(f"repeat('<nav class=\"menu\">', cast(page_id % {DEEPEST} + 1 as int))"), F.lit("A menu of links<h2>Menu</h2>"), F.repeat(F.lit("</nav>rest "), deep.cast("int")), F.lit("<h3> </h3>lost"))
    tail = F.when(F.col("page_id") % 4 == 0, "<h2>Last</h2>of all<footer>never <nav>closed</footer><footer>").otherwise("</nav>stray")
    html = F.replace(F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), menu)), F.lit("</article>"), F.concat(tail, F.lit("</article>")))
    title = H.clean_text(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    found = S.sections(S.admitted(S.admitted(pages, "page_id", "path", "/", [3], []), "page_id", "path", "/en", [], [1, 2]), "page_id", html, title)
    return found.select("page_id", "place", "level", "anchor", "heading", "words", F.md5("body").alias("body_md5"), F.md5("bag").alias("bag_md5"))


_MAIN = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(h, '{p}', 1)), '')" for p in H.MAIN) + ", h)"


def _without(source: str, tag: str, out: str) -> str:
    """Two steps: the depth of each piece is the sum of openings and closings, raised where it would fall below zero."""
    return f"""
{out}_p AS (SELECT page_id, unnest(string_split(regexp_replace(c, '(?is)(<{tag}\\b[^>]*>|</{tag}\\s*>)', chr(4) || '\\1', 'g'), chr(4))) AS p, generate_subscripts(string_split(regexp_replace(c, '(?is)(<{tag}\\b[^>]*>|</{tag}\\s*>)', chr(4) || '\\1', 'g'), chr(4)), 1) AS i FROM {source}),
{out}_d AS (SELECT *, CASE WHEN regexp_matches(p, '(?is)^<{tag}\\b[^>]*/>') THEN 0 WHEN regexp_matches(p, '(?is)^<{tag}\\b[^>]*>') THEN 1 WHEN regexp_matches(p, '(?is)^</{tag}\\s*>') THEN -1 ELSE 0 END AS d FROM {out}_p),
{out}_s AS (SELECT *, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS s FROM {out}_d),
{out}_m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS after FROM {out}_s),
{out}_b AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY page_id ORDER BY i), 0) AS before FROM {out}_m),
{out} AS (SELECT page_id, string_agg(CASE WHEN before = 0 AND after = 0 THEN p WHEN before = 0 THEN ' ' WHEN after = 0 THEN regexp_replace(p, '(?is)^</{tag}\\s*>', '') ELSE '' END, '' ORDER BY i) AS c FROM {out}_b GROUP BY page_id)"""


HTML_SECTIONS = f"""
WITH q AS (SELECT page_id, url, {_clean("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
  replace(replace(html, '</h1>', '</h1>' || repeat('<nav class="menu">', (page_id % {DEEPEST} + 1)::INT) || 'A menu of links<h2>Menu</h2>' || repeat('</nav>rest ', (page_id % {DEEPEST} + 1)::INT) || '<h3> </h3>lost'),
    '</article>', CASE WHEN page_id % 4 = 0 THEN '<h2>Last</h2>of all<footer>never <nav>closed</footer><footer>' ELSE '</nav>stray' END || '</article>') AS html FROM pages),
p AS (SELECT page_id, regexp_replace(html, '{H.NOISE}', ' ', 'g') AS h FROM q WHERE page_id <> 3 AND (page_id IN (1, 2) OR starts_with(regexp_extract(url, '//[^/]*(/[^?#]*)', 1), '/en'))),
m AS (SELECT page_id, {_MAIN} AS c FROM p), {_without("m", "nav", "n")}, {_without("n", "footer", "t")},
s AS (SELECT page_id, title, string_split(regexp_replace(c, '{S.HEADING}', chr(1) || '\\1' || chr(2) || '\\2' || chr(2) || '\\3' || chr(3), 'g'), chr(1)) AS ps FROM t JOIN q USING (page_id)),
e AS (SELECT page_id, title, ps, unnest(ps) AS x, generate_subscripts(ps, 1) - 1 AS o FROM s),
f AS (SELECT page_id, o, CASE WHEN o = 0 THEN 0 ELSE split_part(x, chr(2), 1)::INTEGER END AS level, CASE WHEN o > 0 THEN nullif(regexp_extract(split_part(x, chr(2), 2), '{S.OWN_ANCHOR}', 1), '') END AS anchor,
  CASE WHEN o = 0 THEN title ELSE {_clean("split_part(split_part(x, chr(3), 1), chr(2), 3)")} END[1:120] AS heading, {_clean("CASE WHEN o = 0 THEN x ELSE string_split(x, chr(3))[-1] END")} AS body FROM e),
w AS (SELECT *, list_sort(list_distinct(list_filter(string_split({NORM.format(x='body')}, ' '), lambda w: length(w) >= 2 AND w NOT IN {S.STOP})))[1:120] AS bag FROM f WHERE CASE WHEN o = 0 THEN length(body) >= 25 ELSE heading <> '' END),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS place FROM w WHERE length(heading) >= 3 OR len(bag) >= 5)
SELECT page_id, place::INTEGER AS place, level, anchor, heading, len(bag) AS words, md5(body) AS body_md5, md5(array_to_string(bag, ' ')) AS bag_md5 FROM k
WHERE place < 60 AND page_id IN (SELECT page_id FROM k WHERE place < 60 GROUP BY 1 HAVING sum(len(bag)) >= 5)
"""


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages: each target once for a host, with its slug, text and first page."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html")
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("page_id", "host", F.posexplode(anchors).alias("place", "tag"))
    x = rows.select("page_id", "host", "place", F.regexp_extract("tag", r"(?i)href=\"([^\"]*)\"", 1).alias("href"), H.clean_text(F.col("tag")).alias("text"))
    first = x.groupBy("host", "href").agg(F.min(F.struct("page_id", "place", "text")).alias("b"))
    return first.select("host", "href", F.regexp_extract("href", "([^/?#]*)/?(?:[?#].*)?$", 1).alias("slug"), "b.text", "b.page_id")


LINKS = rf"""
WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS t FROM pages),
r AS (SELECT page_id, host, unnest(t) AS tag, generate_subscripts(t, 1) AS place FROM p),
x AS (SELECT page_id, host, place, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href, {_clean('tag')} AS text FROM r)
SELECT host, href, regexp_extract(href, '([^/?#]*)/?(?:[?#].*)?$', 1) AS slug, text, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host, href ORDER BY page_id, place) AS n FROM x) WHERE n = 1
"""

#: A licence's name in running text: what stands for a legal entity's name here.
ENTITY = r"\b((?:[A-Z][A-Za-z]+ ){1,3}License)\b"


def entity_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """How often each named licence stands in a source's texts, how many texts hold it, and the source's most frequent one."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(1))).alias("entity"))
    x = d.groupBy("source", "entity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("texts"))
    best = x.groupBy("source").agg(F.max(F.struct("n", "entity")).alias("b"))
    return x.join(best, "source").select("source", "entity", "n", "texts", (F.col("b.entity") == F.col("entity")).alias("first"))


ENTITY_FREQUENCY = rf"""
WITH d AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{ENTITY}', 1)) AS entity FROM documents), x AS (SELECT source, entity, count(*) AS n, count(DISTINCT doc_id) AS texts FROM d GROUP BY 1, 2)
SELECT source, entity, n, texts, row_number() OVER (PARTITION BY source ORDER BY n DESC, entity DESC) = 1 AS first FROM x WHERE source IS NOT NULL
"""

FIELDS = ("Supplier", "Ends", "Value")


def labelled_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled fields of a brief, each up to the next label: live or expired by its end date, and whether its stated count is right."""
    p = table(spark, sf, "part")
    ends = F.when(F.col("p_size") % 5 == 0, "to be agreed").otherwise(F.concat(F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit("/06/20"), F.lpad(F.col("p_size").cast("string"), 2, "0")))
    names = F.array_join(F.array("p_name", "p_type", "p_brand"), "; ")
    text = F.concat(F.lit("Brief of "), (F.col("p_size") % 2 + 2).cast("string"), F.lit(" suppliers. Supplier: "), names, F.lit(" Ends : "), ends, F.lit(" Value: £"), F.col("p_size").cast("string"), F.lit("k"))
    rest = lambda name: "|".join(f for f in FIELDS if f != name)
    field = lambda name: F.regexp_extract("text", rf"\b{name}\s*:\s*(.+?)\s*(?=\b(?:{rest(name)})\s*:|$)", 1)
    x = p.select("p_partkey", text.alias("text")).select("p_partkey", field("Supplier").alias("suppliers"), field("Ends").alias("ends"), field("Value").alias("value"), F.regexp_extract("text", r"of (\d+) suppliers", 1).cast("int").alias("stated"))
    end = F.try_to_date("ends", "dd/MM/yyyy")
    parsed = F.size(F.split("suppliers", "; "))
    return x.select("p_partkey", "suppliers", "ends", "value", F.when(F.col("stated") == parsed, parsed).alias("parsed"), (F.col("stated") != parsed).alias("refused"), F.coalesce(end < F.lit("2024-06-01").cast("date"), F.lit(False)).alias("expired"))


LABELLED = """
SELECT p_partkey, p_name || '; ' || p_type || '; ' || p_brand AS suppliers, CASE WHEN p_size % 5 = 0 THEN 'to be agreed' ELSE lpad((p_size % 28 + 1)::VARCHAR, 2, '0') || '/06/20' || lpad(p_size::VARCHAR, 2, '0') END AS ends,
  '£' || p_size || 'k' AS value, CASE WHEN p_size % 2 = 1 THEN 3 END AS parsed, p_size % 2 = 0 AS refused, p_size % 5 <> 0 AND (p_size < 24) AS expired FROM part
"""


def registration_proof(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that state a number within 160 characters of the word version or license, in its forms."""
    near = lambda n: rf"(?is)\b(?:version|license)\b.{{0,160}}\b{n}\b|\b{n}\b.{{0,160}}\b(?:version|license)\b"
    d = table(spark, sf, "documents").select("doc_id", *[F.coalesce(F.col("text").rlike(near(n)), F.lit(False)).alias(f"near_{n}") for n in ("2", "3", "4")])
    return d.where("near_2 or near_3 or near_4")


def _near(n: str) -> str:
    return rf"coalesce(regexp_matches(text, '(?is)\b(?:version|license)\b.{{0,160}}\b{n}\b|\b{n}\b.{{0,160}}\b(?:version|license)\b'), false)"


REGISTRATION = f"SELECT * FROM (SELECT doc_id, {', '.join(f'{_near(n)} AS near_{n}' for n in '234')} FROM documents) WHERE near_2 OR near_3 OR near_4"

QUERIES = {
    "html_sections": (html_sections, HTML_SECTIONS), "page_links": (page_links, LINKS), "entity_frequency": (entity_frequency, ENTITY_FREQUENCY), "labelled_fields": (labelled_fields, LABELLED), "registration_proof": (registration_proof, REGISTRATION),
}
