"""Queries on names: keys, resolution, tagging and relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import ranking, resolve, tagging
from tidemark.tables import table

NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
LEGAL = "|".join(T.LEGAL)


def norm_keys(spark: SparkSession, sf: str) -> DataFrame:
    x = F.concat(F.col("p_name"), F.lit(" & Co. Ltd"))
    return table(spark, sf, "part").select("p_partkey", T.norm(x).alias("norm"), T.norm_and(x).alias("norm_and"), T.strict_key(x).alias("strict"), T.loose_key(x).alias("loose"), T.space_key(x).alias("spaced"), T.slug(x).alias("slug"))


NORM_KEYS = f"""
WITH p AS (SELECT p_partkey, p_name || ' & Co. Ltd' AS x FROM part), n AS (SELECT *, {NORM.format(x='x')} AS norm, {NORM.format(x="replace(x, '&', ' and ')")} AS norm_and FROM p)
SELECT p_partkey, norm, norm_and, regexp_replace(norm_and, '(\\s+({LEGAL}))+$', '') AS strict,
  trim(regexp_replace(regexp_replace(norm, '\\b({LEGAL})\\b', ' ', 'g'), ' +', ' ', 'g')) AS loose,
  regexp_replace(lower(trim(x)), '\\s+', ' ', 'g') AS spaced, right(trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM n
"""


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(T.strict_key(F.col("p_name")).alias("key"), F.concat_ws("/", "p_name", "p_brand").alias("name"), "p_partkey", "p_name", "p_brand")


def entity_resolve_state(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    probes = part.select("p_partkey", T.strict_key(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" Limited"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" unknown"))).otherwise(F.col("p_name"))).alias("key"))
    found = resolve.resolve(probes, _aliases(spark, sf).select("key", "name"))
    return found.select("p_partkey", "state", "name", "candidates", "reason")


ENTITY_RESOLVE = f"""
WITH a AS (SELECT regexp_replace({NORM.format(x="replace(p_name, '&', ' and ')")}, '(\\s+({LEGAL}))+$', '') AS key, p_name || '/' || p_brand AS name FROM part),
i AS (SELECT key, min(name) AS name, count(DISTINCT name) AS n FROM a WHERE key <> '' GROUP BY key),
p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' Limited' WHEN 1 THEN p_name || ' unknown' ELSE p_name END AS x FROM part),
k AS (SELECT p_partkey, regexp_replace({NORM.format(x="replace(x, '&', ' and ')")}, '(\\s+({LEGAL}))+$', '') AS key FROM p)
SELECT k.p_partkey, CASE WHEN n = 1 THEN 'confirmed' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS state, CASE WHEN n = 1 THEN i.name END AS name, coalesce(n, 0) AS candidates,
  CASE WHEN n = 1 THEN 'one record holds this key' WHEN n > 1 THEN n || ' records share this key' ELSE 'no record holds this key' END AS reason FROM k LEFT JOIN i ON k.key = i.key
"""


def first_wins_alias(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.first_wins(_aliases(spark, sf), "key", [F.col("p_partkey")]).select("key", "p_partkey", "name")


FIRST_WINS = f"""
SELECT key, min(p_partkey) AS p_partkey, min_by(name, p_partkey) AS name FROM
 (SELECT regexp_replace({NORM.format(x="replace(p_name, '&', ' and ')")}, '(\\s+({LEGAL}))+$', '') AS key, p_name || '/' || p_brand AS name, p_partkey FROM part) GROUP BY key
"""


def ambiguous_guard(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_brand").alias("key"), F.col("p_type").alias("record"))
    probes = p.select(F.col("p_partkey").alias("probe"), "key", F.col("record").alias("wanted"))
    records = ranking.latest_wins(p, ["key", "record"], [F.col("p_partkey")])
    return resolve.guarded_join(probes, records, "key", "wanted", "record").select("probe", "key", "p_partkey", "record")


AMBIGUOUS = """
WITH r AS (SELECT lower(p_brand) AS key, p_type AS record, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2), s AS (SELECT key FROM r GROUP BY key HAVING count(DISTINCT record) > 1)
SELECT p.p_partkey AS probe, r.key, r.p_partkey, r.record FROM part p JOIN r ON lower(p.p_brand) = r.key WHERE r.key NOT IN (SELECT key FROM s) OR p.p_type = r.record
"""

#: Rules as rows: label, required literal, pattern, negation and priority; a text without a label gets its class's.
_NOT = r"(^|[^a-z])(not|without|no)( [a-z]+)? (licensed|license|licence|version|password)([^a-z]|$)"
RULES = [
    *[("licence", w, rf"(^|[^a-z]){w}([^a-z]|$)", _NOT, 5) for w in ("licensed", "license", "licence", "copyright", "all rights reserved")],
    ("contact", "@", r"[a-z0-9._-]+@[a-z0-9-]+[.][a-z]+", None, 4), *[("contact", w, rf"(^|[^a-z]){w}([^a-z]|$)", None, 4) for w in ("call", "phone", "email", "e-mail")],
    *[("secret", w, rf"(^|[^a-z]){w}([^a-z]|$)", _NOT, 2) for w in ("password", "api key", "api_key", "apikey", "token")],
    ("release", "version", r"(^|[^a-z])version ?[0-9]", _NOT, 3), *[("listing", m, p, None, 6) for m, p in (("- ", r"(^|\n) *- "), ("* ", r"(^|\n) *[*] "), ("• ", r"(^|\n) *• "), (". ", r"(^|\n) *[0-9]+[.] "), (") ", r"(^|\n) *[0-9]+[)] "))],
    *[("spam", w, rf"(^|[^a-z]){w}([^a-z]|$)", None, 1) for w in ("casino", "free bets", "cheap pills", "buy now", "click here")],
]
#: Letters of a benchmark word that becomes a rule, and topics that such words are dealt to.
TOPIC_WORD, TOPICS = 7, 24


def tag_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's labels by a table of some hundred rules: fixed ones, the parts' names, and the benchmark's longer words, unless denied."""
    fixed = spark.createDataFrame(RULES, "label string, literal string, pattern string, negation string, priority int")
    around = lambda w, more="": F.concat(F.lit("(^|[^a-z])"), w, F.lit(f"{more}([^a-z]|$)"))
    part = table(spark, sf, "part").select(F.lower("p_name").alias("w")).distinct().select(F.lit("product").alias("label"), F.col("w").alias("literal"), around(F.col("w"), "s?").alias("pattern"), F.lit(None).cast("string").alias("negation"), F.lit(7).alias("priority"))
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= TOPIC_WORD).distinct()
    topic = F.concat(F.lit("topic "), (F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("int") % TOPICS).cast("string"))
    topics = words.select(topic.alias("label"), F.col("w").alias("literal"), around(F.col("w")).alias("pattern"), F.concat(F.lit("(^|[^a-z])(the|no) "), "w").alias("negation"), F.lit(8).alias("priority"))
    x = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"), F.concat(F.lit("text-"), F.coalesce("lang", F.lit("none"))).alias("class"))
    return tagging.tagged(x, "doc_id", "t", fixed.union(part).union(topics), "class").select("doc_id", F.array_join("labels", ",").alias("labels"), "first_label", "hits")


def _rule(r: tuple) -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"({', '.join(map(text, r[:4]))}, {r[4]})".replace("\\n", "' || chr(10) || '")


TAG_DOCUMENTS = f"""
WITH r(label, literal, pattern, negation, priority) AS (SELECT * FROM (VALUES {', '.join(map(_rule, RULES))})
  UNION ALL SELECT DISTINCT 'product', lower(p_name), '(^|[^a-z])' || lower(p_name) || 's?([^a-z]|$)', NULL, 7 FROM part
  UNION ALL SELECT 'topic ' || (('0x' || md5(w)[1:4])::INT % {TOPICS}), w, '(^|[^a-z])' || w || '([^a-z]|$)', '(^|[^a-z])(the|no) ' || w, 8 FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= {TOPIC_WORD}),
x AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS t FROM documents), m AS (SELECT doc_id, t, r.* FROM x JOIN r ON contains(t, literal)),
h AS (SELECT doc_id, label, priority FROM m WHERE regexp_matches(CASE WHEN negation IS NULL THEN t ELSE regexp_replace(t, negation, ' ', 'g') END, pattern)),
l AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, first(label ORDER BY priority, label) AS first_label, count(*) AS hits FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(labels, 'text-' || coalesce(lang, 'none')) AS labels, coalesce(first_label, 'text-' || coalesce(lang, 'none')) AS first_label, coalesce(hits, 0) AS hits FROM x LEFT JOIN l USING (doc_id)
"""


def relevance_filter(spark: SparkSession, sf: str) -> DataFrame:
    kind, name = F.upper("p_type"), F.lower("p_name")
    keep = (kind.startswith("PROMO") | kind.startswith("ECONOMY") | name.contains("blue")) & ~kind.contains("TIN")
    return table(spark, sf, "part").where(keep).select("p_partkey", "p_type", "p_name")


RELEVANCE = "SELECT p_partkey, p_type, p_name FROM part WHERE (upper(p_type) LIKE 'PROMO%' OR upper(p_type) LIKE 'ECONOMY%' OR lower(p_name) LIKE '%blue%') AND upper(p_type) NOT LIKE '%TIN%'"


def suppression_protected(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    x = docs.join(labels, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, "protected").otherwise("suppressed")).otherwise("kept")
    return x.select("doc_id", status.alias("status"))


SUPPRESSION = "SELECT d.doc_id, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'protected' ELSE 'suppressed' END ELSE 'kept' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def blocklist_precedence(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("source")
    trust = F.when(s.isin("src1", "src13"), "blocked").when(s.isin("src1", "src2", "src5"), "allowed").when(s.contains("7"), "keyword").otherwise("unknown")
    return table(spark, sf, "documents").groupBy("source", trust.alias("trust")).agg(F.count("*").alias("n"))


BLOCKLIST = "SELECT source, CASE WHEN source IN ('src1', 'src13') THEN 'blocked' WHEN source IN ('src1', 'src2', 'src5') THEN 'allowed' WHEN source LIKE '%7%' THEN 'keyword' ELSE 'unknown' END AS trust, count(*) AS n FROM documents GROUP BY 1, 2"


def cascade_phrase_join(spark: SparkSession, sf: str) -> DataFrame:
    """Part names against other parts' names: equal first, else the longest whole-phrase containment by shared first word."""
    p = table(spark, sf, "part").select("p_partkey", T.norm(F.col("p_name")).alias("name"), F.lower("p_brand").alias("brand"))
    names = p.groupBy("name").agg(F.min("p_partkey").alias("hit"))
    probes = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(F.concat_ws(" ", F.lit("old"), "name", F.lit("set"))).alias("probe"))
    exact = probes.join(names, F.col("probe") == F.col("name"), "left").select("p_partkey", "probe", F.col("hit").alias("exact"))
    words = exact.where("exact is null").select("p_partkey", "probe", F.explode(F.array_distinct(F.split("probe", " "))).alias("w"))
    keyed = names.select("name", "hit", F.get(F.split("name", " "), F.lit(0)).alias("w")).where(F.length("name") >= 4)
    phrase = words.join(keyed, "w").where(T.has_phrase(F.col("probe"), F.col("name"))).groupBy("p_partkey").agg(F.max(F.struct(F.length("name"), -F.col("hit")).alias("b")).alias("b"))
    return exact.join(phrase.select("p_partkey", (-F.col("b.col2")).alias("phrase")), "p_partkey", "left").select("p_partkey", F.coalesce("exact", "phrase").alias("matched"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("phrase").isNotNull(), "phrase").otherwise("none").alias("how"))


CASCADE = f"""
WITH p AS (SELECT p_partkey, {NORM.format(x='p_name')} AS name FROM part), names AS (SELECT name, min(p_partkey) AS hit FROM p GROUP BY name),
q AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN name ELSE 'old ' || name || ' set' END AS probe FROM p),
e AS (SELECT q.*, n.hit AS exact FROM q LEFT JOIN names n ON q.probe = n.name),
t AS (SELECT p_partkey, hit, row_number() OVER (PARTITION BY p_partkey ORDER BY length(name) DESC, hit) AS r FROM e JOIN names n ON e.exact IS NULL AND length(name) >= 4 AND contains(' ' || probe || ' ', ' ' || name || ' '))
SELECT e.p_partkey, coalesce(exact, t.hit) AS matched, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN t.hit IS NOT NULL THEN 'phrase' ELSE 'none' END AS how FROM e LEFT JOIN t ON e.p_partkey = t.p_partkey AND t.r = 1
"""


def typeahead(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").where(F.lower("p_name").contains("re") | F.lower("p_type").contains("re")).groupBy("p_name").agg(F.count("*").alias("items"))
    return p.orderBy(F.desc("items"), "p_name").limit(12)


TYPEAHEAD = "SELECT p_name, count(*) AS items FROM part WHERE lower(p_name) LIKE '%re%' OR lower(p_type) LIKE '%re%' GROUP BY p_name ORDER BY items DESC, p_name LIMIT 12"


def word_bags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.word_bag(F.col("text"), ("the", "and", "of")).alias("bag"))


WORD_BAGS = f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: length(w) >= 2 AND w NOT IN ('the', 'and', 'of'))))[1:120], ' ') AS bag FROM documents"


def number_near_word(spark: SparkSession, sf: str) -> DataFrame:
    near = F.regexp_like("text", F.lit(r"(?is)(license|version).{0,40}[0-9]|[0-9].{0,40}(license|version)"))
    return table(spark, sf, "documents").where(near).select("doc_id", F.regexp_extract("text", r"(?i)version ([0-9.]+[0-9]|[0-9])", 1).alias("version"))


NUMBER_NEAR = r"SELECT doc_id, regexp_extract(text, '(?i)version ([0-9.]+[0-9]|[0-9])', 1) AS version FROM documents WHERE regexp_matches(text, '(?is)(license|version).{0,40}[0-9]|[0-9].{0,40}(license|version)')"


def html_title_links(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))).cast("long").alias("links"), F.length(T.strip_blocks(h)).cast("long").alias("stripped_chars"))


HTML_TITLE = r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS links,
 length(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<header\b.*?</header>|<footer\b.*?</footer>', ' ', 'g')) AS stripped_chars FROM pages"""


def url_parts_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    base = F.regexp_replace("url", r"[?#].*$", "")
    x = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.rtrim(base, F.lit("/")), "^http:", "https:").alias("address"))
    return ranking.latest_wins(x, ["address"], [F.col("page_id")]).select("page_id", "address", F.regexp_extract("address", "//([^/]*)", 1).alias("host"))


URL_PARTS = "SELECT min(page_id) AS page_id, address, regexp_extract(address, '//([^/]*)', 1) AS host FROM (SELECT page_id, regexp_replace(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '^http:', 'https:') AS address FROM pages) GROUP BY address"

QUERIES = {
    "norm_keys": (norm_keys, NORM_KEYS), "entity_resolve_state": (entity_resolve_state, ENTITY_RESOLVE), "first_wins_alias": (first_wins_alias, FIRST_WINS),
    "ambiguous_guard": (ambiguous_guard, AMBIGUOUS), "tag_documents": (tag_documents, TAG_DOCUMENTS), "relevance_filter": (relevance_filter, RELEVANCE),
    "suppression_protected": (suppression_protected, SUPPRESSION), "blocklist_precedence": (blocklist_precedence, BLOCKLIST), "cascade_phrase_join": (cascade_phrase_join, CASCADE),
    "typeahead": (typeahead, TYPEAHEAD), "word_bag": (word_bags, WORD_BAGS), "number_near_word": (number_near_word, NUMBER_NEAR), "html_title_links": (html_title_links, HTML_TITLE), "url_parts_dedupe": (url_parts_dedupe, URL_PARTS),
}
