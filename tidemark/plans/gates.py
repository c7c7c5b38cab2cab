"""Gates over feeds, indexes and vocabularies: constraints that hold rows against references, kinds, lists and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import checks, rules as R
from tidemark.plans.constraints import _v
from tidemark.plans.names import NORM
from tidemark.tables import table

AS_OF, FURNITURE = "1998-08-01", ["the", "and", "of", "to", "in", "that", "for", "was"]


def feed_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A feed's rows: references, kinds of dates, suppression, clusters, figures, word bags, shards, counts, types, links and rival lists."""
    t = lambda name: table(spark, sf, name)
    c, o, p, docs = t("customer"), t("orders"), t("part"), t("documents")
    reference = c.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")).cast("int").alias("c_nationkey"))
    dates = o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.element_at(F.array(*map(F.lit, ("published", "deadline", "odd"))), F.when(F.col("o_orderkey") % 50 == 0, 3).otherwise(F.col("o_orderkey") % 2 + 1).cast("int")).alias("kind"))
    clusters = p.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, None).when(F.col("p_partkey") % 9 == 1, -F.col("p_partkey")).when(F.col("p_partkey") % 9 == 2, F.col("p_partkey") - 1).otherwise(F.col("p_partkey")).alias("cluster"))
    figures = p.select("p_partkey", F.when(F.col("p_size") < 10, F.lit(0.0)).when(F.col("p_size") < 20, F.lit(None)).otherwise(F.col("p_retailprice")).cast("double").alias("figure"), (F.col("p_partkey") % 3 > 0).alias("disclosed"))
    bags = docs.select("doc_id", T.word_bag(F.col("text"), ()).alias("bag"))
    header = t("nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 2 == 0).alias("flag")).where("k <> 7")
    shards = t("supplier").where("s_nationkey % 5 <> 0").select(F.col("s_nationkey").alias("k"))
    stated = p.groupBy(F.col("p_name").alias("k")).agg((F.count("*") + F.when(F.length("p_name") % 4 == 0, 1).otherwise(0)).alias("stated"))
    typed = o.select("o_orderkey", F.col("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("a"), F.when(F.col("o_orderkey") % 4 > 0, F.lit("x")).otherwise(" ").alias("b"))
    url = F.when(F.col("c_custkey") % 6 == 0, "/help").when(F.col("c_custkey") % 6 == 1, "//evil.org").when(F.col("c_custkey") % 6 == 2, "https://a.site.org/x").when(F.col("c_custkey") % 6 == 3, "https://other.com?x").when(F.col("c_custkey") % 6 == 4, "http://site.org")
    rivals = p.select("p_partkey", F.col("p_name").alias("own"), F.when(F.col("p_partkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("p_partkey") % 4 == 1, F.array(F.lit("x"), "p_name")).when(F.col("p_partkey") % 4 == 2, F.array(F.concat(F.substring_index("p_name", " ", 1), F.lit(" Ltd")))).otherwise(F.array("p_brand")).alias("items"))
    return checks.report(
        R.compared(c.select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey")), reference, "c_custkey", "c_nationkey", "reference"), R.dated(dates, "date_kinds", "o_orderkey", "day", "kind", ["published"], ["deadline"], AS_OF),
        R.suppressed(docs, t("labels").where("toxic = 1"), "doc_id", "suppression"), R.cluster_members(clusters, "p_partkey", "cluster", "clusters"), R.figures_as_stated(figures, "figures", "p_partkey", "figure", F.col("disclosed")),
        R.leaked_words(bags, "furniture", "doc_id", "bag", FURNITURE), R.most_bytes(bags, "bag", 10_000, "index_size"), R.most_bytes(bags, "bag", 10_000_000_000, "index_fits"), R.flags_and_shards(header, shards, "k", "flag", "shards"),
        R.comparable(stated, p.select(F.col("p_name").alias("k")), "k", "stated", "comparable"), R.required_by_type(typed, "types", "o_orderkey", "kind", {"F": ["a"], "O": ["a", "b"]}), R.link_rules(c.select("c_custkey", url.alias("url")), "links", "c_custkey", "url", F.col("c_custkey") % 12 < 2, ["site.org"]),
        R.rival_lists(rivals, "rivals", "p_partkey", "own", "items"),
    )


_BAG = f"list_sort(list_distinct(list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: length(w) >= 2)))[1:120]"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in R.MONTHS) + "]"
FEED_GATE = f"""
WITH c AS (SELECT *, CASE c_custkey % 6 WHEN 0 THEN '/help' WHEN 1 THEN '//evil.org' WHEN 2 THEN 'https://a.site.org/x' WHEN 3 THEN 'https://other.com?x' WHEN 4 THEN 'http://site.org' END AS url FROM customer),
o AS (SELECT *, o_orderdate::DATE AS day, ['published', 'deadline', 'odd'][CASE WHEN o_orderkey % 50 = 0 THEN 3 ELSE o_orderkey % 2 + 1 END] AS kind FROM orders),
k AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN -p_partkey WHEN 2 THEN p_partkey - 1 ELSE p_partkey END AS cluster FROM part), kk AS (SELECT a.p_partkey, a.cluster, b.p_partkey AS lead, b.cluster AS own FROM k a LEFT JOIN k b ON a.cluster = b.p_partkey),
g AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 0.0 WHEN p_size < 20 THEN NULL ELSE p_retailprice END AS v, p_partkey % 3 > 0 AS told FROM part), b AS (SELECT doc_id, {_BAG} AS bag FROM documents),
h AS (SELECT n_nationkey AS k, n_nationkey % 2 = 0 AS f FROM nation WHERE n_nationkey <> 7), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey % 5 <> 0), hs AS (SELECT coalesce(h.k, s.k) AS k, h.k IS NOT NULL AS h, coalesce(f, false) AS f, s.k IS NOT NULL AS s FROM h FULL JOIN s ON h.k = s.k),
n AS (SELECT p_name AS k, count(*) AS n, count(*) + CASE WHEN length(p_name) % 4 = 0 THEN 1 ELSE 0 END AS stated FROM part GROUP BY 1)
""" + " UNION ALL ".join([
    "SELECT CASE WHEN c_custkey % 5 = 0 THEN 'WARN' ELSE 'FAIL' END AS severity, 'reference' AS check_name, c_custkey::VARCHAR AS row_key, CASE WHEN c_custkey % 5 = 0 THEN 'no reference' ELSE 'differs from the reference' END AS message FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0",
    _v("date_kinds", "o_orderkey", "CASE kind WHEN 'odd' THEN 'unknown kind of date' WHEN 'published' THEN 'in the future' ELSE 'already past' END", f"o WHERE kind = 'odd' OR kind = 'published' AND day > DATE '{AS_OF}' OR kind = 'deadline' AND day < DATE '{AS_OF}'"),
    _v("suppression", "doc_id", "'suppressed, yet there'", "documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    _v("clusters", "p_partkey", "CASE WHEN cluster IS NULL THEN 'no cluster' WHEN lead IS NULL THEN 'its cluster''s lead is not there' ELSE 'its cluster''s lead is in another one' END", "kk WHERE cluster IS NULL OR lead IS NULL OR own IS DISTINCT FROM cluster"),
    _v("figures", "p_partkey", "CASE WHEN told THEN 'null for a figure' WHEN v = 0 THEN '0 for a figure not disclosed' ELSE 'a figure not disclosed' END", "g WHERE told = (v IS NULL)"),
    _v("furniture", "doc_id", "n || ' words of the furniture'", f"(SELECT doc_id, len(list_intersect(bag, {FURNITURE})) AS n FROM b) WHERE n >= 6"),
    _v("furniture", "doc_id", "'names ' || list_filter(bag, lambda w: list_contains(" + _MONTHS + ", w))[1]", f"b WHERE list_has_any(bag, {_MONTHS})", "WARN"),
    _v("index_size", "'table'", "n || ' bytes, 10000 at most'", "(SELECT sum(octet_length(encode(array_to_string(bag, ' ')))) AS n FROM b) WHERE n > 10000"),
    _v("shards", "k", "CASE WHEN NOT h THEN 'rows without a header' WHEN f THEN 'flagged, without rows' ELSE 'has rows, not flagged' END", "hs WHERE NOT h OR f <> s"),
    _v("comparable", "k", "'states ' || stated || ', has ' || n", "n WHERE stated <> n"), _v("comparable", "k", "'a single one'", "n WHERE n = 1", "WARN"),
    _v("types", "o_orderkey", "m", "(SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown type' ELSE nullif('lacks ' || concat_ws(', ', CASE WHEN o_orderkey % 3 = 0 THEN 'a' END, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'O' THEN 'b' END), 'lacks ') END AS m FROM orders) WHERE m IS NOT NULL"),
    _v("links", "c_custkey", "m", "(SELECT c_custkey, CASE WHEN url IS NULL THEN NULL WHEN c_custkey % 12 < 2 THEN CASE WHEN url <> '/help' THEN 'not a path' END WHEN url LIKE 'https://%' THEN CASE WHEN url LIKE '%other%' THEN 'links to other.com' END ELSE 'not https' END AS m FROM c) WHERE m IS NOT NULL"),
    _v("rivals", "p_partkey", "['empty list', 'names its owner', 'names its owner''s group'][p_partkey % 4 + 1]", "part WHERE p_partkey % 4 < 3"),
])


def vocabulary_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Names against their vocabulary: aliases that one owner takes from another, malformed names, and counts that may only fall."""
    p = table(spark, sf, "part")
    before = p.select(T.norm(F.concat_ws(" ", "p_name", "p_type")).alias("alias"), F.col("p_brand").alias("owner")).groupBy("alias").agg(F.min("owner").alias("owner"))
    after = before.select("alias", F.when(F.length("alias") % 3 == 0, "Brand#11").when(F.length("alias") % 3 == 1, "New").otherwise(F.col("owner")).alias("owner"))
    k = F.col("p_partkey") % 10
    name = F.when(k == 0, "123").when(k == 1, F.concat("p_name", F.lit(" &amp; Co"))).when(k == 2, F.concat("p_name", F.lit("  x"))).when(k == 3, F.concat("p_name", F.lit(" (UK"))).when(k == 4, F.concat("p_name", F.lit(" -"))).when(k == 5, None).otherwise(F.concat("p_name", F.lit(" (UK)")))
    names = p.select("p_partkey", name.alias("name"))
    now = p.groupBy(F.col("p_brand").alias("measure")).agg(F.count_if(F.col("p_size") > 25).alias("n"))
    base = now.where(F.right("measure", F.lit(1)) != "5").select("measure", (F.col("n") + F.when(F.length("measure") % 2 == 0, -1).when(F.right("measure", F.lit(1)) == "3", 2).otherwise(0)).alias("n"))
    return checks.report(R.alias_steals(before, after, "alias", "owner", "alias_steals"), R.malformed_names(names, "names", "p_partkey", "name", "WARN"), R.vocabulary_ratchet(now, base, "measure", "n", "ratchet"))


VOCABULARY_GATE = f"""
WITH b AS (SELECT {NORM.format(x="p_name || ' ' || p_type")} AS alias, min(p_brand) AS owner FROM part GROUP BY 1), a AS (SELECT alias, owner, CASE length(alias) % 3 WHEN 0 THEN 'Brand#11' WHEN 1 THEN 'New' ELSE owner END AS new FROM b),
n AS (SELECT p_brand AS k, count(*) FILTER (p_size > 25) AS n FROM part GROUP BY 1), r AS (SELECT k, n, CASE WHEN right(k, 1) <> '5' THEN n + CASE WHEN length(k) % 2 = 0 THEN -1 WHEN right(k, 1) = '3' THEN 2 ELSE 0 END END AS base FROM n)
""" + " UNION ALL ".join([
    "SELECT 'FAIL' AS severity, 'alias_steals' AS check_name, alias AS row_key, 'taken from ' || owner || ' by ' || new AS message FROM a WHERE owner <> new AND owner IN (SELECT new FROM a)",
    _v("names", "p_partkey", "['no letter', 'markup', 'odd blanks', 'brackets', 'a mark at its end', 'no letter'][p_partkey % 10 + 1]", "part WHERE p_partkey % 10 < 6", "WARN"),
    "SELECT CASE WHEN base IS NULL OR n > base THEN 'FAIL' ELSE 'WARN' END, 'ratchet', k, CASE WHEN base IS NULL THEN n || ', cleared before' WHEN n > base THEN 'rose from ' || base || ' to ' || n WHEN n < base THEN 'fell from ' || base || ' to ' || n ELSE n || ' as before' END FROM r WHERE base IS NOT NULL OR n > 0",
])

QUERIES = {"feed_gate": (feed_gate, FEED_GATE), "vocabulary_gate": (vocabulary_gate, VOCABULARY_GATE)}
