"""Queries on notices: awards, titles, relations, identities, orders of names, and resolving stored rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import notices as N
from tidemark.plans.names import NORM
from tidemark.tables import table


def award_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as notices and their lines as awards with a supplier each: a row for each, and for notices without awards."""
    lines = table(spark, sf, "lineitem").where("l_quantity > 10")
    lots = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("lot"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("value"), F.when(F.col("l_quantity") < 45, F.array("l_suppkey")).alias("suppliers"))).alias("lots"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(lots, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return N.award_rows(o, "o_orderkey", "lots", "o_totalprice")


AWARDS = """
SELECT o_orderkey, l_linenumber AS lot, CASE WHEN l_quantity < 45 THEN l_suppkey END AS supplier, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE o_totalprice END AS value
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 10) ON o_orderkey = l_orderkey
"""


def titles_without_makers(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's title without its maker."""
    p = table(spark, sf, "part")
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(": "), "p_brand", F.lit(", "), "p_name")).otherwise(F.concat("p_brand", F.lit(" "), "p_name"))
    return p.select("p_partkey", N.without_maker(title).alias("title"))


TITLES = "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ': ' || p_name ELSE p_brand || ' ' || p_name END AS title FROM part"


def live_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first order, by key, that had not ended by a date; open orders have no end."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("date")).alias("end")))).alias("r"))
    live = N.live_relation(F.col("r"), "1997-01-01")
    return o.select("o_custkey", live["o_orderkey"].alias("relation"))


LIVE_RELATIONS = "SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'O' OR o_orderdate::DATE >= DATE '1997-01-01') AS relation FROM orders GROUP BY 1"


def shown_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The first four parts of each brand that can be shown: with a long name and a size."""
    return N.shown_rows(table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size"), "p_brand", (F.length("p_name") > 9) & (F.col("p_size") > 20), [F.desc("p_size"), F.col("p_partkey")])


SHOWN = "SELECT p_brand, p_partkey, p_name, p_size, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part WHERE length(p_name) > 9 AND p_size > 20) WHERE place <= 4"


def story_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Whose part a line of text is about: by a whole name that one type has, else by a word of one type with its own size's word."""
    p = table(spark, sf, "part")
    aliases = p.where("p_size < 12").select(F.col("p_type").alias("owner"), T.norm(F.col("p_name")).alias("alias")).union(p.select("p_type", F.concat(F.lit("only "), T.norm(F.col("p_type")), F.lit(" made"))))
    scope = p.select(F.col("p_type").alias("owner"), F.lower("p_brand").alias("term")).distinct().withColumn("term", T.slug(F.col("term"))).union(p.select("p_type", F.lit("steelworks")).distinct())
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_name", F.lit("for sale"))).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", F.lit("news of"), "p_type", F.lit("steelworks"))).otherwise(F.concat_ws(" ", F.lit("made only of"), "p_type"))
    stories = p.select("p_partkey", F.split(T.norm(text), " ").alias("words"))
    return N.identities(stories, "p_partkey", "words", aliases, scope)


_N = NORM.format
IDENTITIES = f"""
WITH a AS (SELECT DISTINCT p_type AS owner, {_N(x='p_name')} AS alias FROM part WHERE p_size < 12 UNION SELECT p_type, 'only ' || {_N(x='p_type')} || ' made' FROM part),
s AS (SELECT p_partkey, string_split({_N(x="CASE p_partkey % 3 WHEN 0 THEN p_name || ' for sale' WHEN 1 THEN 'news of ' || p_type || ' steelworks' ELSE 'made only of ' || p_type END")}, ' ') AS ws FROM part),
st AS (SELECT alias, min(owner) AS owner, list_distinct(string_split(alias, ' ')) AS ps FROM a GROUP BY alias HAVING count(DISTINCT owner) = 1),
h AS (SELECT p_partkey, owner, 0 AS step FROM s JOIN st ON len(ps) > 1 AND list_has_all(ws, ps)),
w AS (SELECT w, min(owner) AS owner FROM (SELECT owner, unnest(string_split(alias, ' ')) AS w FROM a) GROUP BY w HAVING count(DISTINCT owner) = 1 AND length(w) >= 4),
sc AS (SELECT DISTINCT p_type AS owner, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS term FROM part UNION SELECT p_type, 'steelworks' FROM part),
k AS (SELECT p_partkey, w.owner, 1 AS step FROM s JOIN w ON list_contains(ws, w.w) JOIN sc ON sc.owner = w.owner AND list_contains(ws, sc.term)),
g AS (SELECT p_partkey, step, count(DISTINCT owner) AS n, min(owner) AS owner FROM (SELECT * FROM h UNION SELECT * FROM k) GROUP BY 1, 2), b AS (SELECT p_partkey, arg_min({{'s': step, 'n': n, 'o': owner}}, step) AS b FROM g GROUP BY 1)
SELECT s.p_partkey, CASE WHEN b.n = 1 THEN b.o END AS owner, CASE WHEN b.n > 1 THEN 'several' WHEN b.s = 0 THEN 'alias' WHEN b.s = 1 THEN 'word and scope' ELSE 'none' END AS how FROM s LEFT JOIN b ON s.p_partkey = b.p_partkey
"""


def ranked_names(spark: SparkSession, sf: str) -> DataFrame:
    """Part names by falling count, then by name whatever its case: the first thirty with their place."""
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("name"))
    x = p.groupBy("name").agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), F.collate("name", "UNICODE_CI"), F.desc("name")).limit(30)


RANKED_NAMES = """
WITH x AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE p_name END AS name, count(*) AS n FROM part GROUP BY 1)
SELECT name, n FROM x ORDER BY n DESC, lower(name), name DESC LIMIT 30
"""


def rematched(spark: SparkSession, sf: str) -> DataFrame:
    """Stored raw names resolved against the index they had and against today's: how many went from which outcome to which."""
    p = table(spark, sf, "part")
    outcome = lambda n: F.when(n == 1, "confirmed").when(n > 1, "ambiguous").otherwise("unmatched")
    index = lambda df, c: df.groupBy(F.lower("p_name").alias("key")).agg(F.count_distinct("p_type").alias(c))
    raw = p.select(F.lower("p_name").alias("key"))
    x = raw.join(index(p.where("p_size = 7"), "before"), "key", "left").join(index(p.where("p_size in (7, 9)"), "after"), "key", "left")
    return x.groupBy(outcome(F.col("before")).alias("was"), outcome(F.col("after")).alias("now")).agg(F.count("*").alias("n"))


REMATCHED = """
WITH b AS (SELECT lower(p_name) AS key, count(DISTINCT p_type) AS n FROM part WHERE p_size = 7 GROUP BY 1), a AS (SELECT lower(p_name) AS key, count(DISTINCT p_type) AS n FROM part WHERE p_size IN (7, 9) GROUP BY 1)
SELECT CASE WHEN b.n = 1 THEN 'confirmed' WHEN b.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS was, CASE WHEN a.n = 1 THEN 'confirmed' WHEN a.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS now, count(*) AS n
FROM part LEFT JOIN b ON lower(p_name) = b.key LEFT JOIN a ON lower(p_name) = a.key GROUP BY 1, 2
"""

QUERIES = {
    "award_rows": (award_rows, AWARDS), "titles_without_makers": (titles_without_makers, TITLES), "live_relations": (live_relations, LIVE_RELATIONS), "shown_parts": (shown_parts, SHOWN), "story_identities": (story_identities, IDENTITIES),
    "ranked_names": (ranked_names, RANKED_NAMES), "rematched": (rematched, REMATCHED),
}
