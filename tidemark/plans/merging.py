"""Queries that merge, compare and rebuild tables of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import merge
from tidemark.plans.names import NORM
from tidemark.plans.records import _SIDES, _customers
from tidemark.tables import table


def first_source_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names of two states of the table and of suppliers: the first source that has the key."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.lit("S").alias("extra"))
    sources = [_customers(spark, sf, 1).select("c_custkey", "c_name"), _customers(spark, sf, 0).select("c_custkey", "c_name"), suppliers]
    return merge.union_first_wins(sources, "c_custkey", [F.col("c_name")])


FIRST_SOURCE = f"""
WITH {_SIDES}, u AS (SELECT c_custkey, c_name, NULL AS extra, 0 AS from_source FROM a UNION ALL SELECT c_custkey, c_name, NULL, 1 FROM o UNION ALL SELECT s_suppkey, s_name, 'S', 2 FROM supplier)
SELECT c_custkey, c_name, extra, from_source FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY from_source, c_name) AS n FROM u) WHERE n = 1
"""


def children_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Part types of every brand: those of large parts in order of key, then all others', once each."""
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", "p_size")
    found = merge.children_union([p.where("p_size > 25"), p], "p_brand", "p_type", "p_partkey")
    return found.select("p_brand", F.array_join("children", ",").alias("children"))


CHILDREN = """
WITH u AS (SELECT p_brand, p_type, 0 AS t, p_partkey AS o FROM part WHERE p_size > 25 UNION ALL SELECT p_brand, p_type, 1, p_partkey FROM part),
m AS (SELECT p_brand, p_type, min({'t': t, 'o': o}) AS spot FROM u GROUP BY 1, 2) SELECT p_brand, string_agg(p_type, ',' ORDER BY spot, p_type) AS children FROM m GROUP BY 1
"""


def feed_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of segments over the table's defaults; rows in the holding pen are left out."""
    feed = _customers(spark, sf, 2).select(F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey")).alias("c_custkey"), F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    return merge.feed_over_defaults(feed, _customers(spark, sf, 0), "c_custkey", "c_mktsegment", F.col("c_nationkey") == 7)


FEED = f"""
WITH {_SIDES}, f AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS k, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS v FROM b WHERE c_nationkey <> 7)
SELECT coalesce(o.c_custkey, k) AS c_custkey, coalesce(v, o.c_mktsegment) AS c_mktsegment, CASE WHEN o.c_custkey IS NULL THEN 'feed only' WHEN k IS NULL THEN 'default' WHEN v IS NULL THEN 'default kept' ELSE 'overlaid' END AS status FROM o FULL JOIN f ON o.c_custkey = k
"""


def range_on_top(spark: SparkSession, sf: str) -> DataFrame:
    """Types that a brand's parts record, and those its name range adds, without overriding."""
    p = table(spark, sf, "part")
    records = p.where("p_size > 20").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    extra = p.where("p_size <= 20").groupBy("p_brand", "p_type").agg((-F.count("*")).alias("n"))
    return merge.added_range(records, extra, ["p_brand", "p_type"])


RANGE = """
WITH r AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size > 20 GROUP BY 1, 2)
SELECT *, false AS from_range FROM r UNION ALL SELECT p_brand, p_type, -count(*), true FROM part WHERE p_size <= 20 AND (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM r) GROUP BY 1, 2
"""


def rename_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose key changed: paired with new ones by whole name and type, else by name alone, one to one."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    head = p.withColumn("p_partkey", F.when(F.col("p_size") < 15, -F.col("p_partkey") - 1).otherwise(F.col("p_partkey"))).withColumn("p_type", F.when(F.col("p_size") < 5, "NEW").otherwise(F.col("p_type"))).where("p_size <> 10")
    return merge.renamed(p, head, "p_partkey", [T.strict_key(F.concat_ws(" ", "p_name", "p_type")), T.norm(F.col("p_name"))])


RENAMES = f"""
WITH g AS (SELECT p_partkey AS k, p_name, p_type FROM part WHERE p_size < 15), c AS (SELECT -p_partkey - 1 AS k, p_name, CASE WHEN p_size < 5 THEN 'NEW' ELSE p_type END AS p_type FROM part WHERE p_size < 15 AND p_size <> 10),
g1 AS (SELECT k, f, row_number() OVER (PARTITION BY f ORDER BY k) AS n FROM (SELECT k, {NORM.format(x="p_name || ' ' || p_type")} AS f FROM g)), c1 AS (SELECT k, f, row_number() OVER (PARTITION BY f ORDER BY k) AS n FROM (SELECT k, {NORM.format(x="p_name || ' ' || p_type")} AS f FROM c)),
p1 AS (SELECT g1.k AS old, c1.k AS new FROM g1 JOIN c1 ON g1.f = c1.f AND g1.n = c1.n),
g2 AS (SELECT k, f, row_number() OVER (PARTITION BY f ORDER BY k) AS n FROM (SELECT k, {NORM.format(x='p_name')} AS f FROM g WHERE k NOT IN (SELECT old FROM p1))), c2 AS (SELECT k, f, row_number() OVER (PARTITION BY f ORDER BY k) AS n FROM (SELECT k, {NORM.format(x='p_name')} AS f FROM c WHERE k NOT IN (SELECT new FROM p1)))
SELECT old, new, 0 AS form FROM p1 UNION ALL SELECT g2.k, c2.k, 1 FROM g2 JOIN c2 ON g2.f = c2.f AND g2.n = c2.n
"""


def children_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Part names that brands gained and lost between two states of the part table."""
    p = table(spark, sf, "part").select("p_brand", "p_name", "p_size")
    return merge.children_diff(p.where("p_size > 8"), p.where("p_size < 44"), "p_brand", "p_name")


CHILDREN_CHANGES = """
WITH a AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size > 8), b AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size < 44), k AS (SELECT p_brand FROM a INTERSECT SELECT p_brand FROM b)
SELECT p_brand, 'lost' AS change, p_name FROM (SELECT * FROM a EXCEPT SELECT * FROM b) WHERE p_brand IN (SELECT p_brand FROM k) UNION ALL SELECT p_brand, 'gained', p_name FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE p_brand IN (SELECT p_brand FROM k)
"""


def vocabulary_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Words of part names and of part types that only one of them has."""
    p = table(spark, sf, "part")
    words = lambda c: p.select(F.explode(F.split(T.norm(F.col(c)), " ")).alias("value"))
    return merge.symmetric_difference(words("p_name").union(p.select(F.lit("common"))), words("p_type").union(p.select(F.lit("common"))))


VOCABULARY = f"""
WITH a AS (SELECT DISTINCT unnest(string_split({NORM.format(x='p_name')}, ' ')) AS value FROM part), b AS (SELECT DISTINCT unnest(string_split({NORM.format(x='p_type')}, ' ')) AS value FROM part)
SELECT value, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT value, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
"""


def _parts(spark: SparkSession, sf: str, bad: bool) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("hub"), F.concat(F.lit("because of "), "p_name").alias("reason"), "p_size")
    second = p.where("p_size >= 25")
    if bad:
        second = second.withColumn("hub", F.when(F.col("p_size") == 50, "none such").otherwise(F.col("hub"))).union(p.where("p_size between 20 and 24").withColumn("hub", F.lit("PROMO"))).withColumn("reason", F.when(F.col("p_size") == 30, " x ").otherwise(F.col("reason")))
    return merge.merged_parts([p.where("p_size < 25"), second], p.select(F.col("hub").alias("value")), "p_partkey", "hub", "reason", 10)


def parts_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Why two parts of a table do not merge."""
    return _parts(spark, sf, True)[1]


PARTS_REFUSED = """
SELECT p_partkey, 'unknown value' AS refusal FROM part WHERE p_size = 50 UNION ALL SELECT p_partkey, 'short reason' FROM part WHERE p_size = 30 UNION ALL SELECT p_partkey, 'contradiction' FROM part WHERE p_size BETWEEN 20 AND 24 AND p_type <> 'PROMO'
"""


def parts_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The merged table of the good parts beside that of the bad ones, which has no rows."""
    return _parts(spark, sf, False)[0].unionByName(_parts(spark, sf, True)[0])


PARTS_MERGED = "SELECT p_partkey, p_type AS hub, 'because of ' || p_name AS reason FROM part WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_type IS NULL)"


def worklist_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Open and decided customers after a rebuild."""
    c = table(spark, sf, "customer")
    previous = c.where("c_nationkey < 12").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("decision"))
    return merge.rebuilt_worklist(c.where("c_nationkey > 5").select("c_custkey"), previous, "c_custkey", "decision")


REBUILD = """
SELECT * FROM (SELECT c_custkey, CASE WHEN c_nationkey < 12 AND c_acctbal > 0 THEN c_mktsegment END AS decision,
  CASE WHEN c_nationkey <= 5 THEN CASE WHEN c_acctbal > 0 THEN 'decided, gone' END WHEN c_nationkey < 12 AND c_acctbal > 0 THEN 'decided' ELSE 'open' END AS state FROM customer) WHERE state IS NOT NULL
"""


def newest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first and last order as two captures: the block checked last, ours at ties."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("checked"), "o_orderpriority")
    ours = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderkey", "checked", "o_orderpriority")).alias("x")).select("o_custkey", "x.checked", "x.o_orderpriority")
    theirs = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "checked", "o_orderpriority")).alias("x")).select("o_custkey", "x.checked", "x.o_orderpriority")
    return merge.newest_block(ours.where("o_custkey % 7 <> 0"), theirs.where("o_custkey % 5 <> 0"), "o_custkey", "checked", ["o_orderpriority"])


NEWEST = """
WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS checked FROM orders),
a AS (SELECT o_custkey AS k, arg_min_null(checked, o_orderkey) AS c, min_by(o_orderpriority, o_orderkey) AS p FROM o WHERE o_custkey % 7 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, arg_max_null(checked, o_orderkey) AS c, max_by(o_orderpriority, o_orderkey) AS p FROM o WHERE o_custkey % 5 <> 0 GROUP BY 1),
x AS (SELECT coalesce(a.k, b.k) AS k, a.c AS ac, b.c AS bc, a.p AS ap, b.p AS bp, coalesce(b.c > a.c, a.k IS NULL OR (a.c IS NULL AND b.c IS NOT NULL)) AS newer FROM a FULL JOIN b ON a.k = b.k)
SELECT k AS o_custkey, CASE WHEN newer THEN bc ELSE ac END AS checked, CASE WHEN newer THEN bp ELSE ap END AS o_orderpriority, CASE WHEN newer THEN 'theirs' ELSE 'ours' END AS side FROM x
"""


def carried_retest(spark: SparkSession, sf: str) -> DataFrame:
    """Carried names against today's index of names: dropped, folded or kept."""
    p = table(spark, sf, "part")
    index = p.where("p_size > 12").groupBy(F.lower("p_name").alias("key")).agg(F.count_distinct("p_brand").alias("n"))
    return merge.retested(p.select(F.lower("p_name").alias("key")), index, "key")


RETEST = """
WITH i AS (SELECT lower(p_name) AS key, count(DISTINCT p_brand) AS n FROM part WHERE p_size > 12 GROUP BY 1)
SELECT DISTINCT lower(p_name) AS key, CASE WHEN n > 1 THEN 'dropped' WHEN n = 1 THEN 'folded' ELSE 'kept' END AS outcome FROM part LEFT JOIN i ON lower(p_name) = i.key
"""


def sticky_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Changed fields of customers: today's, else the flag of the capture before."""
    c = table(spark, sf, "customer")
    today = c.select("c_custkey", F.when(F.col("c_acctbal") > 5000, "c_acctbal").otherwise("").alias("changed"))
    before = c.where("c_nationkey < 10").select("c_custkey", F.when(F.col("c_nationkey") < 5, "c_mktsegment").otherwise("").alias("changed"))
    return merge.sticky_changes(today, before, "c_custkey")


STICKY = "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'c_acctbal' WHEN c_nationkey < 5 THEN 'c_mktsegment' ELSE '' END AS changed FROM customer"


def no_loss_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that are gone: renamed by whole name, by first word, allowed, or lost."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_name"), F.lower("p_brand")).alias("form"), "p_name", "p_size", "p_type")
    return merge.no_loss(p, p.where("p_size > 6"), "p_partkey", "form", [F.concat(F.lower("p_name"), F.lit("/"), "p_type")], p.where("p_type like 'P%'").select("p_partkey"))


NO_LOSS_FORMS = """
WITH a AS (SELECT * FROM part WHERE p_size > 6)
SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS form, CASE WHEN lower(p_name) || ' ' || lower(p_brand) IN (SELECT lower(p_name) || ' ' || lower(p_brand) FROM a) OR lower(p_name) || '/' || p_type IN (SELECT lower(p_name) || '/' || p_type FROM a) THEN 'renamed'
  WHEN p_type LIKE 'P%' THEN 'allowed' ELSE 'lost' END AS outcome FROM part WHERE p_size <= 6
"""

def three_way_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers edited, added and removed on two sides, merged record by record, after a merge with conflicts was refused."""
    s, fields = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["s_name", "s_nationkey", "s_acctbal"]
    k = F.col("s_suppkey")
    ours = s.where(k % 11 != 3).withColumn("s_acctbal", F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("s_acctbal"))).union(s.where(k % 4 == 0).select(-k - 1, F.lit("ours"), "s_nationkey", "s_acctbal"))
    both = s.where(k % 13 != 3).withColumn("s_name", F.when(k % 7 == 0, F.concat("s_name", F.lit(" Ltd"))).otherwise(F.col("s_name")))
    theirs = both.where(k % 35 != 0).union(s.where(k % 35 == 0)).where("s_suppkey % 13 <> 3").union(s.where(k % 6 == 0).select(-k - 1_000_000, F.lit("theirs"), "s_nationkey", "s_acctbal"))
    try:
        merge.three_way_records(s, ours, both, "s_suppkey", fields)
        refused = False
    except ValueError:
        refused = True
    return merge.three_way_records(s, ours, theirs, "s_suppkey", fields).withColumn("refused", F.lit(refused))


THREE_WAY_SUPPLIERS = """
WITH s AS (SELECT s_suppkey AS k, s_name AS n, s_nationkey AS c, s_acctbal AS b FROM supplier),
m AS (SELECT k, CASE WHEN k % 7 = 0 AND k % 35 <> 0 AND k % 13 <> 3 THEN n || ' Ltd' ELSE n END AS n, c, CASE WHEN k % 5 = 0 AND k % 11 <> 3 THEN NULL ELSE b END AS b,
  CASE WHEN k % 7 = 0 AND k % 35 <> 0 AND k % 13 <> 3 THEN 'theirs' WHEN k % 5 = 0 AND k % 11 <> 3 AND b IS NOT NULL THEN 'ours' ELSE 'same' END AS side FROM s WHERE k % 11 <> 3 OR k % 13 <> 3),
u AS (SELECT * FROM m UNION ALL SELECT -k - 1, 'ours', c, b, 'ours' FROM s WHERE k % 4 = 0 UNION ALL SELECT -k - 1000000, 'theirs', c, b, 'theirs' FROM s WHERE k % 6 = 0)
SELECT k AS s_suppkey, n AS s_name, c AS s_nationkey, b AS s_acctbal, side, (SELECT count(*) FROM s WHERE k % 35 = 0 AND k % 11 <> 3 AND k % 13 <> 3) > 0 AS refused FROM u
"""

QUERIES = {
    "three_way_suppliers": (three_way_suppliers, THREE_WAY_SUPPLIERS),
    "first_source_wins": (first_source_wins, FIRST_SOURCE), "children_lists": (children_lists, CHILDREN), "feed_overlay": (feed_overlay, FEED), "range_on_top": (range_on_top, RANGE), "rename_pairs": (rename_pairs, RENAMES),
    "children_changes": (children_changes, CHILDREN_CHANGES), "vocabulary_difference": (vocabulary_difference, VOCABULARY), "parts_refused": (parts_refused, PARTS_REFUSED), "parts_merged": (parts_merged, PARTS_MERGED), "worklist_rebuild": (worklist_rebuild, REBUILD),
    "newest_blocks": (newest_blocks, NEWEST), "carried_retest": (carried_retest, RETEST), "sticky_flags": (sticky_flags, STICKY), "no_loss_forms": (no_loss_forms, NO_LOSS_FORMS),
}
