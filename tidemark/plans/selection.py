"""Queries that filter, partition, order and sample, with what each leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import filters
from tidemark.tables import table


def line_code_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by their headline code against the codes of any line."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    x = lines.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_returnflag"))["l_returnflag"].alias("headline"), F.array_sort(F.collect_set("l_returnflag")).alias("codes"))
    return x.select("l_orderkey", (F.col("headline") == "R").alias("by_headline"), F.exists("codes", lambda c: c == "R").alias("by_any_line"))


LINE_CODE = "SELECT l_orderkey, min({'n': l_linenumber, 'f': l_returnflag}).f = 'R' AS by_headline, bool_or(l_returnflag = 'R') AS by_any_line FROM lineitem GROUP BY 1"


def idle_suppressions(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a suppression list (every user and a few ids more) that match no event."""
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return filters.unmatched_entries(users, table(spark, sf, "events"), "user_id")


IDLE = "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)"


def contact_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as contacts: what keeps a name from being a person's, malformed addresses, curated ones, parked pages."""
    c = table(spark, sf, "customer")
    seg = F.lower("c_mktsegment")
    name = F.when(F.col("c_nationkey") < 5, F.concat(seg, F.lit(" sales team"))).when(F.col("c_nationkey") < 10, seg).when(F.col("c_nationkey") == 10, F.lit(" ")).otherwise(F.concat(F.lit("Jo "), seg))
    email = F.concat(seg, F.when(F.col("c_nationkey") % 3 == 0, F.lit(" @x")).when(F.col("c_nationkey") % 3 == 1, F.lit("@x")).otherwise(F.lit("@x.org")))
    use = F.when(F.col("c_nationkey") % 2 == 0, F.lit(" ")).when(F.col("c_nationkey") % 5 == 0, F.lit("calls"))
    title, body = F.when(F.col("c_nationkey") == 1, "This domain is for sale").otherwise(F.col("c_name")), F.when(F.col("c_nationkey") == 2, "Related searches: x").otherwise(seg)
    return c.select("c_custkey", filters.named_person(name).alias("not_a_person"), filters.email_shape(email).alias("email_ok"), filters.curated(F.col("c_acctbal") < 0, use).alias("curated"), filters.parked(title, body).alias("parked"))


CONTACTS = """
SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'department' WHEN c_nationkey < 10 THEN 'single word' WHEN c_nationkey = 10 THEN 'empty' END AS not_a_person, c_nationkey % 3 = 2 AS email_ok,
  NOT c_acctbal < 0 OR (c_nationkey % 2 = 1 AND c_nationkey % 5 = 0) AS curated, CASE c_nationkey WHEN 1 THEN 'title' WHEN 2 THEN 'body' END AS parked FROM customer
"""


def product_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a product path, without those that are a folder above another page of the host."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"), F.regexp_extract("url", r"//[^/]*(/[^?#]*)", 1).alias("path"))
    above = p.select((-F.col("page_id") - 1).alias("page_id"), "host", F.regexp_replace("path", "/[^/]*/?$", "").alias("path"))
    both = p.union(above).where(F.col("path").rlike("^/(en|fr|de|es)") | (F.col("path") == ""))
    return filters.without_prefixes(both, "host", "path").select("page_id", "host", "path")


PRODUCT_PATHS = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, regexp_extract(url, '//[^/]*(/[^?#]*)', 1) AS path FROM pages),
b AS (SELECT * FROM (SELECT * FROM p UNION ALL SELECT -page_id - 1, host, regexp_replace(path, '/[^/]*/?$', '') FROM p) WHERE regexp_matches(path, '^/(en|fr|de|es)') OR path = ''),
n AS (SELECT *, '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') AS own FROM b)
SELECT page_id, host, path FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.host = x.host AND y.own <> x.own AND starts_with(y.own, CASE WHEN x.own = '/' THEN '/' ELSE x.own || '/' END))
"""


def refused_catalogues(spark: SparkSession, sf: str) -> DataFrame:
    """Brands with few parts, or with most parts outside the known types."""
    return filters.refused_groups(table(spark, sf, "part"), "p_brand", F.length("p_type") % 2 == 0, 8)


REFUSED = "SELECT * FROM (SELECT p_brand, count(*) AS n, count(*) FILTER (length(p_type) % 2 = 0) AS good, CASE WHEN count(*) < 8 THEN 'too few' WHEN 2 * count(*) FILTER (length(p_type) % 2 = 0) < count(*) THEN 'mostly uncategorised' END AS reason FROM part GROUP BY 1) WHERE reason IS NOT NULL"


def cascaded_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Options of brand, type and size: each facet's among the parts that the choices before it leave."""
    p = table(spark, sf, "part")
    return filters.facets(p, {"p_brand": "Brand#11"}, ["p_brand", "p_type", "p_size"])


FACETS = """
SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_brand = 'Brand#11' GROUP BY 2
UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part WHERE p_brand = 'Brand#11' GROUP BY 2
"""


def live_item(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first open order, else the first; and the dearest line's order as answer, in scope if one is."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    live = filters.live_first(o, "o_custkey", "status", [F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("live"))
    best = filters.in_scope_first(o, "o_custkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), [F.desc("o_totalprice"), F.col("o_orderkey")])
    return live.join(best.select("o_custkey", F.col("o_orderkey").alias("answer"), "out_of_scope"), "o_custkey")


LIVE_ITEM = """
WITH o AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS s, NOT (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS x FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY x, o_totalprice DESC, o_orderkey) AS b FROM o)
SELECT l.o_custkey, l.o_orderkey AS live, m.o_orderkey AS answer, m.x AS out_of_scope FROM r l JOIN r m ON l.o_custkey = m.o_custkey AND l.a = 1 AND m.b = 1
"""


def display_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of each priority by date then key with nulls last, flagged ones first, in buckets of relevance: the first six of each."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate", "o_orderstatus", F.split(F.lower("o_orderpriority"), "-").alias("specs"))
    bucket = filters.relevance_bucket(F.array("o_orderstatus"), ["P"], ["O"])
    ended = F.coalesce(F.col("o_orderdate").cast("date") < F.lit("1996-01-01").cast("date"), F.lit(False))
    x = o.withColumns({"bucket": bucket, "ended": ended})
    return filters.ordered_places(x, "o_orderpriority", [F.col("ended"), F.col("bucket"), F.desc(F.coalesce(F.col("o_orderdate").cast("string"), F.lit(""))), F.col("o_orderkey")], 6).select("o_orderpriority", "place", "o_orderkey", "bucket", "ended")


DISPLAY = """
WITH x AS (SELECT *, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS bucket, coalesce(o_orderdate::DATE < DATE '1996-01-01', false) AS ended FROM orders)
SELECT o_orderpriority, place, o_orderkey, bucket, ended FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ended, bucket, o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM x) WHERE place <= 6
"""


def area_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of an area by nation in the region's own order of nations; names compared without case."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation").where("n_regionkey <= 2")
    x = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: a fixed small dimension
    return filters.ordered_places(x, "n_regionkey", [F.col("n_nationkey"), F.lower("s_name"), F.col("s_suppkey")]).select("n_regionkey", "place", "s_suppkey", "n_name")


AREA = "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, lower(s_name), s_suppkey) AS place, s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <= 2"


def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty parts with a long type, the same in every run."""
    return filters.sampled(table(spark, sf, "part").where("length(p_type) > 3"), "p_partkey", "seed-7:", 50).select("p_partkey", "p_name")


SAMPLE = "SELECT p_partkey, p_name FROM part WHERE length(p_type) > 3 ORDER BY md5('seed-7:' || p_partkey::VARCHAR), p_partkey LIMIT 50"


def rivals_locked(spark: SparkSession, sf: str) -> DataFrame:
    """How many parts of the same type other brands have; parts without a type have no rivals."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 5, F.col("p_type")).alias("kind"))
    each = p.where("kind is not null").groupBy("kind", "p_brand").agg(F.count("*").alias("n"))
    per = each.join(each.groupBy("kind").agg(F.sum("n").alias("all")), "kind").select("kind", "p_brand", (F.col("all") - F.col("n")).alias("rivals"))
    return p.join(per, ["kind", "p_brand"], "left").select("p_partkey", F.coalesce("rivals", F.lit(0)).alias("rivals"))


RIVALS_LOCKED = """
WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 5 THEN p_type END AS kind FROM part)
SELECT p_partkey, coalesce(count(*) OVER (PARTITION BY kind) - count(*) OVER (PARTITION BY kind, p_brand), 0) * (kind IS NOT NULL)::BIGINT AS rivals FROM p
"""

QUERIES = {
    "line_code_relevance": (line_code_relevance, LINE_CODE), "idle_suppressions": (idle_suppressions, IDLE), "contact_shapes": (contact_shapes, CONTACTS), "product_paths": (product_paths, PRODUCT_PATHS), "refused_catalogues": (refused_catalogues, REFUSED),
    "cascaded_facets": (cascaded_facets, FACETS), "live_item": (live_item, LIVE_ITEM), "display_orders": (display_orders, DISPLAY), "area_fill": (area_fill, AREA), "seeded_sample": (seeded_sample, SAMPLE), "rivals_locked": (rivals_locked, RIVALS_LOCKED),
}
