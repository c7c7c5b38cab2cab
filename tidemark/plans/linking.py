"""Queries that link records in steps: cascades, crosswalks, containment, two-way checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import lookup
from tidemark.plans.names import NORM
from tidemark.tables import table


def created_ids(spark: SparkSession, sf: str) -> DataFrame:
    """An id for every part name: that of a known name, else one made from the name."""
    p = table(spark, sf, "part")
    known = p.where("p_size < 25").groupBy("p_name").agg(F.min("p_partkey").cast("string").alias("id"))
    return lookup.get_or_create(p, known, "p_name")


CREATED = """
WITH k AS (SELECT p_name, min(p_partkey)::VARCHAR AS id FROM part WHERE p_size < 25 GROUP BY 1)
SELECT n.p_name, coalesce(k.id, 'new-' || md5(n.p_name)[1:12]) AS id, k.id IS NULL AS created FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL) n LEFT JOIN k ON n.p_name = k.p_name
"""

_WORDS = f"list_distinct(string_split({NORM}, ' '))"


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.array_distinct(F.split(T.norm(F.coalesce(text, F.lit(""))), " ")).alias("words"))


PAIRS = [(1, "the", "licensed"), (2, "version", "license"), (3, "der", "und"), (4, "les", "et")]


def two_token_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold both words of a pair: the first such pair."""
    pairs = spark.createDataFrame(PAIRS, "id int, a string, b string")
    return lookup.two_token_match(_tokens(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "words", pairs)


TWO_TOKENS = f"""
WITH p(id, a, b) AS (VALUES {', '.join(map(str, PAIRS))}), w AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents)
SELECT doc_id, min(id) AS id FROM w JOIN p ON list_contains(w, a) AND list_contains(w, b) GROUP BY doc_id
"""


def shared_words(spark: SparkSession, sf: str) -> DataFrame:
    """Part types and names by the words they share, at least one; common words are denied."""
    p = table(spark, sf, "part")
    a = p.select("p_type").distinct().select(F.col("p_type").alias("key"), F.split(T.norm(F.concat_ws(" ", "p_type", F.lit("blue steel"))), " ").alias("words"))
    b = p.select("p_name").distinct().select(F.col("p_name").alias("key"), F.split(T.norm(F.concat_ws(" ", "p_name", F.lit("steel tin"))), " ").alias("words"))
    return lookup.overlap_matches(a, b, "key", "words", 1, ("steel",))


SHARED_WORDS = f"""
WITH a AS (SELECT key, unnest({_WORDS.format(x="key || ' blue steel'")}) AS w FROM (SELECT DISTINCT p_type AS key FROM part)), b AS (SELECT key, unnest({_WORDS.format(x="key || ' steel tin'")}) AS w FROM (SELECT DISTINCT p_name AS key FROM part))
SELECT a.key, b.key AS other, count(*) AS shared FROM a JOIN b ON a.w = b.w AND a.w <> 'steel' GROUP BY 1, 2
"""


def register_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Part names in odd spellings against a register: exactly one active equal name, else one equal slug, else one name that begins with the probe."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    register = p.groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.max("p_size").alias("size"))
    odd = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.substring_index("p_name", " ", 1))
    probes = p.select(F.col("p_partkey").alias("key"), odd.alias("probe"))
    exact = probes.join(register.where("size > 20"), F.col("probe") == F.col("p_name")).select("key", "id")
    slug = probes.join(register, T.slug(F.col("probe")) == T.slug(F.col("p_name"))).select("key", "id")
    begins = probes.join(register, T.norm(F.col("probe")) == F.get(F.split(T.norm(F.col("p_name")), " "), F.lit(0))).select("key", "id")
    return lookup.cascade(probes, "key", [("exact", exact), ("slug", slug), ("partial", begins)])


REGISTER = f"""
WITH r AS (SELECT p_name, min(p_partkey) AS id, max(p_size) AS size FROM part GROUP BY 1),
q AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE split_part(p_name, ' ', 1) END AS probe FROM part),
s AS (SELECT key, 0 AS step, 'exact' AS how, id FROM q JOIN r ON probe = p_name AND size > 20 UNION ALL SELECT key, 1, 'slug', id FROM q JOIN r ON {NORM.format(x='probe')} = {NORM.format(x='p_name')}
  UNION ALL SELECT key, 2, 'partial', id FROM q JOIN r ON {NORM.format(x='probe')} = split_part({NORM.format(x='p_name')}, ' ', 1)),
g AS (SELECT key, step, how, min(id) AS id, count(DISTINCT id) AS n FROM s GROUP BY 1, 2, 3),
b AS (SELECT key, min_by(id, step) FILTER (n = 1) AS id, min_by(how, step) FILTER (n = 1) AS how, bool_or(n > 1) AS several FROM g GROUP BY key)
SELECT q.key, b.id, coalesce(b.how, CASE WHEN several THEN 'refused' END, 'none') AS how FROM q LEFT JOIN b ON q.key = b.key
"""


def shard_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Shards (brands of lines' parts, and a few unknown) that the index of large brands lacks."""
    index = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).where("n >= 8")
    shards = table(spark, sf, "part").select("p_brand").distinct().union(table(spark, sf, "nation").select(F.concat(F.lit("Brand#"), "n_name")))
    return shards.join(index, "p_brand", "left_anti")


SHARDS = "SELECT DISTINCT p_brand FROM (SELECT p_brand FROM part UNION ALL SELECT 'Brand#' || n_name FROM nation) WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 8)"


def proof_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' totals as proofs against the rounded record of dear orders: what either lacks and where they differ."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    proofs = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderstatus").alias("v"))
    records = o.where("o_totalprice > 100000").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "F").otherwise(F.col("o_orderstatus")).alias("v"))
    return lookup.two_way(proofs, records, "o_orderkey", "v")


PROOFS = """
WITH p AS (SELECT o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE o_orderstatus END AS v FROM orders WHERE o_totalprice > 100000)
SELECT o_orderkey, status FROM (SELECT coalesce(p.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN r.o_orderkey IS NULL THEN 'proof without record' WHEN p.o_orderkey IS NULL THEN 'record without proof' WHEN p.v IS DISTINCT FROM r.v THEN 'differs' END AS status
  FROM p FULL JOIN r ON p.o_orderkey = r.o_orderkey) WHERE status IS NOT NULL
"""


def shingle_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items a window of whose text stands in a document, with how many windows do."""
    a = lookup.windows(table(spark, sf, "benchmark"), "item_id", "text").distinct()
    b = lookup.texts_with_windows(table(spark, sf, "documents"), "doc_id", "text", a.select("window"), 60)
    return a.join(b, "window").groupBy("item_id", "doc_id").agg(F.count("*").alias("windows"))


SHINGLES = """
WITH a AS (SELECT DISTINCT item_id, substr(text, i, 60) AS w FROM (SELECT item_id, text, unnest(generate_series(1, length(text) - 59, 20)) AS i FROM benchmark WHERE length(text) >= 60)),
b AS (SELECT DISTINCT doc_id, substr(text, i, 60) AS w FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 59)) AS i FROM documents WHERE length(text) >= 60))
SELECT item_id, doc_id, count(*) AS windows FROM a JOIN b ON a.w = b.w GROUP BY 1, 2
"""

TERMS = [("licensed", "licence", 1), ("version", "release", 2), ("for", "purpose", 3), ("und", "german", 4), ("les", "french", 5)]


def first_term(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's label by the first term of a list that it holds."""
    rules = spark.createDataFrame(TERMS, "term string, label string, place int")
    return lookup.first_contained(_tokens(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", "words", rules)


FIRST_TERM = f"""
WITH r(term, label, place) AS (VALUES {', '.join(map(str, TERMS))}), w AS (SELECT doc_id, unnest({_WORDS.format(x="coalesce(text, '')")}) AS term FROM documents)
SELECT doc_id, min_by(label, place) AS label FROM w JOIN r USING (term) GROUP BY doc_id
"""


def role_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation's items: the first five segments for all, then its customers' own, repeated ones once."""
    c = table(spark, sf, "customer")
    segments = c.select(F.col("c_mktsegment").alias("item")).distinct()
    base = segments.select("item", F.length("item").alias("place")).where("place < 10")
    extras = c.groupBy(F.col("c_nationkey").alias("role"), F.col("c_mktsegment").alias("item")).agg(F.min("c_custkey").cast("int").alias("place"))
    roles = table(spark, sf, "nation").select(F.col("n_nationkey").alias("role"))
    return lookup.expanded(roles, base, extras, "role", "item").select("role", F.array_join("items", ",").alias("items"))


ROLES = """
WITH c AS (SELECT n_nationkey AS role, item, 0 AS part, length(item) AS place FROM nation, (SELECT DISTINCT c_mktsegment AS item FROM customer) WHERE length(item) < 10
  UNION ALL SELECT c_nationkey, c_mktsegment, 1, min(c_custkey)::INTEGER FROM customer GROUP BY 1, 2),
f AS (SELECT role, item, min({'p': part, 'q': place}) AS spot FROM c GROUP BY 1, 2)
SELECT role, string_agg(item, ',' ORDER BY spot, item) AS items FROM f GROUP BY role
"""

CROSSWALK = [("AUTOMOBILE", "motor"), ("BUILDING", "construction"), ("FURNITURE", "home")]


def crosswalk_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' segments in another vocabulary; what the written table lacks has no match."""
    return lookup.crosswalked(table(spark, sf, "customer"), F.broadcast(spark.createDataFrame(CROSSWALK, "ours string, theirs string")), "c_custkey", "c_mktsegment")


CROSSWALK_SQL = f"SELECT c_custkey, theirs FROM customer LEFT JOIN (VALUES {', '.join(map(str, CROSSWALK))}) x(ours, theirs) ON c_mktsegment = ours"


def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's candidate types out of dear parts, then large ones, none of a denied list, the first three."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("host"), "p_size", "p_retailprice")
    dear = p.where("p_retailprice > 950").groupBy("brand", "host").agg(F.count("*").alias("score"))
    large = p.where("p_size > 10").groupBy("brand", "host").agg(F.count("*").alias("score"))
    deny = p.where("p_size = 50 and p_retailprice < 920").select("host")
    return lookup.ranked_sources([dear, large], "brand", "host", deny, 3)


RANKED_CANDIDATES = """
WITH u AS (SELECT p_brand AS brand, p_type AS host, 0 AS source, count(*) AS score FROM part WHERE p_retailprice > 950 GROUP BY 1, 2 UNION ALL SELECT p_brand, p_type, 1, count(*) FROM part WHERE p_size > 10 GROUP BY 1, 2),
b AS (SELECT brand, host, min({'s': source, 'd': -score}) AS b FROM u WHERE host NOT IN (SELECT p_type FROM part WHERE p_size = 50 AND p_retailprice < 920) GROUP BY 1, 2)
SELECT brand, host, b.s AS source, place FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY b, host) AS place FROM b) WHERE place <= 3
"""


def fallback_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's figure: of its dear orders, else of all, else nothing, with the level."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderkey")
    count = lambda df: df.groupBy("c_custkey").agg(F.count("*").alias("n"))
    return lookup.with_fallbacks(table(spark, sf, "customer"), [("profile", count(o.where("o_totalprice > 400000"))), ("directory", count(o))], "c_custkey", "n")


FALLBACK = """
WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1), d AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(p.n, d.n) AS n, CASE WHEN p.k IS NOT NULL THEN 'profile' WHEN d.k IS NOT NULL THEN 'directory' ELSE 'nothing' END AS level FROM customer LEFT JOIN p ON c_custkey = p.k LEFT JOIN d ON c_custkey = d.k
"""


def stated_and_pinned(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose stated number of lines (1 to 7 by key) is not that of their lines."""
    stated = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("n"))
    return lookup.stated_counts(stated, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "n")


STATED = "SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS stated, coalesce(n, 0) AS actual FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE o_orderkey % 7 + 1 <> coalesce(n, 0)"


def open_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without open orders whose nation supplies: the work that is left."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    supplied = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return c.join(supplied, "c_nationkey", "left_semi").join(table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti")


WORKLIST = "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"


def catalogue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Parts listed under a brand's name or any of its aliases."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    alias = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), "p_brand")).otherwise(F.concat(F.lit("x"), "p_brand"))
    listed = p.select("p_partkey", alias.alias("name"))
    brands = p.select("p_brand").distinct()
    names = brands.select("p_brand", F.explode(F.array("p_brand", F.upper("p_brand"), F.concat(F.lit("The "), "p_brand"))).alias("name"))
    return listed.join(names, "name").select("p_partkey", "p_brand").distinct()


CATALOGUE = "SELECT p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"

QUERIES = {
    "created_ids": (created_ids, CREATED), "two_token_documents": (two_token_documents, TWO_TOKENS), "shared_words": (shared_words, SHARED_WORDS), "register_cascade": (register_cascade, REGISTER), "shard_orphans": (shard_orphans, SHARDS),
    "proof_records": (proof_records, PROOFS), "shingle_containment": (shingle_containment, SHINGLES), "first_term": (first_term, FIRST_TERM), "role_items": (role_items, ROLES), "crosswalk_segments": (crosswalk_segments, CROSSWALK_SQL),
    "ranked_candidates": (ranked_candidates, RANKED_CANDIDATES), "fallback_levels": (fallback_levels, FALLBACK), "stated_and_pinned": (stated_and_pinned, STATED), "open_worklist": (open_worklist, WORKLIST), "catalogue_rows": (catalogue_rows, CATALOGUE),
}
