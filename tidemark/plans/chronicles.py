"""Queries on histories: restated figures, year axes, sweeps, events, refusals, retention and recounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import histories as H
from tidemark.plans.names import NORM
from tidemark.tables import table


def restated_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's figure of a year: the latest order's total, with the earlier ones that differ."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("filed"), F.floor(F.col("o_totalprice") / 100000).cast("long").alias("value"))
    return H.restated(o, ["o_custkey", "year"], "filed", "value").select("o_custkey", "year", "value", "filed", F.concat_ws(",", F.transform("superseded", lambda v: v.cast("string"))).alias("superseded"))


RESTATED = """
WITH o AS (SELECT o_custkey, year(o_orderdate) AS year, o_orderdate::DATE AS filed, floor(o_totalprice / 100000)::BIGINT AS value FROM orders), g AS (SELECT * FROM o WHERE value > 0),
l AS (SELECT o_custkey, year, max_by(value, {'f': filed, 'v': value}) AS v, max(filed) AS f FROM g GROUP BY 1, 2)
SELECT l.o_custkey, l.year, v AS value, f AS filed, array_to_string(list_sort(list_distinct(coalesce(list(g.value) FILTER (abs(g.value - v) > 0.5), []))), ',') AS superseded FROM l JOIN g ON l.o_custkey = g.o_custkey AND l.year = g.year GROUP BY 1, 2, 3, 4
"""


def filed_years(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of every customer and year between its first and last; a year without any is null."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.lit(1).cast("long").alias("n"))
    return H.year_axis(o, "o_custkey", "year", "n")


YEARS = """
WITH s AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT o_custkey, min(year) AS lo, max(year) AS hi FROM s GROUP BY 1), a AS (SELECT o_custkey, unnest(generate_series(lo, hi))::INTEGER AS year FROM e)
SELECT a.o_custkey, a.year, s.n FROM a LEFT JOIN s ON a.o_custkey = s.o_custkey AND a.year = s.year
"""


def sweep_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What a sweep over parts has to do after an earlier one."""
    p = table(spark, sf, "part")
    done = p.where("p_size > 15").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "unproven").when(F.col("p_size") % 3 == 1, "refused").otherwise("proven").alias("outcome"))
    return H.resumed(p, done, "p_partkey", "outcome")


SWEEP = "SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'probe' WHEN p_size % 3 = 0 THEN 'probe again' WHEN p_size % 3 = 1 THEN 'leave' ELSE 'skip' END AS action FROM part"


def coverage_order(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty customers to look at next: least share of open orders first, then the oldest capture."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count_if(F.col("o_orderstatus") == "O") * 1000 / F.count("*")).cast("int").alias("ratio"), F.min("o_orderdate").cast("date").alias("oldest"))
    return o.orderBy("ratio", "oldest", "o_custkey").limit(20)


COVERAGE_ORDER = "SELECT o_custkey, floor(count(*) FILTER (o_orderstatus = 'O') * 1000 / count(*))::INTEGER AS ratio, min(o_orderdate)::DATE AS oldest FROM orders GROUP BY 1 ORDER BY 2, 3, 1 LIMIT 20"


def officer_events(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' use of priorities as terms of office: the newest twelve beginnings and ends."""
    o = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").cast("date").alias("start"), F.max(F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))).cast("date").alias("end"))
    return H.role_events(o, "o_custkey", "o_orderpriority", "start", "end", 12)


OFFICERS = """
WITH r AS (SELECT o_custkey, o_orderpriority, min(o_orderdate)::DATE AS s, (max(o_orderdate) FILTER (o_orderstatus <> 'O'))::DATE AS e FROM orders GROUP BY 1, 2),
u AS (SELECT o_custkey, s AS day, o_orderpriority, 'appointed' AS event FROM r UNION SELECT o_custkey, e, o_orderpriority, 'resigned' FROM r WHERE e IS NOT NULL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderpriority, event) AS place FROM u) WHERE place <= 12
"""


def refusal_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why each brand's candidates were refused: the gravest reason, what was tried, near misses."""
    p = table(spark, sf, "part").where("p_size > 10").select("p_brand", "p_type", "p_size", F.when(F.col("p_size") > 40, "too large").when(F.col("p_size") % 2 == 0, "even").otherwise("other").alias("code"))
    return H.refusals(p, "p_brand", "p_type", "code", ["even", "too large"], F.col("p_size").between(39, 42))


REFUSALS = """
WITH p AS (SELECT *, CASE WHEN p_size > 40 THEN 'too large' WHEN p_size % 2 = 0 THEN 'even' ELSE 'other' END AS code FROM part WHERE p_size > 10)
SELECT p_brand, min_by(code, CASE code WHEN 'even' THEN 0 WHEN 'too large' THEN 1 ELSE 2 END) AS reason, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS tried, count(*) FILTER (p_size BETWEEN 39 AND 42) AS near_misses FROM p GROUP BY 1
"""


def probing_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that a comparison of a part with its next one raises."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice", "p_brand")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), *[F.col(c).alias(f"b_{c}") for c in ("p_size", "p_type", "p_retailprice", "p_brand")])
    x = p.join(after, "p_partkey", "left")
    found = H.rule_book(x, ["p_partkey"], [
        ("Why is it dearer?", F.col("p_retailprice") > F.col("b_p_retailprice")), ("Are the types alike?", F.col("p_type") != F.col("b_p_type")), ("Is one a larger size?", F.abs(F.col("p_size") - F.col("b_p_size")) > 20), ("Nothing to compare?", F.col("b_p_brand").isNull()),
    ])
    return found.select("p_partkey", F.array_join("prompts", "|").alias("prompts"))


QUESTIONS = """
SELECT a.p_partkey, concat_ws('|', CASE WHEN a.p_retailprice > b.p_retailprice THEN 'Why is it dearer?' END, CASE WHEN a.p_type <> b.p_type THEN 'Are the types alike?' END, CASE WHEN abs(a.p_size - b.p_size) > 20 THEN 'Is one a larger size?' END, CASE WHEN b.p_brand IS NULL THEN 'Nothing to compare?' END) AS prompts
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1
"""


def refused_proofs(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs by name that are on the list of refused ones go, unless a registration proves them too; with how many rows of a catalogue name each."""
    p = table(spark, sf, "part")
    proofs = p.select("p_partkey", F.lower("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, "registration").otherwise("name").alias("proof"))
    refused = p.where("p_retailprice > 1000").select(F.lower("p_name").alias("name")).distinct()
    kept = proofs.where("proof = 'registration'").union(proofs.where("proof <> 'registration'").join(refused, "name", "left_anti").select(*proofs.columns))
    evidence = table(spark, sf, "lineitem").select("l_partkey").join(p.select("p_partkey", F.lower("p_name").alias("name")), F.col("l_partkey") == F.col("p_partkey")).groupBy("name").agg(F.count("*").alias("rows"))
    return kept.join(evidence, "name", "left").select("p_partkey", "name", "proof", F.coalesce("rows", F.lit(0)).alias("rows"))


PROOFS_KEPT = """
WITH r AS (SELECT lower(p_name) AS name FROM part WHERE p_retailprice > 1000), e AS (SELECT lower(p_name) AS name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_partkey, lower(p_name) AS name, CASE WHEN p_size % 4 = 0 THEN 'registration' ELSE 'name' END AS proof, coalesce(n, 0) AS rows FROM part LEFT JOIN e ON lower(p_name) = e.name WHERE p_size % 4 = 0 OR lower(p_name) NOT IN (SELECT name FROM r)
"""


def created_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that lines alone prove (no supplier record keeps them), with a caveat and a number that stays unconfirmed."""
    known = table(spark, sf, "supplier").where("s_nationkey < 12").select("s_suppkey")
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.max("l_orderkey").alias("candidate"))
    return seen.join(known, "s_suppkey", "left_anti").select("s_suppkey", "lines", "candidate", F.lit("unconfirmed").alias("confidence"), F.format_string("known from %d lines only", "lines").alias("caveat"))


ENTITIES_CREATED = "SELECT l_suppkey AS s_suppkey, count(*) AS lines, max(l_orderkey) AS candidate, 'unconfirmed' AS confidence, 'known from ' || count(*) || ' lines only' AS caveat FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY 1"


def alias_owners(spark: SparkSession, sf: str) -> DataFrame:
    """How many brands own each single word of part names, and whether it tells one from others."""
    words = table(spark, sf, "part").select("p_brand", F.explode(F.split(T.norm(F.col("p_name")), " ")).alias("word")).where("length(word) >= 4")
    return words.groupBy("word").agg(F.count_distinct("p_brand").alias("owners")).withColumn("strong", F.col("owners") == 1)


OWNERS = f"SELECT word, count(DISTINCT p_brand) AS owners, count(DISTINCT p_brand) = 1 AS strong FROM (SELECT p_brand, unnest(string_split({NORM.format(x='p_name')}, ' ')) AS word FROM part) WHERE length(word) >= 4 GROUP BY 1"


def user_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type: how many, the first and last day, and the median of events a user."""
    per = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return per.groupBy("event_type").agg(F.sum("n").alias("events"), F.to_date(F.min("lo")).alias("first"), F.to_date(F.max("hi")).alias("last"), F.median("n").alias("median"))


USER_COVERAGE = "WITH p AS (SELECT event_type, user_id, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1, 2) SELECT event_type, sum(n)::BIGINT AS events, min(lo)::DATE AS first, max(hi)::DATE AS last, median(n) AS median FROM p GROUP BY 1"


def fill_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of filled fields of each segment's customers, a row for each field, and rows by division."""
    c = table(spark, sf, "customer").select("c_mktsegment", F.col("c_name").isNotNull().alias("name"), (F.col("c_acctbal") > 0).alias("balance"), (F.col("c_nationkey") > 5).alias("nation"))
    x = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f) for f in ("name", "balance", "nation")])
    return x.unpivot(["c_mktsegment", "n"], ["name", "balance", "nation"], "field", "filled").select("c_mktsegment", "field", "n", "filled", (F.col("filled") / F.col("n")).alias("rate"))


FILL = """
SELECT c_mktsegment, 'name' AS field, count(*) AS n, count(*) FILTER (c_name IS NOT NULL) AS filled, count(*) FILTER (c_name IS NOT NULL)::DOUBLE / count(*) AS rate FROM customer GROUP BY 1
UNION ALL SELECT c_mktsegment, 'balance', count(*), count(*) FILTER (c_acctbal > 0), count(*) FILTER (c_acctbal > 0)::DOUBLE / count(*) FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'nation', count(*), count(*) FILTER (c_nationkey > 5), count(*) FILTER (c_nationkey > 5)::DOUBLE / count(*) FROM customer GROUP BY 1
"""


def retention(spark: SparkSession, sf: str) -> DataFrame:
    """Users seen in the last thirty days before a date stay; of the others how many days ago they were seen last."""
    e = table(spark, sf, "events")
    as_of = F.broadcast(e.agg(F.max("ts").alias("as_of")))  # one row
    seen = e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(as_of)
    days = F.datediff("as_of", "last")
    return seen.select("user_id", days.alias("days"), (days <= 3).alias("kept"))


RETENTION = "SELECT user_id, date_diff('day', max(ts)::DATE, (SELECT max(ts) FROM events)::DATE) AS days, date_diff('day', max(ts)::DATE, (SELECT max(ts) FROM events)::DATE) <= 3 AS kept FROM events GROUP BY 1"


def recounted(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of orders counted again from their lines, with what the stored rows say when they are resolved anew, and sizes per snapshot year."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    x = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.groupBy("year").agg(F.count("*").alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"))


RECOUNTED = "WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT year(o_orderdate) AS year, count(*) AS orders, coalesce(sum(n), 0)::BIGINT AS lines, coalesce(sum(q), 0.0)::DOUBLE AS quantity FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1"

QUERIES = {
    "restated_figures": (restated_figures, RESTATED), "filed_years": (filed_years, YEARS), "sweep_actions": (sweep_actions, SWEEP), "coverage_order": (coverage_order, COVERAGE_ORDER), "officer_events": (officer_events, OFFICERS), "refusal_reasons": (refusal_reasons, REFUSALS),
    "probing_questions": (probing_questions, QUESTIONS), "refused_proofs": (refused_proofs, PROOFS_KEPT), "created_entities": (created_entities, ENTITIES_CREATED), "alias_owners": (alias_owners, OWNERS), "user_coverage": (user_coverage, USER_COVERAGE), "fill_rates": (fill_rates, FILL),
    "retention": (retention, RETENTION), "recounted": (recounted, RECOUNTED),
}
