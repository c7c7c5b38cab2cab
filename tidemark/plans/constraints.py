"""A report over changed copies of the driver's tables: one check for each kind of constraint, passing and failing rows both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import checks, filters, rules as R
from tidemark.plans.names import NORM
from tidemark.tables import table

AS_OF = "1998-08-01"


def _t(spark: SparkSession, sf: str):
    return lambda name: table(spark, sf, name)


def table_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tables: least rows, shrinking, header counts, shares of groups, caps, gaps, order, lists and fields."""
    t = _t(spark, sf)
    orders, lines, part, customer, labels, docs = t("orders"), t("lineitem"), t("part"), t("customer"), t("labels"), t("documents")
    header = orders.select(F.col("o_orderkey").alias("k"), (F.length("o_orderpriority") % 7).alias("stated"))
    priority = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    months = orders.where("month(o_orderdate) <> 2 or o_orderstatus <> 'F'").select("o_orderpriority", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    ranked = priority.select(F.lit("all").alias("g"), F.col("o_orderpriority").alias("place"), "n")
    bags = part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.lower("p_name")).otherwise(T.word_bag(F.col("p_name"), ())).alias("bag"))
    return checks.report(
        R.least_rows(part, 10, "parts_least"), R.least_rows(t("region"), 6, "regions_least"), R.shrunk(part.where("p_size < 40"), part, "parts_shrunk"), R.shrunk(part.where("p_size < 50"), part, "parts_steady"),
        R.header_count(header, lines.select(F.col("l_orderkey").alias("k")), "k", "stated", "header_count"), R.group_share(lines, "l_returnflag", F.col("l_quantity") > 25, 0.49, "large_share"), R.share_of_all(customer, "c_mktsegment", 0.2, "segment_share"),
        R.cap(part, "p_brand", 8, "brand_cap", "WARN"), R.absent_months(months, "o_orderpriority", "month", "month_gap"), R.non_increasing(ranked, "g", "place", "n", "ranked"), R.disjoint(part.where("p_size > 20").select("p_name"), part.where("p_size < 30").select("p_name"), "p_name", "lists"),
        R.closed_fields(labels, ["doc_id", "quality"], "fields"), R.bag_shape(bags, "bag", "p_partkey", "bag"),
        R.found(docs.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("e"), F.count("*").alias("n")).where("2 * e < n"), "half_the_field", F.coalesce("source", F.lit("-")), "under half", "WARN"),
    )


def _v(check: str, key: str, message: str, source: str, severity: str = "FAIL") -> str:
    return f"SELECT '{severity}' AS severity, '{check}' AS check_name, ({key})::VARCHAR AS row_key, {message} AS message FROM {source}"


_BAG = f"array_to_string(list_sort(list_distinct(list_filter(string_split({NORM.format(x='p_name')}, ' '), lambda w: length(w) >= 2))), ' ')"
TABLE_GATE = """
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), pr AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT DISTINCT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS d FROM orders WHERE month(o_orderdate) <> 2 OR o_orderstatus <> 'F'), e AS (SELECT k, min(d) AS lo, max(d) AS hi FROM m GROUP BY 1),
w AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 MONTH))::DATE AS d FROM e)
""" + " UNION ALL ".join([
    _v("parts_least", "'table'", "count(*) || ' rows, 10 at least'", "part HAVING count(*) < 10"), _v("regions_least", "'table'", "count(*) || ' rows, 6 at least'", "region HAVING count(*) < 6"),
    _v("parts_shrunk", "'table'", "n || ' rows after ' || m", "(SELECT count(*) FILTER (p_size < 40) AS n, count(*) AS m FROM part) WHERE n < 0.9 * m"), _v("parts_steady", "'table'", "n || ' rows after ' || m", "(SELECT count(*) FILTER (p_size < 50) AS n, count(*) AS m FROM part) WHERE n < 0.9 * m"),
    _v("header_count", "o_orderkey", "'states ' || length(o_orderpriority) % 7 || ', has ' || coalesce(n, 0)", "orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE length(o_orderpriority) % 7 <> coalesce(n, 0)"),
    _v("large_share", "l_returnflag", "f || ' of ' || n", "(SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS f FROM lineitem GROUP BY 1) WHERE f > 0.49::DOUBLE * n", "WARN"),
    _v("segment_share", "c_mktsegment", "n || ' of ' || a", "(SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer) AS a FROM customer GROUP BY 1) WHERE n > 0.2::DOUBLE * a"), _v("brand_cap", "p_brand", "n || ' rows'", "(SELECT p_brand, count(*) AS n FROM part GROUP BY 1) WHERE n > 8", "WARN"),
    _v("month_gap", "k || '/' || strftime(d, '%Y-%m')", "'month without rows'", "w WHERE (k, d) NOT IN (SELECT (k, d) FROM m)"), _v("ranked", "'all/' || p", "'rises'", "(SELECT p, n, lag(n) OVER (ORDER BY p) AS b FROM pr) WHERE n > b"),
    _v("lists", "p_name", "'in both lists'", "(SELECT DISTINCT p_name FROM part WHERE p_size > 20 AND p_name IN (SELECT p_name FROM part WHERE p_size < 30))"), _v("fields", "'toxic'", "'unknown field'", "(SELECT 1)"),
    _v("bag", "p_partkey", "'not sorted and unique'", f"part WHERE p_size % 2 = 0 AND array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') <> lower(p_name)"),
    _v("half_the_field", "coalesce(source, '-')", "'under half'", "(SELECT source, count(*) FILTER (lang = 'en') AS e, count(*) AS n FROM documents GROUP BY 1) WHERE 2 * e < n", "WARN"),
])


def record_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Single records: required and barred fields, dates, staleness, shapes, ranges, vocabularies, links and proofs."""
    t = _t(spark, sf)
    customer, supplier, nation = t("customer"), t("supplier"), t("nation")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("first"))
    o = o.withColumns({"last": F.when(F.col("o_orderstatus") == "F", F.date_sub("first", 1)).otherwise(F.date_add("first", 30)), "note": F.when(F.col("o_orderpriority").startswith("1"), F.lit(" ")).otherwise(F.col("o_orderpriority")), "figure": F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice"))})
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", F.concat(F.when(F.col("c_nationkey") % 4 == 0, F.lit("http")).otherwise(F.lit("https")), F.lit("://x.org/"), F.lower("c_mktsegment")).alias("url"), F.concat(F.lower("c_mktsegment"), F.when(F.col("c_nationkey") % 6 == 0, F.lit("@x")).otherwise(F.lit("@x.org"))).alias("email"))
    ranges = spark.createDataFrame([("AUTOMOBILE", 0.0, 5000.0), ("BUILDING", -500.0, 9000.0), ("FURNITURE", -2000.0, 20000.0)], "c_mktsegment string, lo double, hi double")
    status = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("P").alias("o_orderstatus"))
    number = F.concat(F.when(F.col("s_suppkey") % 3 == 0, F.lit("SC")).otherwise(F.lit("0")), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))
    s = supplier.select("s_suppkey", "s_nationkey", number.alias("number"))
    return checks.report(
        R.required_if(o, "note_required", "o_orderkey", F.col("o_orderstatus") == "P", ["note"]), R.forbidden_if(o, "probable_without_figures", "o_orderkey", F.col("o_orderpriority") == "5-LOW", ["figure"]), R.date_order(o, "dates", "o_orderkey", "first", "last", AS_OF),
        R.stale(o, "stale", "o_orderkey", "first", "1998-08-01", 1200, 2000), checks.violations(c, "https_only", "c_custkey", ~F.col("url").startswith("https://"), "not https"), checks.violations(c, "email", "c_custkey", ~filters.email_shape(F.col("email")), "malformed", "WARN"),
        checks.duplicates(c, "url", "url_unique", "WARN"), R.bounds(c, ranges, "c_mktsegment", "c_acctbal", "c_custkey", "balance_range"), R.rederived(o.select("o_orderkey", "o_orderstatus"), status, "o_orderkey", "o_orderstatus", "status_rederived", "WARN"),
        checks.not_in(o, "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "priority_enum"), checks.orphans(s, nation.where("n_regionkey <> 2"), "s_nationkey", "n_nationkey", "nation_fk"), checks.violations(s, "number_form", "s_suppkey", ~F.col("number").rlike("^([0-9]{8}|SC[0-9]{6})$"), "no registration number"),
        R.found(o.where((F.col("last") >= F.lit("1998-05-01").cast("date")) & (F.col("last") <= F.lit(AS_OF).cast("date"))), "expiring", "o_orderkey", "ends within 90 days", "WARN"), R.found(o.where(F.col("last") < F.lit("1992-02-01").cast("date")), "expired", "o_orderkey", "ended"),
    )


RECORD_GATE = """
WITH o AS (SELECT *, o_orderdate::DATE AS f, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE - 1 ELSE o_orderdate::DATE + 30 END AS l FROM orders), a AS (SELECT *, date_diff('day', f, DATE '1998-08-01') AS age FROM o),
c AS (SELECT *, CASE WHEN c_nationkey % 4 = 0 THEN 'http' ELSE 'https' END || '://x.org/' || lower(c_mktsegment) AS url FROM customer),
r(seg, lo, hi) AS (VALUES ('AUTOMOBILE', 0.0, 5000.0), ('BUILDING', -500.0, 9000.0), ('FURNITURE', -2000.0, 20000.0)),
d AS (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS st FROM lineitem GROUP BY 1)
""" + " UNION ALL ".join([
    _v("note_required", "o_orderkey", "'lacks note'", "o WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%'"), _v("probable_without_figures", "o_orderkey", "'may not have figure'", "o WHERE o_orderpriority = '5-LOW' AND o_totalprice > 300000"),
    _v("dates", "o_orderkey", "CASE WHEN f > DATE '1998-08-01' THEN 'first in the future' ELSE 'first after last' END", "o WHERE f > l OR f > DATE '1998-08-01'"),
    "SELECT CASE WHEN age > 2000 THEN 'FAIL' ELSE 'WARN' END, 'stale', o_orderkey::VARCHAR, age || ' days' FROM a WHERE age > 1200", _v("https_only", "c_custkey", "'not https'", "c WHERE c_nationkey % 4 = 0"), _v("email", "c_custkey", "'malformed'", "c WHERE c_nationkey % 6 = 0", "WARN"),
    _v("url_unique", "url", "'url repeats'", "(SELECT url FROM c GROUP BY url HAVING count(*) > 1)", "WARN"), _v("balance_range", "c_custkey", "CASE WHEN lo IS NULL THEN 'no range' ELSE 'out of range' END", "c LEFT JOIN r ON c_mktsegment = seg WHERE lo IS NULL OR NOT c_acctbal BETWEEN lo AND hi"),
    _v("status_rederived", "coalesce(o_orderkey, l_orderkey)", "CASE WHEN o_orderkey IS NULL THEN 'not stored' WHEN l_orderkey IS NULL THEN 'not derived' ELSE 'differs' END", "o FULL JOIN d ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL OR o_orderstatus IS DISTINCT FROM st", "WARN"),
    _v("priority_enum", "o_orderkey", "'o_orderpriority is not a known value'", "o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')"), _v("nation_fk", "s_nationkey", "'s_nationkey has no n_nationkey'", "supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)"),
    _v("number_form", "s_suppkey", "'no registration number'", "supplier WHERE s_suppkey % 3 = 0"), _v("expiring", "o_orderkey", "'ends within 90 days'", "o WHERE l BETWEEN DATE '1998-05-01' AND DATE '1998-08-01'", "WARN"), _v("expired", "o_orderkey", "'ended'", "o WHERE l < DATE '1992-02-01'"),
])

QUERIES = {"table_gate": (table_gate, TABLE_GATE), "record_gate": (record_gate, RECORD_GATE)}
