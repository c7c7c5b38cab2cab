"""Queries on records: listings, series, ranking, merges, diffs and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.operators import checks, listing, merge, ranking, series
from tidemark.tables import table


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


PRICING = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2"


def _bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and the (brand, type) groups in which they have at least six lines."""
    x = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("grp")), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("l_suppkey").alias("member"), "grp").agg(F.count("*").alias("n")).where("n >= 6").select("member", "grp")


_BRIDGE = "b AS (SELECT l_suppkey AS member, p_brand || '/' || p_type AS grp FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) >= 6)"


def colisting(spark: SparkSession, sf: str) -> DataFrame:
    return listing.colisting(_bridge(spark, sf), "member", "grp", 2)


COLISTING = f"WITH {_BRIDGE} SELECT x.member AS a, y.member AS b, count(*) AS shared FROM b x JOIN b y ON x.grp = y.grp AND x.member <> y.member GROUP BY 1, 2 HAVING count(*) >= 2"


def _sixth(x: Column) -> Column:
    """A double that is not negative, to six decimals as DuckDB rounds: by its product, not by its decimals."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def peers_tie_safe(spark: SparkSession, sf: str) -> DataFrame:
    return listing.top_peers(_bridge(spark, sf), "member", "grp", 8).select("a", "b", "shared", _sixth(F.col("weight")).alias("weight"), "rows_upto")


PEERS = f"""
WITH {_BRIDGE}, s AS (SELECT grp, count(*) AS size FROM b GROUP BY grp),
p AS (SELECT x.member AS a, y.member AS b, count(*) AS shared, round_even(sum(1.0::DOUBLE / size), 9) AS weight FROM b x JOIN b y ON x.grp = y.grp AND x.member <> y.member JOIN s ON s.grp = x.grp GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY a ORDER BY {{'s': shared, 'w': weight}} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rows_upto FROM p)
SELECT a, b, shared, round(weight, 6) AS weight, rows_upto FROM r WHERE rows_upto <= 8
"""


def group_rank_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("l_suppkey").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"))


GROUP_RANK = "SELECT l_suppkey, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey"


def weighted_mode_label(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_name").agg(F.sum("l_quantity").alias("items"))
    return x.groupBy("p_brand").agg(F.max(F.struct("items", "p_name")).alias("b")).select("p_brand", F.col("b.p_name").alias("label"), F.col("b.items").alias("items"))


WEIGHTED_MODE = "WITH x AS (SELECT p_brand, p_name, sum(l_quantity) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_brand, p_name AS label, items FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY items DESC, p_name DESC) AS n FROM x) WHERE n = 1"


def _month():
    """An order's month; April's orders count in May, so that April is not published."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    return F.when(F.month(month) == 4, F.add_months(month, 1)).otherwise(month)


_MONTH = "(date_trunc('month', o_orderdate) + CASE WHEN month(o_orderdate) = 4 THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END)::DATE"


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderpriority", _month().alias("month"), F.lit(1).cast("long").alias("one"))


def dense_month_series(spark: SparkSession, sf: str) -> DataFrame:
    return series.dense_months(_monthly(spark, sf), "o_orderpriority", "month", "one")


DENSE = f"""
WITH f AS (SELECT o_orderpriority, {_MONTH} AS month FROM orders),
c AS (SELECT unnest(generate_series((SELECT min(month) FROM f), (SELECT max(month) FROM f), INTERVAL 1 MONTH))::DATE AS month)
SELECT k.o_orderpriority, c.month, c.month IN (SELECT month FROM f) AS published, CASE WHEN c.month IN (SELECT month FROM f) THEN count(f.month) END AS total
FROM c CROSS JOIN (SELECT DISTINCT o_orderpriority FROM f) k LEFT JOIN f ON f.month = c.month AND f.o_orderpriority = k.o_orderpriority GROUP BY 1, 2
"""


def trend_with_floor(spark: SparkSession, sf: str) -> DataFrame:
    m = _monthly(spark, sf).groupBy("o_orderpriority", "month").agg(F.sum("one").alias("n"))
    return series.trend(m, "o_orderpriority", "month", "n", F.lit(25))


TREND = f"""
WITH m AS (SELECT o_orderpriority, {_MONTH} AS month, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT o_orderpriority, min_by(n, month) AS baseline, max_by(n, month) AS latest FROM m GROUP BY 1)
SELECT *, CASE WHEN baseline >= 25 THEN round(100.0::DOUBLE * (latest - baseline) / baseline, 1) END AS change_pct FROM e
"""


def grouping_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.grouping_id().alias("level"))


ROLLUP = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "full")
    return x.groupBy("source").agg(F.count_if(F.col("quality").isNotNull()).alias("labelled"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 1).alias("good"))


COVERAGE = "SELECT source, count(*) FILTER (quality IS NOT NULL) AS labelled, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (quality = 1) AS good FROM documents FULL JOIN labels USING (doc_id) GROUP BY source"


def comparable_having(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).where("n >= 2")


COMPARABLE = "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 2"


def first_seen_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    start = e.agg(F.min("ts").alias("start"))
    seen = e.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    return seen.crossJoin(F.broadcast(start)).select("user_id", "event_type", "first_seen", "last_seen", "n", (F.col("first_seen") == F.col("start")).alias("censored"))  # one row on the right


FIRST_SEEN = "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, min(ts) = (SELECT min(ts) FROM events) AS censored FROM events GROUP BY 1, 2"


def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    a, b = s.select("user_id", F.col("event_type").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")), s.select("user_id", F.col("event_type").alias("b"), "lo", "hi")
    return a.join(b, "user_id").where("a < b and ahi >= lo and hi >= alo").groupBy("a", "b").agg(F.count("*").alias("n"))


OVERLAP = "WITH s AS (SELECT user_id, event_type AS t, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1, 2) SELECT x.t AS a, y.t AS b, count(*) AS n FROM s x JOIN s y ON x.user_id = y.user_id AND x.t < y.t AND x.hi >= y.lo AND y.hi >= x.lo GROUP BY 1, 2"


def latest_wins_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.latest_wins(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"))


LATEST = "SELECT user_id, event_type, event_id, ts, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def capped_brief(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.capped(table(spark, sf, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_orderpriority", "o_orderkey", "place", "shown", "total", "not_listed")


CAPPED = "SELECT o_orderpriority, o_orderkey, place, least(total, 5) AS shown, total, greatest(total - 5, 0) AS not_listed FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS total FROM orders) WHERE place <= 5"


def _customers(spark: SparkSession, sf: str, side: int) -> DataFrame:
    c, fields = table(spark, sf, "customer"), ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    if side == 0:
        return c.where("c_acctbal > -500").select(*fields)
    moved = F.when(F.col("c_nationkey").between(4 * side, 4 * side + 5), F.concat(F.lit(f"SEG{side} "), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return c.where(f"c_acctbal < {9500 - 500 * side}").withColumn("c_mktsegment", moved).withColumn("c_name", F.when(F.col("c_acctbal").between(0, 800), F.lit("")).otherwise(F.col("c_name"))).select(*fields)


def _customers_sql(side: int) -> str:
    if side == 0:
        return "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > -500"
    return f"SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 800 THEN '' ELSE c_name END AS c_name, CASE WHEN c_nationkey BETWEEN {4 * side} AND {4 * side + 5} THEN 'SEG{side} ' || c_mktsegment ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer WHERE c_acctbal < {9500 - 500 * side}"


_SIDES = f"o AS ({_customers_sql(0)}), a AS ({_customers_sql(1)}), b AS ({_customers_sql(2)})"


def overlay_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge.overlay(_customers(spark, sf, 1), _customers(spark, sf, 0), "c_custkey")


OVERLAY = f"""WITH {_SIDES} SELECT c_custkey, coalesce(nullif(trim(a.c_name), ''), o.c_name) AS c_name, coalesce(nullif(trim(a.c_mktsegment), ''), o.c_mktsegment) AS c_mktsegment, coalesce(a.c_nationkey, o.c_nationkey) AS c_nationkey,
 CASE WHEN a.c_nationkey IS NOT NULL AND o.c_nationkey IS NOT NULL THEN 'both' WHEN a.c_nationkey IS NOT NULL THEN 'over' ELSE 'under' END AS origin FROM a FULL JOIN o USING (c_custkey)"""


def record_diff(spark: SparkSession, sf: str) -> DataFrame:
    return merge.record_diff(_customers(spark, sf, 0), _customers(spark, sf, 1), "c_custkey")


_FIELD = "SELECT c_custkey, 'changed' AS change, '{f}' AS field, o.{f}::VARCHAR AS old, a.{f}::VARCHAR AS new FROM o JOIN a USING (c_custkey) WHERE o.{f} IS DISTINCT FROM a.{f}"
RECORD_DIFF = f"WITH {_SIDES} " + " UNION ALL ".join([*(_FIELD.format(f=f) for f in ("c_name", "c_mktsegment", "c_nationkey")), "SELECT c_custkey, 'added', NULL, NULL, NULL FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM o)", "SELECT c_custkey, 'removed', NULL, NULL, NULL FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM a)"])


def three_way_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge.three_way(*(_customers(spark, sf, i) for i in range(3)), "c_custkey", "c_mktsegment")


THREE_WAY = f"""WITH {_SIDES}, x AS (SELECT coalesce(o.c_custkey, a.c_custkey, b.c_custkey) AS c_custkey, o.c_mktsegment AS vo, a.c_mktsegment AS va, b.c_mktsegment AS vb FROM o FULL JOIN a ON o.c_custkey = a.c_custkey FULL JOIN b ON coalesce(o.c_custkey, a.c_custkey) = b.c_custkey),
s AS (SELECT *, CASE WHEN va IS NOT DISTINCT FROM vb THEN 'agreed' WHEN va IS NOT DISTINCT FROM vo THEN 'theirs' WHEN vb IS NOT DISTINCT FROM vo THEN 'ours' ELSE 'conflict' END AS status FROM x)
SELECT c_custkey, CASE status WHEN 'theirs' THEN vb WHEN 'conflict' THEN NULL ELSE va END AS value, status, CASE status WHEN 'theirs' THEN vb IS NULL WHEN 'conflict' THEN false ELSE va IS NULL END AS deleted FROM s"""


def no_loss(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("form"))
    return merge.no_loss(p, p.where("p_type <> 'ECONOMY'"), "p_partkey", "form")


NO_LOSS = "SELECT p_partkey, lower(p_name) AS form, CASE WHEN lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_type <> 'ECONOMY') THEN 'renamed' ELSE 'lost' END AS outcome FROM part WHERE p_type = 'ECONOMY'"


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    return merge.carry_forward(o.withColumn("o_totalprice", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))), o, "o_orderkey", ["o_orderstatus", "o_totalprice"])


CARRY = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderstatus = 'F' AND o_totalprice IS NOT NULL AS carried FROM orders"


def provenance_replace(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return merge.replace_by_provenance(x, x.where("l_returnflag = 'R' and l_quantity > 25"), "l_returnflag", "R").groupBy("l_returnflag").agg(F.count("*").alias("n"))


PROVENANCE = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS DISTINCT FROM 'R' OR l_quantity > 25 GROUP BY 1"


def runway_buckets(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1998-06-01").cast("date"))
    bucket = F.when(days < 0, "ended").when(days <= 14, "two weeks").when(days <= 90, "quarter").when(days <= 365, "year").otherwise("later")
    return table(spark, sf, "orders").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


RUNWAY = "WITH d AS (SELECT date_diff('day', DATE '1998-06-01', o_orderdate::DATE) AS days FROM orders) SELECT CASE WHEN days < 0 THEN 'ended' WHEN days <= 14 THEN 'two weeks' WHEN days <= 90 THEN 'quarter' WHEN days <= 365 THEN 'year' ELSE 'later' END AS bucket, count(*) AS n FROM d GROUP BY 1"


def fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select((F.col("doc_id") * F.when(F.col("doc_id") % 10 == 0, -1).otherwise(1) - F.when(F.col("doc_id") == 0, 1).otherwise(0)).alias("doc_id"), "quality")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return checks.report(
        checks.orphans(labels, docs, "doc_id", "doc_id", "label_fk"), checks.duplicates(labels, "doc_id", "label_key"),
        checks.not_in(docs, "doc_id", "lang", ["en", "fr", "de"], "lang_enum", "WARN"),
        checks.violations(table(spark, sf, "lineitem"), "discount_bounds", "l_orderkey", ~F.col("l_discount").between(0, 0.09), "l_discount out of bounds", "WARN"),
    )


FK_ORPHANS = """
WITH l AS (SELECT doc_id * (CASE WHEN doc_id % 10 = 0 THEN -1 ELSE 1 END) - (CASE WHEN doc_id = 0 THEN 1 ELSE 0 END) AS doc_id FROM labels)
SELECT 'FAIL' AS severity, 'label_fk' AS check_name, doc_id::VARCHAR AS row_key, 'doc_id has no doc_id' AS message FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'FAIL', 'label_key', doc_id::VARCHAR, 'doc_id repeats' FROM l GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'WARN', 'lang_enum', doc_id::VARCHAR, 'lang is not a known value' FROM documents WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT 'WARN', 'discount_bounds', l_orderkey::VARCHAR, 'l_discount out of bounds' FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.09)
"""


def ratchet(spark: SparkSession, sf: str) -> DataFrame:
    now = table(spark, sf, "part").groupBy(F.col("p_brand").alias("measure")).agg(F.count("*").alias("n"))
    base = now.select("measure", (F.col("n") + F.when(F.length("measure") % 2 == 0, -1).otherwise(F.when(F.right("measure", F.lit(1)) == "3", 2).otherwise(0))).alias("n"))
    return checks.ratchet(now, base)


RATCHET = """WITH n AS (SELECT p_brand AS measure, count(*) AS n FROM part GROUP BY 1), b AS (SELECT measure, n + CASE WHEN length(measure) % 2 = 0 THEN -1 WHEN right(measure, 1) = '3' THEN 2 ELSE 0 END AS baseline FROM n)
SELECT measure, baseline, n, CASE WHEN n > baseline THEN 'FAIL' ELSE 'WARN' END AS severity FROM n JOIN b USING (measure) WHERE n <> baseline"""


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


TUMBLING = "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def events_session(spark: SparkSession, sf: str) -> DataFrame:
    return series.sessions(table(spark, sf, "events"), "user_id", "ts", 6 * 3600)


SESSION = """WITH g AS (SELECT user_id, ts, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) <= 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2"""


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("absent"))


JSON_PROPS = "SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS absent FROM events GROUP BY 1"


def canonical_rollup(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    leaves = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return leaves.select("n_name", "r_name", "n").select(F.explode(F.array(F.struct(F.lit("nation").alias("level"), F.col("n_name").alias("label")), F.struct(F.lit("region").alias("level"), F.col("r_name").alias("label")))).alias("x"), "n").groupBy("x.level", "x.label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("customers"))


CANONICAL = """WITH c AS (SELECT n_name, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'nation' AS level, n_name AS label, sum(n)::BIGINT AS customers FROM c GROUP BY n_name UNION ALL SELECT 'region', r_name, sum(n)::BIGINT FROM c GROUP BY r_name"""


def rotation_plan(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    x = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return ranking.due(x, "c_mktsegment", [F.col("last").asc_nulls_first(), F.col("c_custkey")], 28).select("c_mktsegment", "c_custkey", "place", "quota")


ROTATION = """WITH x AS (SELECT c_custkey, c_mktsegment, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY last ASC NULLS FIRST, c_custkey) AS place, ceil(count(*) OVER (PARTITION BY c_mktsegment) / 28.0)::BIGINT AS quota FROM x) SELECT c_mktsegment, c_custkey, place, quota FROM r WHERE place <= quota"""

QUERIES = {
    "q_pricing_summary": (pricing_summary, PRICING), "colisting": (colisting, COLISTING), "peers_tie_safe": (peers_tie_safe, PEERS), "group_rank_counts": (group_rank_counts, GROUP_RANK),
    "weighted_mode_label": (weighted_mode_label, WEIGHTED_MODE), "dense_month_series": (dense_month_series, DENSE), "trend_with_floor": (trend_with_floor, TREND), "grouping_rollup": (grouping_rollup, ROLLUP),
    "coverage_matrix": (coverage_matrix, COVERAGE), "comparable_having": (comparable_having, COMPARABLE), "first_seen_fold": (first_seen_fold, FIRST_SEEN), "interval_overlap": (interval_overlap, OVERLAP),
    "latest_wins_dedupe": (latest_wins_dedupe, LATEST), "capped_brief": (capped_brief, CAPPED), "overlay_merge": (overlay_merge, OVERLAY), "record_diff": (record_diff, RECORD_DIFF), "three_way_merge": (three_way_merge, THREE_WAY),
    "no_loss": (no_loss, NO_LOSS), "carry_forward": (carry_forward, CARRY), "provenance_replace": (provenance_replace, PROVENANCE), "runway_buckets": (runway_buckets, RUNWAY), "constraint_report": (fk_orphans, FK_ORPHANS),
    "ratchet": (ratchet, RATCHET), "events_tumbling": (events_tumbling, TUMBLING), "events_session": (events_session, SESSION), "json_props": (json_props, JSON_PROPS), "canonical_rollup": (canonical_rollup, CANONICAL), "rotation_plan": (rotation_plan, ROTATION),
}
