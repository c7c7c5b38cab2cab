"""Queries on evidence: labels, matching, agreement, comparison and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions.text import label_before_digit, significant_tokens
from tidemark.operators import listing, matching, postings, ranking, search
from tidemark.plans.records import _BRIDGE, _bridge
from tidemark.tables import table


def brand_label(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "part")
    return x.select("p_partkey", label_before_digit(F.col("p_brand")).alias("label"), F.substring("p_brand", 1, 2).alias("chapter"), F.substring("p_brand", 3, 4).alias("segment"))


BRAND_LABEL = "SELECT p_partkey, coalesce(nullif(rtrim(regexp_extract(p_brand, '^[^0-9]*'), ' #-'), ''), p_brand) AS label, substr(p_brand, 1, 2) AS chapter, substr(p_brand, 3, 4) AS segment FROM part"


def token_subset_match(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    probes = part.select(F.col("p_name").alias("probe")).distinct().withColumn("tokens", significant_tokens(F.col("probe")))
    targets = part.select(F.concat_ws(" ", "p_name", "p_type").alias("target")).distinct().withColumn("tokens", significant_tokens(F.col("target")))
    return matching.match_all_tokens(probes, targets)


_TOKENS = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4)))"
TOKEN_SUBSET = f"""
WITH p AS (SELECT DISTINCT p_name AS probe, {_TOKENS.format('p_name')} AS want FROM part),
t AS (SELECT DISTINCT p_name || ' ' || p_type AS target, {_TOKENS.format("p_name || ' ' || p_type")} AS have FROM part)
SELECT probe, target FROM p JOIN t ON len(want) > 0 AND list_has_all(have, want)
"""


def tiered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each type word and name: the equal name first, then names with all its words, else out of scope."""
    part = table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("target")).distinct().withColumn("tokens", significant_tokens(F.col("target")))
    asked = part.select(F.element_at(F.split("p_name", " "), -1).alias("probe")).union(part.select("p_name")).union(part.select("p_type")).distinct()
    asked = asked.withColumn("tokens", significant_tokens(F.col("probe")))
    equal = asked.join(names, F.col("probe") == F.col("target")).select("probe", F.struct(F.lit(1).alias("tier"), F.col("target")).alias("hit"))
    subset = matching.match_all_tokens(asked, names).select("probe", F.struct(F.lit(2).alias("tier"), F.col("target")).alias("hit"))
    best = equal.union(subset).groupBy("probe").agg(F.min("hit").alias("hit"))
    return asked.select("probe").join(best, "probe", "left").select("probe", F.coalesce("hit.tier", F.lit(3)).alias("tier"), F.col("hit.target").alias("target"))


TIERED = f"""
WITH n AS (SELECT DISTINCT p_name AS target, {_TOKENS.format('p_name')} AS have FROM part),
q AS (SELECT probe, {_TOKENS.format('probe')} AS want FROM (SELECT string_split(p_name, ' ')[-1] AS probe FROM part UNION SELECT p_name FROM part UNION SELECT p_type FROM part)),
h AS (SELECT probe, 1 AS tier, target FROM q JOIN n ON probe = target UNION ALL SELECT probe, 2, target FROM q JOIN n ON len(want) > 0 AND list_has_all(have, want)),
b AS (SELECT probe, tier, target FROM h QUALIFY row_number() OVER (PARTITION BY probe ORDER BY tier, target) = 1)
SELECT q.probe, coalesce(b.tier, 3) AS tier, b.target FROM q LEFT JOIN b ON q.probe = b.probe
"""


def split_listed_names(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    rows = part.join(after, "p_partkey", "left").select("p_partkey", F.concat_ws(" and ", "p_name", F.coalesce("next", "p_type")).alias("listed"))
    rows = rows.union(part.select(-F.col("p_partkey") - 1, F.concat_ws(" and ", "p_name", "p_type")))
    return matching.split_listed(rows, "p_partkey", "listed", part.select(F.col("p_name").alias("name")).distinct())


SPLIT_LISTED = """
WITH r AS (SELECT a.p_partkey, a.p_name || ' and ' || coalesce(b.p_name, a.p_type) AS listed FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1
  UNION ALL SELECT -p_partkey - 1, p_name || ' and ' || p_type FROM part),
p AS (SELECT p_partkey, listed, unnest(string_split(listed, ' and ')) AS part FROM r),
k AS (SELECT p_partkey, listed, bool_and(part IN (SELECT p_name FROM part)) AS whole, count(*) AS n FROM p GROUP BY 1, 2)
SELECT p.p_partkey, p.part AS name, k.n AS parts FROM p JOIN k USING (p_partkey) WHERE k.whole UNION ALL SELECT p_partkey, listed, 1 FROM k WHERE NOT whole
"""


def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its fate: round-ups, then sources outside the domain, are set aside with a reason."""
    x = table(spark, sf, "documents")
    listing_page = F.coalesce(F.col("text").rlike(r"(?s)\A[^\n]*\|[^\n]*\|"), F.lit(False))
    reason = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(listing_page, "round-up").when(F.coalesce(F.col("source").isin("src3", "src7"), F.lit(False)), "out of domain")
    return x.select("doc_id", reason.isNull().alias("kept"), reason.alias("reason"))


QUARANTINE = r"""
SELECT doc_id, reason IS NULL AS kept, reason FROM (SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty'
  WHEN coalesce(regexp_matches(text, '\A[^\n]*\|[^\n]*\|'), false) THEN 'round-up' WHEN coalesce(source IN ('src3', 'src7'), false) THEN 'out of domain' END AS reason FROM documents)
"""


#: Groups that two suppliers share before they are listed together.
LISTED = 10


def same_group_not_colisted(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of suppliers that share a group, but too few to be listed together."""
    return listing.colisting(_bridge(spark, sf), "member", "grp", 1).where(F.col("shared") < LISTED).select("a", "b")


NOT_COLISTED = f"WITH {_BRIDGE} SELECT x.member AS a, y.member AS b FROM b x JOIN b y ON x.grp = y.grp AND x.member <> y.member GROUP BY 1, 2 HAVING count(*) < {LISTED}"


def category_competitors(spark: SparkSession, sf: str) -> DataFrame:
    """Brands beside each brand by shared (name, type) categories: the first 24, with the total."""
    bridge = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.concat_ws("/", "p_name", "p_type").alias("category"))
    found = listing.colisting(bridge, "brand", "category", 1)
    return ranking.capped(found, "a", [F.desc("shared"), F.col("b")], 24).select("a", "b", "shared", "place", "shown", "total", "not_listed")


COMPETITORS = """
WITH g AS (SELECT DISTINCT p_brand AS brand, p_name || '/' || p_type AS category FROM part),
f AS (SELECT x.brand AS a, y.brand AS b, count(*) AS shared FROM g x JOIN g y ON x.category = y.category AND x.brand <> y.brand GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS place, count(*) OVER (PARTITION BY a) AS total FROM f)
SELECT a, b, shared, place, least(total, 24) AS shown, total, greatest(total - 24, 0) AS not_listed FROM r WHERE place <= 24
"""


def handover_gap(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's order priorities in order of first use, with the days since the one before was last used."""
    spans = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    w = Window.partitionBy("o_custkey").orderBy("first", "o_orderpriority")
    x = spans.withColumns({"previous": F.lag("o_orderpriority").over(w), "previous_last": F.lag("last").over(w)})
    days = F.datediff("first", "previous_last")
    return x.where("previous is not null").select("o_custkey", "o_orderpriority", "previous", days.alias("gap_days"), ((F.col("first") > F.col("previous_last")) & (days >= 28)).alias("handover"))


HANDOVER = """
WITH s AS (SELECT o_custkey, o_orderpriority, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1, 2),
x AS (SELECT *, lag(o_orderpriority) OVER w AS previous, lag(l) OVER w AS pl FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY f, o_orderpriority))
SELECT o_custkey, o_orderpriority, previous, date_diff('day', pl::DATE, f::DATE) AS gap_days, f > pl AND date_diff('day', pl::DATE, f::DATE) >= 28 AS handover FROM x WHERE previous IS NOT NULL
"""


def evidence_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """The order's own status beside the status its lines tell."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"))
    told = lines.select("k", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("P").alias("status"))
    return matching.agreement([orders, told], "k", "status")


AGREEMENT = """
WITH t AS (SELECT l_orderkey AS k, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS status FROM lineitem GROUP BY 1),
u AS (SELECT o_orderkey AS k, o_orderstatus AS status, 0 AS s FROM orders UNION ALL SELECT k, status, 1 FROM t)
SELECT k, CASE WHEN min(status) = max(status) THEN min(status) END AS status, count(DISTINCT s) AS sources,
  CASE WHEN min(status) <> max(status) THEN 'conflict' WHEN count(DISTINCT s) = 2 THEN 'agreed' ELSE 'one-sided' END AS verdict FROM u GROUP BY k
"""


def multiset_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a base and a changed head that the other lacks, with their counts."""
    base = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    head = base.where("l_returnflag <> 'R' or l_quantity > 5").withColumn("l_quantity", F.when(F.col("l_returnflag") == "A", F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return matching.multiset_diff(base, head, base.columns)


PARITY = """
WITH u AS (SELECT l_partkey, l_suppkey, l_quantity, l_returnflag, 1 AS b, 0 AS h FROM lineitem
  UNION ALL SELECT l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN l_quantity + 1 ELSE l_quantity END, l_returnflag, 0, 1 FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity > 5)
SELECT l_partkey, l_suppkey, l_quantity, l_returnflag, sum(b)::BIGINT AS in_base, sum(h)::BIGINT AS in_head FROM u GROUP BY 1, 2, 3, 4 HAVING sum(b) <> sum(h)
"""


def positional_reply(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the role of the turn at the next position."""
    x = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    after = x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("reply"))
    return x.join(after, ["conv_id", "turn"], "left")


POSITIONAL = "SELECT a.conv_id, a.turn, a.role, b.role AS reply FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def brand_generic_share(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity of the N segment against all others by part brand, and for all brands together."""
    x = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    generic = F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0))
    y = x.rollup("p_brand").agg(generic.alias("generic"), F.sum("l_quantity").alias("items"), F.bool_or((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 0)).alias("generic_present"))
    return y.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), "generic", "items", "generic_present", F.try_divide(F.col("generic") * 100, "items").alias("share"))


SHARE = """
SELECT coalesce(p_brand, 'all') AS brand, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END)::DOUBLE AS generic, sum(l_quantity) AS items, bool_or(l_returnflag = 'N' AND l_quantity > 0) AS generic_present,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END)::DOUBLE * 100 / nullif(sum(l_quantity), 0) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand)
"""


def proven_vs_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """Names each brand records and those its large lines prove: what is missing, what is unproven, four examples."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    large = table(spark, sf, "lineitem").where("l_quantity >= 48").select("l_partkey").distinct()
    proven = part.join(large, F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("p_brand").agg(F.collect_set("p_name").alias("proven"))
    x = part.groupBy("p_brand").agg(F.collect_set("p_name").alias("recorded")).join(proven, "p_brand", "left")
    unproven = F.sort_array(F.array_except("recorded", F.coalesce("proven", F.array().cast("array<string>"))))
    return x.select("p_brand", F.size("recorded").alias("recorded"), F.size(unproven).alias("unproven"), F.array_join(F.slice(unproven, 1, 4), ", ").alias("examples"))


PROVEN = """
WITH v AS (SELECT p_brand, p_name, bool_or(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)) AS proven FROM part GROUP BY 1, 2)
SELECT p_brand, count(*) AS recorded, count(*) FILTER (NOT proven) AS unproven,
  array_to_string(list_sort(coalesce(list(p_name) FILTER (NOT proven), []))[1:4], ', ') AS examples FROM v GROUP BY 1
"""


def changed_since(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose fields differ from the capture before."""
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.withColumns({"c_mktsegment": F.when(F.col("c_acctbal") > 9000, "MACHINERY").otherwise(F.col("c_mktsegment")), "c_acctbal": F.greatest("c_acctbal", F.lit(0.0))})
    return matching.changed_fields(new, old.where("c_acctbal > -900"), "c_custkey", ["c_mktsegment", "c_acctbal"])


CHANGED = """
SELECT c_custkey, CASE WHEN NOT c_acctbal > -900 THEN 'new' ELSE concat_ws(',', CASE WHEN c_acctbal > 9000 AND c_mktsegment <> 'MACHINERY' THEN 'c_mktsegment' END, CASE WHEN c_acctbal < 0 THEN 'c_acctbal' END) END AS changed FROM customer
"""


def roi_calc(spark: SparkSession, sf: str) -> DataFrame:
    """Saving against cost of every line; a cost of zero has no return and no payback."""
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("saving"), (F.col("l_extendedprice") * F.col("l_tax")).alias("cost"))
    net = F.col("saving") - F.col("cost")
    return x.withColumns({"net": net, "roi_pct": F.try_divide(net * 100, "cost"), "payback_months": F.try_divide(F.col("cost") * 12, "saving")})


ROI = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount AS saving, l_extendedprice * l_tax AS cost FROM lineitem)
SELECT *, saving - cost AS net, (saving - cost) * 100 / nullif(cost, 0) AS roi_pct, cost * 12 / nullif(saving, 0) AS payback_months FROM x
"""


def enum_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Order priorities as categories; what the mapping lacks has none, and a note."""
    known = F.create_map(*[F.lit(v) for pair in {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "normal", "5-LOW": "low"}.items() for v in pair])
    x = table(spark, sf, "orders").withColumn("category", F.try_element_at(known, "o_orderpriority"))
    note = F.when(F.col("category").isNull(), F.concat(F.lit("unmapped: "), F.coalesce("o_orderpriority", F.lit("none"))))
    level, reason = matching.confidence(F.col("o_orderkey"), F.nullif("o_orderstatus", F.lit("P")), note)
    return x.select("o_orderkey", "category", level.alias("confidence"), reason.alias("reason"))


CONFIDENCE = """
WITH x AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS p, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'normal' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS category FROM orders)
SELECT o_orderkey, category, CASE WHEN category IS NULL OR o_orderstatus = 'P' OR o_orderstatus IS NULL THEN 'probable' ELSE 'confirmed' END AS confidence,
  CASE WHEN category IS NULL THEN 'unmapped: ' || coalesce(p, 'none') WHEN o_orderstatus = 'P' OR o_orderstatus IS NULL THEN 'no status' ELSE 'number and status known' END AS reason FROM x
"""


def events_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type in hours that begin every quarter of an hour."""
    x = table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return x.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "n", "users")


SLIDING = """
WITH x AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS s, event_type, user_id FROM events, range(4) AS r(i))
SELECT strftime(s, '%Y-%m-%d %H:%M') AS started, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM x GROUP BY 1, 2
"""

QUERY, STOP = "It was for the with", ("the",)


def search_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten documents for a query, out of the session's search index."""
    docs = table(spark, sf, "documents")
    index = postings.once(spark, "texts", docs, postings.text_sections(docs, "doc_id", "text"))
    return search.ranked(postings.scored(spark, index, QUERY, STOP), "id").withColumnRenamed("id", "doc_id")


def _search_sql() -> str:
    tokens, phrase = search.query_tokens(QUERY, STOP), " ".join(search.query_tokens(QUERY, ()))
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
    has = lambda x, p: f"contains(' ' || {x} || ' ', ' {p} ')"
    hit = lambda x, t: "(" + " OR ".join(has(x, f) for f in search.forms(t)) + ")"
    section = f"(CASE WHEN {has('x.h', phrase)} THEN 90 ELSE 0 END)" + "".join(f" + (CASE WHEN {hit('x.h', t)} THEN 12 WHEN {hit('x.b', t)} THEN 6 ELSE 0 END)" for t in tokens)
    title = f"(CASE WHEN {has('s[1].h', phrase)} THEN 140 ELSE 0 END)" + "".join(f" + (CASE WHEN {hit('s[1].h', t)} THEN 18 ELSE 0 END)" for t in tokens)
    covered = " AND ".join(f"len(list_filter(s, lambda x: {hit('x.b', t)})) > 0" for t in tokens)
    return f"""
WITH d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda y: {{'h': {norm("split_part(y, '.', 1)")}, 'b': {norm('y')}}}) AS s FROM documents),
c AS (SELECT doc_id, ({title} + list_max(list_transform(s, lambda x: {section})) + CASE WHEN {covered} THEN 45 ELSE 0 END)::BIGINT AS score FROM d)
SELECT doc_id, score FROM c WHERE score >= greatest(12, 0.18 * (SELECT max(score) FROM c)) ORDER BY score DESC, doc_id LIMIT 10
"""


QUERIES = {
    "brand_label": (brand_label, BRAND_LABEL), "token_subset_match": (token_subset_match, TOKEN_SUBSET), "tiered_lookup": (tiered_lookup, TIERED),
    "split_listed_names": (split_listed_names, SPLIT_LISTED), "quarantine_split": (quarantine_split, QUARANTINE), "same_group_not_colisted": (same_group_not_colisted, NOT_COLISTED),
    "category_competitors": (category_competitors, COMPETITORS), "handover_gap": (handover_gap, HANDOVER), "evidence_agreement": (evidence_agreement, AGREEMENT),
    "multiset_parity": (multiset_parity, PARITY), "positional_reply": (positional_reply, POSITIONAL), "brand_generic_share": (brand_generic_share, SHARE),
    "proven_vs_recorded": (proven_vs_recorded, PROVEN), "changed_since": (changed_since, CHANGED), "roi_calc": (roi_calc, ROI),
    "enum_confidence": (enum_confidence, CONFIDENCE), "events_sliding": (events_sliding, SLIDING), "search_rank": (search_rank, _search_sql()),
}
