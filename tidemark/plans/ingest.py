"""Queries on stored pages, files, sources that fail, chains of snapshots and streams with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.functions.text import contrast
from tidemark.operators import chain
from tidemark.sources import feeds, files, paged, snapshots, status
from tidemark.streaming.first_seen import append_new
from tidemark.streaming.retained import retained
from tidemark.tables import cut, scratch, table

#: Orders on a page; the year whose fourth page is lost, the year that is walked back to a cutoff only, and the year whose pages are numbered.
PAGE, BROKEN, CUT, NUMBERED = 100, 1997, 1999, 1996
CUTOFF = "1999-06-01"


def paged_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders out of pages by year, newest first: followed by links, by numbers, back to a cutoff, and up to a broken link."""
    root = scratch(spark, "pages")
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    # places without a window over a whole year: days are numbered within, and counted before
    per_day = o.groupBy("year", "date").agg(F.count("*").alias("n"))
    before = per_day.select("year", "date", F.coalesce(F.sum("n").over(W.partitionBy("year").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("year", "date").orderBy("o_orderkey")) - 1
    x = o.join(before, ["year", "date"]).withColumn("place", place).withColumn("page", F.floor(F.col("place") / PAGE).cast("int"))
    pages = x.groupBy("year", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "o_orderkey", "date"))), lambda r: F.struct(r.o_orderkey.alias("o_orderkey"), r.date.alias("date"))).alias("items"))
    more = pages.groupBy("year").agg(F.max("page").alias("last"))
    link = F.when(F.col("page") < F.col("last"), F.concat(F.col("year").cast("string"), F.lit("/"), (F.col("page") + 2).cast("string"), F.lit(".json")))
    body = F.to_json(F.struct("items", F.struct(link.alias("next")).alias("links")))
    written = pages.join(more, "year").where(f"year <> {BROKEN} or page <> 3").select(F.format_string("%d/%d.json", "year", F.col("page") + 1).alias("name"), body.alias("content"))
    paged.write_files(written, root)
    years = [str(r[0]) for r in more.select("year").orderBy("year").collect()]  # a row a window
    schema, special = "o_orderkey long", {str(CUT): {"cutoff": CUTOFF}, str(NUMBERED): {"size": PAGE}}
    parts = [paged.walked(spark, root, [y for y in years if y not in special], schema, guard=1_000_000)] + [paged.walked(spark, root, [y], schema, guard=1_000_000, **special[y]) for y in years if y in special]
    items, states = parts[0]
    for i, s in parts[1:]:
        items, states = items.union(i), states.union(s)
    return items.join(F.broadcast(states), "window").select("window", F.col("item.o_orderkey").alias("o_orderkey"), "page", "place", "complete")  # a row a window


PAGED_ORDERS = f"""
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate::DATE DESC, o_orderkey) - 1 AS n FROM orders)
SELECT y::VARCHAR AS window, o_orderkey, (n // {PAGE} + 1)::INT AS page, (n % {PAGE})::INT AS place, NOT (y = {BROKEN} AND (SELECT count(*) FROM o WHERE y = {BROKEN}) > {3 * PAGE}) AS complete
FROM o WHERE (y <> {BROKEN} OR n < {3 * PAGE}) AND (y <> {CUT} OR d >= '{CUTOFF}')
"""


def _logos(spark: SparkSession, sf: str) -> DataFrame:
    """A logo for every brand and type: its name, colour and SVG text, a third of them white letters on a dark ground."""
    p = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k"))
    name = F.concat(F.lower(F.regexp_replace(F.concat_ws("-", "p_brand", "p_type"), "[^A-Za-z0-9]+", "-")), F.lit(".svg"))
    colour = F.substring(F.md5(F.concat_ws("/", "p_brand", "p_type")), 1, 6)
    svg = F.concat(F.lit('<svg><rect style="fill:#'), colour, F.lit('"/><path fill="#FFF"/><text>'), F.concat_ws(" ", "p_brand", "p_type"), F.lit("</text></svg>"))
    return p.select("k", name.alias("name"), colour.alias("fill"), svg.alias("svg"))


def logo_files(spark: SparkSession, sf: str) -> DataFrame:
    """Logos held against their manifest: some altered, lost, copied under another's name, stated with another colour or contrast, and strays."""
    x, root = cut(_logos(spark, sf), "logos"), scratch(spark, "files")
    text = F.when(F.col("k") % 7 == 0, F.concat("svg", F.lit(" "))).when(F.col("k") % 7 == 1, F.replace("svg", F.lit("rect"), F.lit("path"))).when(F.col("k") % 7 == 2, "<svg/>").otherwise(F.col("svg"))
    stored = x.where("k % 11 <> 0").select("name", text.cast("binary").alias("content"))
    strays = x.where("k % 13 = 0").select(F.concat(F.lit("stray-"), "name").alias("name"), F.col("svg").cast("binary").alias("content"))
    paged.write_files(stored.union(strays), root)
    fill = F.when(F.col("k") % 5 == 0, "123456").otherwise(F.col("fill"))
    told = x.select("name", F.octet_length("svg").cast("long").alias("bytes"), F.sha2("svg", 256).alias("sha256"), fill.alias("fill"), (F.round(contrast(fill, F.lit("ffffff")), 2) + F.when(F.col("k") % 17 == 0, 1.0).otherwise(0.0)).alias("contrast"))
    return files.against_manifest(files.stored_files(spark, root, "*.svg"), told)


_CHANNEL = "CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_LIGHT = " + ".join(f"{w} * ({_CHANNEL.format(c=f'''('0x' || fill[{at}:{at + 1}])::INT''')})" for w, at in ((0.2126, 1), (0.7152, 3), (0.0722, 5)))
LOGO_FILES = f"""
WITH g AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY 1, 2), x AS (SELECT k, lower(regexp_replace(p_brand || '-' || p_type, '[^A-Za-z0-9]+', '-', 'g')) || '.svg' AS name, md5(p_brand || '/' || p_type)[1:6] AS own,
  '<svg><rect style="fill:#' || md5(p_brand || '/' || p_type)[1:6] || '"/><path fill="#FFF"/><text>' || p_brand || ' ' || p_type || '</text></svg>' AS svg FROM g),
f AS (SELECT name, CASE k % 7 WHEN 0 THEN svg || ' ' WHEN 1 THEN replace(svg, 'rect', 'path') WHEN 2 THEN '<svg/>' ELSE svg END AS s FROM x WHERE k % 11 <> 0 UNION ALL SELECT 'stray-' || name, svg FROM x WHERE k % 13 = 0),
c AS (SELECT *, count(*) OVER (PARTITION BY s) AS copies FROM f), m AS (SELECT *, CASE WHEN k % 5 = 0 THEN '123456' ELSE own END AS fill FROM x), l AS (SELECT *, round(1.05 / (({_LIGHT}) + 0.05), 2) AS real FROM m),
b AS (SELECT l.name AS named, c.name AS stored, coalesce(l.name, c.name) AS name, l.svg, c.s, c.copies, l.own, l.fill, l.real, l.k FROM l FULL JOIN c ON l.name = c.name),
p AS (SELECT name, unnest([CASE WHEN stored IS NULL THEN 'missing' END, CASE WHEN named IS NULL THEN 'unnamed' END, CASE WHEN octet_length(encode(svg)) <> octet_length(encode(s)) THEN 'size' END, CASE WHEN svg <> s THEN 'digest' END, CASE WHEN copies > 1 THEN 'repeated' END,
  CASE WHEN stored = named AND (s = '<svg/>' OR fill NOT IN (own, 'ffffff')) THEN 'fill' END, CASE WHEN k % 17 = 0 OR real < 3 THEN 'contrast' END]) AS problem FROM b)
SELECT name, problem FROM p WHERE problem IS NOT NULL
"""


def ingested_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The log of two runs over a good, a malformed, an absent and a partly bad source; the first run is asked to log twice."""
    root = scratch(spark, "sources")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    c.write.json(f"{root}/good")
    c.where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 0, "{broken").otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(f"{root}/partly")
    c.where("c_custkey % 9 = 0").select(F.lit("{broken").alias("value")).write.text(f"{root}/malformed")
    schema = "c_custkey long, c_name string, c_acctbal double"
    read = lambda name, mode="PERMISSIVE": lambda s: s.read.schema(schema).option("mode", mode).json(f"{root}/{name}")
    sources = {"absent": read("none"), "good": read("good"), "malformed": read("malformed", "FAILFAST"), "partly": read("partly")}
    bad, newest = F.col("c_custkey").isNull(), F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    for run in ("one", "one", "two"):
        status.ingest(spark, run, sources if run == "one" else {"good": read("good")}, f"{root}/out", bad, newest)
    kept = spark.read.parquet(f"{root}/out/good", f"{root}/out/partly").count()
    return status.logged(spark, f"{root}/out/log").select("run", "source", "ok", "rows", "bad", F.ltrim("newest", F.lit("0")).alias("newest"), F.col("reason").isNotNull().alias("has_reason"), F.lit(kept).alias("kept"))


INGESTED = """
WITH c AS (SELECT c_custkey FROM customer), p AS (SELECT c_custkey, c_custkey % 2 = 0 AS bad FROM c WHERE c_custkey % 3 = 0), k AS (SELECT (SELECT count(*) FROM c) + (SELECT count(*) FROM p WHERE NOT bad) AS kept),
r AS (SELECT unnest(['one', 'two']) AS run, 'good' AS source, true AS ok, (SELECT count(*) FROM c) AS rows, 0 AS bad, (SELECT max(c_custkey)::VARCHAR FROM c) AS newest
  UNION ALL SELECT 'one', 'partly', true, (SELECT count(*) FROM p), (SELECT count(*) FROM p WHERE bad), (SELECT max(c_custkey)::VARCHAR FROM p WHERE NOT bad)
  UNION ALL SELECT 'one', 'absent', false, 0, 0, NULL UNION ALL SELECT 'one', 'malformed', false, 0, 0, NULL)
SELECT run, source, ok, rows, bad, newest, NOT ok AS has_reason, kept FROM r, k
"""

#: Snapshots of the chain, one a month, and how many of them the first run folds.
SNAPSHOTS, FIRST_RUN = 12, 7


def snapshot_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and their orders' states through twelve snapshots, folded in two runs: since when each is known, beside the last snapshot's counts."""
    path, state = scratch(spark, "chain"), scratch(spark, "fold")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    for n in range(SNAPSHOTS):
        # rows come and go: an order is there for five snapshots
        snapshots.write_snapshot(o.where(F.pmod(F.lit(n) - F.col("o_orderkey") % SNAPSHOTS, F.lit(SNAPSHOTS)) < 5).select("o_custkey", "o_orderstatus"), path, f"2024-{n + 1:02d}-01")
        if n + 1 in (FIRST_RUN, SNAPSHOTS):
            chain.fold_snapshots(spark, path, state, "o_custkey", "o_orderstatus")
    last = F.broadcast(chain.counts(spark, state).where(F.col("day") == f"2024-{SNAPSHOTS:02d}-01").select("entities", "children"))  # one row
    return chain.seen(spark, state).crossJoin(last).select(F.col("entity").cast("long").alias("customer"), F.col("child").alias("state"), "first", "at_start", "entities", "children")


SNAPSHOT_CHAIN = f"""
WITH s AS (SELECT n, '2024-' || lpad((n + 1)::VARCHAR, 2, '0') || '-01' AS day, o_custkey AS customer, o_orderstatus AS state FROM orders, range({SNAPSHOTS}) AS t(n) WHERE (n - o_orderkey % {SNAPSHOTS} + {SNAPSHOTS}) % {SNAPSHOTS} < 5),
e AS (SELECT day, customer, state FROM s UNION ALL SELECT day, customer, NULL FROM s), l AS (SELECT count(DISTINCT customer) AS entities, count(DISTINCT (customer, state)) AS children FROM s WHERE n = {SNAPSHOTS - 1})
SELECT customer, state, min(day) AS first, min(day) = '2024-01-01' AS at_start, entities, children FROM e, l GROUP BY customer, state, entities, children
"""

#: Days of retention, and of a stream's batches.
KEEP, STEP = 3, 10
_FIRST_DAY = "2024-01-01"


#: Rows of a file of a batch.
FILE_ROWS = 500_000


def _batches(spark: SparkSession, sf: str, extra: list[tuple[int, DataFrame]]) -> tuple[str, int]:
    """Events in three batches by days, with extra rows added to a batch; the path of their folder and the number of files that each batch has.

    A stream takes files in order of their time, as many at once as a batch has; a batch's rows are dealt in turn, so that no file is empty.
    """
    root, e = scratch(spark, "batches"), table(spark, sf, "events")
    day = F.datediff("ts", F.lit(_FIRST_DAY).cast("date"))
    parts = []
    for n in range(3):
        part = e.where((day >= n * STEP) & ((day < (n + 1) * STEP) if n < 2 else F.lit(True)))
        for at, more in extra:
            part = part.union(more) if at == n else part
        parts.append(part)
    sizes = [part.count() for part in parts]
    files = max(1, min(max(sizes) // FILE_ROWS + 1, min(sizes) // 1000))
    for n, part in enumerate(parts):
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(f"{root}/{n}")
    return root, files


def retained_users(spark: SparkSession, sf: str) -> DataFrame:
    """Users as a stream in three batches keeps them: forgotten after three days, repeated rows counted, rows that come weeks late rejected."""
    e = table(spark, sf, "events")
    day = F.datediff("ts", F.lit(_FIRST_DAY).cast("date"))
    root, files = _batches(spark, sf, [(1, e.where((day >= STEP) & (day < 2 * STEP) & (F.col("event_id") % 5 == 0))), (2, e.where(day < 2))])
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(root).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found, reports = retained(stream, ["user_id"], "ts", scratch(spark, "retained"), KEEP)
    late = sum(r["late"] for r in reports)
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n", "expired", F.lit(late).alias("late"))


RETAINED_USERS = f"""
WITH e AS (SELECT user_id, ts FROM events UNION ALL SELECT user_id, ts FROM events WHERE event_id % 5 = 0 AND date_diff('day', DATE '{_FIRST_DAY}', ts::DATE) BETWEEN {STEP} AND {2 * STEP - 1}),
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL {KEEP} DAY, false)::INT AS gap FROM e), s AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
m AS (SELECT user_id, s, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY 1, 2), h AS (SELECT epoch_ms(max(ts)) - {KEEP} * 86400000 AS mark FROM events)
SELECT user_id, first, last, n, ceil(epoch_us(last) / 1000.0) + 1 <= mark AS expired, (SELECT count(*) FROM events WHERE date_diff('day', DATE '{_FIRST_DAY}', ts::DATE) < 2) AS late
FROM m, h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC) = 1
"""


def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an append-only stream in three batches keeps them: a key that comes again within the window is dropped, a row older than it rejected."""
    e = table(spark, sf, "events")
    day = F.datediff("ts", F.lit(_FIRST_DAY).cast("date"))
    again = e.where((day >= 2 * STEP - 2) & (day < 2 * STEP))
    late = e.where(day < 2).withColumn("event_id", F.col("event_id") + 1_000_000_000)
    root, files = _batches(spark, sf, [(1, e.where((day >= STEP) & (day < STEP + 2))), (2, again.select(e.columns)), (2, late.select(e.columns))])
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(root).select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return append_new(stream, "event_id", f"{scratch(spark, 'window')}/t", "at", "5 days").select("event_id")


WINDOWED = "SELECT event_id FROM events WHERE ts IS NOT NULL"


def tagged_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Turnover, staff and loss of suppliers out of tagged accounts: scaled, signed, in pounds only; a dash is no figure."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    fact = lambda name, unit, text, rest="": F.concat(F.lit(f'<ix:nonFraction name="core:{name}" contextRef="c1" unitRef="{unit}"{rest}>'), text, F.lit("</ix:nonFraction>"))
    head = '<xbrli:context id="c1"><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context><xbrli:context id="c2"><xbrli:segment/><xbrli:period><xbrli:instant>2023-12-31</xbrli:instant></xbrli:period></xbrli:context><xbrli:unit id="u1"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><xbrli:unit id="u2"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit><xbrli:unit id="u3"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit>'
    k = F.col("s_suppkey")
    turnover = F.when(k % 4 == 0, F.concat(F.lit("<b>"), F.format_number(k * 1000 + 1234, 0), F.lit("</b>"))).when(k % 4 == 1, F.lit(" - ")).when(k % 4 == 2, F.lit("n/a")).otherwise(k.cast("string"))
    doc = F.concat(F.lit(head), fact("Turnover", "u1", turnover, ' scale="3"'), fact("Turnover", "u2", F.lit("7")), fact("AverageEmployees", "u3", F.when(k % 3 == 0, "0.012").otherwise("12")), fact("Loss", "u1", k.cast("string"), ' sign="-"'), fact("Other", "u1", F.lit("5")))
    found = feeds.tagged_facts(s.select("s_suppkey", doc.alias("html")), "s_suppkey", "html", ["Turnover", "AverageEmployees", "Loss"])
    return found.select("s_suppkey", "name", F.date_format("end", "yyyy-MM-dd").alias("end_day"), "unit", (F.round("value", 3) + 0.0).alias("value"))


TAGGED_ACCOUNTS = """
WITH s AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k, 'Turnover' AS name, 'GBP' AS unit, CASE k % 4 WHEN 0 THEN (k * 1000 + 1234) * 1000.0 WHEN 3 THEN k * 1000.0 END AS value FROM s
  UNION ALL SELECT k, 'AverageEmployees', 'pure', 12.0 FROM s UNION ALL SELECT k, 'Loss', 'GBP', 0.0 - k FROM s)
SELECT k AS s_suppkey, name, '2023-12-31' AS end_day, unit, round(value::DOUBLE, 3) AS value FROM f WHERE value IS NOT NULL
"""

QUERIES = {
    "paged_orders": (paged_orders, PAGED_ORDERS), "logo_files": (logo_files, LOGO_FILES), "ingested_sources": (ingested_sources, INGESTED), "snapshot_chain": (snapshot_chain, SNAPSHOT_CHAIN), "retained_users": (retained_users, RETAINED_USERS),
    "windowed_events": (windowed_events, WINDOWED), "tagged_accounts": (tagged_accounts, TAGGED_ACCOUNTS),
}
