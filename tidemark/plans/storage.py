"""Queries that write the driver's tables in a stored form and read them back: snapshots, shards, JSON, CSV, guarded and append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources import feeds, snapshots
from tidemark.streaming.first_seen import append_new
from tidemark.tables import scratch, table


def orders_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as they stood three days before a date, out of the snapshots kept since, with the days that were kept after a checkpoint."""
    o, path = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), scratch(spark, "orders")
    for day, share in (("1998-01-01", "O"), ("1998-01-20", "F"), ("1998-01-30", "P")):
        snapshots.write_snapshot(o.where(F.col("o_orderstatus") <= share), path, day)
    kept = len(snapshots.history(spark, path, "1998-01-01"))
    return snapshots.as_of(spark, path, "3d", "1998-01-31").select("o_orderkey", "o_orderstatus", F.lit(snapshots.resolve(spark, path, "3d", "1998-01-31")).alias("day"), F.lit(kept).alias("later"))


AS_OF = "SELECT o_orderkey, o_orderstatus, '1998-01-20' AS day, 2 AS later FROM orders WHERE o_orderstatus <= 'F'"


def sharded_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written by brand, one brand read back; a brand without a shard adds nothing."""
    path = f"{scratch(spark, 'shards')}/t"
    feeds.write_shards(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), path, "p_brand")
    return feeds.read_shard(spark, path, "p_brand", "Brand#11").union(feeds.read_shard(spark, path, "p_brand", "none")).select("p_partkey", "p_name", "p_brand")


SHARDED = "SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand = 'Brand#11'"


def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as JSON lines with facts beside them, read back by schema; a missing document gives its default."""
    path = scratch(spark, "json")
    feeds.write_with_meta(table(spark, sf, "nation"), f"{path}/n", source="nation")
    spark.read.parquet(f"{path}/n/rows").write.json(f"{path}/j")
    rows = snapshots.load_json(spark, f"{path}/j", "n_nationkey long, n_name string", whole=False)
    missing = snapshots.load_json(spark, f"{path}/none", "n_nationkey long, n_name string", default=[(-1, "none")])
    meta = snapshots.load_json(spark, f"{path}/n/meta", "n long, source string").select(F.col("n").alias("n_nationkey"), F.col("source").alias("n_name"))
    return rows.union(missing).union(meta)


JSON = "SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (-1, 'none') UNION ALL SELECT count(*), 'nation' FROM nation"


def quoted_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Parts through a quoted CSV file; what is no number in a count is 0."""
    path = f"{scratch(spark, 'csv')}/t"
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(' say "x", y')).alias("name"), F.when(F.col("p_size") < 10, "*").otherwise(F.col("p_size").cast("string")).alias("n"))
    snapshots.write_csv(p, path)
    return snapshots.load_counts(spark, path, ["n", "p_partkey"])


CSV = "SELECT p_partkey, p_name || ' say \"x\", y' AS name, CASE WHEN p_size < 10 THEN 0 ELSE p_size END::BIGINT AS n FROM part"


def guarded_customers(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of a table after a good write, a shrinking one that is refused, and one that reads itself."""
    c, path = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), f"{scratch(spark, 'guarded')}/t"
    snapshots.guarded_write(c, path)
    try:
        snapshots.guarded_write(c.where("c_nationkey = 1"), path)
        refused = False
    except ValueError:
        refused = True
    snapshots.guarded_write(spark.read.parquet(path).where("c_nationkey > 2"), path)
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


GUARDED = "SELECT c_custkey, c_nationkey, true AS refused FROM customer WHERE c_nationkey > 2"


def append_only_events(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of events by user and type as an append-only stream keeps them: the first row of each key, read again without new ones."""
    schema, path = table(spark, sf, "events").schema, scratch(spark, "append")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events.parque[t]").select("user_id", "event_type")
    keyed = lambda: stream().withColumn("k", F.struct("user_id", "event_type"))
    append_new(keyed(), "k", f"{path}/t")
    return append_new(keyed(), "k", f"{path}/t").select("user_id", "event_type")


APPEND_ONLY = "SELECT DISTINCT user_id, event_type FROM events"


QUERIES = {
    "orders_as_of": (orders_as_of, AS_OF), "sharded_parts": (sharded_parts, SHARDED), "json_documents": (json_documents, JSON), "quoted_csv": (quoted_csv, CSV), "guarded_customers": (guarded_customers, GUARDED),
    "append_only_events": (append_only_events, APPEND_ONLY),
}
