"""Stored feeds and documents as tables: items, search results, resources, sitemaps, tagged facts, part files and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.html import clean_text, decode_entities
from tidemark.sources.snapshots import exists


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published, source) of the items of RSS files; dates that are none are null, links once."""
    schema = "title string, link string, pubDate string, source string"
    items = spark.read.schema(schema).option("rowTag", "item").xml(path)
    # the weekday before the comma is no part of the pattern
    day = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    found = items.select(decode_entities(F.col("title")).alias("title"), F.trim("link").alias("link"), day.alias("published"), "source").where("link is not null")
    return found.groupBy("link").agg(F.min(F.struct("published", "title", "source")).alias("b")).select("b.title", "link", "b.published", "b.source")


def search_results(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(title, url, day) of stored search responses ({"results": [{"title", "link", "public_timestamp"}]}); paths below ``prefix`` become urls."""
    schema = "results array<struct<title:string,link:string,public_timestamp:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    return rows.select("r.title", F.when(F.col("r.link").startswith("/"), F.concat(F.lit(prefix), "r.link")).otherwise(F.col("r.link")).alias("url"), F.try_to_date(F.substring("r.public_timestamp", 1, 10)).alias("day"))


def with_period(files: DataFrame, pattern: str) -> DataFrame:
    """Rows of files whose name matches ``pattern`` (year, month), with the period that the name states; other files' rows go."""
    name = F.regexp_extract(F.input_file_name(), "([^/]*)$", 1)
    period = F.when(name.rlike(pattern), F.make_date(F.regexp_extract(name, pattern, 1).try_cast("int"), F.regexp_extract(name, pattern, 2).try_cast("int"), F.lit(1)))
    return files.withColumn("period", period).where("period is not null")


def sitemap_pages(documents: DataFrame, root: str, most: int = 12) -> DataFrame:
    """(url, depth) of the pages that a sitemap names, through its index files; documents: (url, xml) of stored files.

    At most ``most`` levels of index files are followed, each once; files that are not stored are passed over.
    """
    named = documents.select("url", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("loc"), F.col("xml").contains("<sitemapindex").alias("is_index"))
    level, seen, pages = documents.where(F.col("url") == root).select("url"), None, None
    for depth in range(most):
        found = level.join(named, "url")
        here = found.where("not is_index").select(F.col("loc").alias("url"), F.lit(depth).alias("depth"))
        pages = here if pages is None else pages.union(here)
        seen = level if seen is None else seen.union(level)
        level = found.where("is_index").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        if level.isEmpty():
            break
    return pages.groupBy("url").agg(F.min("depth").alias("depth"))


_ATTRIBUTE = r"(?is)\b{}=\"([^\"]*)\""


def tagged_facts(documents: DataFrame, key: str, html: str, names: list[str], currency: str = "GBP") -> DataFrame:
    """(key, name, start, end, unit, value) of the tagged figures of iXBRL documents.

    Taken are names of ``names`` (whatever their prefix) in contexts with dates and without
    segments; money in ``currency`` only. scale and sign apply; a fact whose text is no number, such as a dash,
    is left out. A head count with a fraction was scaled by mistake and is multiplied back.
    """
    attribute = lambda x, name: F.regexp_extract(x, _ATTRIBUTE.format(name), 1)
    tag = lambda x, name: F.regexp_extract(x, rf"(?is)<(?:[a-z]+:)?{name}[^>]*>\s*([^<]*?)\s*</", 1)
    every = lambda pattern: F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))
    contexts = documents.select(key, every(r"(?is)<xbrli:context\b.*?</xbrli:context>").alias("x")).where(~F.lower("x").contains("segment"))
    instant = tag(F.col("x"), "instant")
    contexts = contexts.select(key, attribute(F.col("x"), "id").alias("context"), F.try_to_date(F.nullif(tag(F.col("x"), "startDate"), F.lit(""))).alias("start"), F.try_to_date(F.coalesce(F.nullif(tag(F.col("x"), "endDate"), F.lit("")), instant)).alias("end")).where("end is not null")
    units = documents.select(key, every(r"(?is)<xbrli:unit\b.*?</xbrli:unit>").alias("x")).select(key, attribute(F.col("x"), "id").alias("u"), F.regexp_extract(tag(F.col("x"), "measure"), "([^:]*)$", 1).alias("unit"))
    x = F.col("x")
    text = F.regexp_replace(clean_text(x), "[ ,]", "")
    number = text.try_cast("decimal(28,4)")  # a dash is a figure not disclosed, no zero
    facts = documents.select(key, every(r"(?is)<ix:nonFraction\b.*?</ix:nonFraction>").alias("x")).select(
        key, F.regexp_extract(attribute(x, "name"), "([^:]*)$", 1).alias("name"), attribute(x, "contextRef").alias("context"), attribute(x, "unitRef").alias("u"),
        (number * F.pow(F.lit(10.0), F.coalesce(attribute(x, "scale").try_cast("int"), F.lit(0))) * F.when(attribute(x, "sign") == "-", -1).otherwise(1)).alias("value"),
    )
    chosen = facts.where(F.col("name").isin(names) & F.col("value").isNotNull()).join(contexts, [key, "context"]).join(units, [key, "u"], "left")
    chosen = chosen.where(F.col("unit").isNull() | ~F.col("unit").rlike("^[A-Z]{3}$") | (F.col("unit") == currency))
    heads = F.col("name").contains("Employees") & (F.col("value") > 0) & (F.col("value") != F.floor("value"))
    return chosen.select(key, "name", "start", "end", "unit", F.when(heads, F.round(F.col("value") * 1000)).otherwise(F.col("value")).alias("value"))


def part_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of JSON-lines part files: lines that cannot be read become (file, line) instead of ending the job."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.input_file_name().alias("file"), "value")
    parsed = lines.select("file", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select("r.*").drop("_bad"), parsed.where("r._bad is not null").select("file", F.col("r._bad").alias("line"))


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """A folder for each shard, so that a reader of one shard reads only that folder."""
    df.repartition(shard).write.partitionBy(shard).parquet(path)


def read_shard(spark: SparkSession, path: str, shard: str, value: str) -> DataFrame:
    """One shard's rows; the others' files are pruned. A missing shard is empty."""
    return spark.read.parquet(path).where(F.col(shard) == value)


def write_with_meta(df: DataFrame, path: str, **meta: str) -> None:
    """Rows below path/rows and one row of facts about them (their number and ``meta``) below path/meta."""
    df.write.parquet(f"{path}/rows")
    n = df.sparkSession.read.parquet(f"{path}/rows").agg(F.count("*").alias("n"))
    n.select("n", *[F.lit(v).alias(k) for k, v in meta.items()]).coalesce(1).write.json(f"{path}/meta")


def append_run(spark: SparkSession, path: str, run: str, **measures: int) -> None:
    """One row for a run and measure appended to a log; a run that is logged already is not logged again."""
    if exists(spark, path) and not spark.read.schema("run string, measure string, n long").json(path).where(F.col("run") == run).isEmpty():
        return
    spark.createDataFrame([(run, k, v) for k, v in measures.items()], "run string, measure string, n long").coalesce(1).write.mode("append").json(path)
