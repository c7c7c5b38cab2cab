"""A search index: a table of postings by word, written once and read for a query's words alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.functions.text import norm
from tidemark.operators.search import (
    BODY_TOKEN, COVERED, HEAD_PHRASE, HEAD_TOKEN, KEY_PHRASE, KEY_TOKEN, NAME_PHRASE, NAME_TOKEN, TITLE_PHRASE, TITLE_TOKEN, UNNAMED, _sum, forms, query_tokens, typed_phrase,
)
from tidemark.tables import scratch

#: Folders that words are dealt to, and characters of texts whose words are told at once.
BUCKETS, CHUNK = 64, 1_000_000
#: Rows of a file; words are sorted within, so that a reader passes over row groups too.
FILE_ROWS = 5_000_000


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def text_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, place, first, second) of texts: their lines are sections, a section's words up to the first full stop its heading."""
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("place", "second"))
    return lines.select("id", "place", F.substring_index("second", ".", 1).alias("first"), "second")


def record_fields(records: DataFrame, key: str, name: str, keywords: str) -> DataFrame:
    """(id, place, first, second) of records: the name and the keywords."""
    return records.select(F.col(key).alias("id"), F.lit(0).alias("place"), F.col(name).alias("first"), F.col(keywords).alias("second"))


def _postings(batches: Iterator[pa.RecordBatch], schema: pa.Schema, chunk: int) -> Iterator[pa.RecordBatch]:
    """The words of some ``chunk`` characters of sections, each once, with the sections that hold them and its positions there."""

    def told(ids: list, places: list, found: dict[str, list[tuple]]) -> pa.RecordBatch:
        entries = [e for es in found.values() for e in es]
        lists = lambda k: pa.array([e[k] for e in entries], pa.list_(pa.int32()))
        kind = schema.field("entries").type.value_type
        columns = [pa.array([ids[e[0]] for e in entries], kind.field("id").type), pa.array([places[e[0]] for e in entries], pa.int32()), lists(1), lists(2)]
        ends = np.cumsum([0, *map(len, found.values())], dtype=np.int32)
        rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.ListArray.from_arrays(pa.array(ends), rows).cast(schema.field("entries").type)], schema=schema)

    for batch in batches:
        ids, places, firsts, seconds = (c.to_pylist() for c in batch.columns)
        found: dict[str, list[tuple]] = {}
        size = 0
        for n, texts in enumerate(zip(firsts, seconds, strict=True)):
            here: dict[str, tuple] = {}
            for field, text in enumerate(texts, 1):
                size += len(text)
                for at, word in enumerate(text.split(" ")):
                    if word:
                        if word not in here:
                            here[word] = (n, [], [])
                        here[word][field].append(at)
            for word, entry in here.items():
                found.setdefault(word, []).append(entry)
            if size >= chunk:
                yield told(ids, places, found)
                found, size = {}, 0
        if found:
            yield told(ids, places, found)


def build(fields: DataFrame, buckets: int = BUCKETS) -> str:
    """Writes the postings of (id, place, first, second) and returns their path in the shared folder.

    A posting is a word of a section or record: id, place, and its positions in the first field (heading or name)
    and in the second (section or keywords). A section's words are told in the task that holds it, so nothing is shuffled: each
    task writes its words' rows (word, entries) to their buckets' folders, and a frequent word is no single task's. Null fields have no words; ids may repeat.
    """
    clean = lambda c: norm(F.coalesce(c, F.lit("")))
    rows = fields.select("id", F.col("place").cast("int").alias("place"), clean(F.col("first")).alias("first"), clean(F.col("second")).alias("second"))
    entry = StructType([rows.schema["id"], *StructType.fromDDL("place int, first array<int>, second array<int>").fields])
    schema = StructType([StructField("word", StringType()), StructField("entries", ArrayType(entry))])
    arrow, chunk = to_arrow_schema(schema), CHUNK
    postings = rows.mapInArrow(lambda batches: _postings(batches, arrow, chunk), schema).withColumn("bucket", bucket_of(F.col("word"), buckets))
    path = scratch(fields.sparkSession, "postings")
    postings.sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return path


def read(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of ``words``: only their buckets' files are listed, and of these only the row groups that may hold them."""
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("w")).select(bucket_of(F.col("w"), buckets)).distinct()
    of = sorted(r[0] for r in asked.collect())  # of the query's words
    return spark.read.parquet(path).where(F.col("bucket").isin(of) & F.col("word").isin(words)).select("bucket", "word", F.explode("entries").alias("e")).select("bucket", "word", "e.*")


def _asked(query: str, stop: tuple[str, ...]) -> tuple[list[str], list[str], list[str]]:
    """The query's tokens, its typed phrase's words, and all words to look up."""
    tokens, phrase = query_tokens(query, stop), (typed_phrase(query) or "").split()
    return tokens, phrase, sorted({f for t in tokens for f in forms(t)} | set(phrase))


def _phrase_in(field: str, phrase: list[str]) -> Column:
    """Whether the words stand one after the other in a section's field; its postings are grouped."""
    if not phrase:
        return F.lit(False)
    def start(i: int, word: str) -> Column:
        """Where the phrase begins if its word number i stands at the word's positions."""
        return F.transform(F.max(F.when(F.col("word") == word, F.col(field))), lambda p: p - i)

    starts = [start(i, w) for i, w in enumerate(phrase)]
    common = starts[0]
    for s in starts[1:]:
        common = F.array_intersect(common, s)
    return F.coalesce(F.size(common) > 0, F.lit(False))


def _hit(field: str, token: str) -> Column:
    return F.bool_or(F.col("word").isin(forms(token)) & (F.size(field) > 0))


def scored(spark: SparkSession, path: str, query: str, stop: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """(id, score) of the texts that hold a word of the query, as ``search.scored`` gives them; the others' score is 0."""
    tokens, phrase, words = _asked(query, stop)
    found = read(spark, path, words, buckets)
    hits = lambda field, name: [_hit(field, t).alias(f"{name}{i}") for i, t in enumerate(tokens)]
    each = found.groupBy("id", "place").agg(_phrase_in("first", phrase).alias("phrase"), *hits("first", "h"), *hits("second", "b"))
    n = range(len(tokens))
    section = _sum([F.when(F.col("phrase"), HEAD_PHRASE).otherwise(0), *[F.when(F.col(f"h{i}"), HEAD_TOKEN).when(F.col(f"b{i}"), BODY_TOKEN).otherwise(0) for i in n]])
    title = F.when(F.col("place") == 0, _sum([F.when(F.col("phrase"), TITLE_PHRASE).otherwise(0), *[F.when(F.col(f"h{i}"), TITLE_TOKEN).otherwise(0) for i in n]])).otherwise(0)
    best = each.groupBy("id").agg(F.max(section).alias("section"), F.max(title).alias("title"), *[F.bool_or(f"b{i}").alias(f"t{i}") for i in n])
    covered = F.lit(True)
    for i in n:
        covered = covered & F.col(f"t{i}")
    return best.select("id", (F.col("title") + F.col("section") + F.when(covered, COVERED).otherwise(0)).cast("long").alias("score"))


def scored_records(spark: SparkSession, path: str, query: str, stop: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """(id, score) of the records that hold a word of the query, as ``search.scored_records`` gives them; the others' score is 0."""
    tokens, phrase, words = _asked(query, stop)
    found = read(spark, path, words, buckets)
    n = range(len(tokens))
    hits = lambda field, name: [_hit(field, t).alias(f"{name}{i}") for i, t in enumerate(tokens)]
    x = found.groupBy("id").agg(_phrase_in("first", phrase).alias("pn"), _phrase_in("second", phrase).alias("pk"), *hits("first", "n"), *hits("second", "k"))
    total = _sum([F.when(F.col("pn"), NAME_PHRASE).when(F.col("pk"), KEY_PHRASE).otherwise(0), *[F.when(F.col(f"n{i}"), NAME_TOKEN).when(F.col(f"k{i}"), KEY_TOKEN).otherwise(0) for i in n]])
    named = F.col("pn")
    for i in n:
        named = named | F.col(f"n{i}")
    return x.select("id", F.when(named | (total >= UNNAMED), total).otherwise(0).cast("long").alias("score"))


_built: dict[tuple, str] = {}


def once(spark: SparkSession, name: str, source: DataFrame, fields: DataFrame) -> str:
    """The path of a session's index ``name`` over the files of ``source``, built when it is first asked for."""
    key = (spark.sparkContext.applicationId, name, tuple(sorted(source.inputFiles())))
    if key not in _built:
        _built[key] = build(fields)
    return _built[key]
