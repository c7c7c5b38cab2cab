"""The search index: its scores are those of a scan of all texts, and a query reads its words' files alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import postings, search

DOCS = [
    (1, "Gas licences of the north. More on gas.\nBlue steel. The steel licence was sold"), (2, "The blue steel licence\nNothing else"), (3, None), (4, ""), (5, "steel blue. blue steel blue steel"),
    (6, "A text. without it\nSteels are blue. licences, licence; LICENCE"), (7, "blue steel"), (7, "other steel\nblue"),
]
QUERIES = [("the blue steel licence", ("the",)), ("steel", ()), ("of", ("of",)), ("blue  STEEL", ()), ("no such word", ())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.mark.parametrize("query, stop", QUERIES)
def test_scores_equal_those_of_a_scan(spark, docs, query, stop):
    path = postings.build(postings.text_sections(docs, "doc_id", "text"), buckets=5)
    want = {(r.doc_id, r.score) for r in search.scored(docs, "doc_id", "text", query, stop).collect() if r.score}
    assert {(r.id, r.score) for r in postings.scored(spark, path, query, stop, buckets=5).collect() if r.score} == want
    records = spark.createDataFrame([(1, "Blue steel", "the licence sold"), (2, "x", "blue steel licence the blue steel licence"), (3, None, "steel"), (4, "steels", None)], "rid long, title string, words string")
    path = postings.build(postings.record_fields(records, "rid", "title", "words"), buckets=3)
    want = {(r.rid, r.score) for r in search.scored_records(records, "rid", "title", "words", query, stop).collect() if r.score}
    assert {(r.id, r.score) for r in postings.scored_records(spark, path, query, stop, buckets=3).collect() if r.score} == want


def test_a_query_reads_its_words_files_alone(spark, docs):
    path = postings.build(postings.text_sections(docs, "doc_id", "text"), buckets=16)
    every = spark.read.parquet(path)
    found = postings.read(spark, path, ["steel"], buckets=16)
    own = {r.bucket for r in every.where("word = 'steel'").select("bucket").distinct().collect()}
    read = {r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(own) == 1 and read and all(f"/bucket={next(iter(own))}/" in f for f in read) and every.select("bucket").distinct().count() > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "In(word, [steel])" in plan or "EqualTo(word,steel)" in plan


def test_an_index_is_built_once_for_its_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = postings.once(spark, "probe", docs, postings.text_sections(docs, "doc_id", "text"))
    assert postings.once(spark, "probe", docs, postings.text_sections(docs, "doc_id", "text")) == first
    assert postings.once(spark, "other", docs.limit(1), postings.text_sections(docs.limit(1), "doc_id", "text")) != first


def test_building_shuffles_nothing_and_cuts_long_runs(spark, docs, monkeypatch):
    """A section's words are told in its task, whole, however few characters are told at once; one row a word and run."""
    monkeypatch.setattr(postings, "CHUNK", 40)
    path = postings.build(postings.text_sections(docs.coalesce(1), "doc_id", "text"), buckets=3)
    every = spark.read.parquet(path)
    rows = every.where("word = 'steel'").collect()
    assert 1 < len(rows) < sum(len(r.entries) for r in rows)
    # one task wrote one file for each bucket
    assert len(every.inputFiles()) == every.select("bucket").distinct().count()
    want = {(r.doc_id, r.score) for r in search.scored(docs, "doc_id", "text", "the blue steel licence", ("the",)).collect() if r.score}
    assert {(r.id, r.score) for r in postings.scored(spark, path, "the blue steel licence", ("the",), buckets=3).collect() if r.score} == want
