"""Queries by dictionaries of terms: thousands of substrings over texts and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import text as T
from tidemark.operators import dictionary
from tidemark.plans.names import NORM
from tidemark.tables import table

#: Lengths of the benchmark's windows that are terms, and groups of terms.
LENGTHS, GROUPS = (6, 7), 9


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    """Terms out of the benchmark's windows and the parts' names with brands, in the order of their digests, so that any group may come first."""
    b = table(spark, sf, "benchmark").select(F.lower("text").alias("t"))
    cut_ = lambda n: b.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(n)))).alias("term"))
    terms = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.lower("p_brand")).alias("term"))
    for n in LENGTHS:
        terms = terms.union(cut_(n))
    place = F.md5("term")
    return terms.distinct().select("term", F.concat(F.lit("group "), F.conv(F.substring(place, 1, 4), 16, 10).cast("int") % GROUPS).alias("label"), place.alias("place"))


def dictionary_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds one of some ten thousand terms: how many, the first by order, and its label."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return dictionary.first_rule(docs, "doc_id", "t", _rules(spark, sf))


DICTIONARY_LABELS = f"""
WITH b AS (SELECT lower(text) AS t FROM benchmark), w AS (SELECT unnest(list_transform(range(1, greatest(length(t) - n + 1, 1) + 1), lambda i: substring(t, i, n))) AS term FROM b, (VALUES {', '.join(f'({n})' for n in LENGTHS)}) AS s(n)),
r AS (SELECT DISTINCT term, md5(term) AS place FROM (SELECT term FROM w UNION ALL SELECT p_name || ' ' || lower(p_brand) FROM part) WHERE term <> ''),
m AS (SELECT doc_id, term, place FROM (SELECT doc_id, lower(text) AS t FROM documents) d JOIN r ON contains(d.t, r.term))
SELECT doc_id, count(*) AS n_terms, arg_min(term, place) AS term, 'group ' || (('0x' || min(place)[1:4])::INT % {GROUPS}) AS label FROM m GROUP BY doc_id
"""

def _ours() -> Column:
    return T.norm(F.when(F.col("p_partkey") % 5 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).when(F.col("p_partkey") % 5 == 1, F.concat_ws(" ", "p_name", "p_type")).when(F.col("p_partkey") % 5 == 2, F.concat_ws(" ", "p_type", "p_name", F.lit("x"))).when(F.col("p_partkey") % 5 == 3, F.regexp_extract("p_name", "^[^ ]*", 0)).otherwise(F.col("p_name")))


def same_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Stored names against the first part of every name and type: equal, contained, contained when joined, or by two words."""
    p = table(spark, sf, "part")
    ours = p.where("p_size = 1").select("p_partkey", _ours().alias("name"))
    theirs = p.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("record")).select("record", T.norm(F.when(F.col("record") % 3 == 0, F.concat_ws(" ", "p_type", "p_name")).otherwise(F.col("p_name"))).alias("name"))
    return dictionary.same_names(ours, theirs, "p_partkey", "record", "name")


SAME_COMPANIES = f"""
WITH o AS (SELECT p_partkey, {NORM.format(x="CASE p_partkey % 5 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_type || ' ' || p_name || ' x' WHEN 3 THEN split_part(p_name, ' ', 1) ELSE p_name END")} AS a FROM part WHERE p_size = 1),
t AS (SELECT record, {NORM.format(x="CASE WHEN record % 3 = 0 THEN p_type || ' ' || p_name ELSE p_name END")} AS b FROM (SELECT p_name, p_type, min(p_partkey) AS record FROM part GROUP BY 1, 2)),
x AS (SELECT p_partkey, record, CASE WHEN a = b THEN 'equal' WHEN contains(a, b) OR contains(b, a) THEN 'contains' WHEN contains(replace(a, ' ', ''), replace(b, ' ', '')) OR contains(replace(b, ' ', ''), replace(a, ' ', '')) THEN 'joined'
  WHEN len(list_intersect(string_split(a, ' '), string_split(b, ' '))) >= 2 THEN 'words' END AS how FROM o, t WHERE a <> '' AND b <> '')
SELECT * FROM x WHERE how IS NOT NULL
"""


def labels_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Parts named by the first of the brands' own names, in order of key, that contains the part's name and type or stands in them."""
    p = table(spark, sf, "part")
    index = p.groupBy(F.lower(F.concat_ws(" ", "p_name", F.regexp_extract("p_type", "^[^ ]*", 0))).alias("term")).agg(F.min("p_partkey").alias("place"), F.min_by("p_brand", "p_partkey").alias("label")).where("place % 7 <> 0")
    names = p.select("p_partkey", F.lower(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.lit("new"), "p_name", "p_type")).otherwise(F.substring_index("p_name", " ", -1))).alias("name"))
    return dictionary.labelled_by_name(names, "p_partkey", "name", index)


LABELS_BY_NAME = """
WITH i AS (SELECT lower(p_name || ' ' || split_part(p_type, ' ', 1)) AS term, min(p_partkey) AS place, arg_min(p_brand, p_partkey) AS label FROM part GROUP BY 1 HAVING min(p_partkey) % 7 <> 0),
n AS (SELECT p_partkey, lower(CASE WHEN p_partkey % 2 = 0 THEN 'new ' || p_name || ' ' || p_type ELSE string_split(p_name, ' ')[-1] END) AS name FROM part),
d AS (SELECT name, arg_min(label, place) AS label FROM (SELECT DISTINCT name FROM n) JOIN i ON contains(name, term) OR contains(term, name) GROUP BY name)
SELECT p_partkey, label FROM n JOIN d USING (name)
"""


def page_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a language that hold the first word of one of its documents' texts, for the first documents of each source."""
    pages = table(spark, sf, "pages").select(F.regexp_extract("html", r'<html lang="([a-z]*)"', 1).alias("lang"), "page_id", "html")
    docs = table(spark, sf, "documents").where("lang is not null").groupBy("lang", "source").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    return dictionary.mentions(docs, pages, "lang", "doc_id", "text", "page_id", "html")


PAGE_MENTIONS = r"""
WITH p AS (SELECT regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, page_id, lower(html) AS t FROM pages),
d AS (SELECT lang, min(doc_id) AS doc_id, lower(regexp_extract(arg_min(text, doc_id), '^[^\s(]*')) AS term FROM documents WHERE lang IS NOT NULL GROUP BY lang, source)
SELECT DISTINCT doc_id, page_id FROM d JOIN p ON d.lang = p.lang AND term <> '' AND contains(t, term)
"""

QUERIES = {"dictionary_labels": (dictionary_labels, DICTIONARY_LABELS), "same_companies": (same_companies, SAME_COMPANIES), "labels_by_name": (labels_by_name, LABELS_BY_NAME), "page_mentions": (page_mentions, PAGE_MENTIONS)}
