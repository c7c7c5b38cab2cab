"""Operator 2: line de-duplication across documents (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.text import LOWER, UPPER, ascii_lower
from tidemark.tables import cut, small, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Rows of frequent lines (two hashes, a count and an id) that may be broadcast.
FREQUENT_ROWS = 200_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with repeated lines removed from the text, plus n_lines and n_dropped (long).

    A line's key is the line stripped of space and U+0009-000D, A-Z lower-cased. A key of at
    least ``min_chars`` code points in at least ``min_docs`` distinct documents keeps its
    lines only in the document with the largest id. Keys travel as 128-bit hashes; a document
    counts once per key however often it repeats the line. Kept lines are put together again
    by position.

    Null or empty text is one empty line and comes back as ''. Rows that repeat an id are one
    document for the counts, each losing its own lines. Null ids are one document that is
    never the largest. Other columns pass through, whatever their names; an empty table gives
    an empty result.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(ident.alias("d"), F.xxhash64(text).alias("r"), F.posexplode(_lines(text)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")))
    keyed = (
        rows.select("d", "r", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("d", "r", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))
    )
    frequent = (
        keyed.select("h1", "h2", "d").distinct().groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("d").alias("keeper")).where(F.col("n") >= min_docs)
    )
    # written first: its rows can be counted, and up to FREQUENT_ROWS the lines go to it by broadcast; beyond, Spark may split a very common line's partition
    dropped = (
        keyed.join(small(cut(frequent, "frequent"), FREQUENT_ROWS), ["h1", "h2"]).where(~F.col("d").eqNullSafe(F.col("keeper")))
        .groupBy("d", "r").agg(F.array_distinct(F.collect_list("pos")).alias("gone"))
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), ident.alias("d0"), F.xxhash64(text).alias("r0"))
    joined = whole.join(dropped, F.col("d0").eqNullSafe(F.col("d")) & (F.col("r0") == F.col("r")), "left")
    lines = _lines(F.col("row").getField(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return joined.select("row", lines.alias("lines"), "gone").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")],
        F.when(F.col("gone").isNull(), F.coalesce(F.col("row").getField(text_col), F.lit("")))
        .otherwise(F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n")).alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.r, k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
