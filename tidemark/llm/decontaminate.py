"""Operator 10: benchmark decontamination by prefix-filtered containment (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.text import LOWER, UPPER, ascii_lower
from tidemark.tables import cut, small, table

WINDOW = 13
#: Contaminated: at least one word in SHARE is hit.
SHARE = 20
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of words, windows or places, and of hashes of words, that may be broadcast.
MAX_BROADCAST, MAX_HASHES = 100_000, 2_000_000


def exact_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, w): the items' windows as word arrays; a shorter item is one window."""
    w = items.select("item_id", exact_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("w")).distinct()


def window_prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, off, w): each distinct window's rarest word and its place; windows with a word that no document has go.

    All of a window's words are necessary, so the first in order of rarity is a sufficient prefix.
    """
    distinct = windows.select("w").distinct()
    each = distinct.select("w", F.posexplode("w").alias("off", "word"))
    rated = each.join(small(counts, MAX_BROADCAST), "word", "left")
    best = rated.groupBy("w").agg(F.min(F.struct("n", "word", "off")).alias("b"), F.count("n").alias("known"), F.count("*").alias("all"))
    return best.where("known = `all`").select("b.word", "b.off", "w")


def _wanted(words: DataFrame, table: DataFrame) -> DataFrame:
    """``words`` joined to ``table`` (word, ...): broadcast if small, else by shuffle of words whose hash is in the table."""
    chosen = small(table, MAX_BROADCAST)
    if chosen is table:
        hashes = cut(table.select(F.xxhash64("word").alias("h")).distinct(), "hashes")
        words = words.join(small(hashes, MAX_HASHES), F.xxhash64("word") == F.col("h"), "left_semi")
    return words.join(chosen, "word")


def find_windows(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits, windows). hits: a row per row of ``docs``: doc_id, r (hash of the text), n_words,
    n_hit and found (distinct windows that occur).

    Windows are ordered by the corpus counts of their words; only their rarest word is joined
    to the documents' words, whose places must leave room for the whole window on both sides.
    The windows at those places are then compared word by word. The tables made from the
    items are broadcast up to MAX_BROADCAST rows and joined by shuffle beyond; then only the
    documents' words whose hash is one of the wanted words' are shuffled (all words where even
    those are over MAX_HASHES). Texts are shuffled only when the places found are more than
    may be broadcast.
    """
    windows = cut(item_windows(items, size), "windows")
    wanted = cut(windows.select(F.explode("w").alias("word")).distinct(), "wanted")
    counts = _wanted(docs.select(F.explode(exact_words(F.col("text"))).alias("word")), wanted).groupBy("word").agg(F.count("*").alias("n"))
    prefixes = cut(window_prefixes(windows, cut(counts, "counts")), "prefixes")
    words = docs.select("doc_id", F.xxhash64("text").alias("r"), exact_words(F.col("text")).alias("x"))
    places = _wanted(words.select("doc_id", "r", F.size("x").alias("n"), F.posexplode("x").alias("pos", "word")), prefixes)
    fits = places.select("doc_id", "r", "n", (F.col("pos") - F.col("off")).alias("start"), "w").where("start >= 0 and start + size(w) <= n")
    asked = cut(fits.groupBy(F.col("doc_id").alias("d"), F.col("r").alias("r1")).agg(F.collect_set(F.struct("start", F.size("w").alias("len"), F.array_join("w", " ").alias("w"))).alias("asked")), "places")
    n_asked = asked.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()[0]
    asked = F.broadcast(asked) if n_asked <= MAX_BROADCAST else asked
    joined = docs.select("doc_id", F.xxhash64("text").alias("r"), "text").join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("r") == F.col("r1")), "left")
    both = joined.select("doc_id", "r", F.struct(exact_words(F.col("text")).alias("x"), "asked").alias("v"))
    there = lambda v: F.filter(v.asked, lambda c: F.array_join(F.transform(F.sequence(F.lit(0), c.len - 1), lambda j: F.get(v.x, c.start + j)), " ") == c.w)
    seen = both.select("doc_id", "r", F.get(F.transform(F.array("v"), lambda v: F.struct(F.size(v.x).cast("long").alias("n_words"), F.coalesce(there(v), F.array()).alias("hit"))), F.lit(0)).alias("h"))
    covered = F.array_distinct(F.flatten(F.transform("h.hit", lambda c: F.sequence(c.start, c.start + c.len - 1))))
    hits = seen.select("doc_id", "r", "h.n_words", F.size(covered).cast("long").alias("n_hit"), F.array_distinct(F.transform("h.hit", lambda c: c.w)).alias("found"))
    return cut(hits, "hits"), windows.select("item_id", F.array_join("w", " ").alias("w"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, r, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit inside any occurrence of an item's window of ``size`` words (of all
    words of a shorter item). Items without words are in no document. contaminated: at least
    one word in ``share`` is hit. Null text has no words. Repeated rows are judged alike, each
    keeping its row; null item ids count as no item. Extra columns are ignored. An empty
    table of documents gives an empty result, an empty benchmark no hits.
    """
    hits, windows = find_windows(docs, items, size)
    found = hits.where("n_hit > 0").select("doc_id", "r", F.explode("found").alias("w")).join(small(windows, MAX_BROADCAST), "w")
    of = found.select("doc_id", "r", F.col("item_id").cast("string").alias("i")).distinct().groupBy(F.col("doc_id").alias("d"), F.col("r").alias("r1")).agg(F.array_sort(F.collect_list("i")).alias("items"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return hits.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("r") == F.col("r1")), "left").select(
        "doc_id", "r", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contamination leaves, with all their columns; null and empty texts stay, repeated rows share their fate. An empty table stays empty."""
    gone = small(cut(contamination(docs, items).where("contaminated").select(F.col("doc_id").alias("d"), "r").distinct(), "contaminated"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["d"]) & (F.xxhash64(docs["text"]) == gone["r"]), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("r")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g, least(len(w), {WINDOW}) AS k FROM bi),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
h AS (SELECT p.r, p.i, p.k, win.item_id FROM p JOIN win ON win.k = p.k AND array_to_string(p.w[p.i : p.i + p.k - 1], ' ') = win.g),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items, sha256(coalesce(it.items, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND {SHARE} * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN it ON d.r = it.r
"""
