"""Pages to sections: one row for each heading of levels 1 to 4, and one for what stands before the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import html as H
from tidemark.functions.text import word_bag

HEADING = r"(?is)<h([1-4])\b([^>]*)>(.*?)</h[1-4]\s*>"
OWN_ANCHOR = r"(?is)\bid=\"([^\"]+)\""
ANCHOR_BEFORE = r"(?is)<[a-z]+\b[^>]*\b(?:id|name)=\"([^\"]+)\"[^>]*>\s*(?:</[a-z]+>)?\s*$"
#: Characters of a lead, of a shown heading and of a heading that stands without words, words of such a section, words of
#: a page and of a bag, and sections of a page that count.
LEAD_CHARS, HEADING_CHARS, SHORT_HEADING, FEW_WORDS, PAGE_WORDS, BAG_WORDS, MOST_SECTIONS = 25, 120, 3, 5, 5, 120, 60
#: Words that tell nothing in a bag.
STOP = tuple((
    "the a an of for in on at to is are am was were be been being do does did how what where which who whom why when this that these those it its and or "
    "but if as by from with without into onto over under than then so such not no nor can could should would will shall may might must have has had you "
    "your we our they their he she his her i me my us them there here all any each every other more most some very also just only own same too s t"
).split())
START, FIELD, BODY = "\x01", "\x02", "\x03"


def sections(pages: DataFrame, key: str, html: Column, title: Column | None = None) -> DataFrame:
    """(key, place, level, anchor, heading, body, bag, words) of each page's main part, in order.

    The text before the first heading is a section of level 0, under the page's title, if it has LEAD_CHARS characters.
    A heading's anchor is its own id, else that of an element just before it. Headings without
    a text are none, with what they head. ``bag`` holds a section's distinct words, ``words`` their number. A section needs a heading of
    SHORT_HEADING characters or FEW_WORDS words; the first MOST_SECTIONS of those are a page's.
    Pages whose sections have fewer than PAGE_WORDS words together have no rows.
    """
    content = H.without_element(H.without_element(H.main_content(F.regexp_replace(html, H.NOISE, " ")), "nav"), "footer")
    marked = F.regexp_replace(content, HEADING, f"{START}$1{FIELD}$2{FIELD}$3{BODY}")
    parts = pages.select(key, (title if title is not None else F.lit("")).alias("title"), F.split(marked, START).alias("ps"))
    body = lambda p, i: F.when(i == 0, p).otherwise(F.substring_index(p, BODY, -1))
    field = lambda p, n: F.get(F.split(F.substring_index(p, BODY, 1), FIELD), F.lit(n))
    anchor = lambda p, i: F.coalesce(F.nullif(F.regexp_extract(field(p, 1), OWN_ANCHOR, 1), F.lit("")), F.nullif(F.regexp_extract(body(F.get("ps", i - 1), i - 1), ANCHOR_BEFORE, 1), F.lit("")))
    each = F.transform("ps", lambda p, i: F.struct(
        F.when(i == 0, 0).otherwise(field(p, 0).try_cast("int")).alias("level"), F.when(i > 0, anchor(p, i)).alias("anchor"),
        F.when(i > 0, H.clean_text(field(p, 2))).otherwise(F.coalesce("title", F.lit(""))).alias("heading"), H.clean_text(body(p, i)).alias("body"),
    ))
    told = F.filter(each, lambda s: F.when(s.level == 0, F.length(s.body) >= LEAD_CHARS).otherwise(s.heading != ""))
    bagged = F.transform(told, lambda s: F.struct(s.level.alias("level"), s.anchor.alias("anchor"), F.substring(s.heading, 1, HEADING_CHARS).alias("heading"), s.body.alias("body"), word_bag(s.body, STOP, BAG_WORDS).alias("bag")))
    counted = F.transform(bagged, lambda s: s.withField("words", F.when(s.bag == "", 0).otherwise(F.size(F.split(s.bag, " ")))))
    # exploded as one value, so that no later projection computes the sections again
    kept = F.slice(F.filter(counted, lambda s: (F.length(s.heading) >= SHORT_HEADING) | (s.words >= FEW_WORDS)), 1, MOST_SECTIONS)
    rows = parts.select(key, F.explode(F.array(kept)).alias("all"))
    enough = rows.where(F.aggregate("all", F.lit(0), lambda n, s: n + s.words) >= PAGE_WORDS)
    return enough.select(key, F.posexplode("all").alias("place", "s")).select(key, "place", "s.level", "s.anchor", "s.heading", "s.body", "s.bag", "s.words")


def admitted(pages: DataFrame, key: str, path: str, prefix: str, exclude: list, include: list) -> DataFrame:
    """Pages below ``prefix`` or named in ``include``, but none of ``exclude``."""
    return pages.where(~F.col(key).isin(exclude) & (F.col(key).isin(include) | F.col(path).startswith(prefix)))
