"""Text and markup functions on cases that the driver's tables do not hold."""

from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import html as H, text as T
from tidemark.operators import filters, lookup, search, sections


def values(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_entities(spark):
    assert values(spark, H.decode_entities, "a &amp;lt; &#65;&#x1F600; &#0; &#99999999; &# &pound;1", None, "x&") == ["a &lt; A😀 &#0; &#99999999; &# £1", None, "x&"]


def removed(text: str, tag: str, word: str = "") -> str:
    """One element after the other, by counting."""
    out, depth = "", 0
    for piece in re.split(rf"(?i)(?=<{tag}\b[^>]*>|</{tag}\s*>)", text):
        opening, closing = re.match(rf"(?i)<{tag}\b[^>]*(?<!/)>", piece), re.match(rf"(?i)</{tag}\s*>", piece)
        if depth == 0 and not (opening and (not word or re.search(rf"""class\s*=\s*["'][^"']*\b{word}""", opening[0]))):
            out += piece
        elif opening:
            out, depth = out + " " * (depth == 0), depth + 1
        elif closing:
            depth -= 1
            out += piece[closing.end() :] if depth == 0 else ""
    return out


def test_nested_elements_go(spark):
    deep = [f"a{'<div>b' * n}c{'</div>d' * n}e" for n in range(1, 51)]
    assert values(spark, lambda x: H.without_element(x, "div"), *deep, "a<div>open", "a</div>b<divx>f", "<div/>a", None, "") == ["a de"] * 50 + ["a ", "a</div>b<divx>f", "<div/>a", None, ""]
    rng = random.Random(5)
    odd = ["".join(rng.choice(["<div>", "</div>", '<div class="x menu-top">', "<DIV class='menu'>", "t", "<div/>", "</div >", "<p>"]) for _ in range(rng.randrange(14))) for _ in range(200)]
    assert values(spark, lambda x: H.without_element(x, "div"), *odd) == [removed(t, "div") for t in odd]
    assert values(spark, lambda x: H.without_element(x, "div", "menu"), *odd) == [removed(t, "div", "menu") for t in odd]


def test_clean_text(spark):
    assert values(spark, H.clean_text, "<p>a <b>b</b></p><p> c&nbsp;d</p><script>x<y</script><!-- z -->") == ["a b\nc d"]


def test_main_content_cascade(spark):
    texts = ["<body>x<main>m</main><article>a</article>", "<article>a</article>", '<div id="content">c</div>', '<div class="wide content">k</div>', "<body>b", "none", "<main> </main><body>b</body>"]
    assert values(spark, H.main_content, *texts) == ["m", "a", "c", "k", "b", "none", "b"]


def test_jsonld(spark):
    block = '<script type="application/ld+json">{}</script>'
    texts = [
        block.format('{"@type": "Product", "name": "n", "brand": {"name": "b"}}'), block.format('{"@graph": [{"@type": "Page"}, {"@type": ["Product", "Thing"], "name": "g", "sku": "s"}]}'),
        block.format("broken") + block.format('[{"@type": "Product", "name": "l", "brand": "x"}]'), block.format('{"@type": "Page"}'), "",
    ]
    found = values(spark, H.jsonld_product, *texts)
    assert [tuple(f) if f else None for f in found] == [("n", None, "b"), ("g", "s", None), ("l", None, "x"), None, None]


def test_sections_of_odd_pages(spark):
    html = '<body>A lead of more than twenty-five letters.<a id="before"></a><h2>First &amp; <b>best</b></h2>text one<h3 id="own">Second</h3><nav><ul><nav>in</nav>out</ul></nav>text two<h4></h4>under nothing<h2>Hi</h2>a b c<h2>No</h2>one two three four five six'
    many = "<body>" + "".join(f"<h2></h2>x<h2>Part {n}</h2>some words" for n in range(80))
    pages = spark.createDataFrame([(1, html), (2, "<h1>too few words</h1>"), (3, "short lead <h1>Heading here</h1> and a body of several whole words"), (4, None), (5, many)], "id int, html string")
    rows = sections.sections(pages, "id", F.col("html"), F.lit("Title")).orderBy("id", "place").collect()
    assert [(r.id, r.level, r.anchor, r.heading, r.body) for r in rows if r.id < 5] == [
        (1, 0, None, "Title", "A lead of more than twenty-five letters."), (1, 2, "before", "First & best", "text one"), (1, 3, "own", "Second", "text two"), (1, 2, None, "No", "one two three four five six"),
    ]
    assert [r.bag for r in rows if r.id == 1] == ["five lead letters twenty", "one text", "text two", "five four one six three two"] and [r.words for r in rows if r.id == 1] == [4, 2, 2, 6]
    assert [r.heading for r in rows if r.id == 5] == [f"Part {n}" for n in range(60)]


def test_names_and_amounts(spark):
    assert values(spark, T.undecorated, "Acme Ltd (UK), *", "Acme t/a Best", "Acme (formerly X) (trading)", "Acme") == ["Acme Ltd", "Acme", "Acme", "Acme"]
    assert values(spark, T.money_units, "£1.2m", "3,400", "$ 5 thousand", "2bn", "n/a", None, "12 apples") == [1_200_000, 3_400, 5_000, 2_000_000_000, None, None, None]
    assert values(spark, lambda x: T.gbp(x.cast("double")), "950", "-1500", "1000000", "1250000000") == ["£950", "-£2k", "£1m", "£1.3bn"]
    assert values(spark, T.last_date, "1/2/2020 to 31/12/2021", "99/99/2021", "soon") == [dt.date(2021, 12, 31), None, None]
    assert values(spark, T.titled, "the nhs OF wales and the UK") == ["The NHS of Wales and the UK"]
    assert values(spark, lambda x: T.js_round(x.cast("double")), "2.5", "-2.5") == [3, -2]
    assert values(spark, lambda x: T.contrast(x, F.lit("ffffff")), "000000", "ffffff", "zz") == [21.0, 1.0, None]
    assert values(spark, T.number_forms, "00042", "00000042") == [["00042", "42", "00000042"], ["00000042", "42"]]


def test_facets_without_choices(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "p string, q string")
    assert {tuple(r) for r in filters.facets(rows, {"p": "a"}, ["p", "q"]).collect()} == {("p", "a", 2), ("p", "b", 1), ("q", "x", 1), ("q", "y", 1)}


def test_phrase_keeps_repeated_words():
    assert search.typed_phrase("New  new York!") == "new new york" and search.typed_phrase("ab") is None
    assert search.query_tokens("the the", ("the",)) == ["the"]


def test_windows_without_whole_words(spark):
    texts = spark.createDataFrame([(1, "x" * 70 + " and more words here"), (2, "some words and " + "y" * 40), (3, None)], "id int, text string")
    wanted = spark.createDataFrame([("x" * 60,), ("me words and yyyyyyy",), ("absent words here now",)], "window string")
    found = lookup.texts_with_windows(texts, "id", "text", wanted, 60).collect()
    assert {(r.id, r.window[:4]) for r in found} == {(1, "xxxx"), (2, "me w")}
