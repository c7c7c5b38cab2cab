"""Stored feeds and documents on small fixtures of our own."""

from __future__ import annotations

import datetime as dt

from tidemark.sources import feeds, snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><link> http://x/1 </link><pubDate>Tue, 3 Feb 2026 10:00:00 GMT</pubDate></item><item><title>late</title><link>http://x/1</link></item><item><title>no link</title></item><item><title>n</title><link>http://x/2</link><pubDate>soon</pubDate></item></channel></rss>")
    found = {r.link: (r.title, r.published) for r in feeds.feed_items(spark, f"file://{tmp_path}/f.xml").collect()}
    assert found["http://x/2"] == ("n", None) and set(found) == {"http://x/1", "http://x/2"}
    assert found["http://x/1"][0] in ("A & B", "late")


def test_search_results_and_periods(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"results": [{"title": "t", "link": "/a", "public_timestamp": "2026-02-03T10:00"}, {"title": "u", "link": "http://o/b"}]}')
    assert [tuple(r) for r in feeds.search_results(spark, f"file://{tmp_path}/s.json", "http://h").orderBy("title").collect()] == [("t", "http://h/a", dt.date(2026, 2, 3)), ("u", "http://o/b", None)]
    for name in ("data_202601.csv", "data_202602.csv", "notes.csv"):
        (tmp_path / name).write_text(f"{name}\n")
    found = feeds.with_period(spark.read.csv([f"file://{tmp_path}/{n}" for n in ("data_202601.csv", "data_202602.csv", "notes.csv")]), r"data_(\d{4})(\d{2})\.csv")
    assert rows(found) == [("data_202601.csv", dt.date(2026, 1, 1)), ("data_202602.csv", dt.date(2026, 2, 1))]


def test_sitemap(spark):
    loc = lambda *urls: "".join(f"<loc> {u} </loc>" for u in urls)
    docs = spark.createDataFrame([("root", "<sitemapindex>" + loc("a", "root", "gone")), ("a", "<sitemapindex>" + loc("b", "a")), ("b", "<urlset>" + loc("p1", "p2", "p1"))], "url string, xml string")
    assert rows(feeds.sitemap_pages(docs, "root")) == [("p1", 2), ("p2", 2)]
    assert rows(feeds.sitemap_pages(docs, "root", 2)) == [] and rows(feeds.sitemap_pages(docs, "b")) == [("p1", 0), ("p2", 0)]


def test_tagged_facts(spark):
    html = """<xbrli:context id="y"><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
    <xbrli:context id="s"><xbrli:segment>x</xbrli:segment><xbrli:instant>2024-12-31</xbrli:instant></xbrli:context><xbrli:context id="i"><xbrli:instant>2023-12-31</xbrli:instant></xbrli:context>
    <xbrli:unit id="g"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><xbrli:unit id="e"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit><xbrli:unit id="p"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit>
    <ix:nonFraction name="c:Turnover" contextRef="y" unitRef="g" scale="3">1,234</ix:nonFraction><ix:nonFraction name="c:Turnover" contextRef="s" unitRef="g">9</ix:nonFraction><ix:nonFraction name="c:Turnover" contextRef="y" unitRef="e">8</ix:nonFraction>
    <ix:nonFraction name="c:Profit" contextRef="i" unitRef="g" sign="-">5</ix:nonFraction><ix:nonFraction name="c:Profit" contextRef="y" unitRef="g">-</ix:nonFraction><ix:nonFraction name="c:AverageEmployees" contextRef="y" unitRef="p">0.042</ix:nonFraction><ix:nonFraction name="c:Other" contextRef="y" unitRef="g">1</ix:nonFraction>"""
    found = feeds.tagged_facts(spark.createDataFrame([(1, html), (2, "nothing")], "id int, html string"), "id", "html", ["Turnover", "Profit", "AverageEmployees"])
    year = (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    assert {(r.start, r.end) for r in found.where("name <> 'Profit'").collect()} == {year}
    assert {(r.name, r.value) for r in found.collect()} == {("AverageEmployees", 42.0), ("Profit", -5.0), ("Turnover", 1_234_000.0)}


def test_part_files_and_run_log(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"a": 1}\n{broken\n')
    (tmp_path / "2.json").write_text('{"a": 2}\n')
    good, bad = feeds.part_files(spark, f"file://{tmp_path}/[12].json", "a long")
    assert rows(good) == [(1,), (2,)] and [r.line for r in bad.collect()] == ["{broken"]
    log = f"file://{tmp_path}/log"
    for run in ("r1", "r2", "r1"):
        feeds.append_run(spark, log, run, read=3, kept=2)
    assert rows(spark.read.schema("run string, measure string, n long").json(log)) == [(r, m, n) for r in ("r1", "r2") for m, n in (("kept", 2), ("read", 3))]


def test_interrupted_guarded_write_is_put_back(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    snapshots.guarded_write(spark.range(10), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash between the two renames leaves it
    assert snapshots.guarded_write(spark.range(8), path) == 8
    assert spark.read.parquet(path).count() == 8 and not (tmp_path / "t.old").exists()
