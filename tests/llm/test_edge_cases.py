"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables for every operator."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat_format, decontaminate, hidden_markov, jaccard_join, license_scan, line_dedup, lm_score, mixing, quality_rules, spread, token_files, tokenizing, url_filter
from tidemark.tables import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r long, key string, size long, d string, n_lines string, row string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SAME = "the same sentence of at least ten words that many documents repeat again"
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, SAME, "en", "a"), (4, SAME, None, "a"), (4, SAME, None, "a"), (5, LONG, "en", None),
    (6, LONG + " tail", "en", "b"), (None, SAME, "en", "b"), (7, " \t\n\x0b ", "fr", "b"), (8, "one", "en", "é"), (9, SAME + "\n" + SAME + "\n" + SAME, "en", "b"),
]
ITEMS = [(1, SAME), (2, None), (3, ""), (4, "one"), (None, "one"), (5, SAME)]


@pytest.fixture(scope="module")
def docs(spark):
    return cut(spark.createDataFrame([(*r, 1, 2, "k", 3, "d", "n", "w") for r in ROWS], SCHEMA), "edge")


@pytest.fixture(scope="module")
def items(spark):
    return cut(spark.createDataFrame(ITEMS, "item_id long, text string"), "items")


def test_line_dedup(docs):
    rows = line_dedup.drop_repeated_lines(docs).collect()
    assert len(rows) == len(ROWS) and {r.text for r in rows if r.doc_id in (1, 2)} == {""}
    kept = [r for r in rows if r.text and SAME in r.text]
    assert [r.doc_id for r in kept] == [9] and kept[0].n_dropped == 0


def test_licenses(docs, spark):
    known = spark.createDataFrame(license_scan.KNOWN, "license_id string, text string")
    assert license_scan.scan_licenses(docs, known).count() == len(ROWS)
    own = spark.createDataFrame([(1, "Copyright 2020 X\n" + license_scan.ZLIB.replace("Permission", "PERMISSION")), (2, "Hello\nReleased under the MIT Licence!")], "doc_id long, text string")
    assert {r.doc_id: (r.license_id, r.notices) for r in license_scan.scan_licenses(own, known).collect()} == {1: ("Zlib", ""), 2: (None, "MIT")}


def test_licenses_in_typeset_punctuation(spark):
    known = spark.createDataFrame(license_scan.KNOWN, "license_id string, text string")
    typeset = lambda t: t.replace('"', "\u201c").replace("'", "\u2019").replace(" - ", " \u2014 ").replace(" of ", "\u00a0of ")
    texts = [(n, typeset(t)) for n, (_, t) in enumerate(license_scan.KNOWN)]
    found = {r.doc_id: r.license_id for r in license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), known).collect()}
    assert [found[n] for n, _ in texts] == [i for i, _ in license_scan.KNOWN]
    assert license_scan.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), known.limit(0)).where("license_id is not null").count() == 0


def _wrapped(text: str, width: int, mark: str) -> str:
    """Paragraphs wrapped anew behind a comment mark; those that name an owner keep their lines."""
    paragraphs = [p if re.search(r"copyright (\(c\)|©|\[|[0-9])", p, re.I) else textwrap.fill(p, width) for p in re.split(r"\n[ \t]*\n", text)]
    return "\n".join(mark + line for p in paragraphs for line in [*p.split("\n"), ""])


def test_wrapped_licenses(spark):
    """Entire texts are found however they are wrapped, commented and headed by owners."""
    known = spark.createDataFrame(license_scan.KNOWN, "license_id string, text string")
    owners = ["", "Copyright 2020 X\n", "Copyright (c) 2019-2021, X. All rights reserved.\n(C) 2022 Y\n\n", "Copyright Jane Doe\nAll rights reserved.\n"]
    texts = [(i, t) for i, t in license_scan.KNOWN if "\n" in t]
    forms = [(i, _wrapped(o + "\n" + t, w, m)) for i, t in texts for w, m, o in zip([38, 50, 62, 71, 79], ["", "# ", " * ", "// ", ""], [*owners, owners[1]], strict=True)]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(forms)], "doc_id long, text string")
    found = {r.doc_id: r.license_id for r in license_scan.scan_licenses(docs, known).collect()}
    assert {i for i, _ in texts} >= {"MIT", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"}
    assert [(i, found[n]) for n, (i, _) in enumerate(forms) if found[n] != i] == []


def test_entire_licenses_in_ordinary_forms_equal_plain_python_and_sql(spark):
    """Titles, owner lists over lines, portions and named holders: Spark, SQL and plain Python state one rule, and find the text."""
    mit, bsd = license_scan.MIT, next(t for i, t in license_scan.KNOWN if i == "BSD-3-Clause")
    known = spark.createDataFrame(license_scan.KNOWN, "license_id string, text string")
    named = re.sub(r"(?i)neither the name of the\s+copyright holder", "Neither the name of Acme & Sons, Inc.", bsd)
    assert named != bsd
    forms = [
        ("MIT", "The MIT License\n\n" + mit), ("MIT", "(The MIT License)\n\nCopyright (c) 2011 A\n\n" + mit), ("MIT", "Copyright (c) 2019 Ann Lee,\nBob Roe and\nCy Poe\n\n" + mit), ("MIT", "Portions copyright (c) 2020 X\n" + mit),
        ("MIT", "# The MIT License (MIT)\r\n#\r\n# Copyright 2020 Z\r\n# All rights reserved.\r\n# All rights reserved.\r\n" + mit), ("BSD-3-Clause", named), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2017, X\nAll rights reserved.\n\n" + named),
        ("BSD-3-Clause", bsd.replace("copyright holder ", "copyright owner ")), ("BSL-1.0", next(t for i, t in license_scan.KNOWN if i == "BSL-1.0").partition("\n\n")[2]), (None, mit + "\nand more"), (None, "The MIT License\n"), (None, ""), (None, None),
    ]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(forms)], "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs, known).collect()}
    assert [found[n].license_id for n in range(len(forms))] == [i for i, _ in forms]
    assert [found[n].digest for n in range(len(forms))] == [hashlib.sha256(license_scan.canonical_plain(t or "").encode()).hexdigest() for _, t in forms]
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    rows = con.execute(license_scan.ORACLE).fetchall()
    assert {r[0]: r[1:3] for r in rows} == {i: (r.digest, r.license_id) for i, r in found.items()}


def test_scores(docs):
    rows = lm_score.score_texts(docs, rounds=1).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)


@pytest.mark.parametrize("rows", [[(i, 120) for i in range(6)], [(1, 1)] * 20_000], ids=["books", "one id"])
def test_scores_are_trained(spark, rows):
    """Texts of long runs are learnt beyond their word counts, whatever the documents' lengths and ids are."""
    text = F.expr("repeat(concat(repeat('a ', 50), repeat('b ', 50)), cast(n as int))").alias("text")
    docs = spark.createDataFrame(rows, "doc_id long, n long").select("doc_id", text).repartition(2)
    assert all(r.score > 0.22 * r.base_score for r in lm_score.score_texts(docs).collect())



def test_quality(docs):
    rows = quality_rules.judge_quality(docs).collect()
    assert len(rows) == len(ROWS) and {r.doc_id for r in rows if not r.kept} == {1, 2, 7, 8, 9}
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_jaccard_below_a_containing_text(spark):
    """x and y link; z holds both, is too large to link and has the smallest id of the buckets they share."""
    rows = []
    for i in range(0, 120, 3):
        words = [f"v{i}x{j}" for j in range(34)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:14])), (i + 2, " ".join(words[:13]))]
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - (i % 3 == 2) for i, _ in rows}


def test_jaccard(docs):
    rows = jaccard_join.link_components(docs).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} >= {(1, 0, 1), (2, 0, 2), (7, 0, 7), (3, 9, 3), (4, 9, 3), (5, 29996, 5), (6, 29997, 5), (8, 1, 8)}
    assert sorted(r.doc_id for r in jaccard_join.keep_one_of_each(docs).where("doc_id is not null").collect()) == [1, 2, 3, 5, 7, 8, 9]


def test_contamination(docs, items):
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.n_hit, r.n_items) for r in rows} >= {(1, 0, 0), (3, 13, 2), (8, 1, 1), (9, 39, 2), (5, 0, 0)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {1, 2, 5, 6, 7}


def test_contamination_lowers_only_a_to_z(spark):
    """Capital sigmas, dotted I and Kelvin signs are words as they stand, beside whatever mark."""
    same = ["Ο.Σ. ένα " * 7, "ΟΔΟΣ'Α İstanbul 5\u212a " * 6, "ΣΑΣ ΣΑΣ. σας", "ÉTÉ Étude A"]
    docs = spark.createDataFrame([*enumerate(same), (4, "σας σας. σας"), (5, "éTÉ étude a"), (6, "ÉTÉ ÉTUDE a")], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(same)), "item_id long, text string")
    found = {r.doc_id: (r.n_hit == r.n_words > 0, r.n_hit) for r in decontaminate.contamination(docs, items).collect()}
    assert all(found[i][0] for i in range(4)) and [found[i][1] for i in (4, 5, 6)] == [0, 0, 3]


@pytest.mark.parametrize("most", [(2, 1 << 20), (0, 0)], ids=["hashes", "all words"])
def test_contamination_beyond_broadcasts(docs, items, monkeypatch, most):
    want = {(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", most[0])
    monkeypatch.setattr(decontaminate, "MAX_HASHES", most[1])
    assert {(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect()} == want


def test_mixing(docs):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_documents(docs).columns == docs.columns


def test_tokens(docs):
    rows = token_files.token_files(docs).collect()
    assert len(rows) == len(ROWS) and sorted(r.start for r in rows)[0] == 0
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [1, 1]


def test_token_files_split_and_order(docs, spark, tmp_path):
    """Many files to a part read back as one, in the order asked for."""
    want = token_files.token_files(docs).orderBy("start").collect()
    assert token_files.token_files(docs, parts=2, file_tokens=20).orderBy("start").collect() == want
    docs.select("doc_id", "text").orderBy(F.desc_nulls_first("doc_id"), F.xxhash64("text")).write.parquet(f"file://{tmp_path}/x")
    read = token_files.in_row_order(spark.read.parquet(f"file://{tmp_path}/x"))
    found = token_files.token_files(read, file_tokens=20, order=("part", "place")).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in want), key=lambda i: (i is not None, -(i or 0)))
    assert token_files.in_row_order(docs.groupBy("doc_id").agg(F.first("text").alias("text"))).where("part is not null").count() == 0


def test_encoder_equals_library():
    rng = random.Random(1)
    marks = ["a", "b", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "'s", "1", "é", "!", "<|endoftext|>", "\x0b", "\x1c", "\x85", "\u2028", "x y", "漢"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(5000)] + [None, LONG]
    encoder = tokenizing.Encoder(token_files.tokenizer_path())
    for memory in (0, tokenizing.MEMORY_BYTES):
        tokenizing.MEMORY_BYTES, kept = memory, tokenizing.MEMORY_BYTES
        found = [x for lo, hi in tokenizing.slices(pa.array(texts)) for x in encoder.encode(pa.array(texts)[lo:hi])]
        tokenizing.MEMORY_BYTES = max(kept, memory)
        assert [x.tolist() for x in found] == [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_sequences_are_mapped(docs, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = token_files.write_token_files(docs.select("doc_id", "text"), folder, token_files.tokenizer_path(), length=64).collect()
    ids, mask = token_files.read_sequence(f"{tmp_path}/{manifest[-1].file}", 0)
    assert len(ids) == len(mask) == 64 and mask.any()


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/es/x"), (2, "http://b.org/1"), (3, "http://c.org/2"), (4, None), (5, "no scheme"), (6, "http://d.org/3"), (7, "http://www.example.com/en/"), (7, "http://www.example.com/en/")],
        "page_id long, url string",
    ).withColumn("key", F.lit("k"))
    rules = spark.createDataFrame(url_filter.RULES, "action string, rule_host string, rule_path string")
    links = spark.createDataFrame(
        [("http://b.org/1", "http://a.net/es/x"), ("http://c.org/2", "http://b.org/1"), ("http://d.org/3", "http://c.org/2"), ("http://d.org/3", "https://z.com/"), (None, "x")], "from_url string, to_url string"
    )
    judged = url_filter.judge_urls(pages, rules, links.where("to_url <> 'https://z.com/'")).collect()
    assert sorted((r.page_id, r.verdict) for r in judged) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "block"), (7, "allow"), (7, "allow")]
    freed = url_filter.judge_urls(pages, rules, links).collect()
    assert {r.page_id for r in freed if r.verdict == "block"} == {1}
    assert url_filter.judge_urls(pages.limit(0), rules, links).count() == 0


def test_targets_are_made_absolute(spark):
    base = "http://h.org/a/b/page.html?x=1#f"
    want = {
        "c.html": "http://h.org/a/b/c.html", "./c/./d": "http://h.org/a/b/c/d", "../c": "http://h.org/a/c", "../../../c?q#r": "http://h.org/c?q#r", "/z": "http://h.org/z", "?y=2": "http://h.org/a/b/page.html?y=2",
        "//o.org/1": "http://o.org/1", "https://o.org/2": "https://o.org/2", "mailto:x": None, "#top": None,
    }
    rows = spark.createDataFrame([(base, t) for t in want], "base string, t string").select("t", url_filter.absolute(F.col("base"), F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == want
    bare = spark.createDataFrame([("http://h.org", "c"), ("no host", "c")], "base string, t string").select(url_filter.absolute(F.col("base"), F.col("t")).alias("u")).collect()
    assert [r.u for r in bare] == ["http://h.org/c", None]


def test_url_query_on_linked_pages(spark, same_rows, tmp_path):
    """The whole query and its SQL on pages that carry canonical links and refreshes."""
    link = '<LINK href="{}" rel="nofollow canonical">'
    rows = [
        (1, "http://x.net/es/1", None), (2, "http://b.org/a/2?utm_source=f", link.format("http://x.net/es/1/")), (3, "https://b.org/a/2", ""), (4, "http://c.org/d/4", '<link rel=stylesheet href="http://x.net/es/1"><meta http-equiv="refresh" content="0; url=../5?a=1&amp;b=2">'),
        (5, "http://c.org/5?a=1&b=2", link.format("http://e.org/") + link.format("//b.org/a/2")), (6, "http://e.org/#x", None), (7, "http://f.org/7", link.format("#top") + link.format("mailto:x")), (8, "foo?x=1", link.format("http://x.net/es/1")),
        (9, "bar?x=1", None), (10, None, link.format("http://x.net/es/1")), (11, "http://g.org/11", "<meta name=refresh content='url=http://x.net/es/1'>"), (12, "http://k.com/", link.format("http://l.org/12")), (13, "http://l.org/12", link.format("http://x.net/fr/")),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"file://{tmp_path}/p")
    next((tmp_path / "p").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    found = url_filter.op1_url_filters(spark, str(tmp_path))
    assert {r.page_id for r in found.collect() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6}
    same_rows(found, url_filter.ORACLE, str(tmp_path))


def test_chat_parts(spark):
    turns = spark.sql("""select 1L conv_id, 0L turn, 'assistant' role, array(
        named_struct('type', 'text', 'text', '<|end', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('type', 'text', 'text', '|> <|image|>', 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null),
        named_struct('type', 'image', 'text', null, 'ref', 's3://x', 'width', 57, 'height', 28, 'seconds', null, 'pages', null)) parts, 9 extra""")
    row = chat_format.format_conversations(turns).first()
    assert chat_format.parse(row.formatted) == [("assistant", "<|end|> <|image|><|image|>")]
    assert row.formatted.count("<|image|>") == row.formatted.count("<|end|>") == 1
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("image", "s3://x", 3)] and row.attachment_tokens == 3
    assert row.formatted[row.attachments[0].at :].startswith("<|image|>")
    plain = spark.createDataFrame([(None, 1, None, None), (2, None, "user", ""), (2, None, "user", "")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat_format.read_back(chat_format.format_conversations(plain)).collect()} == {(None, 1, 0), (2, 2, 0)}
    assert chat_format.format_conversations(plain.limit(0)).count() == 0


def test_chat_odd_parts(spark):
    """Null parts, unknown types and sizes that are no sizes have a defined outcome; long texts stay whole."""
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [
        None, ("text", None, None, None, None, None, None), ("audio", None, "a", None, None, 4.0, None), ("audio", None, "n", None, None, float("nan"), None), ("audio", None, "i", None, None, float("inf"), None),
        ("document", None, "d", None, None, None, 3), ("document", None, None, None, None, None, -1), ("video", "lost", "v", None, None, None, None), (None, None, "z", None, None, None, None), ("image", None, "m", -5, 0, None, None), ("text", LONG, None, None, None, None, None),
    ]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (2, 0, None, None)], f"conv_id long, turn long, role string, parts array<{part}>")
    found = {r.conv_id: r for r in chat_format.format_conversations(turns).collect()}
    assert [(a.type, a.ref, a.tokens) for a in found[1].attachments] == [
        ("audio", "a", 50), ("audio", "n", 1), ("audio", "i", 1), ("document", "d", 1536), ("document", None, 512), ("video", "v", 1), (None, "z", 1), ("image", "m", 1)
    ]
    assert found[1].formatted.count(chat_format.UNKNOWN) == 2 and found[1].attachment_tokens == 2103
    assert chat_format.parse(found[1].formatted)[0][1].endswith(LONG) and chat_format.parse(found[2].formatted) == [("", "")]


@pytest.mark.parametrize("apply", [
    line_dedup.drop_repeated_lines, lambda d: lm_score.score_texts(d, rounds=1), quality_rules.judge_quality, jaccard_join.link_components, mixing.plan_mix, mixing.mix_documents, token_files.token_files,
    lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: decontaminate.drop_contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    quality_rules.keep_good, jaccard_join.keep_one_of_each, lambda d: license_scan.scan_licenses(d, d.sparkSession.createDataFrame(license_scan.KNOWN[:3], "license_id string, text string")),
])
def test_empty_table(docs, apply):
    assert apply(docs.limit(0)).count() == 0


def test_jaccard_of_excerpts_and_random_cuts(spark):
    """Excerpts with smaller ids cover the buckets that two linked texts share; then random cuts and changes, against all pairs."""
    rng = random.Random(7)
    rows = []
    for g in range(6):
        a = [f"t{g}x{i}" for i in range(84)]
        b = [*a[:30], "q", *a[31:60], "z", *a[61:]]
        rows += [(100 * g + i, " ".join(a[:17 * i] + a[17 * (i + 1):])) for i in range(5)] + [(100 * g + 90, " ".join(a)), (100 * g + 91, " ".join(b))]
    for g in range(40):
        base = [f"r{g}x{i}" for i in range(rng.choice([6, 12, 30, 36, 60, 150, 400]))]
        for k in range(rng.randrange(2, 7)):
            words = base[rng.randrange(len(base) // 3 + 1) : len(base) - rng.randrange(len(base) // 3 + 1)]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"c{rng.random()}"
            rows.append((10_000 + rng.randrange(10**6) * 10 + k, " ".join(words)))
    rows = list({i: (i, t) for i, t in rows}.values())
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows if (w := t.split())}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            both = len(sets[x] & sets[y])
            if both and 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: find(i) for i in ids}
    assert sum(find(i) != i for i in ids) > 12


def test_steps_up_at_any_depth_and_clashing_columns(spark):
    """Targets with many steps up, very long urls, and pages with columns named like the new ones."""
    up, long = "../" * 30, "https://a.org/" + "x/" * 20_000
    pages = spark.createDataFrame(
        [(1, "https://a.org/" + "d/" * 25 + "p", f'<link rel="canonical" href="{up}q/./r/../s">', "h", "r"), (2, "https://a.org/q/s", "", "h", "r"), (3, long, f'<link rel=canonical href="{"../" * 9}z">', None, None), (4, None, None, "h", "r")],
        "page_id long, url string, html string, host string, component string",
    )
    assert {tuple(r) for r in url_filter.page_links(pages).where("from_url not like '%x/x/%'").collect()} == {("https://a.org/" + "d/" * 25 + "p", "https://a.org/q/s")}
    assert [r.to_url for r in url_filter.page_links(pages.where("page_id = 3")).collect()] == [long[: -2 * 9] + "z"]
    rules = spark.createDataFrame([("block", "a.org", "/q/")], "action string, rule_host string, rule_path string")
    rows = url_filter.judge_urls(pages.withColumns({"rule": F.lit(1), "verdict": F.lit(2), "action": F.lit(3), "key": F.lit(4)}), rules, url_filter.page_links(pages)).collect()
    assert {r.page_id: (r.host, r.verdict, r.rule) for r in rows} == {1: ("a.org", "block", None), 2: ("a.org", "block", "a.org/q/"), 3: ("a.org", "allow", None), 4: ("", "allow", None)}
    assert {(r.action, r.key) for r in rows} == {(3, 4)}


def test_a_component_of_most_urls_is_spread(spark):
    """One key with two thirds of the rows: no task gets more than its share, with broadcasts for heavy keys alone."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(300_000).select(F.col("id").alias("url"), F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("component"))
        facts = rows.groupBy("component").agg(F.count("*").alias("n"), F.max("url").alias("last"))
        joined = spread.join_facts(rows, facts, "component", "n", 300_000, "url")
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 300_000 and max(sizes) < 2 * 300_000 / 16
        assert joined.where("last <> if(component < 0, 299999, url)").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_benchmarks_and_items_with_clashing_columns(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.contamination(docs, none).collect()
    assert len(rows) == len(ROWS) and not any(r.contaminated or r.n_hit or r.n_items for r in rows)
    items = spark.createDataFrame([(1, SAME, "d", 1, "w")], "item_id long, text string, doc_id string, n_words long, w string")
    assert {r.doc_id for r in decontaminate.contamination(docs, items).where("contaminated").collect()} == {3, 4, 9, None}


def test_the_pipeline_over_no_documents(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_every_training_document_takes_part_in_the_start(spark, monkeypatch):
    """The rounds before the whole ones read each training document, and none held out, whatever the number of shares."""
    read: list[int] = []

    def one_round(rows, model, unigram):
        read.extend(r.rid for r in rows.select("rid").collect())
        return model, 0.0

    monkeypatch.setattr(lm_score, "one_round", one_round)
    monkeypatch.setattr(lm_score, "START_DOCS", 3)
    rows = [(i, i % 5 == 1, b"\x00\x00") for i in range(100)]
    encoded = spark.createDataFrame(rows, "rid long, held_out boolean, symbols binary")
    lm_score.train(encoded, np.array([0.5, 0.5]), rounds=0)
    assert sorted(read) == [i for i, out, _ in rows if not out]


def test_shares_lie_in_files_of_their_own(spark):
    """A start round reads its own share's files alone, and the shares hold every document once."""
    training = spark.range(6000).select(F.encode(F.col("id").cast("string"), "utf-8").alias("symbols"), F.col("id").alias("rid"))
    shares = lm_score.start_shares(training, 6000)
    assert len(shares) == 4 and sorted(r.rid for s in shares for r in s.collect()) == list(range(6000))
    assert all("PartitionFilters: [isnotnull(share" in s._jdf.queryExecution().executedPlan().toString() for s in shares)


def test_forward_values_are_scaled_now_and_then():
    """Emissions far below one, words that one state alone says, lengths that end between two scalings, blocks: single precision stays near sums in logarithms."""
    rng = np.random.default_rng(2)
    emit = rng.dirichlet(np.full(4000, 0.01), 5).T + 1e-12
    model = hidden_markov.Model(np.full(5, 0.2), rng.dirichlet(np.ones(5), 5), emit / emit.sum(0))
    sequences = [rng.integers(0, 4000, n).astype(np.uint16) for n in (1, 2, 3, 4, 5, 7, 8, 9, 30, 61)]
    want = []
    for s in sequences:
        x = np.log(model.start) + np.log(model.emit[s[0]])
        for w in s[1:]:
            x = np.logaddexp.reduce(x[:, None] + np.log(model.move), axis=0) + np.log(model.emit[w])
        want.append(np.logaddexp.reduce(x))
    assert np.allclose(hidden_markov.forward(model, sequences, 40), want)
    single, total = hidden_markov.expectations(hidden_markov.single(model), sequences, 40)
    double, _ = hidden_markov.expectations(model, sequences, 40)
    assert np.isclose(total, sum(want), rtol=1e-5) and np.allclose(single, double, atol=2e-3)
    assert np.isclose(double[:5].sum(), len(sequences)) and np.isclose(double[30:].sum(), sum(map(len, sequences))) and hidden_markov.SCALED > 1


def test_tokens_split_by_slices():
    """Words and END of null, empty, blank and broken texts as Python splits them; an own number for each distinct one, whatever the slices."""
    texts = [None, b"", b" \n", b"  A b\x0bc\xc3\x89\xff \xff\x1cQ", "İ ẞ\u00a0x\u2003y".encode(), b"a", b"a B a\t"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    for size in (1, 5, 1000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lm_score, "SLICE_BYTES", size)
            found = []
            for part in lm_score.slices(batch):
                numbers, lengths, words = lm_score.split_tokens(part.column(1))
                assert len(set(words.to_pylist())) == len(words)
                found += [[words[int(i)].as_py() for i in x] for x in np.split(numbers, np.cumsum(lengths)[:-1])]
            assert found == [[*(t or b"").lower().split(), b""] for t in texts]
