"""Stored pages, files, sources, folds and rule tables on small fixtures."""

from __future__ import annotations

import json

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chain, merge, rules, tagging
from tidemark.sources import files, paged, snapshots, status


def pages(spark, root: str, window: str, bodies: list) -> None:
    rows = [(f"{window}/{n + 1}.json", b if isinstance(b, str) else json.dumps(b)) for n, b in enumerate(bodies) if b is not None]
    paged.write_files(spark.createDataFrame(rows, "name string, content string"), root)


def test_walks_end_where_they_should(spark, tmp_path):
    root, item = f"file://{tmp_path}", lambda k, d="2024-01-09": {"k": k, "date": d}
    link = lambda w, n: {"next": f"{w}/{n}.json"}
    pages(spark, root, "whole", [{"items": [item(1)], "links": link("whole", 2)}, {"items": [item(2), item(3)]}])
    pages(spark, root, "broken", [{"items": [item(4)], "links": link("broken", 2)}, None])
    pages(spark, root, "bad", [{"items": [item(5)], "links": link("bad", 2)}, "{no json"])
    pages(spark, root, "ring", [{"items": [item(6)], "links": link("ring", 1)}])
    pages(spark, root, "old", [{"items": [item(7), item(8, "2023-12-31"), item(9)], "links": link("old", 2)}, {"items": [item(10)]}])
    windows = ["whole", "broken", "bad", "ring", "old", "none"]
    items, states = paged.walked(spark, root, windows, "k int", guard=3, cutoff="2024-01-01")
    assert {r.window: (r.pages, r.complete) for r in states.collect()} == {"whole": (2, True), "broken": (1, False), "bad": (1, False), "ring": (3, False), "old": (1, True), "none": (0, False)}
    assert sorted((r.window, r.item.k) for r in items.collect()) == [("bad", 5), ("broken", 4), ("old", 7), ("old", 9), ("ring", 6), ("ring", 6), ("ring", 6), ("whole", 1), ("whole", 2), ("whole", 3)]
    pages(spark, root, "full", [{"items": [item(1), item(2)]}, {"items": [item(3), item(4)]}])
    pages(spark, root, "short", [{"items": [item(1), item(2)]}, {"items": [item(3)]}, {"items": [item(9), item(9)]}])
    items, states = paged.walked(spark, root, ["full", "short"], "k int", size=2)
    assert {(r.window, r.pages, r.complete) for r in states.collect()} == {("full", 2, True), ("short", 2, True)} and items.count() == 7


def test_files_against_their_manifest(spark, tmp_path):
    svg = lambda c: f"<svg style='fill: #{c}'/>"
    rows = [("a.svg", svg("000")), ("sub/b.svg", svg("abcdef")), ("c.svg", svg("abcdef")), ("e.txt", "x")]
    paged.write_files(spark.createDataFrame(rows, "name string, content string"), f"file://{tmp_path}")
    found = files.stored_files(spark, f"file://{tmp_path}", "*.svg")
    assert {(r.name, tuple(r.fills)) for r in found.collect()} == {("a.svg", ("000000",)), ("b.svg", ("abcdef",)), ("c.svg", ("abcdef",))}
    digest = {r.name: r.sha256 for r in found.collect()}
    told = spark.createDataFrame([("a.svg", len(svg("000")), digest["a.svg"], "000000", 21.0), ("b.svg", 1, "0", "123456", 21.0), ("d.svg", 1, "0", None, 1.0)], "name string, bytes long, sha256 string, fill string, contrast double")
    problems = files.against_manifest(found, told).groupBy("name").agg(F.array_sort(F.collect_list("problem")).alias("p")).collect()
    assert {r.name: r.p for r in problems} == {"b.svg": ["contrast", "digest", "fill", "repeated", "size"], "c.svg": ["repeated", "unnamed"], "d.svg": ["contrast", "missing"]}


def test_a_failed_source_keeps_its_former_rows(spark, tmp_path):
    path, good = f"file://{tmp_path}/out", lambda s: s.range(3).toDF("k")
    absent = lambda s: s.read.parquet(f"file://{tmp_path}/none")
    failing = lambda s: s.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("k"))
    status.ingest(spark, "one", {"x": good, "y": good}, path, F.col("k") == 2, F.col("k"))
    rows = status.ingest(spark, "two", {"x": absent, "y": failing, "z": good}, path, F.lit(False), F.col("k")).collect()
    assert [(r.source, r.ok, r.rows, r.newest) for r in rows] == [("x", False, 0, None), ("y", False, 0, None), ("z", True, 3, "2")] and all(r.reason for r in rows[:2])
    assert spark.read.parquet(f"{path}/x").count() == spark.read.parquet(f"{path}/y").count() == 2
    assert not status.log(spark, f"{path}/log", "two", []) and status.logged(spark, f"{path}/log").count() == 5


def test_folds_resume_and_agree(spark, tmp_path):
    path, rows = f"file://{tmp_path}/s", [[("a", "x")], [("a", "x"), ("a", "y"), ("b", None), (None, "z")], [("c", "x"), ("a", "y"), ("a", "y")]]
    write = lambda n: snapshots.write_snapshot(spark.createDataFrame(rows[n], "e string, c string"), path, f"2024-01-0{n + 1}")
    states = [f"file://{tmp_path}/{n}" for n in ("steps", "once")]
    assert chain.fold_snapshots(spark, path, states[0], "e", "c") is None
    for n in range(3):
        write(n)
        assert chain.fold_snapshots(spark, path, states[0], "e", "c") == f"2024-01-0{n + 1}"
    chain.fold_snapshots(spark, path, states[1], "e", "c")
    assert chain.fold_snapshots(spark, path, states[1], "e", "c") == "2024-01-03"  # nothing new
    seen = [{tuple(r) for r in chain.seen(spark, s).collect()} for s in states]
    assert seen[0] == seen[1] == {("a", None, "2024-01-01", True), ("a", "x", "2024-01-01", True), ("a", "y", "2024-01-02", False), ("b", None, "2024-01-02", False), ("c", None, "2024-01-03", False), ("c", "x", "2024-01-03", False)}
    assert all({tuple(r) for r in chain.counts(spark, s).collect()} == {("2024-01-01", 1, 1), ("2024-01-02", 2, 2), ("2024-01-03", 2, 2)} for s in states)


def test_rules_hold_by_literal_pattern_and_negation(spark):
    table = [("a", "cat", "\\bcats?\\b", "no cats?", 2), ("b", "dog", "dog", None, 1), ("b", "hound", "hound", None, 1), ("z", "cat", "scat", None, 0)]
    texts = [(1, "two cats", "x"), (2, "no cats, a dog and a hound", "x"), (3, "no cat but a cat", "x"), (4, None, "y"), (5, "concat", None), (6, "scat", "x")]
    found = tagging.tagged(spark.createDataFrame(texts, "id int, t string, kind string"), "id", "t", spark.createDataFrame(table, "label string, literal string, pattern string, negation string, priority int"), "kind")
    assert {r.id: (r.labels, r.first_label, r.hits) for r in found.collect()} == {1: (["a"], "a", 1), 2: (["b"], "b", 2), 3: (["a"], "a", 1), 4: (["y"], "y", 0), 5: ([None], None, 0), 6: (["z"], "z", 1)}


@pytest.mark.parametrize("severity", ["FAIL", "WARN"])
def test_aliases_that_move_with_a_merger_are_not_stolen(spark, severity):
    before = spark.createDataFrame([("x", "A"), ("y", "A"), ("z", "B"), ("w", "C")], "alias string, owner string")
    after = spark.createDataFrame([("x", "A"), ("y", "B"), ("z", "D"), ("w", "C"), ("w", "B")], "alias string, owner string")
    found = rules.alias_steals(before, after, "alias", "owner", "steals", severity).collect()
    # y went from A, which is still there; z went from B, which is too; w has both
    assert sorted((r.severity, r.row_key, r.message) for r in found) == [(severity, "y", "taken from A by B"), (severity, "z", "taken from B by D")]
    merged = after.where("owner <> 'B'")
    assert [r.row_key for r in rules.alias_steals(before, merged, "alias", "owner", "steals", severity).collect()] == []


def test_whole_records_are_merged_or_refused(spark):
    table = lambda *rows: spark.createDataFrame(rows, "k int, a string, b int")
    base = table((1, "a", 1), (2, "b", None), (3, "c", 3), (4, "d", 4), (5, "e", 5))
    ours, theirs = table((1, "A", 1), (2, "b", None), (3, "c", 3), (5, "E", 5), (6, "new", 1)), table((1, "a", 1), (2, "b", 2), (4, "d", 4), (5, "E", 5), (7, "x", None))
    found = merge.three_way_records(base, ours, theirs, "k", ["a", "b"])
    assert {tuple(r) for r in found.collect()} == {(1, "A", 1, "ours"), (2, "b", 2, "theirs"), (3, "c", 3, "same"), (4, "d", 4, "same"), (5, "E", 5, "both"), (6, "new", 1, "ours"), (7, "x", None, "theirs")}
    with pytest.raises(ValueError, match="refused: 1 records .* 2"):
        merge.three_way_records(base, table((1, "A", 1), (2, "z", None)), theirs, "k", ["a", "b"])


def test_rules_told_by_neighbours_equal_their_patterns(spark, monkeypatch):
    """Words alone, with an s, denied, denied twice, joined to what was denied, overlapping themselves; rules of other patterns beside them; rules in several parts; no shuffle."""
    monkeypatch.setattr(tagging, "CHARS", 150, raising=False)
    rng = random.Random(4)
    alone, denied = "(^|[^a-z]){}([^a-z]|$)", "(^|[^a-z])(the|no) {}"
    table = [(f"l{i % 4}", w, alone.format(w), denied.format(w), i) for i, w in enumerate(("anan", "foo", "the"))] + [("p", "foo", "(^|[^a-z])foos?([^a-z]|$)", None, 9), ("l1", "an o", alone.format("an o"), None, 3), ("q", ".", "[.]s", "o[.]", 1), ("r", "a.", "(^|[^a-z])a.([^a-z]|$)", None, 0)]
    texts = [(i, "".join(rng.choices(["foo", "anan", "an", "the ", "no ", "s", " ", ".", "\n", "é", "o", "x"], k=rng.randrange(9))), "x") for i in range(1500)]
    found = tagging.tagged(spark.createDataFrame(texts, "id int, t string, kind string"), "id", "t", spark.createDataFrame(table, "label string, literal string, pattern string, negation string, priority int"), "kind")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t, _ in texts:
        held = [(p, label) for label, literal, pattern, negation, p in table if literal in t and re.search(pattern, re.sub(negation, " ", t) if negation else t)]
        want[i] = (sorted({x for _, x in held}) or ["x"], min(held)[1] if held else "x", len(held))
    assert {r.id: (r.labels, r.first_label, r.hits) for r in found.collect()} == want
    assert tagging.word_kind("foo", alone.format("foo"), denied.format("foo")) and not tagging.word_kind("a.", alone.format("a."), None)
