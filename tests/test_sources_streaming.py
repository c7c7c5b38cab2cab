"""Sources, sinks and streams on small fixtures."""

from __future__ import annotations

import pytest

from tidemark.operators import matching, search
from tidemark.sources import snapshots
from tidemark.streaming.first_seen import append_new, first_seen


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshots_as_of(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert snapshots.resolve(spark, path, "7d", "2026-01-31") is None
    for n, day in enumerate(("2026-01-01", "2026-01-20", "2026-01-30"), 1):
        snapshots.write_snapshot(spark.range(n), path, day)
    assert snapshots.resolve(spark, path, "7d", "2026-01-31") == "2026-01-20"
    assert snapshots.as_of(spark, path, "2026-01-30", "2026-01-31").count() == 3
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.as_of(spark, path, "2025-12-31", "2026-01-31")


def test_guarded_write_refuses_loss(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert snapshots.guarded_write(spark.range(10), path) == 10
    for fewer in (0, 4):
        with pytest.raises(ValueError, match="refused"):
            snapshots.guarded_write(spark.range(fewer), path)
    assert snapshots.guarded_write(spark.read.parquet(path).where("id < 5"), path) == 5
    assert spark.read.parquet(path).count() == 5 and not snapshots.exists(spark, f"{path}.new")


def test_tolerant_loads(spark, tmp_path):
    assert snapshots.load_json(spark, f"file://{tmp_path}/none.json", "a long").count() == 0
    (tmp_path / "a.json").write_text('{"a": 1}')
    assert rows(snapshots.load_json(spark, f"file://{tmp_path}/a.json", "a long, b string")) == [(1, None)]
    (tmp_path / "c.csv").write_text("name,n\nx,3\ny,*\nz,\n")
    assert rows(snapshots.load_counts(spark, f"file://{tmp_path}/c.csv", ["n"])) == [("x", 3), ("y", 0), ("z", 0)]
    snapshots.write_csv(spark.createDataFrame([('say "a"',)], "t string").coalesce(1), f"file://{tmp_path}/out")
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == '"t"\n"say ""a"""\n'


def test_first_seen_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema("k string, t long").json(f"file://{tmp_path}/in")
    fold = lambda: rows(first_seen(stream(), ["k"], "t", f"file://{tmp_path}/fold"))
    assert fold() == []
    (tmp_path / "in/1.json").write_text('{"k": "a", "t": 5}\n{"k": "b", "t": 6}\n')
    assert fold() == [("a", 5, 5, 1), ("b", 6, 6, 1)]
    (tmp_path / "in/2.json").write_text('{"k": "a", "t": 3}\n{"k": null, "t": 1}\n')
    want = {("a", 3, 5, 2), ("b", 6, 6, 1), (None, 1, 1, 1)}
    found = lambda: {tuple(r) for r in first_seen(stream(), ["k"], "t", f"file://{tmp_path}/fold").collect()}
    assert found() == want
    assert found() == want  # nothing new


def test_append_new_never_edits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema("k string, v long").json(f"file://{tmp_path}/in")
    (tmp_path / "in/1.json").write_text('{"k": "a", "v": 1}\n')
    assert rows(append_new(stream(), "k", f"file://{tmp_path}/out")) == [("a", 1)]
    (tmp_path / "in/2.json").write_text('{"k": "a", "v": 2}\n{"k": "b", "v": 3}\n')
    assert rows(append_new(stream(), "k", f"file://{tmp_path}/out")) == [("a", 1), ("b", 3)]


def test_token_match_edges(spark):
    probes = spark.createDataFrame([("p", ["a", "b"]), ("none", []), ("odd", ["a", "z"])], "probe string, tokens array<string>")
    targets = spark.createDataFrame([("t", ["b", "a", "c"]), ("u", ["a"])], "target string, tokens array<string>")
    assert rows(matching.match_all_tokens(probes, targets)) == [("p", "t")]


def test_search_scores(spark):
    docs = spark.createDataFrame([(1, "Red pumps. x\nother"), (2, "none\nhere a pump is red"), (3, None), (4, "pumper")], "id long, text string")
    found = dict(rows(search.scored(docs, "id", "text", "the red pump", ("the",))))
    assert found == {1: 18 + 18 + 12 + 12 + 45, 2: 12 + 12 + 45, 3: 0, 4: 0}
    assert rows(search.ranked(search.scored(docs, "id", "text", "the red pump", ("the",)), "id")) == [(1, 105), (2, 69)]
