"""State that ends: batches one by one, late rows, keys that expire and come again."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tidemark.plans import ingest
from tidemark.streaming.retained import retained

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_keys_expire_and_late_rows_are_counted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[("a", 0), ("a", 2), ("b", 1), (None, 3), ("c", None)], [("a", 5), ("b", 12), ("b", 12)], [("d", 13), ("a", 13)], [("d", 0), ("d", 9), ("e", 20)], [("e", 21)]]
    reports, found = [], None
    for n, rows in enumerate(batches):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"k": k, "t": d if d is None else DAY(d).isoformat()}) for k, d in rows))
        stream = spark.readStream.schema("k string, t timestamp").json(f"file://{tmp_path}/in")
        found, new = retained(stream, ["k"], "t", f"file://{tmp_path}/state", 7)
        reports += new
    got = {r.k: ((r.first - DAY(0)).days, (r.last - DAY(0)).days, r.n, r.expired) for r in found.collect()}
    # a was away from day 5 to day 13; day 9 is late enough to be older than the last row, not too late; the row of day 0 is
    assert got == {"a": (13, 13, 1, True), "b": (12, 12, 2, True), None: (3, 3, 1, True), "d": (9, 13, 2, True), "e": (20, 21, 2, False)}
    assert sum(r["late"] for r in reports) == 1 and sum(r["rows"] for r in reports) == sum(map(len, batches))
    last = reports[-1]
    assert last["keys"] <= 4 and last["updated"] <= 6  # forgotten keys are no state any more


@pytest.mark.parametrize("name", ["windowed_events", "retained_users"])
def test_batches_of_several_files(spark, same_rows, monkeypatch, name):
    """A large batch is written by several tasks, and the stream still takes it as one."""
    monkeypatch.setattr(ingest, "FILE_ROWS", 1500)
    sf = "/root/testdata/sf0.01"
    root, files = ingest._batches(spark, sf, [])
    assert files == 3 and [len(spark.read.parquet(f"{root}/{n}").inputFiles()) for n in range(3)] == [3, 3, 3]
    query, sql = ingest.QUERIES[name]
    same_rows(query(spark, sf), sql, sf)
