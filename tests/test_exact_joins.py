"""Joins that look at few candidates against all pairs: rivals and overlapping stories."""

from __future__ import annotations

import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters, listing, notices, search
from tidemark.plans import evidence, records, stories as stories_plans


@pytest.mark.parametrize("seed", [1, 2])
def test_rivals_equal_all_pairs(spark, seed):
    """Many ties, groups of one record and of many, kinds without a shared stem, no kind, no detail, no specialities, nulls."""
    rng = random.Random(seed)
    words = ["suture", "sutures", "stapler", "gauze", "dressing", "absorbent", "hi"]
    rows = []
    for i in range(150):
        text = " ".join(rng.sample(words, rng.randrange(4))) + (" common" if rng.random() < 0.9 else "")
        rows.append((i, f"g{rng.choice([0, 0, 0, 1, 2, rng.randrange(40)])}", rng.choice(["a", "a", "b", None]), text if rng.random() < 0.95 else None, rng.choice([True, False, None]), rng.choice([None, [], ["x"], ["x", "y"], ["y", "z"]])))
    records = spark.createDataFrame(rows, "rid int, grp string, type string, text string, has boolean, specs array<string>")
    found = search.rivals(records, "rid", "grp", "type", "text", "text", F.col("has"), F.col("specs"), k=3)
    full = [(i, g, t, {w[:8] for w in re.findall("[a-z]{5,}", x or "")}, set(re.findall("[a-z]{5,}", x or "")), d, set(s or [])) for i, g, t, x, d, s in rows]
    want = set()
    for i, g, t, st, w, _, sp in full:
        if t is None:
            out = sorted((j, None) for j, h, _, _, v, _, _ in full if h != g and w & v)[:3]
        else:
            out = [(j, -n) for n, j in sorted((-(10 * len(st & su) + 5 * bool(d) + len(sp & sq)), j) for j, h, u, su, _, d, sq in full if h != g and u == t)[:3]]
        want |= {(i, j, n, place + 1) for place, (j, n) in enumerate(out)}
    assert {tuple(r) for r in found.select("rid", "rival", "score", "place").collect()} == want


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choices([f"w{int(rng.paretovariate(0.6))}" for _ in range(30)], k=rng.randrange(8))) for i in range(120)]
    found = clusters.overlaps(spark.createDataFrame(rows, "id int, lang string, tokens array<string>"), "lang", "id", "tokens")
    sets = [(i, g, set(t)) for i, g, t in rows]
    want = {(g, i, j) for i, g, s in sets for j, h, t in sets if i < j and g == h and len(s & t) >= max(2, min(len(s), len(t)) // 2)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_colisting_equals_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40), None if rng.random() < 0.02 else f"g{int(rng.paretovariate(0.5)) % 30}") for _ in range(400)]
    of: dict = {}
    for m, g in rows:
        if g:
            of.setdefault(m, set()).add(g)
    for floor in (1, 2, 4):
        found = [tuple(r) for r in listing.colisting(spark.createDataFrame(rows, "m int, g string"), "m", "g", floor).select("a", "b", "shared").collect()]
        assert sorted(found) == sorted((a, b, len(of[a] & of[b])) for a in of for b in of if a != b and len(of[a] & of[b]) >= floor)


def test_members_with_equal_groups_are_paired_once_and_expanded_in_parts(spark, monkeypatch):
    """Classes of one member and of many, whose rows are more than a part's; ties that pass k."""
    monkeypatch.setattr(listing, "CHUNK", 3)
    rng = random.Random(8)
    kinds = [rng.sample("abcdefgh", rng.randrange(1, 5)) for _ in range(12)]
    of = {m: set(kinds[min(int(rng.paretovariate(0.7)), 12) - 1]) for m in range(60)}
    bridge = spark.createDataFrame([(m, g) for m, gs in of.items() for g in gs] + [(None, "a"), (3, None)], "m int, g string")
    size = {g: sum(g in gs for gs in of.values()) + (g == "a") for g in "abcdefgh"}
    want = {(a, b): (len(of[a] & of[b]), round(sum(1 / size[g] for g in of[a] & of[b]), 9)) for a in of for b in of if a != b and of[a] & of[b]}
    assert sorted(tuple(r) for r in listing.colisting(bridge, "m", "g", 2).select("a", "b", "shared").collect()) == sorted((a, b, n) for (a, b), (n, _) in want.items() if n >= 2)
    assert {(r.a, r.b): (r.shared, round(r.weight, 9)) for r in listing.peers(bridge, "m", "g").collect()} == want
    top = {}
    for (a, b), score in want.items():
        upto = sum(s >= score for (x, _), s in want.items() if x == a)
        if upto <= 7:
            top[a, b] = (*score, upto)
    assert top and {(r.a, r.b): (r.shared, round(r.weight, 9), r.rows_upto) for r in listing.top_peers(bridge, "m", "g", 7).collect()} == top


def test_pairs_are_made_of_classes(spark):
    """Copies of members make no more pairs before the result is made of them."""
    rows = [(m + 10 * c, f"g{g}") for c in range(20) for m in range(6) for g in range(m, m + 3)]
    members, classes, met = listing._classes(spark.createDataFrame(rows, "m int, g string"), "m", "g")
    assert (members.count(), classes.count(), met.count()) == (120, 6, 6 + 5 + 4)


def _unequal(spark, n: int):
    """Members of 9 groups out of 20, no two with the same; all of them meet."""
    rng = random.Random(4)
    of = {m: set(rng.sample(range(20), 9)) for m in range(n)}
    return of, spark.createDataFrame([(m, f"g{g}") for m, gs in of.items() for g in gs], "m int, g string")


def _written(monkeypatch) -> list[int]:
    rows, real = [], listing.cut
    monkeypatch.setattr(listing, "cut", lambda df, label: (out := real(df, label), rows.append(out.count()))[0])
    return rows


def _pairs_stay(df) -> bool:
    """Nothing is shuffled after the step that meets the members."""
    above, step, _ = df._jdf.queryExecution().executedPlan().toString().partition("FlatMapGroupsInArrow")
    return bool(step) and "Exchange" not in above


@pytest.mark.parametrize("block", [1000, 25])
def test_colisting_neither_writes_nor_shuffles_pairs(spark, monkeypatch, block):
    """Where all members differ, no table that is written is larger than the bridge, and the pairs stay in the task that counted them."""
    monkeypatch.setattr(listing, "BLOCK", block, raising=False)
    of, bridge = _unequal(spark, 90)
    written = _written(monkeypatch)
    found = listing.colisting(bridge, "m", "g", 4)
    assert max(written) <= 90 * 9 < 90 * 89 / 2
    assert _pairs_stay(found)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b, len(of[a] & of[b])) for a in of for b in of if a != b and len(of[a] & of[b]) >= 4)


@pytest.mark.parametrize("k", [1, 5, 30])
def test_top_peers_of_blocks_are_those_of_all(spark, monkeypatch, k):
    """Ties within a block, across blocks and of more than k, members with equal groups in several units; no table that is written is larger than the bridge."""
    monkeypatch.setattr(listing, "BLOCK", 20, raising=False)
    monkeypatch.setattr(listing, "CHUNK", 2)
    of, _ = _unequal(spark, 70)
    of |= {70 + m: of[m % 3] for m in range(15)} | {85 + m: {"x"} for m in range(7)}
    rows = [(m, f"g{g}") for m, gs in of.items() for g in gs]
    size = {g: sum(g in gs for gs in of.values()) for gs in of.values() for g in gs}
    want = {}
    for a in of:
        score = {b: (len(of[a] & of[b]), round(sum(1 / size[g] for g in of[a] & of[b]), 9)) for b in of if b != a and of[a] & of[b]}
        want |= {(a, b): (*s, n) for b, s in score.items() if (n := sum(t >= s for t in score.values())) <= k}
    written = _written(monkeypatch)
    found = listing.top_peers(spark.createDataFrame(rows, "m int, g string"), "m", "g", k)
    assert max(written) <= len(rows) < 70 * 69 / 2
    assert {(r.a, r.b): (r.shared, round(r.weight, 9), r.rows_upto) for r in found.collect()} == want and want


def test_weights_are_rounded_as_the_sql_rounds_them(spark):
    """0.0160785, a weight of nine decimals, lies below the half as a double times a million."""
    values = [0.0160785, 0.0160775, 0.1234565, 1.0000005, 0.0000005, 0.25, 0.0, 20.0000015]
    found = spark.createDataFrame([(v,) for v in values], "weight double").select(records._sixth(F.col("weight"))).collect()
    assert [r[0] for r in found] == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]


@pytest.mark.parametrize("dense", [1, 10_000])
def test_counts_of_blocks_are_those_of_sets(monkeypatch, dense):
    """Many small groups are added pair by pair, large ones as a product of matrices, in more than one slice."""
    monkeypatch.setattr(listing, "DENSE", dense)
    monkeypatch.setattr(listing, "SLAB", 3)
    monkeypatch.setattr(listing, "ADDED", 20)
    rng = random.Random(2)
    of = {(b, at): set(rng.sample(range(30), rng.randrange(12))) for b in (0, 1) for at in range(8)}
    held = {(g, b): [at for at in range(8) if g in of[b, at]] for g in range(30) for b in (0, 1)}
    cells = [{"i": 0, "j": 1, "size": g + 1, "xs": held[g, 0], "ys": held[g, 1], "block": None, "at": None, "ms": None} for g in range(30) if held[g, 0] and held[g, 1]]
    units = [{"i": 0, "j": 1, "size": None, "xs": None, "ys": None, "block": b, "at": at, "ms": [100 * b + at]} for b, at in of]
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("size", pa.int64()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32())), ("block", pa.int32()), ("at", pa.int32()), ("ms", pa.list_(pa.int32()))])
    b = listing._Blocks(iter(pa.Table.from_pylist(units[::-1] + cells, schema).to_batches()), True)
    assert b.xms.to_pylist() == [[at] for at in range(8)] and b.yms.to_pylist() == [[100 + at] for at in range(8)]
    for x in range(8):
        for y in range(8):
            both = of[0, x] & of[1, y]
            assert b.shared[x, y] == len(both) and b.weight[x, y] == pytest.approx(sum(1 / (g + 1) for g in both))


@pytest.mark.parametrize("block", [2048, 3])
def test_same_group_not_colisted_keeps_pairs_in_their_task(spark, sf_dir, same_rows, monkeypatch, block):
    """Suppliers in one block and in several; those that share too many groups are left out before rows are made of members."""
    monkeypatch.setattr(listing, "BLOCK", block, raising=False)
    found = evidence.same_group_not_colisted(spark, sf_dir)
    assert _pairs_stay(found)
    above = found._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInArrow")[0]
    assert above.rindex("Generate") < above.index("Filter (isnotnull(shared")
    same_rows(found, evidence.NOT_COLISTED, sf_dir)


def test_stories_are_not_broadcast(spark, monkeypatch):
    """Aliases and scope may be, after they are counted; the plan broadcasts nothing else, however small the stories' files."""
    monkeypatch.setattr(notices, "small", lambda df: df)
    stories = spark.createDataFrame([(1, ["ann", "lee"]), (2, ["lee", "north"]), (3, ["x"])], "sid int, words array<string>")
    aliases, scope = spark.createDataFrame([("o", "ann lee")], "owner string, alias string"), spark.createDataFrame([("o", "north")], "owner string, term string")
    found = notices.identities(stories, "sid", "words", aliases, scope)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.sid, r.owner, r.how) for r in found.collect()) == [(1, "o", "alias"), (2, None, "none"), (3, None, "none")]


def test_rivals_records_are_dealt_and_not_broadcast(spark, sf_dir):
    """The classes' rows meet their records, and rivals their own attributes, by three merges; the records lie in a file for each task."""
    found = stories_plans.rival_ranking(spark, sf_dir)
    assert found._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") >= 3
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert search.dealt(part, 10).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, part.count() // 10 + 1)


@pytest.mark.parametrize("long", [64, 5])
def test_first_fit_equals_the_greedy_order_and_pairs_no_copies(spark, monkeypatch, long):
    """Copies, sets of one token and of none, a null group, sets that meet by single tokens, steps of a few sets; the pairs that are kept are of distinct sets."""
    monkeypatch.setattr(clusters, "LONG", long, raising=False)
    monkeypatch.setattr(clusters, "STEP", 10, raising=False)
    kept, real = [], clusters.cut
    monkeypatch.setattr(clusters, "cut", lambda df, label: (out := real(df, label), label == "overlaps" and kept.append(out.count()))[0])
    rng = random.Random(5)
    kinds = [rng.choices([f"w{int(rng.paretovariate(0.6))}" for _ in range(40)], k=rng.randrange(9)) for _ in range(45)]
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice(kinds)) for i in range(600)]
    found = clusters.first_fit(spark.createDataFrame(rows, "id int, lang string, tokens array<string>"), "lang", "id", "tokens").collect()
    seeds, want = [], []
    for i, g, t in rows:
        s = set(t)
        first = next((j for j, h, u in seeds if g and g == h and len(s & u) >= max(2, min(len(s), len(u)) // 2)), None)
        want.append((g, i, i if first is None else first))
        if first is None:
            seeds.append((i, g, s))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert 0 < sum(kept) < 2 * 45 * 44 / 2


def test_first_fit_reads_tokens_once_and_merges_pairs(spark):
    """Each item's tokens are told once, however many steps follow, and the pairs of tokens are not broadcast, though their files are small."""
    told = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(i):
        told.add(1)
        return [f"w{i % 7}", f"w{i % 5 + 7}", f"w{i % 3 + 12}"]

    items = spark.range(50).select(F.col("id"), F.lit("a").alias("lang"), tokens("id").alias("tokens"))
    assert clusters.first_fit(items, "lang", "id", "tokens").count() == 50
    assert told.value == 50
    sets = spark.range(50).select(F.lit("a").alias("lang"), F.col("id").alias("k"), F.array("id", F.col("id") + 1).alias("ts"))
    plan = clusters._met(sets, sets, "lang", False, "i < j")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
