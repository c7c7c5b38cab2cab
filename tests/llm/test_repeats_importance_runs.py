"""Long repeats, importance resampling and periodic runs against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, periodic_runs, registry, run_index

sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def uncovered(texts: list[bytes], span: int) -> list[np.ndarray]:
    """Which bytes lie in no string of ``span`` bytes that begins twice."""
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        kept = np.ones(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                kept[i : i + span] = False
        out.append(kept)
    return out


def test_long_repeats_equal_all_windows(spark, sf_dir, docs):
    found = {r.doc_id: r for r in registry.queries()["op11_run_index"](spark, sf_dir).collect()}
    texts = [(d["text"] or "").encode() for d in docs]
    for d, t, kept in zip(docs, texts, uncovered(texts, 200), strict=True):
        r, edge = found[d["doc_id"]], np.diff(np.concatenate([[1], kept.astype(int)]))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), int((~kept).sum()), int((edge == -1).sum()))
        assert r.kept_sha256 == sha(np.frombuffer(t, np.uint8)[kept].tobytes())


@pytest.mark.parametrize("most", [run_index.MOST, 3])
def test_repeats_in_hard_texts(spark, monkeypatch, most):
    """Periodic, nested, shifted and odd texts, null and repeated ids; with MOST at 3 every busy anchor is cut anew."""
    monkeypatch.setattr(run_index, "MOST", most)
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abé漢 ") for _ in range(rng.randrange(1, 7)))
    passage = "".join(word() for _ in range(30))
    rows = [(i, word() * rng.randrange(3) + passage[rng.randrange(9) : 40 + rng.randrange(60)] + "".join(word() for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(100, "ab" * 900), (101, "ba" * 40), (102, "x" * 700), (103, None), (104, ""), (None, passage), (None, passage), (105, passage + passage), (105, "short"), (106, "y" * 23), (107, "z" * 24)]
    found = run_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), span=24, k=9).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = [(str(i), len(t), bytes(np.frombuffer(t, np.uint8)[k])) for (i, _), t, k in zip(rows, texts, uncovered(texts, 24), strict=True)]
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.kept)) for r in found) == sorted(want)


def test_long_texts_are_hashed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(run_index, "STRETCH", 500)
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text), (2, text[1777:4000]), (3, "q" + text[499:702] + "q")]
    found = {r.doc_id: r for r in run_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[(s.at, s.till) for s in found[i].spans] for i in (1, 2, 3)] == [[(499, 702), (1777, 4000)], [(0, 2223)], [(1, 204)]]


def test_index_states_the_longest_match_elsewhere():
    rng = random.Random(3)
    for _ in range(200):
        base = bytes(rng.randrange(rng.choice([1, 2, 3, 250])) for _ in range(60))
        texts = [base[(a := rng.randrange(60)) : a + rng.randrange(1, 60)] or b"x" for _ in range(rng.randint(1, 6))]
        ends = np.cumsum([len(t) for t in texts])
        index = run_index.RunIndex(np.frombuffer(b"".join(texts), np.uint8), ends)
        assert index.lengths.sum() == ends[-1] and len(index.heads) == len(index.tails) == len(index.symbols)
        suffixes = [(int(e) - len(t) + i, t[i:]) for t, e in zip(texts, ends, strict=True) for i in range(len(t))]
        common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B023, E731
        for i, x in suffixes:
            assert max(index.reaches()[i] - i, 0) == max((common(x, y) for j, y in suffixes if j != i), default=0)


def test_ngram_hashes_equal_those_of_the_bytes():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab Z9é \n-_ü漢") for _ in range(rng.choice([0, 3, 40, 400]))).encode() for _ in range(200)] + [None]
    prefixes = importance.Prefixes(texts)
    words = [re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t or b"")) for t in texts]
    for n in (1, 2, 3, 5):
        crc, many = prefixes.ngrams(n)
        assert crc.tolist() == [zlib.crc32(b" ".join(w[i : i + n])) for w in words for i in range(len(w) - n + 1)]
        assert many.tolist() == [max(0, len(w) - n + 1) for w in words]


def test_draws_equal_brute_force(spark):
    """Longer features, few buckets, repeated and null ids, texts of few words and none."""
    rng = random.Random(4)
    text = lambda v: " ".join(rng.choice(v) for _ in range(rng.randrange(30)))
    docs = [(i if i % 50 else None, text(["one", "two", "tre", "vier"]) if i % 9 else None, 1) for i in range(400)] + [(7, "one two one", 1)] * 3
    items = [("x", text(["one", "two"])) for _ in range(20)] + [("y", None)]
    low, high, buckets, least, share = 1, 3, 50, 3, 40
    found = importance.resample(
        spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(items, "item string, text string"), low, high, buckets, least, share
    ).collect()
    grams = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [(t or "").split()] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    s, t = (Counter(g for row in rows for g in grams(row[1])) for rows in (docs, items))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x, _ in docs:
        g = grams(x)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = None if i is None else int(sha(f"2024:{i}".encode())[:8], 16)
        rows.append([i, len((x or "").split()), len(g), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0], r[2], r[3]))
    drawn = [[*r, k + 1] for k, r in enumerate(able[: share * len(able) // 100])]
    want = Counter(map(str, drawn + [[*r, None] for r in able[len(drawn) :]] + [[*r, None] for r in rows if r[1] < least or r[4] is None]))
    assert Counter(str(list(r)) for r in found) == want and drawn


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    assert importance.resample(docs, docs).count() == run_index.remove_repeats(docs).count() == periodic_runs.find_runs(docs).count() == 0
    assert [r.weight for r in importance.resample(some, docs, share=100).collect()] == [math.floor(1000 * math.log(10060 / 21 / 10000))]


def runs(w: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All runs by comparing words every distance apart."""
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // exponent + 1):
        equal = np.append(np.array([a == b for a, b in zip(w, w[q:])], bool), False)
        edge = np.diff(np.concatenate([[0], equal.astype(int)]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
    return sorted(((i, n, q) for (i, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force(spark, sf_dir, docs):
    found = {r.doc_id: r for r in registry.queries()["op13_periodic_runs"](spark, sf_dir).collect()}
    code: dict[str, int] = {}
    planted = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(w), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        x = np.array([code.setdefault(t, len(code)) for t in w], np.int64)
        rows: dict[tuple[int, int], int] = {}
        for q in range(1, n // 4 + 1):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]])))
            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if j - i + q >= max(6, 4 * q):
                    rows.setdefault((i, j - i + q), q)
        want = sorted(((i, m, q) for (i, m), q in rows.items()), key=lambda r: (r[0], r[2]))
        gone = {k for i, m, q in want for k in range(i + q, i + m)}
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        r = found[d["doc_id"]]
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == sha("".join(f"{i},{m},{q}\n" for i, m, q in want).encode())
        assert r.collapsed_sha256 == sha(" ".join(t for k, t in enumerate(w) if k not in gone).encode())
        planted += bool(want)
    assert planted >= 5


def test_runs_of_small_alphabets_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, some = rng.choice([0, 1, 5, 7, 20, 60]), rng.choice([1, 2, 3, 9])
            w = [rng.randrange(some) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        bounds = np.cumsum([0, *map(len, texts)])
        for exponent, least in ((4, 6), (2, 2), (3, 6)):
            found = periodic_runs.runs_of(np.array([x for t in texts for x in t], np.int64), bounds, exponent, least)
            assert list(zip(*(x.tolist() for x in found))) == [(i + b, m, q) for b, t in zip(bounds.tolist(), texts) for i, m, q in runs(t, exponent, least)]


def test_runs_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (None, "a " * 6, "x"), (4, "a " * 5, "x"), (5, "\n".join(["k", *["é", "z"] * 4, "k"]), "x"), (5, "one", "x"), (6, "w " * 200_000, "x"), (7, "a a a a a a", "x"), (7, "a a a a a a", "x")]
    found = periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found)
    assert got == sorted([
        ("1", [], ""), ("2", [], ""), ("3", [], ""), ("None", [(0, 6, 1)], "a"), ("4", [], "a a a a a"), ("5", [(1, 8, 2)], "k é z k"), ("5", [], "one"), ("6", [(0, 200_000, 1)], "w"), ("7", [(0, 6, 1)], "a"), ("7", [(0, 6, 1)], "a"),
    ])


def test_hot_passage_in_ever_new_surroundings(spark, monkeypatch):
    """A passage in a third of all texts, each time between other words, is found everywhere and nothing else is."""
    monkeypatch.setattr(run_index, "MOST", 50)
    passage = " ".join(f"p{i * 7919 % 1000}" for i in range(80))
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.when(F.col("id") % 3 == 0, F.lit(passage)), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 512)).alias("text"))
    for r in run_index.remove_repeats(rows).collect():
        spans = [(s.at, s.till) for s in r.spans]
        if r.doc_id % 3:
            assert spans == []
        else:  # the blanks beside it, and letters that chance repeats
            assert len(spans) == 1 and 128 - 9 <= spans[0][0] <= 128 and spans[0][1] - (129 + len(passage)) in range(10)
