"""Corpus operators that SQL cannot express, against plain Python over whole tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import hidden_markov, jaccard_join, lm_score, mixing, quality_rules, registry, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()


def run(spark, sf_dir, name):
    return {r.doc_id: r for r in registry.queries()[name](spark, sf_dir).collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_base_scores_and_held_out_gain(spark, sf_dir, docs):
    tokens = {d["doc_id"]: [*WORD.findall(lower(d["text"])), ""] for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(t for i, x in tokens.items() if not held[i] for t in x)
    n, v = sum(c.values()), len(c)
    found = run(spark, sf_dir, "op3_lm_score")
    assert set(found) == set(tokens)
    for i, x in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(c[t] > 0 for t in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x), rel_tol=1e-9)
    assert sum(r.score for r in found.values() if r.held_out) > sum(r.base_score for r in found.values() if r.held_out)


def test_forward_and_counts_equal_sums_over_all_paths():
    rng = np.random.default_rng(0)
    rows = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    m = hidden_markov.Model(rows(3), rows(3, 3), np.ascontiguousarray(rows(3, 4).T))
    seqs = [np.array(s, np.uint16) for s in ([0, 3, 1, 2], [2], [1, 1])]
    want_counts, want = np.zeros(3 + 9 + 12), []
    for s in seqs:
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = [m.start[z[0]] * math.prod(m.move[a, b] for a, b in zip(z, z[1:])) * math.prod(m.emit[x, k] for x, k in zip(s, z)) for z in paths]
        want.append(math.log(sum(p)))
        for z, q in zip(paths, np.array(p) / sum(p)):
            want_counts[z[0]] += q
            for a, b in zip(z, z[1:]):
                want_counts[3 + 3 * a + b] += q
            for x, k in zip(s, z):
                want_counts[12 + 4 * k + x] += q
    assert np.allclose(hidden_markov.forward(m, seqs), want)
    for tokens in (1000, 3, 2, 1):  # in blocks of times too
        counts, total = hidden_markov.expectations(m, seqs, tokens)
        assert np.allclose(counts, want_counts) and math.isclose(total, sum(want))


def test_scores_equal_sums_over_all_words_and_states(spark, monkeypatch):
    """Symbols, classes and words beyond the broadcast table, against plain sums, under a model that is not trained."""
    monkeypatch.setattr(lm_score, "SYMBOL_WORDS", 5)
    monkeypatch.setattr(lm_score, "TABLE_WORDS", 12)
    model = None

    def untrained(encoded, unigram, rounds):
        nonlocal model
        model = hidden_markov.random_model(3, unigram)
        return model

    monkeypatch.setattr(lm_score, "train", untrained)
    rng = np.random.default_rng(8)
    vocabulary = [f"{'ABab'[i % 4]}w{i}é" for i in range(40)]
    rows = [(i, " ".join(vocabulary[int(k) % 40] for k in rng.pareto(0.7, int(rng.integers(0, 30))) * 3)) for i in range(60)] + [(None, "aw2é bw3é"), (61, None), (62, "never seen before " * 3)]
    found = lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = [[w.encode() for w in WORD.findall(lower(t))] + [b""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for x, h in zip(words, held, strict=True) if not h for w in x)
    frequent = [b"", *sorted((w for w in c if w), key=lambda w: (-c[w], w))]
    symbols = frequent[:5]
    of = lambda w: symbols.index(w) if w in symbols else 5 + zlib.crc32(w[-3:]) % lm_score.CLASSES
    size, kinds = Counter(), Counter()
    for w, n in c.items():
        if w not in symbols:
            size[of(w)] += n
            kinds[of(w)] += 1
    want = []
    for (i, _), x in zip(rows, words, strict=True):
        at = np.array(model.start, float)
        for n, w in enumerate(x):
            at = (at if n == 0 else at @ model.move) * model.emit[of(w)]
        score = math.log10(at.sum()) + sum(math.log10((c[w] + 0.5) / (size[of(w)] + 0.5 * (kinds[of(w)] + 1))) for w in x if w not in symbols)
        want.append((str(i), sum(c[w] > 0 for w in x), score))
    got = sorted((str(r.doc_id), r.n_known, r.score) for r in found)
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], rtol=1e-9)
    assert len(c) > 20 and any(w not in frequent[:12] for x in words for w in x)


def test_quality_statistics_and_verdicts(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op5_quality_rules")
    kept = 0
    for d in docs:
        text, w, r = d["text"] or "", WORD.findall(d["text"] or ""), found[d["doc_id"]]
        at = defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeated = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
        lines = Counter(x for x in text.split("\n") if WORD.search(x))
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (sum(lines.values()) - len(lines), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        assert not (r.kept and r.base_failed)
        kept += r.kept
    assert kept >= 0.9 * sum(not r.base_failed for r in found.values())


def targets(sizes, weights, total):
    """Shares by weight, those above three times their size stopped there, one after the other."""
    done = {}
    while True:
        level = (total - sum(done.values())) / sum(w for s, w in weights.items() if s not in done)
        over = [s for s in sizes if s not in done and level * weights[s] > 3 * sizes[s]]
        if not over:
            return {s: done.get(s, level * weights[s]) for s in sizes}
        done[min(over, key=lambda s: 3 * sizes[s] / weights[s])] = 0
        done = {s: 3 * sizes[s] for s in done}


def test_mix_meets_its_targets_and_repeats(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op6_mixing")
    again = run(spark, sf_dir, "op6_mixing")
    assert found == again
    sizes, taken = Counter(), Counter()
    for d in docs:
        r = found[d["doc_id"]]
        assert r.size == len(WORD.findall(d["text"] or "")) and r.taken <= 3 * r.size
        sizes[d["source"]] += r.size
        taken[d["source"]] += r.taken
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets(sizes, {s: float(i % 3 + 1) for i, s in enumerate(ordered)}, sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1
    for d in docs:
        assert found[d["doc_id"]].source_size == sizes[d["source"]] and math.isclose(found[d["doc_id"]].target, goal[d["source"]])


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    t.encode_special_tokens = True
    out, start = [], 0
    for d in sorted(rows, key=lambda d: d["doc_id"]):
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        out.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_hold_every_id(spark, sf_dir, docs):
    found = run(spark, sf_dir, "op7_token_files").values()
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in found) == encoded(docs)


def test_sketches_lower_bound_the_difference():
    rng = np.random.default_rng(1)
    none = jaccard_join.Rarity(np.empty(0, np.uint64), np.empty(0, np.int64))
    for n in (6, 30, 33, 40, 90, 400, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            gone = int(rng.integers(0, len(a) // 9 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 9 + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 5 * shared >= 4 * (len(a) + len(b) - shared):
                assert np.intersect1d(jaccard_join.bucket_keys(a, none), jaccard_join.bucket_keys(b, none)).size


def test_pipeline_stages_take_effect(spark, sf_dir, docs):
    kept = {i for i, r in run(spark, sf_dir, "op5_quality_rules").items() if r.kept}
    texts = {d["doc_id"]: d["text"] or "" for d in docs if d["doc_id"] in kept}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := lower(t).split())}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    single = {i for i in texts if find(i) == i}
    dirty = {i for i, r in run(spark, sf_dir, "op10_decontaminate").items() if r.contaminated}
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    want = {i: (n, crc) for i, _, n, crc in encoded(docs)}
    assert {r[1] for r in rows} <= single - dirty
    at = 0
    for start, i, n, crc in rows:
        assert (start, (n, crc)) == (at, want[i])
        at += n
    clean = pd.DataFrame([d for d in docs if d["doc_id"] in single - dirty])
    order = mixing.training_order(mixing.plan_mix(spark.createDataFrame(clean))).where("2 * words >= size or at = 0").collect()
    assert [r[1] for r in rows] == [r.doc_id for r in order]
    assert max(Counter(r[1] for r in rows).values()) <= 3


def least_determinant(x, floors, share, rng, starts=60, steps=30):
    """Exact h-subsets from random starts to convergence: mean and floored covariance of the least determinant."""
    h, best = int(np.ceil(share * len(x))), None
    for _ in range(starts):
        some = x[rng.choice(len(x), 8, replace=False)]
        mu, v = some.mean(0), np.cov(some.T, bias=True)
        for _ in range(steps):
            np.fill_diagonal(v, np.maximum(np.diag(v), floors**2))
            near = x[np.argsort(np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(v), x - mu))[:h]]
            mu, v = near.mean(0), np.cov(near.T, bias=True)
        np.fill_diagonal(v, np.maximum(np.diag(v), floors**2))
        if best is None or np.linalg.det(v) < best[0]:
            best = np.linalg.det(v), mu, v
    return best


def test_robust_estimates_equal_a_search_over_subsets(spark):
    """Groups with shifted bulks: the estimate is that of the least determinant, and only the planted vectors lie beyond the limit."""
    rng = np.random.default_rng(5)
    q = quality_rules
    mix = np.array([[0.3, 0, 0, 0], [0.05, 0.08, 0, 0], [0, 0.02, 0.25, 0], [0.02, 0, 0.03, 0.09]]) * q.UNIT
    bulk = rng.normal(size=(600, 4)) @ mix.T + np.array([1.5, 0.3, 0.4, 0.3]) * q.UNIT
    planted = rng.normal(size=(150, 4)) * 200 + np.array([4.5, 1.2, 0.1, 0.9]) * q.UNIT
    x = np.round(np.concatenate([bulk, planted])).astype(int)
    rows = [("a", *map(int, r), 1) for r in x] + [("b", *map(int, r), 1) for r in np.round(bulk[:300]).astype(int)]
    vectors = spark.createDataFrame(rows, "g string, x_0 long, x_1 long, x_2 long, x_3 long, m long")
    found = {r.g: r for r in q.covariance_estimates(vectors).collect()}
    scale = q.COVERED / q.chi2_cdf(q.chi2_quantile(q.COVERED, 4), 6)
    floors = np.array(list(q.FLOORS.values())) * q.UNIT
    for g, own in (("a", x), ("b", x[:300])):
        det, mu, v = least_determinant(own.astype(float), floors / np.sqrt(scale), q.COVERED, rng)
        mine = np.array([[found[g][f"v_{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)]) / scale
        assert np.linalg.det(mine) <= 1.1 * det
        assert np.all(np.abs(np.array([found[g][f"mu_{i}"] for i in range(4)]) - mu) < 0.25 * np.sqrt(np.diag(v)))
        far = np.einsum("ij,jk,ik->i", own - mu, np.linalg.inv(mine * scale), own - mu)
        beyond = far > q.chi2_quantile(1 - q.TAIL, 4)
        assert beyond[600:].all() and not beyond[: min(600, len(own))].any()


def squares(x: np.ndarray, mu: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances and the determinant's logarithm by a factor whose diagonal is 1 at least, as few documents may give no full rank."""
    low = np.zeros((4, 4))
    for j in range(4):
        low[j, j] = math.sqrt(max(v[j, j] - low[j] @ low[j], 1.0))
        for i in range(j + 1, 4):
            low[i, j] = (v[i, j] - low[i] @ low[j]) / low[j, j]
    return (np.linalg.solve(low, (x - mu).T) ** 2).sum(0), 2 * float(np.log(np.diag(low)).sum())


def concentrated(x: np.ndarray, floors: np.ndarray, q) -> tuple[np.ndarray, np.ndarray]:
    """The estimate as its docstring has it, in matrices: three starts, steps with the last bin in part, the least determinant."""
    lo, mid, hi = (np.quantile(x, p, axis=0) for p in (0.25, 0.5, 0.75))
    floored = lambda v: v + np.diag(np.maximum(floors**2 - np.diag(v), 0))
    starts = [(mid, np.diag(floors**2)), (mid, np.diag(np.maximum(0.7413 * (hi - lo), floors) ** 2)), (x.mean(0), floored(np.cov(x.T, bias=True).reshape(4, 4)))]
    scale, found = q.COVERED / q.chi2_cdf(q.chi2_quantile(q.COVERED, 4), 6), []
    for start, (mu, v) in enumerate(starts):
        for step in range(q.STEPS):
            d2, _ = squares(x, mu, v)
            bins = np.floor(q.FINE * np.log2(d2 + 0.001))
            due, weight = q.COVERED * len(x), np.zeros(len(x))
            for b in np.unique(bins):
                n = (bins == b).sum()
                weight[bins == b] = min(1.0, max(0.0, due / n))
                due -= n
            mu = weight @ x / weight.sum()
            v = floored(scale * ((x * weight[:, None]).T @ x / weight.sum() - np.outer(mu, mu)))
            found.append((round(squares(x, mu, v)[1], 3), start, step, mu, v))
    return min(found, key=lambda f: f[:3])[3:]


def test_distances_equal_those_of_blended_estimates(spark, sf_dir, docs):
    """The whole verdict again in numpy: vectors, estimates of three levels, how they lean on each other, distance and limit."""
    q, stats = quality_rules, run(spark, sf_dir, "op5_quality_rules")
    rows = [(d, stats[d["doc_id"]]) for d in docs if not stats[d["doc_id"]].base_failed]
    lines = [sum(bool(WORD.search(x)) for x in d["text"].split("\n")) for d, _ in rows]
    x = np.array([[math.log(max(r.word_chars / r.n_words, 0.1)), math.sqrt(r.n_symbols / r.word_chars), r.n_dup_lines / n, r.n_repeat_words / r.n_words] for (_, r), n in zip(rows, lines, strict=True)])
    x = np.floor(x * q.UNIT + 0.5)
    floors, vague = (np.array(list(v.values())) * q.UNIT for v in (q.FLOORS, q.VAGUE))
    keys = [(None, d["lang"], (d["lang"], d["source"])) for d, _ in rows]
    own = {k: np.flatnonzero([key[level] == k for key in keys]) for level in range(3) for k in {key[level] for key in keys} if level or k is None}
    estimates: dict = {}
    blends: dict = {}
    for key in set(keys):
        m, v = None, np.diag(vague**2)
        for level, k in enumerate(key):
            at = own[k] if level else np.arange(len(x))
            if (level, k) not in estimates:
                estimates[level, k] = concentrated(x[at], floors, q)
            mu, e = estimates[level, k]
            w = len(at) / (len(at) + q.PRIOR)
            m, v = (mu, w * e + (1 - w) * v) if m is None else (w * mu + (1 - w) * m, w * e + (1 - w) * v + w * (1 - w) * np.outer(mu - m, mu - m))
        blends[key] = m, v
    far = np.array([math.sqrt(squares(z[None], *blends[k])[0][0]) for z, k in zip(x, keys, strict=True)])
    assert np.allclose([r.distance for _, r in rows], far, atol=2e-3)
    limit = math.sqrt(q.chi2_quantile(1 - q.TAIL, 4))
    assert all(r.kept == (f <= limit) for (_, r), f in zip(rows, far, strict=True) if abs(f - limit) > 0.01)


def test_one_odd_document_is_rejected(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    rows = [(i, " ".join(word(int(rng.integers(3, 8))) for _ in range(120)), "en", "s") for i in range(300)]
    rows += [(1000, " ".join(word(40) for _ in range(120)), "en", "s"), (1001, " ".join(f"{word(4)}#$" for _ in range(120)), "en", "tiny")]
    kept = {r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(300))


def test_positions_follow_the_schedules(spark, sf_dir):
    """Words trained up to a time are the integral of the source's schedule up to it, and the order is that of positions."""
    plan = mixing.plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = mixing.training_order(plan).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    ordered = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    for k, source in enumerate(ordered):
        knots = mixing.SCHEDULES[float(k % 3 + 1)]
        own = [r for r in rows if r.source == source]
        total, at = sum(r.words for r in own), 0
        grid = np.linspace(0, 1, 20_001)
        weight = np.interp(grid, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        for r in own:
            assert abs(np.interp(r.position, grid, area / area[-1]) - (at + r.words / 2) / total) < 1e-6
            at += r.words


def test_every_source_with_a_target_is_mixed(spark):
    """A source whose target is less than half its one document is taken all the same."""
    docs = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 10, None), (4, "w " * 10, None)], "doc_id long, text string, source string")
    flat = lambda s: s.withColumn("weight", F.lit(1.0))
    plan = {r.doc_id: r for r in mixing.plan_mix(docs, weigh=flat, share=0.3).collect()}
    assert (plan[1].taken, plan[2].taken, plan[3].taken + plan[4].taken) == (30, 219, 60)
    assert {r.doc_id for r in mixing.mix_documents(docs, weigh=flat, share=0.3).collect()} == {1, 2, 3, 4}
