"""Operator 5: quality rules and robust multivariate outliers (DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.text import SPACES, words
from tidemark.tables import cut, small, table

SYMBOLS = r"[#*$%&|<>]"
SHINGLE = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Base rules: fewer words, or more words in repeated windows (percent), fail.
MIN_WORDS, MAX_REPEAT = 10, 20
#: Transformed statistics and the least standard deviation each is given.
FLOORS = {"word_length": 0.12, "symbols": 0.03, "dup_lines": 0.1, "repeats": 0.035}
#: Standard deviations that stand for those of about PRIOR documents beside all documents; these stand so beside a language, and it beside a source.
VAGUE, PRIOR = {"word_length": 0.5, "symbols": 0.2, "dup_lines": 0.5, "repeats": 0.2}, 50
#: The share of a group that the estimate covers, concentration steps, and bins of the squared distance to a doubling.
COVERED, STEPS, FINE = 0.7, 5, 32
#: Rows of estimates (a few for each source) that may be broadcast.
ESTIMATE_ROWS = 50_000
#: The chance that a document like the covered ones is rejected.
TAIL = 1e-5
UNIT = 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column, k: int = SHINGLE) -> Column:
    """The number of words of array ``w`` that lie in a k-word window found twice or more.

    Windows are hashed into the high bits of a long, their place into the low bits; sorted,
    equal hashes are neighbours. Those few are compared by their words.
    """
    def of_hashes(h: Column) -> Column:
        places = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h).cast("long")))) - 1
        return let(places, lambda m: let(F.sort_array(F.transform(
            F.sequence(F.lit(0).cast("long"), F.size(h).cast("long") - k),
            lambda i: F.xxhash64(*[F.get(h, (i + j).cast("int")) for j in range(k)]).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i),
        )), lambda s: among(s, m)))

    def alike(x: Column, y: Column, m: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(y) <= m, F.lit(False)) & F.coalesce(x.bitwiseXOR(y) >= 0, F.lit(False))

    def among(s: Column, m: Column) -> Column:
        found = F.filter(s, lambda x, j: alike(x, F.get(s, j - 1), m) | alike(x, F.get(s, j + 1), m))
        return F.when(F.size(found) == 0, F.lit(0).cast("long")).otherwise(let(F.transform(found, lambda x: x.bitwiseAND(m).cast("int")), exact))

    def exact(places: Column) -> Column:
        named = F.sort_array(F.transform(places, lambda p: F.struct(F.concat_ws(" ", *[F.get(w, p + j) for j in range(k)]).alias("t"), p.alias("p"))))
        twice = lambda c: F.filter(c, lambda x, j: F.coalesce(x.t == F.get(c, j - 1).t, F.lit(False)) | F.coalesce(x.t == F.get(c, j + 1).t, F.lit(False)))
        starts = let(named, lambda c: F.sort_array(F.transform(twice(c), lambda x: x.p)))
        return let(starts, lambda c: F.aggregate(
            F.transform(c, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(c, j + 1) - p, F.lit(k))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
        ))

    return F.when(F.size(w) <= k, F.lit(0).cast("long")).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))


def text_stats(text: Column) -> Column:
    """Struct of STATS for a whole text; null text has no words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    ))


def vector() -> list[Column]:
    """The transformed statistics in whole units of 1/UNIT, so that their sums are exact."""
    n = F.greatest("n_words", F.lit(1))
    x = (
        F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1))),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        F.col("n_repeat_words") / n,
    )
    return [F.round(v * UNIT).cast("long").alias(name) for v, name in zip(x, (f"x_{i}" for i in range(len(FLOORS))), strict=True)]


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, dof) < p else (lo, mid)
    return hi


P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
LEVELS = ["g0", "g1", "g2"]
#: Groups by level: all documents, a language, a source in it.
GROUPS = {"g0": "'0'", "g1": "concat('1', coalesce(hex(lang), '-'))", "g2": "concat('2', coalesce(hex(lang), '-'), '/', coalesce(hex(source), '-'))"}
# Expressions below are (name, text) in an order in which later ones may use earlier ones; they serve ORACLE too.
Named = list[tuple[str, str]]


def _floored() -> Named:
    """v_ij from mu_i and the raw covariances c_ij, whose variances are bounded from below by FLOORS."""
    floors = [(x * UNIT) ** 2 for x in FLOORS.values()]
    return [(f"v_{i}{j}", f"greatest(c_{i}{j}, {floors[i]!r})" if i == j else f"c_{i}{j}") for i, j in PAIRS]


def _factored() -> Named:
    """The Cholesky factor l_ij of v_ij and the logarithm of its determinant, to 3 decimals: nearer ones are ties."""
    out = []
    for i, j in sorted(PAIRS, key=lambda x: (x[1], x[0])):
        rest = "".join(f" - l_{i}{k} * l_{j}{k}" for k in range(j))
        out.append((f"l_{i}{j}", f"sqrt(greatest(v_{i}{j}{rest}, 1.0))" if i == j else f"(v_{i}{j}{rest}) / l_{j}{j}"))
    return [*out, ("logdet", "round(" + " + ".join(f"2 * ln(l_{i}{i})" for i in range(P)) + ", 3)")]


def _distances() -> Named:
    """d2, the squared Mahalanobis distance of the row's vector x_i from mu_i under the factor l_ij."""
    out = [(f"z_{i}", f"(x_{i} - mu_{i}" + "".join(f" - l_{i}{k} * z_{k}" for k in range(i)) + f") / l_{i}{i}") for i in range(P)]
    return [*out, ("d2", " + ".join(f"z_{i} * z_{i}" for i in range(P)))]


def _starts() -> dict[int, Named]:
    """Three starting points from a group's quartiles lo_i, mid_i and hi_i, sums s_i and q_ij and count n."""
    floors = [x * UNIT for x in FLOORS.values()]
    middle = [(f"mu_{i}", f"cast(mid_{i} as double)") for i in range(P)]
    diagonal = lambda of: [(f"l_{i}{j}", of(i) if i == j else "cast(0.0 as double)") for i, j in PAIRS]
    means = [(f"mu_{i}", f"cast(s_{i} as double) / n") for i in range(P)]
    raw = [(f"c_{i}{j}", f"cast(q_{i}{j} as double) / n - mu_{i} * mu_{j}") for i, j in PAIRS]
    return {
        0: middle + diagonal(lambda i: f"cast({floors[i]!r} as double)"),
        1: middle + diagonal(lambda i: f"greatest(0.7413 * (hi_{i} - lo_{i}), {floors[i]!r})"),
        2: means + raw + _floored() + _factored(),
    }


STATE = [f"mu_{i}" for i in range(P)] + [f"l_{i}{j}" for i, j in PAIRS]
SUMS = [f"s_{i}" for i in range(P)] + [f"q_{i}{j}" for i, j in PAIRS]
BIN = f"cast(floor({FINE} * log2(d2 + 0.001)) as int)"


def _covered() -> Named:
    """From a group's bins (n, SUMS, before, total): the same of its COVERED share h, of the last bin as much as is due."""
    whole, last = f"before + n <= {COVERED} * total", f"before < {COVERED} * total AND before + n > {COVERED} * total"
    out = [("n", "max(total)"), ("h", f"{COVERED} * max(total)")]
    return out + [
        (f"t{x}", f"coalesce(cast(sum({x}) FILTER (WHERE {whole}) as double), 0.0) + coalesce(max(({COVERED} * total - before) / n * cast({x} as double)) FILTER (WHERE {last}), 0.0)")
        for x in SUMS
    ]


def _estimated() -> Named:
    """mu_i, v_ij, l_ij and logdet of a group's covered share, made consistent for normal vectors."""
    scale = COVERED / chi2_cdf(chi2_quantile(COVERED, P), P + 2)
    means = [(f"mu_{i}", f"ts_{i} / h") for i in range(P)]
    return means + [(f"c_{i}{j}", f"{scale!r} * (tq_{i}{j} / h - mu_{i} * mu_{j})") for i, j in PAIRS] + _floored() + _factored()


def _blended() -> Named:
    """mu_i and v_ij of a source's estimate (mu2_i, v2_ij, n2), to which its language's (1) adds as PRIOR documents, to that all documents' (0) and to that VAGUE."""
    vague = [(x * UNIT) ** 2 for x in VAGUE.values()]
    out = [(f"w{k}", f"n{k} / (n{k} + {float(PRIOR)!r})") for k in range(3)]
    out += [(f"m0_{i}", f"mu0_{i}") for i in range(P)] + [(f"b0_{i}{j}", f"w0 * v0_{i}{j}" + (f" + (1 - w0) * {vague[i]!r}" if i == j else "")) for i, j in PAIRS]
    for k in (1, 2):
        out += [(f"m{k}_{i}", f"w{k} * mu{k}_{i} + (1 - w{k}) * m{k - 1}_{i}") for i in range(P)]
        out += [(f"b{k}_{i}{j}", f"w{k} * v{k}_{i}{j} + (1 - w{k}) * b{k - 1}_{i}{j} + w{k} * (1 - w{k}) * (mu{k}_{i} - m{k - 1}_{i}) * (mu{k}_{j} - m{k - 1}_{j})") for i, j in PAIRS]
    return out + [(f"mu_{i}", f"m2_{i}") for i in range(P)] + [(f"v_{i}{j}", f"b2_{i}{j}") for i, j in PAIRS]


def _with(df: DataFrame, named: Named) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in named])


def covariance_estimates(vectors: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates: g, n, mu_i and v_ij of each group of ``vectors`` (g, x_i, m times).

    From each of three starting points (medians with the floors or the quartiles' spread,
    means with the whole covariance), STEPS concentration steps keep the COVERED share of a
    group with the least distances, of the last bin of their logarithms as much as is due, and
    estimate again from it. Of all a group's estimates the one with the least determinant is
    taken. Every step is one pre-aggregated pass over the distinct vectors, whose number the
    UNIT of the coordinates bounds; sums are of whole numbers, so the order of rows is no matter.
    """
    m = lambda e: f"sum(cast(m * {e} as decimal(38,0)))"
    sums = [(f"s_{i}", m(f"x_{i}")) for i in range(P)] + [(f"q_{i}{j}", m(f"cast(x_{i} * x_{j} as decimal(20,0))")) for i, j in PAIRS]
    quartiles = [f"percentile(x_{i}, {p}, m) AS {n}_{i}" for i in range(P) for n, p in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))]
    whole = cut(vectors.groupBy("g").agg(F.sum("m").alias("n"), *[F.expr(f"{e} AS {n}") for n, e in sums], *map(F.expr, quartiles)), "whole")
    current = None
    for k, named in _starts().items():
        one = _with(whole, named).select("g", F.lit(k).alias("start"), *STATE)
        current = one if current is None else current.union(one)
    found, current = None, cut(current, "starts")
    for step in range(STEPS):
        far = _with(vectors.join(small(current, ESTIMATE_ROWS), "g"), [*_distances(), ("bin", BIN)])
        binned = far.groupBy("g", "start", "bin").agg(F.sum("m").alias("n"), *[F.expr(f"{e} AS {n}") for n, e in sums])
        own = Window.partitionBy("g", "start")
        placed = binned.withColumns({"before": F.sum("n").over(own.orderBy("bin")) - F.col("n"), "total": F.sum("n").over(own)})
        new = cut(_with(placed.groupBy("g", "start").agg(*[F.expr(f"{e} AS {n}") for n, e in _covered()]), _estimated()).withColumn("step", F.lit(step)), "mcd")
        found, current = new if found is None else found.union(new), new.select("g", "start", *STATE)
    best = F.row_number().over(Window.partitionBy("g").orderBy("logdet", "start", "step"))
    return found.withColumn("best", best).where("best = 1").select("g", "n", *[f"mu_{i}" for i in range(P)], *[f"v_{i}{j}" for i, j in PAIRS])


def judge_quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): doc_id, r (hash of the text),
    STATS, base_failed, distance and kept.

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT percent of them in repeated
    windows. The others are outliers if their vector (log word length, root of symbols per
    character, shares of repeated lines and repeated words) lies beyond the 1 - TAIL quantile
    of Mahalanobis distance from the robust estimate of its language and source. To that the
    language's estimate is added with the weight of PRIOR documents, to the language's that of
    all documents, and to theirs the wide spread VAGUE: small groups lean on larger ones, at
    every size alike. FLOORS bound variances from below, so that statistics which never vary
    do not make the first odd character an outlier; the least distances from the centre that
    reject alone follow from them.

    Null text has no words and fails. Null language or source is a group of its own. Repeated
    rows each count and are judged alike. Extra columns are ignored. An empty table gives an
    empty result.
    """
    stats = docs.select("doc_id", F.xxhash64("text").alias("r"), "lang", "source", text_stats(F.col("text")).alias("s")).select("doc_id", "r", "lang", "source", "s.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    stats = cut(stats.withColumn("base_failed", failed).select("*", *vector()), "stats")
    x = [f"x_{i}" for i in range(P)]
    usual = stats.where("not base_failed").groupBy("lang", "source", *x).agg(F.count("*").alias("m"))
    usual = cut(_with(usual, list(GROUPS.items())), "vectors")
    # a vector counts for its source, its language and all documents
    vectors = usual.groupBy("g2", *x).agg(F.sum("m").alias("m")).select(F.col("g2").alias("g"), *x, "m")
    for level in ("g1", "g0"):
        vectors = vectors.union(usual.groupBy(level, *x).agg(F.sum("m").alias("m")).select(F.col(level).alias("g"), *x, "m"))
    estimates = covariance_estimates(cut(vectors, "levels"))
    groups = usual.select(*LEVELS).distinct()
    for k, level in enumerate(LEVELS):
        own = estimates.select(F.col("g").alias(level), F.col("n").alias(f"n{k}"), *[F.col(f"mu_{i}").alias(f"mu{k}_{i}") for i in range(P)], *[F.col(f"v_{i}{j}").alias(f"v{k}_{i}{j}") for i, j in PAIRS])
        groups = groups.join(small(own, ESTIMATE_ROWS), level)
    blended = cut(_with(_with(groups, _blended()).select("g2", *[f"mu_{i}" for i in range(P)], *[f"v_{i}{j}" for i, j in PAIRS]), _factored()).select("g2", *STATE), "blended")
    placed = _with(stats, [("g2", GROUPS["g2"])]).join(small(blended, ESTIMATE_ROWS), "g2", "left")
    judged = _with(placed, _distances()).withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))
    limit = math.sqrt(chi2_quantile(1 - TAIL, P))
    return judged.select("doc_id", "r", *STATS, "base_failed", "distance", (~F.col("base_failed") & (F.col("distance") <= limit)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that judge_quality keeps, with all their columns; null and empty texts go, repeated rows alike. An empty table stays empty."""
    gone = small(cut(judge_quality(docs).where("not kept").select(F.col("doc_id").alias("d"), "r").distinct(), "rejected"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["d"]) & (F.xxhash64(docs["text"]) == gone["r"]), "left_anti")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, the statistics, base_failed, kept, and the distance (4 decimals)."""
    return judge_quality(table(spark, sf_dir, "documents")).drop("r").withColumn("distance", F.round("distance", 4))


def _select(named: Named, source: str, only: list[str] | None = None) -> str:
    """SQL of _with, or of its columns ``only``."""
    inner = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in named)} FROM {source}"
    return f"SELECT {', '.join(only)} FROM ({inner})" if only else inner


def _oracle() -> str:
    x = ", ".join(f"x_{i}" for i in range(P))
    sums = ", ".join([f"sum(x_{i}) AS s_{i}" for i in range(P)] + [f"sum(x_{i}::HUGEINT * x_{j}) AS q_{i}{j}" for i, j in PAIRS])
    quartiles = ", ".join(f"quantile_cont(x_{i}, {p}) AS {n}_{i}" for i in range(P) for n, p in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75)))
    state, kept = ", ".join(STATE), ", ".join([f"mu_{i}" for i in range(P)] + [f"v_{i}{j}" for i, j in PAIRS])
    starts = " UNION ALL ".join(_select(named, "whole_groups", ["g", f"{k} AS start", *STATE]) for k, named in _starts().items())
    steps, last = [], "starts"
    for k in range(STEPS):
        steps.append(f"""far{k} AS (SELECT v.g, start, {x}, {BIN} AS bin FROM ({_select(_distances(), f'(SELECT v.*, {", ".join("e." + c for c in ["start", *STATE])} FROM levels v JOIN {last} e ON v.g = e.g)')}) v),
bins{k} AS (SELECT *, (sum(n) OVER (PARTITION BY g, start ORDER BY bin) - n)::DOUBLE AS before, (sum(n) OVER (PARTITION BY g, start))::DOUBLE AS total
  FROM (SELECT g, start, bin, count(*) AS n, {sums} FROM far{k} GROUP BY g, start, bin)),
mcd{k} AS MATERIALIZED ({_select(_estimated(), f"(SELECT g, start, {k} AS step, {', '.join(f'{e} AS {n}' for n, e in _covered())} FROM bins{k} GROUP BY g, start)")})""")
        last = f"mcd{k}"
    found = " UNION ALL ".join(f"SELECT g, n, start, step, logdet, {kept} FROM mcd{k}" for k in range(STEPS))
    level = lambda k: f"(SELECT g AS g{k}, n AS n{k}, {', '.join([f'mu_{i} AS mu{k}_{i}' for i in range(P)] + [f'v_{i}{j} AS v{k}_{i}{j}' for i, j in PAIRS])} FROM best)"
    symbols = SYMBOLS.replace("'", "''")
    vectors = (
        f"round({UNIT} * ln(greatest(word_chars::DOUBLE / greatest(n_words, 1), 0.1)))::BIGINT AS x_0", f"round({UNIT} * sqrt(n_symbols::DOUBLE / greatest(word_chars, 1)))::BIGINT AS x_1",
        f"round({UNIT} * (n_dup_lines::DOUBLE / greatest(n_lines, 1)))::BIGINT AS x_2", f"round({UNIT} * (n_repeat_words::DOUBLE / greatest(n_words, 1)))::BIGINT AS x_3",
    )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACES[1:-2]}]+') AS w FROM documents),
ls AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{SPACES[1:-2]}]') GROUP BY r),
grams AS (SELECT r, i, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d WHERE len(w) >= {SHINGLE})),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {SHINGLE})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1) GROUP BY r),
st AS MATERIALIZED (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{symbols}'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN ls ON d.r = ls.r LEFT JOIN rep ON d.r = rep.r),
sx AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, {', '.join(vectors)}, {', '.join(f'{e} AS {n}' for n, e in GROUPS.items())} FROM st),
levels AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {g} AS g, {x} FROM sx WHERE NOT base_failed' for g in GROUPS)}),
whole_groups AS MATERIALIZED (SELECT g, count(*) AS n, {sums}, {quartiles} FROM levels GROUP BY g),
starts AS MATERIALIZED ({starts}),
{", ".join(steps)},
best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY logdet, start, step) AS k FROM ({found})) WHERE k = 1),
groups AS (SELECT DISTINCT g0, g1, g2 FROM sx WHERE NOT base_failed),
joined AS (SELECT * FROM groups JOIN {level(0)} USING (g0) JOIN {level(1)} USING (g1) JOIN {level(2)} USING (g2)),
blended AS MATERIALIZED ({_select(_factored(), "(" + _select(_blended(), "joined", ["g2", *kept.split(", ")]) + ")", ["g2", *STATE])}),
judged AS ({_select(_distances(), f"(SELECT sx.*, {state} FROM sx LEFT JOIN blended ON sx.g2 = blended.g2)")})
SELECT doc_id, {', '.join(STATS)}, base_failed, CASE WHEN NOT base_failed THEN round(sqrt(d2), 4) END AS distance, NOT base_failed AND sqrt(d2) <= {math.sqrt(chi2_quantile(1 - TAIL, P))!r} AS kept FROM judged
"""


ORACLE = _oracle()
