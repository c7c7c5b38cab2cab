"""Operator 6: mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.text import words
from tidemark.tables import cut, small, table

MAX_REPEAT = 3.0
#: Hexadecimal digits of a document's place in its source's walk.
ORDER_DIGITS = 15
#: Weight schedules as (time, weight) knots; one for each base weight of the production mix.
SCHEDULES = {1.0: [(0.0, 1.5), (1.0, 0.5)], 2.0: [(0.0, 1.0), (1.0, 1.0)], 3.0: [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)]}
FLAT = [(0.0, 1.0), (1.0, 1.0)]


def ranked_weights(sources: DataFrame) -> DataFrame:
    """``sources`` (a row for each) with weights 1, 2, 3, repeating, in code point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    return sources.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))


def with_targets(weighted: DataFrame, share: float = 1.0, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``weighted`` (source, size, weight, a row for each source) with target.

    ``share`` of all words is dealt by weight; a source stops at max_repeat times its size and
    the excess is reshared until none is above. All sources that a level exceeds are stopped
    at once, so rounds are few; each is one aggregate of two numbers.
    """
    stop = max_repeat * F.col("size")
    total = share * float(weighted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    level, before = 0.0, None
    while level != before:
        stopped = stop <= F.lit(level) * F.col("weight")
        x = weighted.where("weight > 0").agg(F.sum(F.when(stopped, stop).otherwise(0.0)).alias("stopped"), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        before = level
        if not x.weight:
            break
        level = max(level, (total - x.stopped) / x.weight)
    return weighted.withColumn("target", F.when(F.col("weight") > 0, F.least(stop, F.lit(level) * F.col("weight"))).otherwise(0.0))


def segments(knots: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """(t0, length, w0, w1, c0, c1): a piecewise linear schedule with its integral scaled to 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, c = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        part = (t1 - t0) * (w0 + w1) / 2 / area
        out.append((t0, t1 - t0, w0 / area, w1 / area, c, c + part))
        c += part
    return out


def _when_due(demand: Column) -> Column:
    """The time at which a source's integrated schedule reaches the share ``demand`` of its tokens."""
    fits = F.filter("segments", lambda s: (s.c1 > s.c0) & (demand <= s.c1))
    s = F.coalesce(F.get(fits, F.lit(0)), F.element_at("segments", -1))
    rest = F.greatest(F.least(demand, s.c1) - s.c0, F.lit(0.0))
    under = F.greatest(s.w0 * s.w0 + 2 * (s.w1 - s.w0) / s.length * rest, F.lit(0.0))
    below = s.w0 + F.sqrt(under)
    return s.t0 + F.when(below > 0, 2 * rest / below).otherwise(F.lit(0.0))


def plan_mix(docs: DataFrame, weigh=ranked_weights, share: float = 1.0, max_repeat: float = MAX_REPEAT, schedules: dict | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, r (hash of the text), source, size, source_size,
    target, taken and pieces (array of epoch, words, at, position).

    size is the number of words. Sources get ``share`` of all words by the weights that
    ``weigh`` gives them, at most ``max_repeat`` times what they have. Each source is walked in
    a fixed pseudo-random order, as many whole times as its target allows and then up to the
    exact word at which the target is reached. A piece's position in [0, 1] is the time at
    which the source's integrated weight schedule has asked for the words up to its middle;
    ``schedules`` has the knots by weight, others are flat.

    The walk needs running sums: sizes are summed by slices of the hash order first, so that
    neither a source with a third of all rows nor the whole table meets in one task; a slice
    holds about sqrt(rows) rows. Sources stay a table, of a row for each; two numbers a round
    reach the driver.

    Null text has size 0; null source is a source of its own, last in order. Documents of size
    0 are taken 0 times with no pieces. Rows that repeat an id are separate documents. An
    empty table gives an empty result.
    """
    schedules = SCHEDULES if schedules is None else schedules
    spark = docs.sparkSession
    order = F.conv(F.substring(F.md5(F.concat(F.lit("6:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, ORDER_DIGITS), 16, 10).cast("long")
    sized = cut(docs.select("doc_id", F.xxhash64("text").alias("r"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), order.alias("o")), "sized")
    sources = cut(weigh(sized.groupBy("source").agg(F.sum("size").alias("size"))), "sources")
    knots = spark.createDataFrame(
        [(float(w), [tuple(map(float, x)) for x in segments(k)]) for w, k in schedules.items()] + [(None, [tuple(map(float, x)) for x in segments(FLAT)])],
        "w double, segments array<struct<t0:double,length:double,w0:double,w1:double,c0:double,c1:double>>",
    )
    scheduled = F.when(F.col("weight").isin(*map(float, schedules)), F.col("weight"))
    params = small(cut(with_targets(sources, share, max_repeat).join(F.broadcast(knots), scheduled.eqNullSafe(F.col("w"))).select(
        F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "segments"
    ), "params"), 20_000)
    n = sized.count()
    bits = max(0, math.ceil(math.log2(max(1.0, n / max(500.0, math.sqrt(n))))))
    placed = sized.withColumn("slice", F.shiftright("o", 4 * ORDER_DIGITS - bits))
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = sums.select(
        F.col("source").alias("s1"), F.col("slice").alias("k1"),
        (F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")).alias("before"),
    )
    within = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("o", "doc_id", "size", "r").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("within", within)
    joined = ranked.join(before, F.col("source").eqNullSafe(F.col("s1")) & (F.col("slice") == F.col("k1"))).join(
        params, F.col("source").eqNullSafe(F.col("s"))
    )
    c0 = F.col("before") + F.col("within") - F.col("size")
    budget = F.round("target").cast("long")
    last = F.floor(F.greatest(budget - 1, F.lit(0)) / F.greatest("source_size", F.lit(1))).cast("long")
    piece = lambda e: F.struct(
        e.alias("epoch"),
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - e * F.col("source_size") - F.col("c0"))).cast("long").alias("words"),
        (e * F.col("source_size") + F.col("c0")).alias("at"),
    )
    pieces = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), piece), lambda p: p.words > 0)
    out = joined.select("*", c0.alias("c0"), budget.alias("budget"), last.alias("last")).withColumn("raw", pieces)
    return out.select(
        "doc_id", "r", "source", "size", "source_size", "target",
        F.aggregate("raw", F.lit(0).cast("long"), lambda a, p: a + p.words).alias("taken"),
        F.transform("raw", lambda p: F.struct(p.epoch.alias("epoch"), p.words.alias("words"), p["at"].alias("at"), _when_due((p["at"] + p.words / 2) / F.col("budget")).alias("position"))).alias("pieces"),
    )


def training_order(plan: DataFrame) -> DataFrame:
    """The pieces of a plan, one row each, range-sorted by training position."""
    return (
        plan.select("doc_id", "r", "source", "size", F.explode("pieces").alias("p"))
        .select("doc_id", "r", "source", "size", "p.epoch", "p.words", "p.at", "p.position")
        .orderBy("position", "doc_id", "r", "epoch")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in training order: each row once for every piece of at least half its words.

    A source's first piece is taken however short it is, so that no source with a target goes.
    Rows equal in id and text are one document here; null ids and texts join as equals, null
    and empty texts have no words and are not taken. Texts stay whole; all columns of ``docs``
    pass through, whatever their names. Written to files, rows keep the order of positions.
    An empty table gives an empty result.
    """
    plan = plan_mix(docs, **options)
    taken = training_order(plan).where("2 * words >= size or at = 0").select(F.col("doc_id").alias("d"), "r", "epoch", "position").distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d0"), F.xxhash64("text").alias("r0")).dropDuplicates(["d0", "r0"])
    return row.join(taken, F.col("d0").eqNullSafe(F.col("d")) & (F.col("r0") == F.col("r"))).orderBy("position", "d0", "r0", "epoch").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns]
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, size, source_size, target, taken, and its first training position (9 decimals)."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", F.round(F.array_min(F.transform("pieces", lambda p: p.position)), 9).alias("first_position")
    ).orderBy("first_position", "doc_id")


def _due(x: str) -> str:
    """SQL of the time at which the schedule of weight w reaches the share x: the roots of each linear segment's integral."""
    out = []
    for w, knots in SCHEDULES.items():
        parts = [f"WHEN {x} <= {c1!r} THEN {t0!r} + 2 * ({x} - {c0!r}) / ({w0!r} + sqrt({w0!r} * {w0!r} + 2 * ({w1!r} - {w0!r}) / {n!r} * ({x} - {c0!r})))" for t0, n, w0, w1, c0, c1 in segments(knots)]
        out.append(f"WHEN w = {w!r} THEN CASE {' '.join(parts)} END")
    return f"CASE {' '.join(out)} END"


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('6:' || coalesce(doc_id::VARCHAR, '')), 1, {ORDER_DIGITS}))::BIGINT AS o FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, {MAX_REPEAT} * size AS most FROM s0),
s2 AS (SELECT *, most / w AS ratio, sum(size) OVER () AS total,
    coalesce(sum(most) OVER (ORDER BY most / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(w) OVER (ORDER BY most / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
lv AS (SELECT coalesce(max((total - stopped) / rest) FILTER ((total - stopped) / rest <= ratio), max(ratio)) AS level FROM s2),
s3 AS (SELECT source, size AS source_size, w, least(most, level * w)::DOUBLE AS target, round(least(most, level * w))::BIGINT AS budget FROM s2, lv),
c AS (SELECT d.*, source_size, w, target, budget,
    (sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS c0
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
p AS (SELECT doc_id, size, source_size, target, w, budget, c0, e * source_size + c0 AS pos, greatest(0, least(size, budget - e * source_size - c0)) AS words
  FROM c, range(0, {int(MAX_REPEAT)} + 1) AS r(e)),
q AS (SELECT *, (pos + words / 2) / budget AS x FROM p WHERE words > 0)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(m.taken, 0)::BIGINT AS taken, m.first_position
FROM c LEFT JOIN (SELECT doc_id, c0, sum(words) AS taken, round(min({_due('x')}), 9) AS first_position FROM q GROUP BY doc_id, c0) m ON c.doc_id = m.doc_id AND c.c0 = m.c0 AND c.size > 0
"""
