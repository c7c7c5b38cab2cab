"""Operator 13: periodic runs of words, by branching tandem repeats in an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.text import words
from tidemark.llm.tokenizing import slices
from tidemark.tables import table

#: A run holds its period at least EXPONENT times and is LEAST words long at least.
EXPONENT, LEAST = 4, 6
RUNS = "array<struct<start:long,length:long,period:long>>"


class SuffixArray:
    """Suffix, inverse and LCP arrays of many sequences at once; suffixes end with their sequence.

    ``codes`` are the words' numbers, ``bounds`` where each sequence starts and the last one
    ends. Suffixes are sorted by prefix doubling, and of each round only those still tied. A
    round's ranks are kept: equal ranks of round h mean that 2^h words are equal, which gives
    common extensions to either side in as many steps as there are rounds.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(codes)
        sequence = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.start, self.end = bounds[sequence], bounds[sequence + 1]
        key = sequence * (int(codes.max(initial=0)) + 1) + codes
        self.sa = np.argsort(key, kind="stable")
        key = key[self.sa]
        first = np.append(True, key[1:] != key[:-1])[:n]
        rank = np.empty(n, np.int64)
        rank[self.sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.levels, reach = [rank], 1
        while (at := np.flatnonzero(~(first & np.append(first[1:], True)))).size:
            some = self.sa[at]
            after = some + reach
            key = rank[some] * (n + 1) + np.where(after < self.end[some], rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            some, key = some[order], key[order]
            self.sa[at] = some
            first[at[1:]] |= key[1:] != key[:-1]
            rank = rank.copy()
            rank[some] = np.maximum.accumulate(np.where(first[at], at, 0))
            self.levels.append(rank)
            reach *= 2
        self.isa = rank
        self.lcp = np.zeros(n, np.int64)
        tied = 1 + np.flatnonzero(self.levels[0][self.sa[1:]] == self.levels[0][self.sa[:-1]])
        self.lcp[tied] = self.extension(self.sa[tied - 1], self.sa[tied])

    def extension(self, i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
        """How many words from i and from j on are equal, or how many before them; i and j in one sequence, i < j if left."""
        length, level = np.zeros(len(i), np.int64), 0

        def equal(h: int, some: np.ndarray) -> np.ndarray:
            step = length[some] + (1 << h if left else 0)
            a, b = (i[some] - step, j[some] - step) if left else (i[some] + step, j[some] + step)
            inside = a >= self.start[i[some]] if left else np.maximum(a, b) < len(self.sa)
            a, b = (np.where(inside, x, 0) for x in (a, b))
            return inside & (self.levels[h][a] == self.levels[h][b])

        able = [np.arange(len(i))]
        while level < len(self.levels) and len(able[-1]):
            able.append(able[-1][equal(level, able[-1])])  # 2^level words at least
            level += 1
        for h in range(level - 1, -1, -1):
            more = able[h + 1]
            done = length[more] > 0
            length[more[~done]] = 1 << h
            more = more[done]
            length[more[equal(h, more)]] += 1 << h
        return length


def _children(lcp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """LCP intervals below the root as flat arrays: each child's first place and last place, its interval's first and last place, and depth.

    ``places`` are the boundaries to look at: all of an interval or none. One pass with a stack
    gives a boundary's neighbours of less or equal depth; intervals and children follow from these.
    """
    n = len(places)
    before, after = [0] * n, [0] * n
    stack: list[int] = []
    value, where, last = lcp[places].tolist(), places.tolist(), -2
    for t in range(n):
        p, v = where[t], value[t]
        if p != last + 1:
            for e in stack:
                after[e] = last + 1
            stack.clear()
        while stack and value[stack[-1]] > v:
            after[stack.pop()] = p
        before[t] = stack[-1] if stack else -1
        stack.append(t)
        last = p
    for e in stack:
        after[e] = last + 1
    up, right, depth = np.array(before, np.int64), np.array(after, np.int64), lcp[places]
    # the lower end of a stretch of boundaries is the place before its first
    edge = np.maximum.accumulate(np.where(np.append(True, places[1:] != places[:-1] + 1)[:n], places - 1, -1))
    low = np.where(up < 0, edge, places[np.maximum(up, 0)])
    same = (up >= 0) & (depth[np.maximum(up, 0)] == depth)
    # a boundary whose left neighbour has its depth belongs to that one's interval
    root = np.where(same, up, np.arange(n))
    while not np.array_equal(root, root[root]):
        root = root[root]
    left = low[root]
    is_last = np.ones(n, bool)
    is_last[up[same]] = False
    t = np.flatnonzero(is_last)
    return (np.concatenate([low, places[t]]), np.concatenate([places - 1, right[t] - 1]), np.concatenate([left, left[t]]), np.concatenate([right - 1, right[t] - 1]), np.concatenate([depth, depth[t]]))


def runs_of(codes: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run of the sequences, by start and period.

    In each LCP interval the suffixes of all children but the largest are looked at: if the
    suffix ``depth`` words on, or as many before, lies in the interval but in another child, a
    branching square begins there. Rotating it to the left as far as words agree gives the run
    that it ends. Any other square of a run is a rotation of that one. A run that repeats its
    period ``exponent`` times gives its interval as many suffixes, so smaller ones are left out.
    """
    none = np.empty(0, np.int64)
    if len(codes) < least:
        return none, none, none
    s = SuffixArray(codes, bounds)
    places, size = np.unique(s.levels[0][s.sa], return_counts=True)
    often = np.repeat(size >= exponent, size)
    places = np.flatnonzero((s.lcp > 0) & often)
    if not len(places):
        return none, none, none
    lo, hi, left, right, depth = _children(s.lcp, places)
    keep = right - left + 1 >= exponent
    lo, hi, left, right, depth = (x[keep] for x in (lo, hi, left, right, depth))
    order = np.lexsort((hi - lo, depth, left))  # an interval's children together, the largest last
    lo, hi, left, right, depth = (x[order] for x in (lo, hi, left, right, depth))
    largest = np.append((left[1:] != left[:-1]) | (depth[1:] != depth[:-1]), True)[: len(left)]
    lo, hi, left, right, depth = (x[~largest] for x in (lo, hi, left, right, depth))
    count = hi - lo + 1
    child = np.repeat(np.arange(len(count)), count)
    i = s.sa[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[child]]
    d, squares = depth[child], []
    for j, inside in ((i + d, i + d < s.end[i]), (i - d, i - d >= s.start[i])):
        place = s.isa[np.where(inside, j, 0)]
        hit = inside & (place >= left[child]) & (place <= right[child]) & ((place < lo[child]) | (place > hi[child]))
        squares.append(np.stack([np.minimum(i, j)[hit], d[hit]]))
    begin, period = np.unique(np.concatenate(squares, axis=1), axis=1)
    turned = s.extension(begin, begin + period, left=True)
    start, length = begin - turned, 2 * period + turned
    keep = (length >= exponent * period) & (length >= least)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # the same stretch with a multiple of its period
    own = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[own], length[own], period[own]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _runs_of_texts(texts: pa.Array, exponent: int, least: int) -> tuple[pa.Array, pa.Array]:
    """Runs of each text and its words outside repeated periods, joined by blanks."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = split.values, split.offsets.to_numpy()
    flat = flat.slice(ends[0], ends[-1] - ends[0])
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.append(0, np.cumsum(real))[ends - ends[0]]
    flat = flat.filter(pa.array(real))
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    start, length, period = runs_of(codes, bounds, exponent, least)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept))[bounds], pa.int32()), flat.filter(pa.array(kept)))
    of = np.searchsorted(bounds[1:], start, "right")
    rows = pa.StructArray.from_arrays([pa.array(start - bounds[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))), pa.int32()), rows)
    return runs, pc.binary_join(left, " ")


def find_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``runs`` (start, length and period in words) and ``collapsed`` text.

    A run is a stretch of words with smallest period q, of at least ``exponent`` times q and
    ``least`` words, that no neighbouring word extends. Runs are ordered by start, then period.
    ``collapsed`` holds each run's first period alone: the words that no run holds after its
    first period, joined by one space. Words are runs without space and U+0009-000D.

    Texts are taken whole, some megabytes at a time and one text at least, each where it was
    read: nothing is shuffled. Null and empty texts have no run and collapse to ''. Rows that
    repeat an id are searched each on its own; null ids come back as they are. Columns other
    than the two named are not carried, so their names cannot clash. An empty table gives an empty result.
    """
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL(f"runs {RUNS}, collapsed string")])
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for lo, hi in slices(texts):
                runs, collapsed = _runs_of_texts(texts.slice(lo, hi - lo), exponent, least)
                columns = [batch.column(0).slice(lo, hi - lo), runs, collapsed]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(search, schema)


def _planted(text: Column, doc_id: Column) -> Column:
    """The contract's texts: where crc32 of the id ends with 0, words from a on repeat a period of p words."""
    w = words(text)
    n, h = F.size(w).cast("long"), F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.try_mod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_runs, the greatest run's start, length, period and exponent_milli, runs_sha256, collapsed_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs)

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x.length * best.period > best.length * x.period), x).otherwise(best)  # ordered by start and period: the first stays

    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    line = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
