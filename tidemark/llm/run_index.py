"""Operator 11: removal of long repeats, by run-length indexes of the strings that share an anchor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.llm.shingles import _BASE, _BYTE, _INVERSE, _powers, mix
from tidemark.llm.tokenizing import slices
from tidemark.tables import cut, table

#: Bytes of a string that is removed wherever it repeats, and of an anchor within it.
SPAN, ANCHOR = 200, 64
#: Bytes hashed at once, and most windows of a piece.
STRETCH, WINDOWS = 2_000_000, 512
#: Lower bits of a hash that give way to its place while the least is sought; a stretch fits them.
PLACE = np.uint64((1 << 21) - 1)
#: Bytes of pieces in an index; an anchor's pieces are never parted.
BLOCK = 1_000_000
#: An anchor with more different pieces is cut anew by whole windows.
MOST = 500
#: One in so many of all pieces makes a class heavy: there are at most so many, and they are broadcast.
HEAVY = 10_000
U = np.uint64
SPANS = "array<struct<at:int,till:int>>"


def cut_pieces(buf: np.ndarray, k: int, span: int) -> tuple[np.ndarray, ...]:
    """Pieces of one string of bytes: start, length, anchor, hash, and whether its windows find their anchor at several places.

    Every window of ``span`` bytes is anchored by the least hash of the k-byte strings in it,
    so equal windows have equal anchors. A piece is a stretch of windows with one anchor;
    each window lies in one piece only.
    """
    n = len(buf)
    up, down = _powers_to(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[buf] * up, out=sums[1:])
    hashes = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    # the leftmost of the least, by their upper bits
    wide, have, least = span - k + 1, 1, (hashes & ~PLACE) | np.arange(len(hashes), dtype=U)
    while 2 * have <= wide:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    least = np.minimum(least[: n - span + 1], least[wide - have : wide - have + n - span + 1])
    place = (least & PLACE).astype(np.int64)
    least = hashes[place]
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    long = np.diff(first, append=len(least))
    if long.max() > WINDOWS:
        parts = -(-long // WINDOWS)
        first = np.repeat(first, parts) + WINDOWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    end = np.append(first[1:], len(least)) - 1 + span
    return first, end - first, mix(least[first]), mix((sums[end] - sums[first]) * down[first] + (end - first).astype(U)), place[first] != place[end - span]


_tables = [_powers(_BASE, 1), _powers(_INVERSE, 1)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        size = max(n, 2 * len(_tables[0]))
        _tables[:] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[0][:n], _tables[1][:n]


class RunIndex:
    """Run-length Burrows-Wheeler index of strings, with the text positions of both ends of every run.

    Strings are ended by terminators that differ from each other and come before any byte.
    ``heads`` and ``tails`` hold, in order of suffixes, where the suffixes at the first and
    the last place of each run begin; ``agree`` the length that a head has in common with the
    suffix before it, which is the tail of the run before. The suffix array itself is given up.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        self.n, n, m = len(text), len(text), len(ends)
        string = np.repeat(np.arange(m), np.diff(ends, prepend=0))
        self.end = ends[string]
        # seven bytes and terminators in 63 bits, then two or three ranks at once
        symbols = np.append(text.astype(np.int64) + 1, np.zeros(7, np.int64))
        left, key = self.end - np.arange(n), np.zeros(n, np.int64)
        for i in range(7):
            key = key << 9 | np.where(left > i, symbols[i : i + n], 0)
        bits = int(n + m).bit_length()
        parts = min(63 // bits, 3)
        sa = np.argsort(key)
        key = key[sa]
        first = np.append(True, key[1:] != key[:-1])[:n]
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, reach = [(7, rank)], 7
        while (at := np.flatnonzero(~(first & np.append(first[1:], True)))).size:
            some = sa[at]
            key = rank[some]
            for p in range(1, parts):
                after = some + p * reach
                key = key << bits | np.where(after < self.end[some], m + rank[np.minimum(after, n - 1)], string[some])
            order = np.argsort(key)
            some, key = some[order], key[order]
            sa[at] = some
            first[at[1:]] |= key[1:] != key[:-1]
            rank = rank.copy()
            rank[some] = np.maximum.accumulate(np.where(first[at], at, 0))
            reach *= parts
            levels.append((reach, rank))
        before = np.where(left == self.end - np.append(0, ends[:-1])[string], -1 - string, symbols[np.arange(n) - 1])  # a string's first byte follows a terminator
        bwt = before[sa]
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1])[:n])
        self.symbols, self.lengths = bwt[head], np.diff(head, append=n)
        self.heads, self.tails = sa[head], sa[np.append(head[1:], n)[: len(head)] - 1]
        self.agree = np.zeros(len(head), np.int64)
        self.agree[1:] = self._common(self.tails[:-1], self.heads[1:], text, levels)

    def _common(self, i: np.ndarray, j: np.ndarray, text: np.ndarray, levels: list) -> np.ndarray:
        """Bytes that the suffixes at i and j have in common; every level holds ranks by so many bytes."""
        out = np.zeros(len(i), np.int64)
        for size, rank in reversed(levels):
            on = np.arange(len(i))
            while len(on):
                a, b = i[on] + out[on], j[on] + out[on]
                on = on[(a + size <= self.end[i[on]]) & (b + size <= self.end[j[on]])]
                on = on[rank[i[on] + out[on]] == rank[j[on] + out[on]]]
                out[on] += size
        on = np.arange(len(i))
        while len(on):
            on = on[(i[on] + out[on] < self.end[i[on]]) & (j[on] + out[on] < self.end[j[on]])]
            on = on[text[i[on] + out[on]] == text[j[on] + out[on]]]
            out[on] += 1
        return out

    def reaches(self) -> np.ndarray:
        """For each position in text order, how far the longest string that also begins elsewhere reaches.

        The nearest suffixes on both sides share the most. From a position to the next one the
        neighbour moves along and the match loses its first byte, unless the position is a
        run's head (for the neighbour before) or tail (for the one after): there the sample
        states it. So the statistics are streamed from the run ends alone.
        """
        reach = np.zeros((2, self.n), np.int64)
        reach[0, self.heads] = self.heads + self.agree
        reach[1, self.tails[:-1]] = self.tails[:-1] + self.agree[1:]
        return np.maximum.accumulate(reach, axis=1).max(axis=0)

    def repeats(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal stretches covered by strings of ``span`` bytes and more that also begin elsewhere."""
        reach, at = self.reaches(), np.arange(self.n)
        covered = np.maximum.accumulate(np.where(reach - at >= span, reach, 0)) > at
        start = self.end[1:] != self.end[:-1]
        opens = covered & ~np.append(False, covered[:-1] & ~start)[: self.n]
        closes = covered & ~np.append(covered[1:] & ~start, False)[: self.n]
        return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _pieces(rows: DataFrame, k: int, span: int) -> DataFrame:
    """(d, r, at, n, anchor, hash, twice) of every piece of the rows' texts."""
    schema = StructType([rows.schema["d"], rows.schema["r"], *StructType.fromDDL("at int, n int, anchor long, hash long, twice boolean")])
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lo, hi in slices(texts):
                found, of = [], []
                for i in range(lo, hi):
                    buf = np.frombuffer(texts[i].as_buffer() or b"", np.uint8)
                    for a in range(0, len(buf) - span + 1, STRETCH):
                        start, *rest = cut_pieces(buf[a : a + STRETCH + span - 1], k, span)
                        found.append((start + a, *rest))
                        of.append(np.full(len(start), i))
                if found:
                    start, size, anchor, code, twice = (np.concatenate(x) for x in zip(*found, strict=True))
                    whose = pa.array(np.concatenate(of))
                    columns = [batch.column(0).take(whose), batch.column(1).take(whose), pa.array(start), pa.array(size), pa.array(anchor.view(np.int64)), pa.array(code.view(np.int64)), pa.array(twice)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.select("d", "r", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= span).mapInArrow(split, schema)


MARKS = "anchor long, hash long, spans " + SPANS


def _index_blocks(batches: Iterator[pa.RecordBatch], span: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repeats in pieces that come ordered by anchor and hash, an index for each block of whole anchors."""

    def searched(rows: pa.Table) -> pa.RecordBatch:
        texts = rows.column("text").combine_chunks()
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
        start, end = RunIndex(np.frombuffer(b"".join(texts.to_pylist()), np.uint8), ends).repeats(span)
        of = np.searchsorted(ends, start, "right")
        begin = np.append(0, ends[:-1])[of]
        found, many = np.unique(of, return_counts=True)
        spans = pa.StructArray.from_arrays([pa.array(start - begin, pa.int32()), pa.array(end - begin, pa.int32())], ["at", "till"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), spans)
        some = rows.take(pa.array(found))
        columns = [some.column("anchor").combine_chunks(), some.column("hash").combine_chunks(), lists]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held: list[pa.Table] = []
    size, last = 0, None
    for batch in batches:
        # rows of equal id and text give a piece more than once
        name = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("anchor", "hash")])
        new = np.append(len(name[0]) > 0 and (last is None or (name[:, :1] != last).any()), (name[:, 1:] != name[:, :-1]).any(axis=0))[: name.shape[1]]
        last = name[:, -1:] if name.shape[1] else last
        batch = batch.filter(pa.array(new.astype(bool)))
        held.append(pa.Table.from_batches([batch]))
        size += batch.column(batch.schema.get_field_index("text")).nbytes
        if size < BLOCK:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        anchors = rows.column("anchor").to_numpy()
        group = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        bytes_to = np.append(0, np.cumsum(pc.binary_length(rows.column("text")).to_numpy()))
        lo = 0
        for g, stop in zip(group, [*group[1:], 0], strict=True):  # the last anchor may go on in the next batch
            if stop and (bytes_to[stop] - bytes_to[lo] >= BLOCK or stop == group[-1]):
                yield searched(rows.slice(lo, stop - lo))
                lo = stop
        held, size = [rows.slice(lo)], int(bytes_to[-1] - bytes_to[lo])
    if held and sum(map(len, held)):
        yield searched(pa.concat_tables(held).combine_chunks())


def repeated_spans(rows: DataFrame, k: int = ANCHOR, span: int = SPAN) -> DataFrame:
    """(d, r, spans) for the rows (d, r, text) in which strings of ``span`` bytes also begin elsewhere; spans may overlap.

    Pieces with equal bytes form a class and travel as hashes. A class of two pieces or more repeats
    as a whole. One piece of each class whose anchor has other classes too, or which holds its anchor
    more than once, is fetched from its text, and the pieces of an anchor meet in a run-length index. Equal windows have equal
    anchors, so no repeat is lost. An anchor with more than MOST classes (a passage in ever new
    surroundings) is not gathered: its pieces are cut anew with whole windows as anchors, by this function.
    """
    pieces = _pieces(rows, k, span)
    classes = cut(pieces.groupBy("anchor", "hash").agg(F.count("*").alias("m"), F.min(F.struct("d", "r", "at", "n", "twice")).alias("of")), "classes")
    kinds = cut(classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchors")
    total = classes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count("*")).first()
    # the anchors of many classes, at most HEAVY of them, need no shuffle
    heavy = F.broadcast(kinds.where(F.col("kinds") * HEAVY > total[1]))
    rest = kinds.where(F.col("kinds") * HEAVY <= total[1])
    told = classes.join(heavy, "anchor", "left")
    spread = F.when(F.col("kinds").isNull(), F.col("anchor")).otherwise(F.col("hash"))
    told = told.withColumn("key", spread).join(rest.select(F.col("anchor").alias("key"), F.col("kinds").alias("more")), "key", "left")
    several = told.where(F.col("kinds").isNotNull() | F.col("more").isNotNull() | F.col("of.twice")).withColumn("hot", F.coalesce("kinds", "more", F.lit(1)) > MOST)
    wanted = several.groupBy(F.col("of.d").alias("d"), F.col("of.r").alias("r")).agg(F.collect_list(F.struct("anchor", "hash", "hot", "of.at", "of.n")).alias("wanted"))
    fetch = lambda w: F.struct(w.anchor.alias("anchor"), w.hash.alias("hash"), w.hot.alias("hot"), F.substring(F.col("text"), w.at + 1, w.n).alias("text"))
    texts = rows.select(F.col("d").alias("d0"), F.col("r").alias("r0"), F.col("text").cast("binary").alias("text"))
    fetched = texts.join(wanted, F.col("d0").eqNullSafe(F.col("d")) & F.col("r0").eqNullSafe(F.col("r"))).select(F.inline(F.transform("wanted", fetch)))
    if kinds.where(F.col("kinds") > MOST).isEmpty():
        cold, again = fetched, None
    else:
        fetched = cut(fetched, "pieces")
        cold, again = fetched.where(~F.col("hot")), repeated_spans(fetched.where("hot").select(F.col("anchor").alias("d"), F.col("hash").alias("r"), "text"), span, span)
    schema = to_arrow_schema(StructType.fromDDL(MARKS))
    found = cold.repartition("anchor").sortWithinPartitions("anchor", "hash").mapInArrow(lambda it: _index_blocks(it, span, schema), MARKS)
    if again is not None:
        found = found.union(again.select(F.col("d").alias("anchor"), F.col("r").alias("hash"), "spans"))
    common = F.broadcast(classes.where((F.col("m") > 1) & (F.col("m") * HEAVY > total[0])).select("anchor", "hash", F.lit(True).alias("common")))
    marked = classes.where((F.col("m") > 1) & (F.col("m") * HEAVY <= total[0])).select("anchor", "hash", F.lit(None).cast(SPANS).alias("spans")).union(found)
    # pieces of common classes are spread by their place, as nothing more is asked about them
    placed = pieces.join(common, ["anchor", "hash"], "left").withColumn("key", F.when(F.col("common"), F.xxhash64("d", "at")).otherwise(F.col("anchor")))
    hits = placed.join(marked.select(F.col("anchor").alias("key"), "hash", "spans", F.lit(True).alias("marked")), ["key", "hash"], "left").where("common or marked")
    own = F.when(F.col("common") | F.col("spans").isNull(), F.array(F.struct(F.col("at"), (F.col("at") + F.col("n")).alias("till")))).otherwise(
        F.transform("spans", lambda s: F.struct((F.col("at") + s.at).alias("at"), (F.col("at") + s.till).alias("till")))
    )
    return hits.groupBy("d", "r").agg(F.flatten(F.collect_set(own)).alias("spans"))


def remove_repeats(docs: DataFrame, span: int = SPAN, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, n_bytes, the removed ``spans`` (at, till in bytes, maximal) and the ``kept`` bytes.

    Every byte of the UTF-8 text that lies in a string of ``span`` bytes which also begins
    anywhere else, in this or another document, is removed. Strings are judged on the input, and
    none crosses documents. ``kept`` is binary, as a cut may part a character.

    Null and empty texts have no bytes; null comes back as empty. Rows that repeat an id and
    text repeat each other; rows that repeat an id with other texts are documents of their own. Null
    ids are treated like any other. Columns other than the two named are not carried, so their
    names cannot clash. An empty table gives an empty result.
    """
    if not 1 <= k <= span < int(PLACE) - STRETCH:
        raise ValueError("an anchor has one byte at least and fits the span, and a span fits a stretch")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(text).alias("r"), text.alias("text"))
    spans = repeated_spans(rows, k, span).select(F.col("d").alias("d0"), F.col("r").alias("r0"), "spans")
    joined = rows.join(spans, F.col("d").eqNullSafe(F.col("d0")) & F.col("r").eqNullSafe(F.col("r0")), "left").select("d", F.col("text").cast("binary").alias("text"), "spans")
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL(f"n_bytes long, spans {SPANS}, kept binary")])
    arrow = to_arrow_schema(schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or b""
                maximal, left, last = [], [], 0
                flat = found.values
                if flat is not None and len(flat):
                    at, till = (flat.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(at, kind="stable")
                    at, far = at[order], np.maximum.accumulate(till[order])
                    opens = np.flatnonzero(np.append(True, at[1:] > far[:-1]))
                    for a, b in zip(at[opens].tolist(), far[np.append(opens[1:], len(at)) - 1].tolist(), strict=True):
                        maximal.append({"at": a, "till": b})
                        left.append(text[last:a])
                        last = b
                sizes.append(len(text))
                merged.append(maximal)
                kept.append(b"".join([*left, text[last:]]))
            columns = [batch.column(0), pa.array(sizes), pa.array(merged, arrow.field(2).type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(remove, schema)


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, b, unnest(range(0, n - {SPAN} + 1)) AS i FROM d WHERE n >= {SPAN}),
h AS (SELECT r, i, md5(b[i + 1 : i + {SPAN}]) AS h FROM w),
m AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
o AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {SPAN}, true) AS opens FROM m),
p AS (SELECT *, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM o),
s AS (SELECT r, k, min(i) AS lo, max(i) + {SPAN} AS hi FROM p GROUP BY r, k),
g AS (SELECT r, hi AS a, coalesce(lead(lo) OVER (PARTITION BY r ORDER BY lo), -1) AS e FROM s UNION ALL SELECT r, 0, min(lo) FROM s GROUP BY r),
t AS (SELECT r, unhex(string_agg(hex(b[a + 1 : CASE WHEN e < 0 THEN n ELSE e END]), '' ORDER BY a)) AS kept FROM g JOIN d USING (r) GROUP BY r),
c AS (SELECT r, sum(hi - lo) AS gone, count(*) AS n FROM s GROUP BY r)
SELECT doc_id, d.n AS n_bytes, coalesce(c.gone, 0)::BIGINT AS n_removed, coalesce(c.n, 0) AS n_spans, sha256(coalesce(t.kept, d.b)) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
