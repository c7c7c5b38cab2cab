"""Joins through shared groups: who is listed beside whom."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.tables import cut

#: Members of a class that stand together as a unit, and members of a block of units. A task meets two blocks.
CHUNK, BLOCK = 500, 2048
#: Tasks that meet blocks at most (a task then meets several pairs of them); members in a batch of rows that a task hands on.
TASKS, BATCH = 10_000, 500_000
#: Pairs from which the units of a group are multiplied as a matrix, groups of such a product, and pairs that are added at once.
DENSE, SLAB, ADDED = 1024, 256, 1_000_000


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of lists of numbers."""
    n = pc.list_value_length(column).to_numpy().astype(np.int64)
    return pc.list_flatten(column).to_numpy(), np.cumsum(n) - n, n


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


class _Blocks:
    """Two blocks of units: their lists of members (xms, yms), and for each two units the number of shared groups and, if asked for, their weight."""

    def __init__(self, batches: Iterator[pa.RecordBatch], weighed: bool) -> None:
        t = pa.Table.from_batches(batches)
        self.i, self.j = t["i"][0].as_py(), t["j"][0].as_py()
        units, cells = t.filter(pc.is_valid(t["at"])), t.filter(pc.is_null(t["at"]))
        self.xms, self.yms = (_one(units.filter(pc.equal(units["block"], b)).sort_by("at")["ms"]) for b in (self.i, self.j))
        self.kx, self.ky = (pc.list_value_length(ms).to_numpy(zero_copy_only=False).astype(np.int64) for ms in (self.xms, self.yms))
        self.shared = np.zeros((len(self.xms), len(self.yms)), np.int32)
        self.weight = np.zeros(self.shared.shape) if weighed else None
        if cells.num_rows:
            self._count(cells)

    def _count(self, cells: pa.Table) -> None:
        (xs, ox, nx), (ys, oy, ny), w = _lists(cells["xs"]), _lists(cells["ys"]), 1.0 / cells["size"].to_numpy()
        dense, sparse = np.flatnonzero(nx * ny >= DENSE), np.flatnonzero(nx * ny < DENSE)
        for rows in np.split(dense, range(SLAB, len(dense), SLAB)) if len(dense) else []:
            x, y = (np.zeros((len(rows), n), np.float32) for n in self.shared.shape)
            for at, r in enumerate(rows):
                x[at, xs[ox[r]:ox[r] + nx[r]]] = 1
                y[at, ys[oy[r]:oy[r] + ny[r]]] = 1
            self.shared += (x.T @ y).astype(np.int32)
            if self.weight is not None:
                self.weight += (x * w[rows, None]).T @ y.astype(np.float64)
        made = np.cumsum(nx[sparse] * ny[sparse])
        for rows in np.split(sparse, np.searchsorted(made, np.arange(ADDED, made[-1], ADDED))) if len(sparse) else []:
            n = nx[rows] * ny[rows]
            r, k = np.repeat(rows, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = (xs[ox[r] + k // ny[r]], ys[oy[r] + k % ny[r]])
            np.add.at(self.shared, at, 1)
            if self.weight is not None:
                np.add.at(self.weight, at, w[r])

    def turned(self) -> _Blocks:
        out = object.__new__(_Blocks)
        out.i, out.j, out.xms, out.yms, out.kx, out.ky = self.j, self.i, self.yms, self.xms, self.ky, self.kx
        out.shared, out.weight = np.ascontiguousarray(self.shared.T), None if self.weight is None else np.ascontiguousarray(self.weight.T)
        return out

    def scored(self, x: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The units ``at`` in falling order of what they share with x, and start, shared and weight of each run of equal ones."""
        s = self.shared[x, at]
        if self.weight is None:
            order = np.argsort(-s, kind="stable")
            s, w = s[order], np.zeros(len(s))
        else:
            w = np.round(self.weight[x, at], 9)
            order = np.lexsort((-w, -s))
            s, w = s[order], w[order]
        starts = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (w[1:] != w[:-1])))
        return at[order], starts, s[starts], w[starts]


def _members_of(ms: pa.Array, units: list[np.ndarray], runs: list[int]) -> pa.Array:
    """A list of members for each run of so many units."""
    lists = ms.take(pa.array(np.concatenate(units) if units else np.array([], np.int64)))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(ends[np.append(0, np.cumsum(runs))].astype(np.int32)), lists.flatten())


def _pairs(b: _Blocks, floor: int) -> Iterator[pa.RecordBatch]:
    """(ms, shared, weight, bs, own): each two units once, those of equal score with a unit in one row; a unit beside itself has a row of its own."""
    rows, units, runs, made = [], [], [], 0

    def batch() -> pa.RecordBatch:
        x, shared, weight, own = zip(*rows)
        return pa.RecordBatch.from_arrays([b.xms.take(pa.array(x)), pa.array(shared, pa.int64()), pa.array(weight, pa.float64()), _members_of(b.yms, units, runs), pa.array(own)], ["ms", "shared", "weight", "bs", "own"])

    for x in range(len(b.xms)):
        found = [(np.flatnonzero(b.shared[x, (x + 1 if b.i == b.j else 0):] >= floor) + (x + 1 if b.i == b.j else 0), False)]
        if b.i == b.j and b.kx[x] > 1 and b.shared[x, x] >= floor:
            found.append((np.array([x]), True))
        for at, own in found:
            if len(at):
                at, starts, shared, weight = b.scored(x, at)
                units.append(at)
                runs.extend(np.diff(np.append(starts, len(at))).tolist())
                rows.extend((x, int(s), float(w), own) for s, w in zip(shared, weight))
                made += int(b.ky[at].sum()) + len(starts) * int(b.kx[x])
        if made >= BATCH:
            yield batch()
            rows, units, runs, made = [], [], [], 0
    if rows:
        yield batch()


def _tops(b: _Blocks, k: int) -> Iterator[pa.RecordBatch]:
    """(block, at, shared, weight, n, bs): for each unit of x the n members of y of equal score, where fewer than k have a better one; bs are these members unless they are more than k."""
    rows, units, runs = [], [], []
    for x in range(len(b.xms)):
        n = b.ky
        if b.i == b.j:
            n = n.copy()
            n[x] -= 1  # its own unit
        at = np.flatnonzero((b.shared[x] > 0) & (n > 0))
        if len(at) > k:
            s = b.shared[x, at]
            at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        if len(at):
            at, starts, shared, weight = b.scored(x, at)
            told = np.add.reduceat(n[at], starts)
            for r in np.flatnonzero(np.cumsum(told) - told < k):
                rows.append((x, int(shared[r]), float(weight[r]), int(told[r])))
                units.append(at[starts[r]:starts[r + 1] if r + 1 < len(starts) else None] if told[r] <= k else at[:0])
                runs.append(len(units[-1]))
    if rows:
        x, shared, weight, told = zip(*rows)
        columns = [pa.array([b.i] * len(x), pa.int32()), pa.array(x, pa.int32()), pa.array(shared, pa.int64()), pa.array(weight, pa.float64()), pa.array(told, pa.int64()), _members_of(b.yms, units, runs)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "at", "shared", "weight", "n", "bs"])


def _blocks(bridge: DataFrame, member: str, group: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members with the same groups are one class, named by the least of them; units are parts of some CHUNK members of a class, dealt to blocks of some BLOCK.

    Gives the members (c, part, m), the classes (c, k), of k members, the units (block, at, ms), and all that a task needs
    to know of two blocks i <= j: their units, and for each group that both have the units of either (xs, ys). Pairs of units
    are neither shuffled nor written: a group's units are sent once for each block that shares it, or pair by pair where that is less.
    """
    pairs = cut(bridge.select(F.col(member).alias("m"), F.col(group).alias("g")).where("g is not null").distinct(), "pairs")
    groups = cut(pairs.groupBy("g").agg(F.count("*").alias("size")).withColumn("n", F.monotonically_increasing_id()), "groups")
    lists = cut(pairs.where("m is not null").join(groups, "g").groupBy("m").agg(F.array_sort(F.collect_list(F.struct("n", "size"))).alias("gs")), "lists")
    classes = cut(lists.groupBy("gs").agg(F.min("m").alias("c"), F.count("*").alias("k")), "classes")
    members = cut(lists.join(classes, "gs").select("c", F.pmod(F.xxhash64("m"), F.floor(F.col("k") / CHUNK) + 1).cast("int").alias("part"), "m"), "members")
    n = members.count() // BLOCK + 1
    units = members.groupBy("c", "part").agg(F.array_sort(F.collect_list("m")).alias("ms")).withColumn("block", F.pmod(F.xxhash64("c", "part"), F.lit(n)).cast("int"))
    units = cut(units.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("c", "part")) - 1), "units")
    each = units.select("c", "block", "at").join(classes.select("c", "gs"), "c").select("block", "at", F.explode("gs").alias("s"))
    cells = cut(each.groupBy("s.n", "s.size", "block").agg(F.collect_list("at").alias("xs")), "cells")
    met = cells.withColumnRenamed("block", "i").join(cells.select("n", F.col("block").alias("j"), F.col("xs").alias("ys")).hint("merge"), "n").where("i <= j")
    sides = units.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "at", "ms")
    both = met.select("i", "j", "size", "xs", "ys").unionByName(sides, allowMissingColumns=True)
    return members, classes.select("c", "k"), units.select("block", "at", "ms"), both.repartition(min(n * (n + 1) // 2, TASKS), "i", "j")


def _classes(bridge: DataFrame, member: str, group: str, floor: int = 1, weighed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members and classes as ``_blocks`` gives them, and the pairs of units that share ``floor`` groups at least (ms, shared, weight, bs, own).

    The members ms of a unit share as much with each of bs; their weight is the sum of 1 / group size. Each two units come once.
    """
    members, classes, _, both = _blocks(bridge, member, group)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pairs(_Blocks(batches, weighed), floor)

    kind = members.schema["m"].dataType.simpleString()
    return members, classes, both.groupBy("i", "j").applyInArrow(met, f"ms array<{kind}>, shared long, weight double, bs array<{kind}>, own boolean")


def _expanded(rows: DataFrame) -> DataFrame:
    """Members ms beside members bs; nobody is beside themself."""
    rest = [c for c in rows.columns if c not in ("ms", "bs")]
    return rows.select(F.explode("ms").alias("a"), "bs", *rest).select("a", F.explode("bs").alias("b"), *rest).where("a <> b")


def _both_ways(met: DataFrame, *rest: str) -> DataFrame:
    """Ordered pairs of members: lists are turned, not pairs."""
    ways = F.when(F.col("own"), F.array(F.struct("ms", "bs"))).otherwise(F.array(F.struct("ms", "bs"), F.struct(F.col("bs").alias("ms"), F.col("ms").alias("bs"))))
    return _expanded(met.select(F.explode(ways).alias("p"), *rest).select("p.ms", "p.bs", *rest)).select("a", "b", *rest)


def colisting(bridge: DataFrame, member: str, group: str, floor: int) -> DataFrame:
    """(a, b, shared): ordered pairs of members with at least ``floor`` groups in common.

    Groups are counted for pairs of classes, whose members have the same groups, and only the result is
    made of members, by the task that counted. Null groups are none.
    """
    return _both_ways(_classes(bridge, member, group, floor, False)[2], "shared")


def peers(bridge: DataFrame, member: str, group: str) -> DataFrame:
    """(a, b, shared, weight): pairs weighed by the sum of 1 / group size, so small groups count for more."""
    return _both_ways(_classes(bridge, member, group)[2], "shared", "weight")


def top_peers(bridge: DataFrame, member: str, group: str, k: int) -> DataFrame:
    """(a, b, shared, weight, rows_upto): of each member's ``peers`` whole tie groups in falling order of shared and weight, up to the first that would pass k rows.

    A task keeps of two blocks the ties that fewer than k of the other block's members precede, and counts those that are more
    than k without naming them; a tie that ends within k rows of all blocks is whole, as is all before it.
    """
    members, _, units, both = _blocks(bridge, member, group)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _Blocks(batches, True)
        yield from _tops(b, k)
        if b.i != b.j:
            yield from _tops(b.turned(), k)

    kind = members.schema["m"].dataType.simpleString()
    found = both.groupBy("i", "j").applyInArrow(tops, f"block int, at int, shared long, weight double, n long, bs array<{kind}>").repartition("block", "at")
    ties = found.groupBy("block", "at", "shared", "weight").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("bs")).alias("bs"))
    order = Window.partitionBy("block", "at").orderBy(F.desc(F.struct("shared", "weight"))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = ties.withColumn("rows_upto", F.sum("n").over(order)).where(F.col("rows_upto") <= k)
    return _expanded(x.join(units, ["block", "at"]).select("ms", "bs", "shared", "weight", "rows_upto"))
