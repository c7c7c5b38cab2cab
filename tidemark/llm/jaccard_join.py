"""Operator 9: n-gram Jaccard join by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shingles import SHINGLE, mix, shingle_set
from tidemark.tables import cut, discard, small, table

#: Similarity as a fraction: documents link when DEN * intersection >= NUM * union.
NUM, DEN = 4, 5
#: Sets up to TINY shingles have no sketch; larger ones fall into bands growing by BAND.
TINY, BAND = 32, (DEN / NUM) ** 5
#: Shingles in a sketch block of the largest set of a band, on average.
LOAD = 2.9
#: Rows of keys or shingles that a task groups at once.
CHUNK = 1_000_000
#: Shingles seen so often in a chunk, and in all such chunks, are common; at most COMMON of them,
#: the most frequent, are told apart. This orders shingles and bounds a broadcast; it drops none.
OFTEN_HERE, OFTEN, COMMON = 2, 8, 200_000
#: Leader rounds go on while more pairs than this many times the keys are left and enough of those tried link.
PAIRS_PER_KEY, WORTH = 4, 0.05
#: Words of the sketches that are compared within the last join, and rows of them that may be broadcast.
MOST_WORDS, SKETCH_ROWS = 32, 50_000
#: Rows of classes of equal sets, and of ids, that may be broadcast.
CLASS_ROWS, ID_ROWS = 100_000, 200_000
U = np.uint64


def lower_edge(lane: int) -> int:
    """The smallest set size of a lane; lane 0 holds the tiny sets."""
    return 0 if lane == 0 else int(np.ceil((TINY + 1) * BAND ** (lane - 1)))


def lane_of(size: int) -> int:
    lane = 0
    while size >= lower_edge(lane + 1):
        lane += 1
    return lane


def lane_blocks(lane: int) -> int:
    return int(np.ceil(lower_edge(lane + 1) / LOAD))


def sketch(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parity sketch of a sorted set: block numbers, parity words, check words and counts of its used blocks.

    A shingle flips one bit of one block's 64-bit word. Sets that differ in d shingles differ
    in at most d bits, and so in at most d blocks.
    """
    block = ((hashes >> U(32)) * U(blocks)) >> U(32)  # grows with the hash: blocks are runs
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    parity = np.bitwise_xor.reduceat(U(1) << (hashes & U(63)), first)
    check = np.bitwise_xor.reduceat(mix(hashes), first)
    return block[first], parity, check, np.diff(np.append(first, len(hashes)))


class Rarity:
    """A global order of shingles: the common ones after all others, by frequency; ties by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def counted(self, hashes: np.ndarray) -> np.ndarray:
        """The counts of common shingles, 0 for others."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that a linked set holds at least one of them."""
    need = -(-NUM * len(hashes) // DEN)
    return hashes[np.argsort(counts, kind="stable")[: len(hashes) - need + 1]]


def bucket_keys(hashes: np.ndarray, rarity: Rarity) -> np.ndarray:
    """The buckets of a set: any two linked sets share at least one.

    A lane takes the sets of one size band, and those of the band below that could link
    upwards. With a <= b <= 1.25 a shingles a linked pair differs in d <= (a + b) / 9 of them,
    so at most d blocks of the sketch differ. Common shingles are left out of the sketches,
    which cannot raise d, so that a passage many documents share is no bucket. Only blocks of
    two or more shingles are used (an empty or single one says little and would be a hot key):
    if either set has more than d of them, one is untouched, hence equal in both. A set that
    may lack so many gives its prefix too, so that a pair where both may lack them meets there.
    """
    size = len(hashes)
    if not size:
        return np.empty(0, U)
    counts = rarity.counted(hashes)
    rare = hashes[counts == 0]
    own, out = lane_of(size), []
    lanes = [own, own + 1] if DEN * size >= NUM * lower_edge(own + 1) else [own]
    if own == 1 and NUM * size <= DEN * TINY:
        lanes.append(0)
    for lane in lanes:
        if lane == 0:
            out.append(mix(prefix(hashes, counts) + U(1)))
            continue
        tag = mix(np.full(1, lane * 2 + 2, U))
        full = np.zeros(0, bool)
        if len(rare):
            block, parity, check, count = sketch(rare, lane_blocks(lane))
            full = count >= 2
            out.append(mix(mix(mix(block[full] + tag) + parity[full]) ^ (check[full] + count[full].astype(U))))
        if np.count_nonzero(full) <= size // 4:
            out.append(mix(prefix(hashes, counts) + mix(tag + U(1))))
    return np.concatenate(out)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _some(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple[list, list]]:
    """Ids and texts, a few at a time."""
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def describe_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """doc_id, set size and a 128-bit name of the set, equal for equal sets; then, with often
    set, shingles found OFTEN_HERE times in a chunk (f1) and their counts (n_shingles)."""
    names = ["often", "doc_id", "n_shingles", "f1", "f2"]

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        found, n = found[n >= OFTEN_HERE], n[n >= OFTEN_HERE]
        nothing = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), bool)), nothing, pa.array(n), _signed(found), nothing], names=names)

    held: list[np.ndarray] = []
    for batch in batches:
        for ids, texts in _some(batch):
            sets = [shingle_set(t, k) for t in texts]
            one = np.array([np.bitwise_xor.reduce(mix(s + U(11))) if len(s) else 0 for s in sets], U)
            two = np.array([np.add.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets], U)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), bool)), pa.array(ids, pa.int64()), pa.array(sizes), _signed(one), _signed(two)], names=names)
            held += sets
            if sum(map(len, held)) >= 2 * CHUNK:
                yield often(held)
                held = []
    if held:
        yield often(held)


def chained_keys(batches: Iterator[pa.RecordBatch], k: int, rarity) -> Iterator[pa.RecordBatch]:
    """(key, doc_id): of each bucket the smallest id in a chunk of rows, its others hung on that one.

    Documents that share a bucket within a chunk are paired with the smallest of them; every
    such pair gets a bucket of its own. So a bucket has at most one row for each chunk,
    however many documents it holds.
    """
    def grouped(keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        same = key[1:] == key[:-1]
        first = np.concatenate([[True], ~same])
        least = doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
        pairs = np.unique(np.stack([least, doc])[:, least != doc], axis=1)
        own = mix(mix(pairs[0].view(U) + U(77)) ^ pairs[1].view(U))
        return pa.RecordBatch.from_arrays([_signed(np.concatenate([key[first], own, own])), pa.array(np.concatenate([doc[first], pairs[0], pairs[1]]))], names=["key", "doc_id"])

    keys, docs, held = [], [], 0
    for batch in batches:
        for ids, texts in _some(batch):
            for i, t in zip(ids, texts, strict=True):
                found = bucket_keys(shingle_set(t, k), rarity.value)
                if len(found):
                    keys.append(found)
                    docs.append(np.full(len(found), i, np.int64))
                    held += len(found)
            if held >= CHUNK:
                yield grouped(keys, docs)
                keys, docs, held = [], [], 0
    if held:
        yield grouped(keys, docs)


def rare_prefixes(batches: Iterator[pa.RecordBatch], k: int, rarity) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, n): each document's rarest shingles, of which a linked document shares one, and its set's size."""
    for batch in batches:
        for ids, texts in _some(batch):
            sets = [shingle_set(t, k) for t in texts]
            found = [prefix(s, rarity.value.counted(s)) for s in sets]
            each = [len(f) for f in found]
            if sum(each):
                sizes = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), pa.array(np.repeat(np.array(ids, np.int64), each)), pa.array(np.repeat(sizes, each))], names=["key", "doc_id", "n"])


def parity_bits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, bits): a set's size and its parity sketch of a power of two of words, up to MOST_WORDS.

    The bit is the hash modulo the sketch's bits, so a sketch folds into one of half the words by XOR.
    """
    for batch in batches:
        for ids, texts in _some(batch):
            sets = [shingle_set(t, k) for t in texts]
            bits = []
            for h in sets:
                words = min(MOST_WORDS, max(2, 1 << max(0, len(h) - 1).bit_length() >> 5))
                own = np.zeros(words, U)
                np.bitwise_xor.at(own, (h >> U(6)) & U(words - 1), U(1) << (h & U(63)))
                bits.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "n", "bits"])


def _folded(bits: str, other: str) -> str:
    half = f"cast(size({bits}) / 2 as int)"
    return f"if(size({bits}) > size({other}), zip_with(slice({bits}, 1, {half}), slice({bits}, {half} + 1, {half}), (p, q) -> p ^ q), {bits})"


#: A linked pair's sketches (bits, n; obits, ny) differ in no more bits than its sets may differ in shingles.
ALIKE = (
    f"aggregate(zip_with({_folded('bits', 'obits')}, {_folded('obits', 'bits')}, (p, q) -> bit_count(p ^ q)), 0, (a, b) -> a + b)"
    f" * {DEN + NUM} <= (n + ny) * {DEN - NUM}"
)


def verified(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The pairs (x, y) of rows (x, y, text_x, text_y) that link; sketches are compared before sets."""
    for batch in batches:
        seen: dict[str, tuple] = {}

        def known(text: str) -> tuple:
            if text not in seen:
                if len(seen) > 200:
                    seen.clear()
                h = shingle_set(text, k)
                bits = np.zeros(256, U)
                np.bitwise_xor.at(bits, (h >> U(40)) & U(255), U(1) << (h & U(63)))
                seen[text] = h, bits
            return seen[text]

        out = []
        for lo in range(0, batch.num_rows, 500):
            x, y, tx, ty = (c.to_pylist() for c in batch.slice(lo, 500).columns)
            for i, j, s, t in zip(x, y, tx, ty, strict=True):
                (a, p), (b, q) = known(s), known(t)
                most = (len(a) + len(b)) * (DEN - NUM) // (DEN + NUM)
                if np.bitwise_count(p ^ q).sum() > most:
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if len(a) and DEN * shared >= NUM * (len(a) + len(b) - shared):
                    out.append((i, j))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["x", "y"])


class _Join:
    """State of one run: texts of the representatives in question, their buckets, the links found."""

    def __init__(self, texts: DataFrame, k: int):
        self.texts, self.k = texts, k
        self.links: DataFrame | None = None
        self.groups: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> DataFrame:
        a = self.texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx"))
        b = self.texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
        rows = pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty")
        return cut(rows.mapInArrow(lambda it, k=self.k: verified(it, k), "x long, y long"), "links")

    def add(self, found: DataFrame) -> int:
        self.links = found if self.links is None else self.links.union(found)
        return found.count()

    def components(self) -> DataFrame:
        """(node, component) of all links so far: of the last result's stars and the links since."""
        edges = self.links
        if self.groups is not None:
            stars = self.groups.select(F.col("node").alias("x"), F.col("component").alias("y"))
            edges = stars if edges is None else stars.union(edges)
        before, self.groups, self.links = self.groups, cut(connected_components(edges, "x", "y"), "groups"), None
        discard(before)
        return self.groups


def link_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    Documents whose sets of k-word shingles have a Jaccard similarity of at least NUM/DEN
    link; component_id is the smallest doc_id reachable by links.

    1. Equal sets are one class; only its smallest id goes on.
    2. Shingles that many documents hold are told apart. Sets meet in the buckets of
       ``bucket_keys``. A bucket's documents are paired with the first in their chunk of rows,
       and those of its chunks chained, which tells what documents meet any other at all.
       Each is first tried with the smallest and the largest id of near size it was paired with.
    3. Pairs are verified on whole sets, after a comparison of sketches.
    4. The documents that met any other, a small part, may still have links between the
       components so far. They meet again by their rarest shingles; where all that share one
       are in one component, nothing is left. Else pairs of different components are: while
       these are many, each document is first tried against a leader (the one that meets
       most others); of what still is apart, the pairs whose sketches are near enough are
       verified, so no link is lost.

    Texts are shuffled for documents in question only. Null or empty text has an empty set
    and links with nothing; a null doc_id has a null component. Rows that repeat an id are
    one document, linked by whatever either links with. Extra columns are ignored. An empty
    table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    everything = cut(docs.mapInArrow(lambda it: describe_sets(it, k), "often boolean, doc_id long, n_shingles long, f1 long, f2 long"), "sets")
    often = everything.where("often").groupBy("f1").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= OFTEN)
    often = often.orderBy(F.desc("n"), "f1").limit(COMMON).collect()
    rarity = spark.sparkContext.broadcast(Rarity(np.array([r.f1 for r in often], np.int64).view(U), np.array([r.n for r in often], np.int64)))
    described = everything.where("not often").drop("often")
    full = described.where("n_shingles > 0 and doc_id is not null")
    # only sets that several documents hold are joined back; as a written table, so that a large group of copies can be split
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    classes = small(cut(classes, "classes"), CLASS_ROWS)
    members = full.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    members = cut(members.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n_shingles").distinct(), "members")
    usable = docs.where("doc_id is not null and text is not null")
    keyed = usable.mapInArrow(lambda it: chained_keys(it, k, rarity), "key long, doc_id long")
    met = keyed.select("doc_id", F.lag("doc_id").over(Window.partitionBy("key").orderBy("doc_id")).alias("before")).where("before <> doc_id")
    chained = cut(met.distinct(), "chained")
    rep = members.select(F.col("doc_id").alias("m"), "rep", "n_shingles")
    mapped = (
        chained.join(rep, chained["doc_id"] == rep["m"]).select("before", F.col("rep").alias("x"), F.col("n_shingles").alias("n1"))
        .join(rep, F.col("before") == rep["m"]).select("x", F.col("rep").alias("y"), "n1", F.col("n_shingles").alias("n2"))
        .where("x <> y").select("x", "y", F.expr(f"{DEN} * n1 >= {NUM} * n2 and {DEN} * n2 >= {NUM} * n1").alias("near")).distinct()
    )
    met = cut(mapped, "met")
    # sizes are no condition here: a document may link with another that was hung on the same, far larger or smaller, one
    asked = cut(met.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "asked")
    ends = met.where("near").groupBy("x").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    tried = ends.select("x", F.explode(F.array_distinct(F.array("low", "high"))).alias("y"))
    pairs = cut(tried.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    discard(chained)
    texts = cut(usable.join(small(asked, ID_ROWS), "doc_id", "left_semi"), "texts")
    run = _Join(texts, k)
    run.add(run.verify(pairs))
    twice = members.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    same_id = members.join(twice.select("doc_id", "x"), "doc_id").select("x", F.col("rep").alias("y")).where("x <> y")
    run.links = run.links.union(same_id)
    each = texts.mapInArrow(lambda it: rare_prefixes(it, k, rarity), "key long, doc_id long, n long")
    shared = each.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key")
    keys = cut(each.join(shared, "key", "left_semi"), "prefixes")
    n_keys = keys.count()
    while True:
        groups = run.components()
        placed = keys.join(groups, keys["doc_id"] == groups["node"], "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
        counts = placed.groupBy("key", "c").agg(F.count("*").alias("m"))
        open_keys = counts.groupBy("key").agg(F.sum("m").alias("weight"), F.sum(F.col("m") * F.col("m")).alias("inner"), F.count("*").alias("cs")).where("cs > 1")
        left = cut(placed.join(open_keys.select("key", "weight", (F.col("weight") * F.col("weight") - F.col("inner")).alias("apart")), "key"), "open")
        apart = left.groupBy("key").agg(F.first("apart").alias("apart")).agg(F.sum(F.col("apart").cast("decimal(38,0)"))).first()[0] or 0
        if apart <= 2 * PAIRS_PER_KEY * max(n_keys, 1):
            break
        weight = left.groupBy("doc_id").agg(F.sum("weight").alias("w"))
        lead = (
            left.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("i"), "c")).alias("best"))
            .select("key", (-F.col("best.i")).alias("leader"), F.col("best.c").alias("lc"))
        )
        tries = left.join(lead, "key").where("c <> lc").select(F.least("doc_id", "leader").alias("x"), F.greatest("doc_id", "leader").alias("y")).distinct()
        tries = cut(tries, "tries")
        if run.add(run.verify(tries)) < WORTH * tries.count():
            groups = run.components()
            break
    sketches = cut(texts.mapInArrow(lambda it: parity_bits(it, k), "doc_id long, n long, bits array<long>"), "sketches")
    now = left.drop("c").join(groups, left["doc_id"] == groups["node"], "left").withColumn("c", F.coalesce("component", "doc_id"))
    sketched = now.join(small(sketches, SKETCH_ROWS), ["doc_id", "n"]).select("key", "doc_id", "c", "n", "bits")
    other = sketched.select("key", F.col("doc_id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("bits").alias("obits"))
    near = f"{DEN} * n >= {NUM} * ny and {DEN} * ny >= {NUM} * n"
    rest = sketched.withColumnRenamed("doc_id", "x").join(other, "key").where(f"x < y and c <> cy and {near} and {ALIKE}").select("x", "y").distinct()
    last = run.verify(rest)
    if run.add(last):
        groups = run.components()
    final = members.join(groups, members["rep"] == groups["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    final = final.groupBy(F.col("doc_id").alias("d")).agg(F.min("component_id").alias("component_id"))
    return described.join(final, F.col("doc_id") == F.col("d"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``docs`` with the smallest doc_id of each component only; ids that link with nothing stay.

    Rows with a null id, null or empty text stay, as do all rows of a kept id. All columns pass
    through; an empty table gives an empty result.
    """
    found = cut(link_components(docs, k).where("doc_id <> component_id").select(F.col("doc_id")).distinct(), "copies")
    return docs.join(small(found, ID_ROWS), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id."""
    return link_components(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE {DEN} * c >= {NUM} * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) m ON d.doc_id = m.node
"""
