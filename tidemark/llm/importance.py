"""Operator 12: importance resampling towards a target, with n-gram hashes cut out of running CRCs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.llm.text import LOWER, UPPER
from tidemark.llm.tokenizing import slices
from tidemark.tables import cut, table

#: Features are runs of LOW to HIGH words; their hashes fall into BUCKETS.
LOW, HIGH, BUCKETS = 1, 1, 10_000
#: Documents of MIN_WORDS words and more are eligible; SHARE per cent of them are drawn, by noise of SEED.
MIN_WORDS, SHARE, SEED = 20, 10, 2024
#: Every ASCII byte but letters and digits parts words; A-Z are lower-cased, all other bytes stay.
NORMAL = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


def _zero_byte() -> np.ndarray:
    """The map of a CRC-32 register that one zero byte makes, as four tables by the register's bytes."""
    low = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear: what a byte adds
    return np.stack([low, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3))])


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Registers ``x`` sent through a linear map."""
    out = tables[0][x & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Shift:
    """Moves CRC-32 values over zero bytes: multiplication by x^(8 n) over GF(2), by the bits of n."""

    _powers = [_zero_byte()]

    @classmethod
    def over(cls, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = crc.copy()
        for bit in range(int(n.max(initial=0)).bit_length()):
            if bit == len(cls._powers):
                cls._powers.append(_through(cls._powers[-1], cls._powers[-1]))  # the map twice
            some = np.flatnonzero(n >> bit & 1)
            out[some] = _through(cls._powers[bit], out[some])
        return out


class Prefixes:
    """Running CRCs of separator-normalised texts, one scan of each: a text's words joined by single blanks."""

    def __init__(self, texts: list[bytes | None]):
        ends, sizes, counts = [], [], []
        for text in texts:
            words = text.translate(NORMAL).split() if text else []
            if words:
                # each word with the blank before it, the first without
                running = accumulate(words[1:], lambda crc, word: zlib.crc32(word, zlib.crc32(b" ", crc)), initial=zlib.crc32(words[0]))
                ends.append(np.fromiter(running, np.uint32, len(words)))
                sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
            counts.append(len(words))
        self.counts = np.array(counts, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        #: CRC of the text up to each word's end, and up to its start: the blank shifts the register by a byte
        self.ends = np.concatenate([np.empty(0, np.uint32), *ends])
        self.sizes = np.concatenate([np.empty(0, np.int64), *sizes])
        before = np.append(np.uint32(0), self.ends[:-1])[: len(self.ends)]
        self.starts = Shift.over(before, np.ones(len(before), np.int64)) ^ np.uint32(zlib.crc32(b" "))
        self.starts[self.first[self.counts > 0]] = 0

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRC-32 of every run of n words joined by blanks, and the number of them in each text.

        With A the text before a run B, crc(AB) = shift(crc(A), |B|) xor crc(B): two prefixes
        give the run's CRC whatever stands before it, without its bytes.
        """
        many = np.maximum(self.counts - n + 1, 0)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first, many)
        total = np.append(0, np.cumsum(self.sizes))
        size = total[at + n] - total[at] + n - 1
        return self.ends[at + n - 1] ^ Shift.over(self.starts[at], size), many


def _features(texts: pa.Array, low: int, high: int, buckets: int) -> Iterator[tuple[int, int, Prefixes, list[tuple[np.ndarray, np.ndarray]]]]:
    for lo, hi in slices(texts):
        prefixes = Prefixes(texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist())
        yield lo, hi, prefixes, [((crc % np.uint32(buckets)).astype(np.int64), many) for crc, many in map(prefixes.ngrams, range(low, high + 1))]


def bucket_counts(rows: DataFrame, text_col: str, low: int, high: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task adds up its own before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in _features(batch.column(0).cast(pa.string()), low, high, buckets):
                for bucket, _ in found:
                    n += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["bucket", "n"])

    return rows.select(F.col(f"`{text_col}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str, low: int, high: int, buckets: int) -> np.ndarray:
    """Each bucket's gain in thousandths: log ratio of its smoothed shares in the target's and the documents' features."""
    spark = docs.sparkSession
    s = bucket_counts(docs, text_col, low, high, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
    t = bucket_counts(target, text_col, low, high, buckets).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t"))
    all_ = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    n = all_.union(s).union(t).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()  # BUCKETS rows
    s, t = (np.zeros(buckets, np.int64) for _ in range(2))
    for name, into in (("s", s), ("t", t)):
        into[n.column("bucket").to_numpy()] = n.column(name).to_numpy()
    up = (t + 1).astype(float) * float(s.sum() + buckets)
    return np.floor(1000 * np.log(up / ((s + 1).astype(float) * float(t.sum() + buckets)))).astype(np.int64)


def weigh_documents(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, low: int, high: int) -> DataFrame:
    """One row per document: the id, n_words, n_features and weight, the floored mean of its features' gains."""
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("n_words long, n_features long, weight long")])
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for lo, hi, prefixes, found in _features(batch.column(1).cast(pa.string()), low, high, len(gain)):
                total, n = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for bucket, many in found:
                    sums = np.append(0, np.cumsum(gain[bucket]))
                    stop = np.cumsum(many)
                    total += sums[stop] - sums[stop - many]
                    n += many
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(prefixes.counts), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(weigh, schema)


def resample(
    docs: DataFrame, target: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, min_words: int = MIN_WORDS, share: int = SHARE,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: the id, n_words, n_features, weight, score and rank (null if not drawn).

    Documents are drawn without replacement in proportion to the ratio of the target's and
    their own hashed n-gram shares: Gumbel noise of the id is added to each weight, and the
    ``share`` per cent of the eligible documents with the highest scores are drawn, ties to
    the smaller id. Reruns agree.

    Ranks need no sort in one place. Scores are whole numbers whose noise alone spreads them
    over thousands of values (at most 1 in 2,700 documents share one, whatever their weights);
    the documents of each score are counted, the counts added up, and each score's documents
    numbered apart.

    Null and empty texts have no words and no features: their weight is 0 and they are never
    drawn, unless ``min_words`` is 0. Rows that repeat an id count as documents of their own, and
    have the same noise. A null id has no noise: score and rank are null, and it does not count
    as eligible. Other columns are not carried, so their names cannot clash; both tables
    name their text ``text_col``. Empty tables give an empty result, an empty target equal shares.
    """
    gains = bucket_gains(docs, target, text_col, low, high, buckets)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = cut(weigh_documents(docs, gains, id_col, text_col, low, high).withColumn("score", F.col("weight") + noise), "scored")
    eligible = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    by_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    # as many rows as there are scores
    all_above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = by_score.select(F.col("score").alias("s"), F.coalesce(F.sum("n").over(all_above), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    reached = F.col("above") < F.floor(F.col("all") * share / 100)
    wanted = F.broadcast(above.where(reached).withColumn("most", F.floor(F.col("all") * share / 100)))
    joined = scored.join(wanted, eligible & (F.col("score") == F.col("s")), "left")
    place = F.col("above") + F.row_number().over(Window.partitionBy("s").orderBy(F.col(f"`{id_col}`"), "n_features", "weight"))
    names = [id_col, "n_words", "n_features", "weight", "score"]
    drawn = joined.where("s is not null").withColumn("place", place).select(*[F.col(f"`{c}`") for c in names], F.when(F.col("place") <= F.col("most"), F.col("place")).cast("long").alias("rank"))
    return joined.where("s is null").select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("long").alias("rank")).union(drawn)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of a word, bit by bit, from the polynomial alone
_CRC = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || hex(encode(w))[2 * i - 1 : 2 * i])::UBIGINT)),
  lambda c, b: xor(c >> 8, table_[(1 + (xor(c, b) & 255))::BIGINT]))"""
ORACLE = f"""
WITH crcs AS (SELECT list(v ORDER BY b) AS table_ FROM (SELECT b, list_reduce(list_concat([b::UBIGINT], list_transform(range(8), lambda k: 0::UBIGINT)),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(b))),
w AS (SELECT 0 AS side, doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
      UNION ALL SELECT 1, NULL, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT side, r, unnest(ws) AS w FROM w),
b AS (SELECT w, xor({_CRC}, 4294967295::UBIGINT) % {BUCKETS} AS b FROM (SELECT DISTINCT w FROM f), crcs),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (w) GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM n),
g AS (SELECT n.b, floor(1000 * ln((n.t + 1) * (tot.s + {BUCKETS}) / ((n.s + 1) * (tot.t + {BUCKETS}))))::BIGINT AS gain FROM n, tot),
m AS (SELECT r, sum(gain)::DOUBLE / count(*) AS mean FROM f JOIN b USING (w) JOIN g USING (b) WHERE side = 0 GROUP BY r),
d AS (SELECT w.doc_id, w.r, len(ws)::BIGINT AS n_features, coalesce(floor(mean), 0)::BIGINT AS weight,
        ('0x' || sha256('{SEED}:' || w.doc_id)[1:8])::UBIGINT::DOUBLE AS h FROM w LEFT JOIN m USING (r) WHERE side = 0),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * n // 100 THEN rank END AS rank FROM s LEFT JOIN k USING (r)
"""
