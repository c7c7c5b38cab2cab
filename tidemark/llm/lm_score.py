"""Operator 3: scoring by a hidden Markov language model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import hidden_markov as hmm
from tidemark.tables import cut, discard, table

FOLDS, HELD_OUT = 5, 1
END = b""
#: Words looked up in a table that is broadcast; all others are joined by shuffle.
TABLE_WORDS = 300_000
#: Bins of counts: single values below this one, then so many bins a doubling.
SINGLE, FINE = 1024, 64
#: Emission symbols: the most frequent words, and classes of all others by their last bytes.
SYMBOL_WORDS, CLASSES, SUFFIX = 8192, 2048, 3
STATES, ROUNDS, PRIOR = 12, 4, 200.0
#: Before the rounds over all training documents at once, so many or more over one of START_SHARE shares of them in turn, dealt by hash of the row;
#: over fewer shares where they would have less than START_DOCS, but always over every share.
START_ROUNDS, START_SHARE, START_DOCS = 12, 16, 1500
#: Tokens that a task deals to shares, so that these are a few files.
SHARE_TOKENS = 32_000_000
#: Rounds end early when the log likelihood of a token gains less.
LEAST_GAIN = 1e-5
FLUSH = 800_000
#: Text that is split at once.
SLICE_BYTES = 8_000_000
ENCODED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, known long, table_log double, class_log double, "
    "class_cost double, symbols binary, rare array<binary>, times array<int>"
)
LN10 = float(np.log(10))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def word_class(token: bytes) -> int:
    return zlib.crc32(token[-SUFFIX:]) % CLASSES


def _rows(batches: Iterator[pa.RecordBatch], n: int = 500) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, n):
            part = batch.slice(lo, n)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` (texts second) in runs of rows of some SLICE_BYTES of text, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def split_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens of all texts in order, as numbers of the distinct ones; how many each text has; the distinct ones.

    A text's tokens are the words of its UTF-8 bytes, A-Z lower-cased, then END. Arrow splits and numbers them, so what
    Python does for a word is done once for all its occurrences in a slice.
    """
    # copied, as a slice of widened texts is read from its start; these functions look at ASCII alone, so bytes that are no UTF-8 stay as they are
    texts = texts.take(pa.array(np.arange(len(texts))))
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").cast(pa.large_binary()).view(pa.large_string())))
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    ended = pc.if_else(pc.equal(plain, empty), empty, pc.binary_join_element_wise(plain, empty, space))
    lists = pc.ascii_split_whitespace(ended)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy(), coded.dictionary.view(pa.large_binary()).cast(pa.binary())


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, c) of the training documents, summed within a task."""
    parts: list[pa.RecordBatch] = []

    def summed() -> pa.Table:
        return pa.Table.from_batches(parts).group_by("token").aggregate([("c", "sum")]).rename_columns({"c_sum": "c"})

    for batch in batches:
        for part in slices(batch):
            learnt = part.filter(pa.array([not held_out(i) for i in part.column(0).to_pylist()], pa.bool_()))
            if not learnt.num_rows:
                continue
            numbers, _, words = split_tokens(learnt.column(1))
            parts.append(pa.RecordBatch.from_arrays([words, pa.array(np.bincount(numbers, minlength=len(words)).astype(np.int64))], names=["token", "c"]))
            if sum(len(x) for x in parts) > FLUSH:
                table = summed()
                parts = table.to_batches()
                if len(table) > FLUSH // 2:
                    yield from parts
                    parts = []
    if parts:
        yield from summed().select(["token", "c"]).to_batches()


class Lexicon:
    """The broadcast table: words by falling count, symbols and classes of words, class sizes."""

    def __init__(self, words: list[bytes], counts: np.ndarray, symbols: int, class_tokens: np.ndarray, class_words: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.symbols = symbols
        self.log = np.log10(counts + 0.5)
        self.known = counts > 0
        self.symbol = np.array([i if i < symbols else symbols + word_class(w) for i, w in enumerate(words)], np.uint16)
        self.cost = np.log10(class_tokens + 0.5 * (class_words + 1))

    @classmethod
    def of(cls, broadcast) -> "Lexicon":
        """Built once for each Python worker: it stays beside the broadcast parameters."""
        payload = broadcast.value
        if "lexicon" not in payload:
            payload["lexicon"] = cls(**payload["parameters"])
        return payload["lexicon"]

    def encode(self, texts: pa.Array) -> list[pa.Array]:
        """n_tokens, known, log10(c + 0.5) over table words, over those in classes, log10 class sizes, symbols, other words and their times of each text."""
        numbers, lengths, words = split_tokens(texts)
        names = words.to_pylist()
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        inside = at >= 0
        symbol = np.empty(len(names), np.uint16)
        symbol[inside] = self.symbol[at[inside]]
        other = np.flatnonzero(~inside)
        symbol[other] = [self.symbols + word_class(names[i]) for i in other]
        log, known, cost = np.zeros(len(names)), np.zeros(len(names), np.int64), np.zeros(len(names))
        log[inside], known[inside] = self.log[at[inside]], self.known[at[inside]]
        classed = symbol >= self.symbols
        cost[classed] = self.cost[symbol[classed].astype(np.int64) - self.symbols]
        ends = np.cumsum(lengths, dtype=np.int64)
        summed = [pa.array(np.add.reduceat(x[numbers], ends - lengths)) for x in (known, log, np.where(classed, log, 0.0), cost)]
        bounds = np.append(0, 2 * ends).astype(np.int32)
        symbols = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(symbol[numbers])])
        rare = np.flatnonzero(~inside[numbers])
        text = np.searchsorted(ends, rare, side="right")
        found, times = np.unique(text * len(names) + numbers[rare], return_counts=True)
        starts = pa.array(np.searchsorted(found, np.arange(len(texts) + 1) * len(names)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, x) for x in (words.take(pa.array(found % len(names))), pa.array(times.astype(np.int32)))]
        return [pa.array(lengths.astype(np.int64)), *summed, symbols, *lists]


def encode_documents(batches: Iterator[pa.RecordBatch], broadcast) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon.of(broadcast)
    rid = TaskContext.get().partitionId() << 33
    names = [x.strip().split()[0] for x in ENCODED.split(", ")]
    for batch in batches:
        for part in slices(batch):
            ids = part.column(0)
            held = pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_())
            rids = pa.array(np.arange(rid, rid + len(ids)))
            rid += len(ids)
            yield pa.RecordBatch.from_arrays([rids, ids.cast(pa.int64()), held, *lexicon.encode(part.column(1))], names=names)


def head_words(counts: DataFrame) -> tuple[list[bytes], np.ndarray, Column]:
    """END and the most frequent words with their counts, by falling count, and the condition of being one.

    As many whole bins of counts as hold TABLE_WORDS words: only bin sizes and the words chosen
    reach the driver, however many tasks hold counts.
    """
    c = F.col("c")
    level = F.when(c < SINGLE, c).otherwise(SINGLE + F.floor(F.log2(c / float(SINGLE)) * FINE))
    taken, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        taken += r.n
        if taken > TABLE_WORDS:
            break
        least = r.level
    chosen = F.col("token") == END
    if least is not None:
        chosen = chosen | (level >= least)
    found = counts.where(chosen).toArrow()
    words, sizes = found.column("token").to_pylist(), found.column("c").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (words[i] != END, -sizes[i], words[i]))
    return [words[i] for i in order] or [END], np.array([sizes[i] for i in order] or [0], np.float64), chosen


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16) for x in column]


def gather_expectations(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(i, v): Baum-Welch counts of a task's documents, and at -1 their log likelihood."""
    counts, total = 0.0, 0.0
    rounded = hmm.single(model.value)
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            found, part = hmm.expectations(rounded, _sequences(batch.slice(lo, 4000).column(0)))
            counts, total = counts + found, total + part
    if not np.isscalar(counts):
        at = np.flatnonzero(counts > 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], total))], names=["i", "v"])


def score_documents(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Replaces the symbols by log10 of their sequence's likelihood."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            part = batch.slice(lo, 4000)
            i = part.schema.get_field_index("symbols")
            likelihood = hmm.forward(model.value, _sequences(part.column(i))) / LN10
            yield part.set_column(i, "likelihood", pa.array(likelihood))


def one_round(training: DataFrame, model: hmm.Model, unigram: np.ndarray) -> tuple[hmm.Model, float]:
    """A Baum-Welch round over ``training`` (symbols): the next model, and the log likelihood under this one."""
    states = len(model.start)
    shared = training.sparkSession.sparkContext.broadcast(model)
    sums = training.select("symbols").mapInArrow(lambda it: gather_expectations(it, shared), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    counts = np.zeros(states + states * states + states * len(unigram))
    at, v = sums.column("i").to_numpy(), sums.column("v").to_numpy()
    counts[at[at >= 0]] = v[at >= 0]
    shared.destroy()
    return hmm.maximised(counts, states, unigram, PRIOR), float(v[at < 0].sum())


def start_shares(training: DataFrame, documents: int, tokens: float = 0) -> list[DataFrame]:
    """The training documents dealt to shares, each of them in one, and each in files of its own: a round over one reads no other."""
    shares = max(1, min(START_SHARE, documents // START_DOCS))
    if shares == 1:
        return [training]
    writers = max(training.sparkSession.sparkContext.defaultParallelism, int(tokens) // SHARE_TOKENS)
    dealt = cut(training.coalesce(writers).withColumn("share", F.pmod(F.xxhash64("rid"), F.lit(shares)).cast("int")), "shares", by="share")
    return [dealt.where(F.col("share") == i) for i in range(shares)]


def train(encoded: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> hmm.Model:
    """Baum-Welch over all training documents at once, after rounds over shares of them in turn, until each document had its own.

    All rounds run on Spark; the model and the summed counts (a few for each symbol) are all
    that the driver holds.
    """
    training = encoded.where("not held_out").select("symbols", "rid")
    # two bytes a symbol
    size = training.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.length("symbols")), F.lit(0)) / 2).alias("tokens")).first()
    shares = start_shares(training, size.n, size.tokens)
    turns = [shares[i % len(shares)] for i in range(max(START_ROUNDS, len(shares)))]
    model = hmm.random_model(states, unigram)
    for tables in (turns, [training] * rounds):
        before = None
        for rows in tables if size.n else []:
            model, likelihood = one_round(rows, model, unigram)
            # likelihoods of different shares tell nothing about a gain
            if tables is turns and len(shares) > 1:
                continue
            if before is not None and likelihood - before < LEAST_GAIN * size.tokens:
                break
            before = likelihood
    return model


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score and score.

    Token counts come from all training documents. base_score is the smoothed unigram log10
    probability. score is that of a hidden Markov model whose symbols are the SYMBOL_WORDS
    most frequent words and CLASSES classes of all others; a word in a class has its smoothed
    share of the class. Baum-Welch counts are summed over all training documents in each
    round. Counts of up to TABLE_WORDS most frequent words are broadcast; words beyond are
    joined by shuffle, none is left out.

    Null text is empty: one token, END. A null doc_id is in training. Repeated rows count and
    are scored each. Extra columns are ignored; an empty table gives an empty result. Texts of
    any length are scored whole.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counts = cut(docs.mapInArrow(count_tokens, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words, c, in_table = head_words(counts)
    n_symbols = min(SYMBOL_WORDS, len(words))
    least = float(c[n_symbols - 1]) if n_symbols > 1 else float("inf")
    own = spark.sparkContext.broadcast(set(words[:n_symbols]))

    def class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for names, cs in _rows(batches, 10_000):
            for w, k in zip(names, cs, strict=True):
                if w not in own.value:
                    n[word_class(w)] += k
                    v[word_class(w)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    sizes = counts.where(F.col("c") <= least).mapInArrow(class_sizes, "k int, n double, v double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        class_tokens[r.k], class_words[r.k] = r.n, r.v
    lexicon = spark.sparkContext.broadcast({"parameters": {"words": words, "counts": c, "symbols": n_symbols, "class_tokens": class_tokens, "class_words": class_words}})
    encoded = cut(docs.mapInArrow(lambda it: encode_documents(it, lexicon), ENCODED), "encoded")
    mass = np.concatenate([c[:n_symbols], class_tokens]) + 0.5
    model = spark.sparkContext.broadcast(train(encoded, mass / mass.sum(), rounds))
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("rid", F.col("z.rare").alias("token"), F.col("z.times").alias("times"))
    c0 = F.coalesce("c", F.lit(0))
    joined = rare.join(counts.where(~in_table), "token", "left").groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(c0 + 0.5)).alias("rare_log"), F.sum(F.when(c0 > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    scored = encoded.drop("rare", "times").mapInArrow(lambda it: score_documents(it, model), ENCODED.replace("symbols binary", "likelihood double").split(", rare")[0])
    out = scored.join(joined, "rid", "left")
    extra = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("table_log") + extra - F.col("n_tokens") * F.lit(float(np.log10(total.n + 0.5 * (total.v + 1))))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("likelihood") + F.col("class_log") + extra - F.col("class_cost")).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_texts(table(spark, sf_dir, "documents"))
