"""Operator 7: token ids in Arrow files of equal-length sequences."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.tokenizing import Encoder, slices
from tidemark.tables import cut, scratch, table

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE, BATCH = 2048, 64
#: A file is closed at the first document end beyond this many tokens.
FILE_TOKENS = 16_000_000
#: Bytes of input (as its files have them) for each part, and the most parts.
PART_BYTES, MOST_PARTS = 256_000_000, 400_000
END = 0
MANIFEST = "file string, part int, number int, documents long, tokens long"
READ_BACK = "part int, number int, doc_id long, position long, local_start long, n_tokens long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def schema(length: int, dtype: str) -> pa.Schema:
    """ids, mask (true: a token, false: padding), ends (last token of a document), ids of the documents ending here."""
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
        ("ends", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64())),
    ])


class SequenceWriter:
    """One Arrow file. Ids are buffered for a batch of sequences only; the last one is padded."""

    def __init__(self, fs, path: str, length: int, dtype: str):
        self.fs, self.path, self.length, self.dtype = fs, path, length, np.dtype(dtype)
        self.schema = schema(length, dtype)
        self.sink = fs.open_output_stream(path + ".tmp")
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.held = self.tokens = self.documents = self.flushed = 0
        self.ends: list[int] = []
        self.docs: list[int | None] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.documents += 1
        self.ends.append(self.tokens - 1 - self.flushed)
        self.docs.append(doc_id)
        if self.held >= self.length * BATCH:
            self.flush(self.held // self.length)

    def flush(self, rows: int) -> None:
        flat = np.concatenate(self.ids)
        for lo in range(0, rows, BATCH):
            self.batch(flat, lo * self.length, min(rows, lo + BATCH) * self.length)
        used = rows * self.length
        kept = [i for i, e in enumerate(self.ends) if e >= used]
        self.ids, self.held = [flat[used:].copy()], max(0, self.held - used)
        self.ends, self.docs = [self.ends[i] - used for i in kept], [self.docs[i] for i in kept]
        self.flushed += used

    def batch(self, flat: np.ndarray, lo: int, hi: int) -> None:
        n, rows = self.length, (hi - lo) // self.length
        ids = np.zeros(hi - lo, self.dtype)
        part = flat[lo:hi]
        ids[: len(part)] = part
        mask, ends = np.zeros(hi - lo, bool), np.zeros(hi - lo, bool)
        mask[: len(part)] = True
        first, last = np.searchsorted(self.ends, [lo, hi])
        at = np.asarray(self.ends[first:last], dtype=np.int64) - lo
        ends[at] = True
        offsets = np.searchsorted(at, np.arange(rows + 1) * n).astype(np.int32)
        fixed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), n)
        docs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.docs[first:last], pa.int64()))
        self.writer.write_batch(pa.record_batch([fixed(ids), fixed(mask), fixed(ends), docs], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self.flush(-(-self.held // self.length))
        self.writer.close()
        self.sink.close()
        self.fs.move(self.path + ".tmp", self.path)


def read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document in one file's batches, in order."""
    rest: list[np.ndarray] = []
    start = 0
    for b in batches:
        ids = b.column("ids").flatten().to_numpy()
        stop = int(np.count_nonzero(b.column("mask").flatten().to_numpy(zero_copy_only=False)))
        docs = b.column("doc_ids").flatten().to_pylist()
        lo = 0
        for doc_id, e in zip(docs, np.flatnonzero(b.column("ends").flatten().to_numpy(zero_copy_only=False)) + 1, strict=True):
            whole = np.concatenate([*rest, ids[lo:e]]) if rest else ids[lo:e]
            yield doc_id, start, whole
            start += len(whole)
            rest, lo = [], e
        if lo < stop:
            rest.append(ids[lo:stop].copy())


def read_sequence(path: str, index: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a local file; the ids are a view of the mapped file."""
    f = pa.ipc.open_file(pa.memory_map(path))
    b = f.get_batch(index // BATCH)
    i = index % BATCH
    return b.column("ids")[i].values.to_numpy(), b.column("mask")[i].values.to_numpy(zero_copy_only=False)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, length: int = SEQUENCE, parts: int | None = None, file_tokens: int = FILE_TOKENS, order: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Write ``docs`` (doc_id, text, and the columns of ``order``) below ``folder`` (a URI that all
    executors reach); returns the manifest.

    Documents are range-partitioned and sorted by ``order`` (ties by the hash of the text, nulls
    first), encoded, closed with END and packed into sequences of ``length``. File (part,
    number) order is that order; a document lies in one file, and only a file's last sequence
    is padded. There is a part for each PART_BYTES of input, and a task holds the pieces of
    the encoder and the ids of one batch of sequences. Files are written under a temporary
    name, renamed when whole, and count only when the manifest, which is written last, lists
    them: a task that runs again leaves unlisted files, never doubled rows.

    Null text is encoded as ''. Rows that repeat an id are separate documents. Extra columns
    are ignored. An empty table gives an empty manifest.
    """
    dtype = "uint16" if Encoder(tokenizer).size <= 1 << 16 else "uint32"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        part, encoder, writer, number = TaskContext.get().partitionId(), Encoder.shared(tokenizer, dtype), None, 0
        done = []

        def finish() -> None:
            writer.close()
            done.append({"file": writer.path.rsplit("/", 1)[1], "part": part, "number": number, "documents": writer.documents, "tokens": writer.tokens})

        end = np.array([END], dtype)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in slices(texts):
                for doc_id, found in zip(ids[lo:hi], encoder.encode(texts.slice(lo, hi - lo)), strict=True):
                    if writer is None:
                        writer = SequenceWriter(fs, f"{root}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.arrow", length, dtype)
                    writer.add(doc_id, np.concatenate([found, end]))
                    if writer.tokens >= file_tokens:
                        finish()
                        writer, number = None, number + 1
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    keys = [*order, "tie"]
    ordered = docs.select(*dict.fromkeys(["doc_id", "text", *order]), F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange(parts or _parts(docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "manifest")


def _parts(docs: DataFrame) -> int:
    """A part for each PART_BYTES of what Spark knows the input to hold, and one for each shuffle partition at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // PART_BYTES)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (tokens before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    f = pa.ipc.open_file(source)
                    out = []
                    for i, (doc_id, start, ids) in enumerate(read_documents(f.get_batch(k) for k in range(f.num_record_batches))):
                        out.append((row["part"], row["number"], doc_id, i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ_BACK.split(", ")])

    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = manifest.select("file", "part", "number").repartition(parts, "file").mapInArrow(read, READ_BACK)
    # one row for each file of many million tokens
    before = manifest.select("part", "number", (F.sum("tokens").over(Window.orderBy("part", "number")) - F.col("tokens")).alias("before"))
    return found.join(before, ["part", "number"]).select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files and read them back; see write_token_files and read_token_files."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer or tokenizer_path(), **options), folder)


def in_row_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part, place) of ``docs`` read from Parquet files: the number in a row's file name and its place in the file.

    So rows keep the order in which Spark wrote them. Both are null where rows come from elsewhere.
    """
    try:
        return docs.select("doc_id", "text", F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).try_cast("long").alias("part"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("place"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read back from its Arrow file: doc_id, start, n_tokens, ids_crc32."""
    return token_files(table(spark, sf_dir, "documents"))
