"""Token-id files with canonical length-limited Huffman codes.

Lengths come from global id counts by package-merge (at most 16 bits), codes are
canonical, so the codebook is one length for each id. A block holds one document:
a header, the bit offset of every ``STEP``-th token as a difference, and the bits.
Decoding looks 16 bits up in a table; all checkpoints of many blocks advance
together, one token a step, so the table look-ups are vectorised.

Files are ranges of doc_id of about equal bytes: folder ``bucket=<n>`` holds the n-th
range, its blocks in ascending order, written by Spark's own writer (any file system
Spark knows). An id (or null) with the rows of many files is dealt to as many. A
document's start is the sum of the ranges before it and of the blocks before it.

Odd cases: null and empty texts hold the end id alone; null ids come first; rows
with one doc_id are written each, in any order among themselves; a very long text
is one block, so its file may be longer than the others; an empty table writes no
block; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, dealt, doc_frame, mix, range_bounds, released, shared_dir, slices, trim
from .tokens import SLICE, encoder

LIMIT = 16
STEP = 128
HEAD = "<4sBqQIQ"  # magic, has an id, doc_id, tokens, checkpoints, bytes of bits
MAGIC = b"HFB1"
MOST_FILES = 1_000_000
NO_ID = -(1 << 63)

_IDS = "doc_id long, row long, n long, ids binary, counts binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol (0: unused) with the least total over codes of at most ``limit`` bits: package-merge."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    merged, flags = coins, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        flags.append(at < n)
    take = 2 * (n - 1)
    lengths = np.zeros(n, np.int64)
    for own in reversed(flags):
        first = own[:take]
        c = int(first.sum())
        lengths[:c] += 1
        take = 2 * (len(first) - c)
    out[order] = lengths
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by symbol."""
    out = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[np.searchsorted(lengths[order], 1) :].tolist():
        bits = int(lengths[s])
        code <<= bits - last
        out[s] = code
        code, last = code + 1, bits
    return out


def table(lengths: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each next 16 bits: symbol and bits used."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    symbol, bits = np.zeros(1 << LIMIT, np.uint16), np.ones(1 << LIMIT, np.uint8)
    symbol[: span.sum()], bits[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, bits


def encode(docs: list[np.ndarray], lengths: np.ndarray, book: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(checkpoints, bits) of each document; each starts at a byte."""
    n = np.array([len(d) for d in docs])
    ids = np.concatenate(docs)
    bits = lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(bits)])
    first = np.concatenate([[0], np.cumsum(n)])
    own = total[first[1:]] - total[first[:-1]]
    at_byte = np.concatenate([[0], np.cumsum((own + 7) // 8)])
    pos = total[:-1] + np.repeat(at_byte[:-1] * 8 - total[first[:-1]], n)
    byte = pos >> 3
    window = book[ids].astype(np.int64) << (24 - bits - (pos & 7))
    size = int(at_byte[-1])
    out = np.zeros(size + 3, np.float64)
    for k in range(3):
        out += np.bincount(byte + k, (window >> (16 - 8 * k)) & 255, minlength=size + 3)
    raw = out[:size].astype(np.uint8).tobytes()
    made = []
    for d in range(len(docs)):
        marks = pos[first[d] : first[d + 1] : STEP] - at_byte[d] * 8
        made.append((np.diff(marks).astype("<u2").tobytes(), raw[at_byte[d] : at_byte[d + 1]]))
    return made


def decode(blocks: list[tuple[int, bytes, bytes]], symbol: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """The ids of each block (tokens, checkpoints, bits); all stretches between checkpoints advance together."""
    raw = np.frombuffer(b"".join(x[2] for x in blocks) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = np.array([x[0] for x in blocks])
    stretches = -(-n // STEP)
    starts, base = [], 0
    for _, marks, bits in blocks:
        starts.append(base * 8 + np.concatenate([[0], np.cumsum(np.frombuffer(marks, "<u2").astype(np.int64))]))
        base += len(bits)
    pos = np.concatenate(starts)
    want = np.full(len(pos), STEP)
    want[np.cumsum(stretches) - 1] = n - (stretches - 1) * STEP
    out = np.zeros((len(pos), STEP), np.uint16)
    order = np.argsort(-want, kind="stable")
    pos, want = pos[order], want[order]
    for k in range(int(want[0]) if len(want) else 0):
        live = int(np.searchsorted(-want, -k, "left"))
        p = pos[:live]
        b = p >> 3
        peek = ((raw[b] << 16 | raw[b + 1] << 8 | raw[b + 2]) >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
        out[order[:live], k] = symbol[peek]
        pos[:live] = p + width[peek]
    flat, got, at = out.reshape(-1), [], 0
    for count, s in zip(n.tolist(), stretches.tolist(), strict=True):
        got.append(flat[at : at + count])
        at += s * STEP
    return got


def id_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, row, n, ids (16 bits each) with the end id; each task's last row has the counts of its ids and no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(tokenizer), np.zeros(1 << 16, np.int64)
        names = ["doc_id", "row", "n", "ids", "counts"]
        for b in batches:
            for i, j, data, offs in slices(b.column("text"), SLICE):
                ids, at = encode(data, offs, end_id)
                total += np.bincount(ids, minlength=1 << 16)
                ids = ids.astype("<u2", copy=False)
                cells = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(2 * at), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("row").slice(i, j - i), pa.array(np.diff(at)), cells, pa.nulls(j - i, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())], names)
        trim()

    return doc_frame(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _IDS)


def id_counts(rows: DataFrame) -> np.ndarray:
    """Uses of each of the 65,536 ids, from what the tasks counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(zlib.decompress(x.as_buffer()), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    got = rows.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << 16, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


def write(rows: DataFrame, path: str, least: int = 4 << 20) -> np.ndarray:
    """Write ``rows`` (as ``id_rows`` makes them, stored) as files under ``path``; returns the codebook (bits of each id), also kept beside them. ``least``: bytes of a file in a small table."""
    spark = rows.sparkSession
    counts = id_counts(rows)
    rows = rows.where(F.col("n").isNotNull())
    lengths = code_lengths(counts)
    book = codes(lengths)
    total = int(counts.sum())
    size = int((counts * lengths.astype(np.int64)).sum()) // 8
    file = max(least, min(64 << 20, size // 1000), size // MOST_FILES)
    bounds = range_bounds(rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "n"), "key", F.col("n"), total, -(-total * file // max(size, 1)) or 1)
    sent = spark.sparkContext.broadcast((lengths, book, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, book, bounds = sent.value
        for b in batches:
            for i, j in _runs(b.column("ids"), 1 << 20):
                part = b.slice(i, j - i)
                docs = [np.frombuffer(x, "<u2") for x in part.column("ids").to_pylist()]
                made = []
                for doc_id, d, (marks, bits) in zip(part.column("doc_id").to_pylist(), docs, encode(docs, lengths, book), strict=True):
                    made.append(struct.pack(HEAD, MAGIC, doc_id is not None, doc_id or 0, len(d), len(marks) // 2, len(bits)) + marks + bits)
                bucket = dealt(bounds, part.column("doc_id").fill_null(NO_ID).to_numpy(), mix(part.column("row").to_numpy().astype(U64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bucket.astype(np.int32)), pa.array(made, pa.binary())], ["doc_id", "bucket", "block"])
        trim()

    blocks = rows.select("doc_id", "row", "ids").mapInArrow(run, "doc_id long, bucket int, block binary").repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "doc_id")
    blocks.select(F.col("block").cast("string").alias("value"), "bucket").write.partitionBy("bucket").option("lineSep", "\n").text(f"{path}/blocks")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    return lengths


def _runs(col: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of a binary column of about ``most`` bytes."""
    size = 0
    first = 0
    for i, x in enumerate(col):
        n = len(x.as_buffer())
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if len(col) > first:
        yield first, len(col)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, bucket, before (tokens before it in its range), n_tokens, ids_crc32 (of 32-bit ids), read from the files."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()["lengths"], np.uint8)
    sent = spark.sparkContext.broadcast(table(lengths, codes(lengths)))
    files = spark.read.format("binaryFile").load(f"{path}/blocks")
    if "bucket" not in files.columns:  # no document, no folder
        files = files.withColumn("bucket", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, width = sent.value
        for b in batches:
            for k in range(b.num_rows):
                buf = memoryview(b.column(0)[k].as_buffer())
                at = before = 0
                group, heads, tokens = [], [], 0
                while at < len(buf):
                    magic, has, doc_id, n, marks, size = struct.unpack_from(HEAD, buf, at)
                    if magic != MAGIC:
                        raise ValueError("not a block of this format")
                    at += struct.calcsize(HEAD)
                    group.append((n, bytes(buf[at : at + 2 * marks]), bytes(buf[at + 2 * marks : at + 2 * marks + size])))
                    heads.append((doc_id if has else None, before))
                    at += 2 * marks + size + 1
                    before += n
                    tokens += n
                    if tokens > 1 << 20 or at >= len(buf):
                        ids = decode(group, symbol, width)
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in heads], pa.int64()), pa.array([b.column(1)[k].as_py()] * len(heads), pa.int32()), pa.array([x[1] for x in heads], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["doc_id", "bucket", "before", "n_tokens", "ids_crc32"])
                        group, heads, tokens = [], [], 0

    return files.select("content", "bucket").mapInArrow(run, "doc_id long, bucket int, before long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, least: int = 4 << 20) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32. The files stay under ``path``."""
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    ids = f"{path}/ids"
    id_rows(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(ids)
    write(spark.read.schema(_IDS).parquet(ids), path, least)
    released(spark, ids)
    got = read(spark, path)
    got.write.parquet(f"{path}/read_back")
    got = spark.read.schema(got.schema).parquet(f"{path}/read_back")
    # Sums of the files before a file, in two steps, so that no task sums over more than about a thousand groups or files.
    per = got.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).withColumn("shelf", F.floor(F.col("bucket") / 1024))
    shelves = per.groupBy("shelf").agg(F.sum("n").alias("n")).select("shelf", (F.sum("n").over(Window.orderBy("shelf")) - F.col("n")).alias("below"))
    inside = F.sum("n").over(Window.partitionBy("shelf").orderBy("bucket")) - F.col("n")
    per = per.withColumn("inside", inside).join(F.broadcast(shelves), "shelf").select("bucket", (F.col("below") + F.col("inside")).alias("above"))
    return got.join(F.broadcast(per), "bucket").select("doc_id", (F.col("above") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
