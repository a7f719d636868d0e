"""Arrow buffers, byte-level words, 64-bit hashing and shared folders.

Everything here works on whole record batches at once: the UTF-8 bytes of a
string column are one numpy buffer, and word boundaries, word hashes and k-gram
hashes come from a few vectorised passes over it. UTF-8 continuation and lead
bytes are all >= 0x80, so ASCII classes can be decided on bytes.

A batch is cut into slices of about ``SLICE_BYTES`` so that temporaries (some
40 bytes for each byte of text) stay small; a single longer document is a slice
of its own.
"""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)


def cache() -> dict:
    """What a Python worker keeps from task to task (code arrives by value, so module globals don't last)."""
    return sys.__dict__.setdefault("_evigrain_cache", {})


def trim() -> None:
    """Gives freed memory back to the system at the end of a task; workers stay for later stages."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i <= n; the table doubles when a longer text comes."""
    c = cache()
    have = c.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 2 * SLICE_BYTES)
        base = 0xD1342543DE82EF95
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = U64(1)
            both.append(np.multiply.accumulate(p))
        have = c["powers"] = tuple(both)
    return have


def _byte_values() -> np.ndarray:
    c = cache()
    if "byte_values" not in c:
        c["byte_values"] = mix(np.arange(1, 257, dtype=U64) * MULT) | U64(1)
    return c["byte_values"]


def slices(col: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``most`` bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, o, d = col.buffers()
    offs = np.frombuffer(o, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def table(separators: bytes) -> np.ndarray:
    """Per byte: 0 for a separator, else the byte with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t


#: Words ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A zero byte inside a white-space word must not split it, so it maps to a free value (0xFF never occurs in UTF-8).
SPACE_WORDS = table(b"\x20\x09\x0a\x0b\x0c\x0d")
SPACE_WORDS[0] = 255
ALNUM_WORDS = table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of the byte strings data[starts:ends]; equal strings have equal names."""
    up, down = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum(_byte_values()[data] * up[: len(data)], out=c[1:])
    h = (c[ends] - c[starts]) * down[starts]
    h += (ends - starts).astype(U64) * MULT
    return mix(h)


def words(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, per document number of words) of the lower-cased words of a slice."""
    n = len(offs) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(n, np.int64)
    low = classes[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(data)]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per = np.diff(np.searchsorted(starts, offs))
    return starts, ends, names(low, starts, ends), per


def grams(h: np.ndarray, per: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of every run of k words inside one document."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(m, U64)
    for i in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[i : i + m]
    owner = np.repeat(np.arange(len(per)), per)
    at = np.flatnonzero(owner[:m] == owner[k - 1 :])
    return mix(out[at]), at


def low_bound(n: int, most: int, what: str) -> None:
    """Raise when something meant for a broadcast is larger than its documented bound."""
    if n > most:
        raise ValueError(f"{what}: {n} bytes are more than the bound of {most}")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name that all executors share: under spark.checkpoint.dir, else (tests, one machine) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        import tempfile

        base = cache().setdefault("tmp", tempfile.mkdtemp(prefix="evigrain-"))
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/evigrain-{uuid.uuid4().hex}"


def range_bounds(rows: DataFrame, key: str, size: Column, total: int, per_range: int) -> np.ndarray:
    """Sorted upper bounds that cut ``rows`` by the long ``key`` into ranges of about ``per_range`` of ``size`` (``total`` in all); a key that fills several ranges stands there as often.

    Rows turn into points in proportion to their size, 20 a range. Up to 1000 ranges come from one summary of
    bounded accuracy; more come in two levels, each group of ranges summarised in a task of its own.
    """
    n = -(-total // per_range)
    if n <= 1:
        return np.zeros(0, np.int64)
    spark = rows.sparkSession
    c = F.floor(size * F.lit(20.0 / per_range) + F.rand(7)).cast("int")
    points = rows.select(F.explode(F.array_repeat(F.col(key), c)).alias("key"))
    cuts = lambda k: F.percentile_approx("key", [i / k for i in range(1, k)], 100 * k)
    if n <= 1000:
        return np.array(sorted(points.agg(cuts(n).alias("b")).first()["b"] or []), np.int64)
    outer = int(np.ceil(np.sqrt(n)))
    points = stored(points)
    coarse = np.array(sorted(points.agg(cuts(outer).alias("b")).first()["b"] or []), np.int64)
    sent = spark.sparkContext.broadcast(coarse)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dealt(sent.value, keys, mix(np.arange(len(keys), dtype=U64))).astype(np.int32))], ["key", "part"])

    inner = points.mapInArrow(group, "key long, part int").groupBy("part").agg(cuts(outer).alias("b")).toArrow()
    return np.sort(np.concatenate([coarse, *(np.array(x, np.int64) for x in inner["b"].to_pylist())]))


def dealt(bounds: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Range of each key; a key that fills several ranges is dealt to them in the order of ``tie`` (uint64)."""
    low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
    return low + ((tie >> U64(32)) * np.maximum(high - low, 1).astype(U64) >> U64(32)).astype(np.int64)


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Written as Parquet in the shared folder and read back: lineage ends here and nothing upstream runs twice. ``paths`` gets the folder, for released()."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, path: str) -> None:
    """Delete a folder that stored() or a writer made, through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows: with long texts, Spark's 10,000 hold tens of MB in each task's Python and JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def doc_frame(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under fixed names; whatever else the table has is pruned at the scan."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)
