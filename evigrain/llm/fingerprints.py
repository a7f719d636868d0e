"""Document fingerprints by locally consistent parsing.

Level by level, a text's symbols (bytes at first) are cut into phrases: runs of one
symbol become one, deterministic coin tossing turns neighbouring names into labels
0 to 5 that differ from their neighbours, and a phrase begins at each local maximum.
A phrase's name is a hash of its symbols, so no dictionary is shared. Cuts depend on
a few neighbours only: equal substrings get equal phrases but for some at both ends,
wherever they stand. Tasks parse many texts at once with numpy.

The fingerprint has up to three sketches: of the phrases of level 3 and above, of level
2 and above, and of all. Each keeps, in 64 buckets, the least name (16 bits) there. A
text's own level is the highest of 3, 2 and 1 with enough phrases; its fingerprint is
that digit and the sketches of that level and below. Two fingerprints are compared at
the lower of their own levels, so two texts are never sketched over different levels.
Their likeness is the share of buckets that agree among those that either fills: an
estimate of the Jaccard similarity of their phrases.

Odd cases: null counts as the empty text, whose fingerprint is all zeros; two such
have likeness 1; repeated ids are ordered by text, null ids come first; a table of
one document has itself as the next one; a very long text is parsed whole, in one
piece; of equal names a bucket keeps one; other columns are ignored. An id, or null,
with the rows of many ranges is dealt to several by the first bytes of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, U64, _byte_values, cache, dealt, doc_frame, mix, range_bounds, trim

BUCKETS = 64
ENOUGH = 24  # phrases below which a lower level joins the sketch
LEVELS = 12
SKETCHES = 3
RANGE_BYTES = 8 << 20
MOST_RANGES = 100_000
NO_ID = -(1 << 63)


def _toss() -> np.ndarray:
    """Label of (own, previous) for values below 256: twice the lowest differing bit, plus the own bit there."""
    c = cache()
    if "toss" not in c:
        a, b = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
        d = a ^ b
        low = np.bitwise_count(((d & -d) - 1) & 0xFF)
        low[d == 0] = 0
        c["toss"] = (2 * low + ((a >> low) & 1)).astype(np.uint8).reshape(-1)
    return c["toss"]


def _phrases(names: np.ndarray, small: np.ndarray | None, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names of the phrases, offsets of each text). ``small``: the symbols themselves if they are bytes."""
    n = len(names)
    head = np.zeros(n, bool)
    head[offs[:-1][np.diff(offs) > 0]] = True
    key = small if small is not None else names
    new = head.copy()
    new[0] = True
    new[1:] |= key[1:] != key[:-1]
    if not new.all():  # a run of one symbol is one symbol
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n))
        names = names[at]
        long = length > 1
        names[long] = mix(names[long] + length[long].astype(U64) * MULT)
        offs = np.searchsorted(at, offs)
        head, n = head[at], len(at)
        small = None if small is None else small[at]  # neighbours differ still
    if small is None:
        before = np.zeros_like(names)
        before[1:] = names[:-1]
        before[head] = ~names[head]
        d = names ^ before
        low = np.bitwise_count((d & (~d + U64(1))) - U64(1)).astype(np.uint8)
        label = 2 * low + ((names >> low.astype(U64)) & U64(1)).astype(np.uint8)
    else:
        label = small
    toss = _toss()
    for _ in range(3 if small is None else 4):
        before = np.zeros_like(label)
        before[1:] = label[:-1]
        before[head] = label[head] ^ 1
        label = toss[label.astype(np.int32) << 8 | before]
    cut = np.zeros(n, bool)
    cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    cut |= head
    after = np.flatnonzero(head)[1:] - 1  # a text's last symbol has no right neighbour
    cut[after] &= head[after]
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, n))
    k = np.arange(n) - np.repeat(at, length)
    c = cache()
    if "phrase_powers" not in c or len(c["phrase_powers"]) <= k.max():
        c["phrase_powers"] = np.multiply.accumulate(np.full(max(64, int(k.max()) + 1), U64(0xD6E8FEB86659FD93)))
    out = mix(np.add.reduceat(names * c["phrase_powers"][k], at) + length.astype(U64) * MULT)
    return out, np.searchsorted(at, offs)


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(own level of each text, (texts, SKETCHES, BUCKETS) uint16); 0 is an empty bucket. Sketch k is of the phrases of level k + 1 and above."""
    n = len(texts)
    least = np.full((n, BUCKETS), ~U64(0))
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    own, out = np.ones(n, np.int64), np.zeros((n, SKETCHES, BUCKETS), np.uint16)
    if not len(data):
        return own, out
    names, small = _byte_values()[data], data
    levels = []
    for level in range(1, LEVELS + 1):
        names, offs = _phrases(names, small, offs)
        small = None
        levels.append((names, offs))
        if np.diff(offs).max() <= 1:
            break
    many = [np.diff(o) for _, o in levels]
    for k in range(1, min(SKETCHES, len(levels))):
        own[many[k] >= ENOUGH] = k + 1
    for k in range(max(len(levels), SKETCHES) - 1, -1, -1):
        if k < len(levels):
            names, offs = levels[k]
            row = np.repeat(np.arange(n), many[k])
            if k:  # a text that is one phrase already has no higher level, whatever else is parsed with it
                use = (many[k - 1] > 1)[row]
                names, row = names[use], row[use]
            np.minimum.at(least.reshape(-1), row * BUCKETS + (names >> U64(58)).astype(np.int64), names << U64(6))
        if k < SKETCHES:
            x = (least >> U64(48)).astype(np.uint16)
            x[x == 0] = 1
            x[least == ~U64(0)] = 0
            out[:, k] = x
    return own, out


def shown(own: np.ndarray, found: np.ndarray) -> list[str]:
    """Own level, then the sketches from that level down to the first."""
    return [f"{k}{x[k - 1 :: -1].astype('>u2').tobytes().hex()}" for k, x in zip(own.tolist(), found, strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, 0 to 1, at the lower of the two own levels."""
    at, rows = np.minimum(a[0], b[0]) - 1, np.arange(len(a[0]))
    x, y = a[1][rows, at], b[1][rows, at]
    filled = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of doc_id, each range in order and ended by the first row of the next (``borrowed``)."""
    spark = docs.sparkSession
    rows = doc_frame(docs).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text") + 64
    total = rows.agg(F.sum(size).alias("n")).first()["n"] or 0
    bounds = range_bounds(rows.select("key", size.cast("long").alias("n")), "key", F.col("n"), total, max(RANGE_BYTES, -(-total // MOST_RANGES)))
    values, times = np.unique(bounds, return_counts=True)
    hot = values[times > 1].tolist()  # ids that fill several ranges; there the first seven bytes of a text decide
    first_bytes = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = rows.withColumn("tie", F.when(F.col("key").isin(hot), first_bytes).otherwise(F.lit(0).cast("long")) if hot else F.lit(0).cast("long"))
    sent = spark.sparkContext.broadcast(bounds)

    def buckets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, tie = b.column("key").to_numpy(), b.column("tie").to_numpy()
        return key, tie, dealt(sent.value, key, tie.astype(U64) << U64(8))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, tie, bucket = buckets(b)
            order = np.lexsort((tie, key, bucket))
            own, at = np.unique(bucket[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(key[order][at]), pa.array(tie[order][at])], ["bucket", "key", "tie"])

    first = rows.select("key", "tie").mapInArrow(firsts, "bucket int, key long, tie long").groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("x")).select("bucket", "x.*").toArrow().sort_by("bucket")
    lends = (first["key"].to_numpy(), first["tie"].to_numpy(), first["bucket"].to_numpy(), np.roll(first["bucket"].to_numpy(), 1))
    lent = spark.sparkContext.broadcast(lends)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ties, own, to = lent.value
        names = ["doc_id", "key", "text", "bucket", "borrowed"]
        for b in batches:
            key, tie, bucket = buckets(b)
            b = b.select(["doc_id", "key", "text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket.astype(np.int32)), pa.array(np.zeros(len(key), bool))], names)
            at = np.minimum(np.searchsorted(own, bucket), len(own) - 1)
            mask = (keys[at] == key) & (ties[at] == tie) & (own[at] == bucket)
            if mask.any():
                part = b.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to[at[mask]].astype(np.int32)), pa.array(np.ones(part.num_rows, bool))], names)
        trim()

    rows = rows.mapInArrow(deal, "doc_id long, key long, text string, bucket int, borrowed boolean")
    return rows.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "borrowed", "key", "text")


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def described(group: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in group] + [following]
        edited = [edited_text(a, b).encode() for a, b in zip(texts, texts[1:])]
        both = sketches([t.encode() for t in texts] + edited)
        n = len(group)
        own, after, changed = (tuple(x[i:j] for x in both) for i, j in ((0, n), (1, n + 1), (n + 1, None)))
        show = lambda x: pa.array(shown(*x), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in group], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), show(own), show(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, after))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, bucket = 0, None
        for b in batches:
            for doc_id, text, where, borrowed in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("bucket").to_pylist(), b.column("borrowed").to_pylist(), strict=True):
                text = text.as_py()
                if group and (borrowed or size > 1 << 18):
                    yield described(group, text)
                    group, size = [], 0
                if not borrowed:
                    if bucket is not None and group and where != bucket:
                        raise ValueError("a range has no row borrowed from the next")
                    group.append((doc_id, text))
                    size += len(text)
                    bucket = where
        if group:
            raise ValueError("a range has no row borrowed from the next")
        trim()

    return with_next(docs).select("doc_id", "text", "bucket", "borrowed").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
