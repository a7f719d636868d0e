"""Best-fit packing planned over a histogram of lengths.

Only the number of pieces of each length (at most ``capacity`` numbers) reaches
the driver. Best-fit decreasing runs over those counts: equal bins are one entry,
so the plan has a few thousand ranges however many documents there are. A range
says: pieces of this length with ranks r0, r0+1, ... go, ``q`` to a sequence,
behind ``base`` tokens of sequences s0, s0+1, ... Pieces get their rank within
their length from counts by (length, salt) and a row number inside each salted
group, so that no length, however common, is ranked by one task.

Odd cases: null and empty texts have the end id alone (one piece of length 1);
repeated rows are packed each; a very long text is a slice of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_frame, slices, stored, trim
from .tokens import SLICE, encoder, public_path


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, first sequence, pieces a sequence, base) in order of length and rank."""
    plan, bins, left = [], {}, []  # bins: room left -> [(first sequence, number)]; left: those rooms, sorted
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in bins:
                bins[room] = []
                insort(left, room)
            bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        c, rank = counts[length], 0
        while rank < c:
            k = bisect_left(left, length)
            if k < len(left):
                room = left[k]
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    left.pop(k)
            else:
                room, first = capacity, sequences
                n = -(-(c - rank) // (capacity // length))
                sequences += n
            q = room // length
            whole = min(n, (c - rank) // q)
            if whole:
                plan.append((length, rank, first, q, capacity - room))
                rank += whole * q
                put(room - q * length, first, whole)
            if whole < n:
                rest = c - rank
                if rest:
                    plan.append((length, rank, first + whole, q, capacity - room))
                    put(room - rest * length, first + whole, 1)
                    rank, whole = c, whole + 1
                put(room, first + whole, n - whole)
    return sorted(plan)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in batches:
            for i, j, data, offs in slices(b.column(1), SLICE):
                ids, at = encode(data, offs, end_id)
                n = np.diff(at)
                per = -(-n // capacity)
                row = np.repeat(np.arange(j - i), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                first, raw = at[row] + start, memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return doc_frame(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def placed(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """``rows`` (with ``length``, and columns that tell them apart) plus sequence_id and offset. ``rows`` should be stored: it is read three times."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).toArrow().to_pylist()}
    group = max(256, isqrt(sum(counts.values())))  # rows in a salted group, and about as many groups
    spark = rows.sparkSession
    known = spark.createDataFrame([(n, -(-c // group)) for n, c in counts.items()] or [(0, 1)], "length long, salts long")
    tags = [c for c in rows.columns if c != "length"]
    salted = rows.join(F.broadcast(known), "length").withColumn("_salt", F.pmod(F.xxhash64(*tags), "salts")).drop("salts")
    per = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    per = per.select("length", "_salt", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*tags))
    ranked = salted.withColumn("_own", own).join(per, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1).drop("_salt", "_own", "_before")

    names = rows.columns
    plan = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        starts = (p[:, 0] << 44) + p[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            own = p[np.searchsorted(starts, (length << 44) + rank, "right") - 1] if len(p) else np.zeros((0, 5), np.int64)
            k = rank - own[:, 1]
            out = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(own[:, 2] + k // own[:, 3]), pa.array(own[:, 4] + k % own[:, 3] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = pieces(docs, tokenizer or public_path("word_bpe_49k.json"), end_id, capacity).withColumn("_row", F.monotonically_increasing_id())
    return placed(stored(rows), capacity).drop("_row")
