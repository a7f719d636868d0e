"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits, lower-cased ASCII letters and non-ASCII
characters. Each side keeps, for every run of ``window - K + 1`` consecutive
word K-grams, the K-gram of least hash (the last one of equals). The choice
depends on the run's words alone, so any ``window`` words that a document and an
item share leave one common fingerprint at the same place in both: joining
fingerprints and extending each hit word by word to both sides finds every
shared span of at least ``window`` words. Items shorter than a window have no
such guarantee; they are looked up by the hash of all their words.

A benchmark of up to ``BLOCK_BYTES`` is broadcast to one pass over the documents,
which never shuffle. A larger one meets them in a shuffle of fingerprints: a bounded
filter of the items' fingerprints lets few of the documents' through, these are
joined, and only texts with a common fingerprint, once for equal texts, travel to be
extended against the items that they share one with. A document's items come in
chunks of bounded bytes.

Odd cases: null or wordless texts have no words and no hits; items without words
match nothing; equal item ids count once; a null item id reads as the empty
text; an empty benchmark leaves every document clean; repeated documents are judged
each; of equal least hashes the last is the fingerprint; a very long text is scanned
whole, in a slice of its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, MULT, U64, doc_frame, grams, mix, slices, small_batches, stored, trim, words

K = 5
BLOCK_BYTES = 16 << 20  # benchmark text in one broadcast
CHUNK_BYTES = 4 << 20  # item texts that one document is extended against at once
FILTER_BITS = 27  # bits of the filter of a large benchmark: 2**27, 16 MB


def winnow(g: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """Indexes into ``g`` of the fingerprints; ``at`` is each K-gram's first word, in order, so a run inside one document has at[i + run - 1] - at[i] == run - 1."""
    m = len(g) - run + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, arg = g[:m].copy(), np.arange(m)
    for j in range(1, run):
        x = g[j : j + m]
        less = x <= best
        best[less] = x[less]
        arg[less] = np.flatnonzero(less) + j
    whole = at[run - 1 :] - at[:m] == run - 1
    return np.unique(arg[whole])


def build_index(ids: list[str], texts: list[str], window: int) -> dict:
    """Fingerprints of the long items (sorted, with their places) and whole hashes of the short ones."""
    hashes, prints, where, short = [], [], [], {}
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8"), np.uint8)
        _, _, h, per = words(raw, np.array([0, len(raw)]), ALNUM_WORDS)
        hashes.append(h)
        if len(h) >= window:
            g, at = grams(h, per, K)
            for j in winnow(g, at, window - K + 1):
                prints.append(g[j])
                where.append((i, int(at[j])))
        elif len(h):
            short.setdefault(len(h), {}).setdefault(int(grams(h, per, len(h))[0][0]), []).append(i)
    order = np.argsort(np.array(prints, np.uint64), kind="stable")
    keys = np.array(prints, np.uint64)[order]
    return {"ids": ids, "words": hashes, "keys": keys, "where": np.array(where, np.int64).reshape(-1, 2)[order], "short": {n: (np.array(sorted(d), np.uint64), d) for n, d in short.items()}}


def hits_of(data: np.ndarray, offs: np.ndarray, index: dict, window: int) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
    """(words of each row, hit flag of each word, row -> items) of a slice."""
    _, _, h, per = words(data, offs, ALNUM_WORDS)
    first = np.concatenate([[0], np.cumsum(per)])
    flag = np.zeros(len(h), bool)
    found: dict[int, set[int]] = {}
    keys = index["keys"]
    g, at = grams(h, per, K)
    sel = winnow(g, at, window - K + 1)
    if len(sel) and len(keys):
        f = g[sel]
        lo = np.searchsorted(keys, f, "left")
        hit = keys[np.minimum(lo, len(keys) - 1)] == f
        lo, pos = lo[hit], at[sel[hit]]
        hi = np.searchsorted(keys, f[hit], "right")
        rows = np.searchsorted(first, pos, "right") - 1
        reach: dict[tuple[int, int, int], int] = {}
        for a, b, p, r in zip(lo.tolist(), hi.tolist(), pos.tolist(), rows.tolist(), strict=True):
            start, end = int(first[r]), int(first[r + 1])
            for item, q in index["where"][a:b].tolist():
                diagonal = (r, item, p - q)
                if reach.get(diagonal, -1) > p:
                    continue
                own = index["words"][item]
                left = min(p - start, q)
                x = h[p - left : p] == own[q - left : q]
                left = left if x.all() else int(np.argmin(x[::-1]))
                right = min(end - p, len(own) - q)
                x = h[p : p + right] == own[q : q + right]
                right = right if x.all() else int(np.argmin(x))
                reach[diagonal] = p + right
                if left + right >= window:
                    flag[p - left : p + right] = True
                    found.setdefault(r, set()).add(item)
    for n, (known, items) in index["short"].items():
        g, at = grams(h, per, n)
        for j in np.flatnonzero(np.isin(g, known)).tolist():
            p = int(at[j])
            flag[p : p + n] = True
            found.setdefault(int(np.searchsorted(first, p, "right")) - 1, set()).update(items[int(g[j])])
    return per, flag, found


def _items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull())


def _small(items: DataFrame, block_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0) <= block_bytes


def _packed(per: np.ndarray, flag: np.ndarray, found: dict[int, set[int]], ids: list[str]) -> tuple[list[bytes], list[list[str]]]:
    """(hit bits of each row, none if there is no hit; its item ids, sorted)."""
    first = np.concatenate([[0], np.cumsum(per)])
    hits = [np.packbits(flag[first[r] : first[r + 1]]).tobytes() if r in found else b"" for r in range(len(per))]
    return hits, [sorted({ids[x] for x in found.get(r, ())}) for r in range(len(per))]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (packed bits, one a word, empty if none), items (ids, sorted)."""
    items = _items(benchmark)
    if not _small(items, block_bytes):
        counted, matched = _joined(docs, items, window)
        empty = {"hits": F.coalesce("hits", F.lit(b"")), "items": F.coalesce("items", F.array().cast("array<string>"))}
        return counted.join(matched, "text_key", "left").withColumns(empty).select("doc_id", "n_words", "hits", "items")
    own = items.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(build_index(own["id"].to_pylist(), own["text"].to_pylist(), window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(1)):
                per, flag, found = hits_of(data, offs, sent.value, window)
                hits, names = _packed(per, flag, found, sent.value["ids"])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(per.astype(np.int64)), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])
        trim()

    return doc_frame(docs).mapInArrow(scan, "doc_id long, n_words long, hits binary, items array<string>")


def _keys(h: np.ndarray, per: np.ndarray, lengths: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, its first word) of the fingerprints, and of all runs of as many words as short items have."""
    g, at = grams(h, per, K)
    sel = winnow(g, at, window - K + 1)
    keys, where = [g[sel]], [at[sel]]
    for n in lengths:
        g, at = grams(h, per, n)
        keys.append(mix(g + U64(n * int(MULT) & 0xFFFFFFFFFFFFFFFF)))
        where.append(at)
    return np.concatenate(keys), np.concatenate(where)


def _spots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each key."""
    x = mix(keys)
    return (x >> U64(64 - FILTER_BITS)).astype(np.int64), (x & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter(keys: DataFrame) -> np.ndarray:
    """The words of 64 bits of the filter of column ``key``; at most its 16 MB, as (place, word) rows, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for b in batches:
            for x in _spots(b.column(0).to_numpy().view(U64)):
                np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
        own = bits.view(np.int64)
        at = np.flatnonzero(own)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)]), pa.array(own[at[k : k + (1 << 16)]])], ["place", "word"])
        trim()

    got = keys.select("key").mapInArrow(run, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got["place"].to_numpy()] = got["word"].to_numpy()
    return out.view(np.uint8)


def _joined(docs: DataFrame, items: DataFrame, window: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n_words, text_key) of every document, (text_key, hits, items) of the texts with a hit)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = stored(items.distinct().withColumn("item_key", F.unhex(F.md5(F.concat_ws("\0", "id", "text").cast("binary")))))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column("text")):
                _, _, h, per = words(data, offs, ALNUM_WORDS)
                first = np.concatenate([[0], np.cumsum(per)])
                keys, at = _keys(h, per, [], window)
                row, n = np.searchsorted(first, at, "right") - 1, np.zeros(len(at), np.int64)
                for r in np.flatnonzero((per > 0) & (per < window)).tolist():
                    size = int(per[r])
                    own = grams(h[first[r] : first[r + 1]], np.array([size]), size)[0]
                    keys = np.append(keys, mix(own + U64(size * int(MULT) & 0xFFFFFFFFFFFFFFFF)))
                    row, n = np.append(row, r), np.append(n, size)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), b.column("item_key").slice(i, j - i).take(pa.array(row))], ["key", "n", "item_key"])
        trim()

    item_keys = stored(items.select("text", "item_key").mapInArrow(of_items, "key long, n long, item_key binary").distinct())
    lengths = sorted(r["n"] for r in item_keys.where("n > 0").select("n").distinct().collect())  # fewer than ``window``
    sent = spark.sparkContext.broadcast((_filter(item_keys), lengths))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = sent.value
        for b in batches:
            for i, j, data, offs in slices(b.column("text")):
                _, _, h, per = words(data, offs, ALNUM_WORDS)
                keys, at = _keys(h, per, lengths, window)
                ok = np.ones(len(keys), bool)
                for x in _spots(keys):
                    ok &= (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 > 0
                keys, row = keys[ok], np.searchsorted(np.cumsum(per), at[ok], "right")
                order = np.lexsort((keys, row))
                keys, row = keys[order], row[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                keys, row = keys[new], row[new]
                ends = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(per.astype(np.int64)), b.column("text_key").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))], ["doc_id", "n_words", "text_key", "keys"])
        trim()

    keyed = doc_frame(docs).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    counted = stored(keyed.mapInArrow(of_docs, "doc_id long, n_words long, text_key binary, keys array<long>"))
    probes = counted.select("text_key", F.explode("keys").alias("key")).distinct()
    pairs = stored(probes.join(item_keys.select("key", "item_key"), "key").select("text_key", "item_key").distinct().join(items, "item_key"))
    size = pairs.groupBy("text_key").agg(F.ceil(F.sum(F.octet_length("text") + 64) / chunk_bytes).alias("chunks"))
    chunk = F.pmod(F.xxhash64("item_key"), F.col("chunks"))
    lists = pairs.join(size, "text_key").groupBy("text_key", chunk.alias("chunk")).agg(F.collect_list(F.struct("id", F.col("text").alias("item"))).alias("items"))
    texts = keyed.select("text_key", "text").join(size.select("text_key"), "text_key", "left_semi").dropDuplicates(["text_key"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1)
                own = b.column("items")[0].values
                index = build_index(own.field("id").to_pylist(), own.field("item").to_pylist(), window)
                for _, _, data, offs in slices(b.column("text")):
                    hits, names = _packed(*hits_of(data, offs, index, window), index["ids"])
                    if names[0]:
                        yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["text_key", "hits", "items"])
        trim()

    def merge(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, names = None, set()
        for b in group:
            for x, own in zip(b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                bits = x if bits is None else bits | x
                names.update(own)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.binary()), pa.array([bits.tobytes()], pa.binary()), pa.array([sorted(names)], pa.list_(pa.string()))], ["text_key", "hits", "items"])

    schema = "text_key binary, hits binary, items array<string>"
    matched = texts.join(lists, "text_key").select("text_key", "text", "items").mapInArrow(extend, schema)
    return counted.drop("keys"), stored(matched.groupBy("text_key").applyInArrow(merge, schema))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in b.column("hits").to_pylist()]
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hits, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in hits], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    full = contamination(docs, benchmark, window)
    return full.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, with all their columns."""
    items = _items(benchmark)
    small_batches(docs.sparkSession)
    if not _small(items, block_bytes):
        found = _joined(docs, items, window)[1].select("text_key")
        return docs.join(found, F.unhex(F.md5(docs["text"].cast("string").cast("binary"))) == found["text_key"], "left_anti")
    own = items.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(build_index(own["id"].to_pylist(), own["text"].to_pylist(), window))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in slices(b.column(at).cast(pa.string())):
                found = hits_of(data, offs, sent.value, window)[2]
                yield b.slice(i, j - i).filter(pa.array([r not in found for r in range(j - i)], pa.bool_()))
        trim()

    return docs.mapInArrow(keep, docs.schema)
