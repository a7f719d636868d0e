"""BM25's best documents for whole batches of queries, counted and scored by batches in Python.

A document's words are cut and looked up once; what is shuffled and stored of it are
the ids and counts of its matched terms. Each task scores its documents by blocks and
keeps the k best of each query, so pairs of query and document are never rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analyze, fixed
from . import lexical
from .best import BLOCK_SCORES, Best, key_array

#: (query, term) pairs that one pass over the documents serves.
BLOCK_PAIRS = 1 << 20
#: Characters of text, and rows, that a task's Python holds together.
BATCH_ROWS = 256
MATCHED = "source_id string, dl long, tids array<int>, tfs array<int>"

_plain = re.compile(r"[^\W_]+").findall


def cut(docs: DataFrame, key: str, analyser: Callable[[Column], Column]) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[list[str]]]]:
    """(key, source_id and what is sent of each text, the function that gives the terms of a batch's documents). ``docs`` have ``terms``, or ``text`` that the analyser's rule cuts."""
    if "terms" in docs.columns or analyser not in (lexical.plain_terms, analyze.analyze):
        made = F.col("terms") if "terms" in docs.columns else analyser(F.coalesce("text", F.lit("")))
        return docs.select(key, "source_id", made.alias("_terms")), lambda b: (x or [] for x in b.column("_terms").to_pylist())
    if analyser is analyze.analyze:
        return docs.select(key, "source_id", F.col("text").alias("_text")), lambda b: map(analyze.stemmer(), b.column("_text").to_pylist())
    # Letters that are newer than the JVM's tables aren't letters to the queries: such texts are cut there.
    low = F.lower(F.coalesce("text", F.lit("")))
    odd = F.when(low.rlike(r"\p{Cn}"), lexical.plain_terms(F.col("text")))
    sent = docs.select(key, "source_id", low.alias("_text"), odd.alias("_odd"))
    return sent, lambda b: (_plain(t) if o is None else o for t, o in zip(b.column("_text").to_pylist(), b.column("_odd").to_pylist(), strict=True))


def small(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def counted(docs: DataFrame, key: str, analyser: Callable[[Column], Column]) -> DataFrame:
    """key, source_id, dl, term, tf of documents whose keys are their own, without a shuffle."""
    sent, terms = cut(docs, key, analyser)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            dl, words, tfs = [], [], []
            for ws in terms(b):
                own = Counter(ws)
                dl.append(len(ws))
                words.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dl, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))], ["key", "source_id", "dl", "words", "tfs"])

    rows = sent.mapInArrow(run, f"key {kind}, source_id string, dl int, words array<string>, tfs array<bigint>")
    return rows.select(F.col("key").alias(key), "source_id", "dl", F.inline(F.arrays_zip(F.col("words").alias("term"), F.col("tfs").alias("tf"))))


def _matched(docs: DataFrame, key: str, analyser: Callable[[Column], Column], wanted: dict[str, int]) -> DataFrame:
    """A row for each document: key, source_id, dl, the ids and counts of its wanted terms."""
    sent, terms = cut(docs, key, analyser)
    sent_ids = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent_ids.value
        for b in small(batches):
            dl, tids, tfs = [], [], []
            for ws in terms(b):
                own = Counter([known[w] for w in ws if w in known])
                dl.append(len(ws))
                tids.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dl, pa.int64()), pa.array(tids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["key", "source_id", "dl", "tids", "tfs"])

    return sent.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {MATCHED}")


class _Groups:
    """Rows sorted by (key, source_id, dl), by whole keys: what equal rows hold of a term is summed first."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """keys of a block; for each entry the key's place, dl, term id, tf; the number of rows."""
        held: pa.Table | None = None
        for b in small(self.batches, 4096):
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            keys = key_array(t.column("key").combine_chunks())
            cut_at = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)
            held = t.slice(cut_at)
            if cut_at:
                yield self._entries(t.slice(0, cut_at), keys[:cut_at])
        if held is not None and held.num_rows:
            yield self._entries(held, key_array(held.column("key").combine_chunks()))

    @staticmethod
    def _entries(t: pa.Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        one = lambda c: t.column(c).combine_chunks()
        dl, sources = one("dl").to_numpy(), key_array(one("source_id"))
        tids, tfs = one("tids"), one("tfs")
        size = np.diff(tids.offsets.to_numpy())
        flat, tf = tids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.float64)
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        row = np.cumsum(fresh) - 1
        if not fresh.all():
            same = np.ones(len(keys), bool)
            same[1:] = fresh[1:] | (dl[1:] != dl[:-1]) | (sources[1:] != sources[:-1])
            part = np.repeat(np.cumsum(same) - 1, size)
            code, where = np.unique(part * (int(flat.max(initial=0)) + 1) + flat, return_inverse=True)
            first = np.full(len(code), len(flat))
            np.minimum.at(first, where, np.arange(len(flat)))
            entry_row = np.repeat(np.arange(len(keys)), size)[first] if len(flat) else np.zeros(0, np.int64)
            return keys[fresh], row[entry_row], dl[entry_row], flat[first] if len(flat) else flat, np.bincount(where, weights=tf, minlength=len(code)), len(keys)
        return keys, np.repeat(row, size), np.repeat(dl, size), flat, tf, len(keys)


def topk(docs: DataFrame | lexical.Postings, queries: DataFrame, k: int, key: str = "chunk_id", sources: tuple[str, ...] | None = None, decimals: int | None = None, analyser: Callable[[Column], Column] = lexical.plain_terms, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``lexical.ranked(lexical.bm25(...))`` in bounded memory: query_id, key, score, rank. ``docs`` also may have ``text`` instead of ``terms``; queries come in blocks of a bounded number of terms."""
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("repeat"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {(docs.rows if isinstance(docs, lexical.Postings) else docs).schema[key].dataType.simpleString()}, score double"
    blocks, found, spark = 1, None, queries.sparkSession
    got = asked.limit(block_pairs + 1).toArrow()
    if got.num_rows > block_pairs:
        blocks = -(-asked.count() // block_pairs) + 1
    for i in range(blocks):
        own = got if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        if own.num_rows:
            part = _block(docs, own, k, key, sources, decimals, analyser, kinds)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{kinds}, rank int")
    return lexical.ranked(found, key, k, decimals)


def _block(docs: DataFrame | lexical.Postings, own: pa.Table, k: int, key: str, sources: tuple[str, ...] | None, decimals: int | None, analyser: Callable[[Column], Column], kinds: str) -> DataFrame:
    from ..sources.store import settled

    words = own.column("term").combine_chunks().dictionary_encode()
    query = own.column("query_id").combine_chunks().dictionary_encode()
    terms = words.dictionary.to_pylist()
    q, t, repeat = query.indices.to_numpy().astype(np.int64), words.indices.to_numpy().astype(np.int64), own.column("repeat").to_numpy().astype(np.float64)
    df = np.zeros(len(terms))
    if isinstance(docs, lexical.Postings):
        spark = docs.rows.sparkSession
        wanted = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "_tid": pa.array(range(len(terms)), pa.int32())}))
        on = ["term"]
        if docs.shelves:
            wanted, on = wanted.withColumn("shelf", F.pmod(F.xxhash64("term"), F.lit(docs.shelves)).cast("int")), ["shelf", "term"]
        one = docs.rows.join(F.broadcast(wanted), on).select(F.col(key).alias("key"), "source_id", F.col("dl").cast("long").alias("dl"), "_tid", F.col("tf").cast("int").alias("tf"))
        counts = (docs.terms if docs.terms is not None else docs.rows.groupBy("term").agg(F.count("*").alias("df"))).join(F.broadcast(wanted), on).select("_tid", "df").toArrow()
        df[counts.column("_tid").to_numpy()] = counts.column("df").to_numpy()
        stats = docs.stats.first()
        n_docs, avgdl = stats["n_docs"], float(stats["avgdl"] or 1.0)
        rows = one.repartition("key").sortWithinPartitions("key", "source_id", "dl").select("key", "source_id", "dl", F.array("_tid").alias("tids"), F.array("tf").alias("tfs"))
    else:
        matched = _matched(docs, key, analyser, dict(zip(terms, range(len(terms)), strict=True)))
        rows = settled(matched.repartition("key").sortWithinPartitions("key", "source_id", "dl"))

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = n = 0
            per = np.zeros(0, np.int64)
            seen = (b for b in batches)

            def tallied() -> Iterator[pa.RecordBatch]:
                nonlocal total
                for b in seen:
                    total += sum(b.column("dl").to_pylist())
                    yield b

            for _, _, _, tid, _, count in _Groups(tallied()):
                n += count
                more = np.bincount(tid)
                per = np.pad(per, (0, max(0, len(more) - len(per))))
                per[: len(more)] += more
            hit = np.flatnonzero(per)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], hit])), pa.array(np.concatenate([[n, total], per[hit]]))], ["tid", "n"])

        counts = rows.mapInArrow(numbers, "tid long, n long").groupBy("tid").agg(F.sum("n").alias("n")).toArrow()
        tid, n = counts.column("tid").to_numpy(), counts.column("n").to_numpy()
        df[tid[tid >= 0]] = n[tid >= 0]
        n_docs = int(n[tid == -2].sum())
        avgdl = (int(n[tid == -1].sum()) / n_docs if n_docs else 0.0) or 1.0
    raw = np.log((n_docs - df + 0.5) / (df + 0.5))
    weight = repeat * np.where(raw <= 0, fixed.BM25_IDF_FLOOR, raw)[t]
    order = np.argsort(t, kind="stable")
    starts = np.searchsorted(t[order], np.arange(len(terms) + 1))
    sent = rows.sparkSession.sparkContext.broadcast((query.dictionary, starts, q[order], weight[order]))
    k1, b_ = fixed.BM25_K1, fixed.BM25_B

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, qs, ws = sent.value
        best, kind = Best(len(ids), k, decimals), None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field("key").type
                yield b

        step = max(1, BLOCK_SCORES // len(ids))
        for keys, place, dl, tid, tf, _ in _Groups(typed()):
            part = tf * (k1 + 1) / (tf + k1 * ((1 - b_) + b_ * dl / avgdl))
            edge = np.searchsorted(place, np.arange(0, len(keys) + step, step))
            for i in range(0, len(keys), step):
                # Entries come by key; each is dealt to the queries that ask for its term.
                lo, hi = edge[i // step], edge[i // step + 1]
                n = min(step, len(keys) - i)
                total = np.zeros(len(ids) * n)
                for e in range(lo, hi, 65536):
                    own = slice(e, min(hi, e + 65536))
                    first, last = starts[tid[own]], starts[tid[own] + 1]
                    size = last - first
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                    total += np.bincount(qs[at] * n + np.repeat(place[own] - i, size), weights=ws[at] * np.repeat(part[own], size), minlength=len(total))
                total[total == 0] = -np.inf
                best.update(total.reshape(len(ids), n), keys[i : i + n])
                best.next_rows(n)
        for columns in best.rows(ids, kind):
            yield pa.RecordBatch.from_arrays(columns, ["query_id", key, "score"])

    return (rows.where(F.col("source_id").isin(*sources)) if sources else rows).mapInArrow(run, kinds)
