"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased ASCII bytes and all bytes >= 0x80; every other byte is a
space. Byte 1- to 4-grams are hashed to ``buckets`` columns. Training counts the
buckets for each language over labelled training rows (all of them up to about
``most_docs`` a language, else a hashed sample of about that many): tasks sum their
own counts first, so the shuffle carries at most languages x buckets rows a task.
A language's prior is its share of all labelled training rows. The log-probability
matrix, its last column the prior (languages x (buckets + 1) float32:
``MAX_MODEL_BYTES`` is checked before anything is collected), is broadcast; scoring
adds rows of it with numpy.

Results in odd cases: null text or text without a letter -> ``und`` and score 0;
null ``lang`` rows don't train; no training rows at all -> every text is ``und``
with score 0; extra columns are ignored; repeated rows are scored each; equal
posteriors go to the first language by name; a very long text is scored whole, in a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, slices, small_batches, trim

MAX_MODEL_BYTES = 512 << 20
SIZES = (1, 2, 3, 4)

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _features(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its row). N-grams of spaces only, or across documents, don't count."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    low = _LETTER[data]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    gap = low == 32
    out, rows = [], []
    h = np.zeros(len(low), np.uint32)
    blank = np.ones(len(low), bool)
    for k in range(1, max(SIZES) + 1):
        m = len(low) - k + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x9E3779B1) + low[k - 1 :] + np.uint32(1)
        blank = blank[:m] & gap[k - 1 :]
        if k in SIZES:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x85EBCA77)
            x = (x ^ (x >> np.uint32(13))) % np.uint32(buckets)
            ok = ~blank & (row[:m] == row[k - 1 :])
            if k > 1:
                ok &= ~(gap[:m] & gap[1 : m + 1])
            out.append(x[ok].astype(np.int32))
            rows.append(row[:m][ok])
    return np.concatenate(out), np.concatenate(rows)


def _lettered(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per row: has it a letter? Only rows with bytes >= 0x80 and no ASCII letter are decoded."""
    c = _LETTER[data]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((c > 32) & (c < 128), c >= 128)]
    plain, high = (np.diff(x[offs]) > 0 for x in sums)
    for i in np.flatnonzero(high & ~plain):
        plain[i] = any(map(str.isalpha, bytes(data[offs[i] : offs[i + 1]]).decode("utf-8", "replace")))
    return plain


def fit(docs: DataFrame, buckets: int = 1 << 15, smoothing: float = 0.5, most_docs: int = 50_000) -> tuple[list[str], np.ndarray]:
    """(languages in order, log-probability matrix) from ``docs`` (doc_id, text, lang).

    A language with more than ``most_docs`` labelled rows trains on a hashed
    sample of about that many, so that fitting costs the same on any input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for i, j, data, offs in slices(b.column(0)):
                x, rows = _features(data, offs, buckets)
                names, code = np.unique(langs[i:j].astype(str), return_inverse=True)
                c = np.bincount(code[rows] * buckets + x, minlength=len(names) * buckets).reshape(len(names), buckets)
                for name, own in zip(names, c, strict=True):
                    sums[name] = sums.get(name, 0) + own
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at].astype(np.int64))], ["lang", "bucket", "n"])
        trim()

    rows = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    per_lang = rows.groupBy("lang").agg(F.count("*").alias("n"))
    several = per_lang.count()
    if several * (buckets + 1) * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"{several} languages x {buckets} buckets pass the broadcast bound")
    there = {r["lang"]: r["n"] for r in per_lang.toArrow().to_pylist()}
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, most_docs / n)) for k, n in there.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / F.lit(1 << 20)
    rows = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).where(F.col("text").isNotNull()).select("text", "lang")
    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One packed row a language: at most languages x buckets numbers reach the driver.
    per = got.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).toArrow()
    at = {k: i for i, k in enumerate(per.column("lang").to_pylist())}
    langs = sorted(there)
    model = np.zeros((len(langs), buckets + 1), np.float64)
    for k, lang in enumerate(langs):
        if lang in at:
            model[k, per.column("b")[at[lang]].values.to_numpy()] = per.column("n")[at[lang]].values.to_numpy()
    if langs:
        grams = model[:, :buckets] + smoothing
        model[:, :buckets] = np.log(grams / grams.sum(axis=1, keepdims=True))
        model[:, buckets] = np.log(np.array([there[k] for k in langs]) / sum(there.values()))
    return langs, model.astype(np.float32)


def _judged(col: pa.Array, names: list[str], logp: np.ndarray) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """(first row, end row, languages, scores) for slices of a text column."""
    for i, j, data, offs in slices(col):
        x, rows = _features(data, offs, len(logp) - 1)
        n = j - i
        seen = _lettered(data, offs)
        if names:
            total = np.stack([np.bincount(rows, logp[:, k][x], minlength=n) for k in range(len(names))], axis=1) + logp[-1]
            best = total.argmax(axis=1)
            p = 1 / np.exp(total - total[np.arange(n), best][:, None]).sum(axis=1)
        else:
            best, p, seen = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
        yield i, j, [names[k] if s else "und" for k, s in zip(best, seen, strict=True)], np.where(seen, p, 0.0)


def predict(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (posterior of the winner; ties go to the first name)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(model.T)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, lang, p in _judged(b.column(1), *sent.value):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])
        trim()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def recognised(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(model.T)))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, lang, _ in _judged(b.column(at), *sent.value):
                yield b.slice(i, j - i).filter(pa.array([x != "und" for x in lang], pa.bool_()))
        trim()

    return docs.mapInArrow(keep, docs.schema)


def train_split(docs: DataFrame, held_out: int = 2, modulus: int = 4) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), modulus) != held_out)
