"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

Counting. Tasks count the words and bigrams of their own training texts, and send
them as packed blocks, one for each hash range ("part"); a part's blocks are summed
in one task. There are as many parts as the input needs to keep them small, up to
2**MOST_BITS; beyond that parts grow. Where there are more than 2**FAN_BITS parts,
blocks are first summed by coarser ranges, so that no block holds only a few keys.

Model. A bigram counted c times has level 1 + floor(log2 c). The filter holds the
items (bigram, 1) ... (bigram, level), so a count is read back by probing level
after level until one is missing (Talbot and Osborne 2007). Errors are one-sided
and rare. A word's probability given the one before is smoothed with a Dirichlet
prior: (c12 + mu * p(w2)) / (c1 + mu), with add-one word probabilities p. As c12 is a
quantised count, a context's probabilities need not sum to one; the score is the sum
of their logarithms all the same.

Bounds. The word table (exact counts) and the filter are broadcast; each has a byte
bound. What doesn't fit, always the rarest words or bigrams by level, isn't given
up: documents send what they didn't find there to a join with the rest of the
counts. Words come first: a bigram with a word outside the table stays open until
the word's exact count is back, so a score doesn't depend on the table's size. Then
come the bigrams that the filter lacks. Frequent keys, which could be hot, are all
in the broadcast part.

Odd cases: null and empty texts are the end token alone; repeated rows count and
are scored each; without training rows every count is 0 and N is 0; a very long text
is counted and scored whole, in a slice of its own; there are no ties to break; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULT, SPACE_WORDS, U64, crc_mod, mix, slices, stored, trim, words

WORD_BYTES = 32 << 20
FILTER_BYTES = 128 << 20
ITEM_BITS = 12
LEVELS = 40
MU = 4.0
PART_BYTES = 4 << 20  # text for each part
MOST_BITS = 20  # at most 2**20 parts: 16 MB of a part's place and size in the broadcast
FAN_BITS = 13  # parts that one task sends blocks to
FLUSH = 1_000_000  # tokens, or keys, that a task sums at once

START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_PAIR = U64(0xD6E8FEB86659FD93)
#: What a row keeps for the joins: words and bigrams not found, and bigrams with a word outside the table (its number among the row's words, from 1, else 0, and the counts known).
_LISTS = {"words": "long", "word_n": "int", "pairs": "long", "pair_n": "int", "pair_v": "float", "pair_c": "float", "open": "long", "open_n": "int", "open_lv": "int", "open_word": "int", "open_before": "int", "open_c": "long", "open_context": "long"}
_COUNTED = "kind int, part int, keys binary, counts binary"


def tokens(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the one before it, its row): the words of each row, then the end; START comes before the first."""
    n = len(per)
    row = np.repeat(np.arange(n), per + 1)
    last = np.cumsum(per + 1) - 1
    own = np.empty(len(row), U64)
    inner = np.ones(len(row), bool)
    inner[last] = False
    own[inner] = h
    own[last] = END
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[last - per] = START
    return own, before, row


def pairs(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + own)


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c); exact for counts below 2**53."""
    return np.frexp(counts.astype(np.float64))[1]


def level_count(lv: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range."""
    return np.where(lv <= 1, lv.astype(float), 2.0 ** (lv - 1) * 1.2)


def _packed(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, :width] = own
    return out.reshape(-1).view("<u8")


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


def _part(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U64(64 - bits)).astype(np.int64)


def _rest(h: np.ndarray, bits: int) -> np.ndarray:
    """40 bits of a bigram's hash beside its part; n bigrams of a part share them in about n**2 / 2**41 pairs, less than one in a million of them for n of up to 2 million."""
    return (h << U64(bits)) >> U64(24)


def _cut(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of the runs of an ascending array."""
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return zip(part[first].tolist(), first.tolist(), np.append(first[1:], len(part)).tolist(), strict=True)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "part", "keys", "counts"])


def count(train: DataFrame, bits: int, fan: int = FAN_BITS) -> DataFrame:
    """One row for each kind and part: keys (words 8 bytes, bigrams 5), counts (uint64, deflated), levels (numbers of keys at each level), total."""
    if bits > MOST_BITS or bits - fan > 8:
        raise ValueError(f"2**{bits} parts of 2**{fan} at a time are too many")
    wide = max(0, bits - fan)  # bits of a part's number that the first blocks' keys hold
    coarse = bits - wide
    width = 6 if wide else 5

    def blocks(kind: int, h: np.ndarray) -> list[tuple]:
        keys, n = _summed(h)
        rows = []
        for p, i, j in _cut(_part(keys, coarse)):
            own = keys[i:j]
            raw = _packed(own, 8) if kind == 0 else _packed((own << U64(coarse)) >> U64(64 - 8 * width), width)
            rows.append((kind, p, raw, zlib.compress(n[i:j].astype("<u4").tobytes(), 1)))
        return rows

    def finer(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a coarse range summed, up to FLUSH keys at once, and cut into those of its parts."""
        kind, part = (k.as_py() for k in key)
        keys, counts, many = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            own, n = _summed(np.concatenate(keys), np.concatenate(counts))
            sub = _part(own, bits) if kind == 0 else (part << wide) + (own >> U64(48 - wide)).astype(np.int64)
            rest = own if kind == 0 else (own << U64(16 + wide)) >> U64(24)
            yield from _batches([(kind, p, _packed(rest[i:j], 5 if kind else 8), zlib.compress(n[i:j].astype("<u8").tobytes(), 1)) for p, i, j in _cut(sub)])

        for b in group:
            for x, c in zip(b.column("keys"), b.column("counts"), strict=True):
                keys.append(_unpacked(x.as_buffer(), width if kind else 8))
                counts.append(np.frombuffer(zlib.decompress(c.as_buffer()), "<u4").astype(np.int64))
                many += len(keys[-1])
                if many >= FLUSH:
                    yield from flush()
                    keys, counts, many = [], [], 0
        if many:
            yield from flush()
        trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                rows = blocks(kind, np.concatenate(held[kind]))
                held[kind].clear()
                yield from _batches(rows)

        for b in batches:
            for _, _, data, offs in slices(b.column(0)):
                _, _, h, per = words(data, offs, SPACE_WORDS)
                own, before, _ = tokens(h, per)
                held[0].append(own)
                held[1].append(pairs(before, own))
                size += len(own)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()
        trim()

    def merge(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part = (k.as_py() for k in key)
        width = 5 if kind else 8
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for b in group:
            new = [_unpacked(x.as_buffer(), width) for x in b.column("keys")]
            n = [np.frombuffer(zlib.decompress(x.as_buffer()), "<u8" if wide else "<u4").astype(np.int64) for x in b.column("counts")]
            keys, counts = _summed(np.concatenate([keys, *new]), np.concatenate([counts, *n]))
        per = np.bincount(level(counts), minlength=LEVELS + 1)[1 : LEVELS + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([_packed(keys, width)], pa.binary()), pa.array([zlib.compress(counts.astype("<u8").tobytes(), 1)], pa.binary()), pa.array([per.tolist()], pa.list_(pa.int64())), pa.array([int(counts.sum())], pa.int64())],
            ["kind", "part", "keys", "counts", "levels", "total"],
        )

    texts = train.select(F.col("text").cast("string").alias("text"))
    sent = texts.mapInArrow(run, _COUNTED)
    if wide:
        sent = sent.groupBy("kind", "part").applyInArrow(finer, _COUNTED)
    return sent.groupBy("kind", "part").applyInArrow(merge, f"{_COUNTED}, levels array<long>, total long")


def _masks(x: np.ndarray) -> np.ndarray:
    m = np.zeros(len(x), U64)
    for i in range(5):
        m |= U64(1) << ((x >> U64(6 * i)) & U64(63))
    return m


def _places(key: np.ndarray, lv: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(word of 64 bits, bits in it) of the item (key, level) in a part's filter of ``size`` words."""
    x = mix(key + U64(lv * int(MULT) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> U64(32)) * np.asarray(size, U64)) >> U64(32), _masks(x)


def bloom(keys: np.ndarray, levels: np.ndarray, least: int) -> np.ndarray:
    """The filter of one part's bigrams of ``least`` levels or more."""
    keys, levels = keys[levels >= least], levels[levels >= least]
    out = np.zeros(max(1, -(-int(levels.sum()) * ITEM_BITS // 64)), U64)
    for lv in range(1, int(levels.max(initial=0)) + 1):
        at, m = _places(keys[levels >= lv], lv, len(out))
        np.bitwise_or.at(out, at.astype(np.int64), m)
    return out


class Model:
    """What is broadcast: the word table, the filter and corpus totals."""

    def __init__(self, bits: int, n: int, v: int, docs: int):
        self.bits, self.n, self.v, self.docs = bits, n, v, docs
        self.words, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.filter, self.first = np.zeros(1, U64), np.zeros(1, np.int64)
        self.size = np.ones(1, np.int64)
        self.word_level = self.pair_level = 1

    def word_counts(self, u: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(u), np.int64)
        at = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
        return np.where(self.words[at] == u, self.counts[at], 0)

    def pair_levels(self, h: np.ndarray) -> np.ndarray:
        """By repeated membership probes."""
        out = np.zeros(len(h), np.int64)
        left = np.arange(len(h))
        part, key = _part(h, self.bits), _rest(h, self.bits)
        first, size = self.first[part], self.size[part].astype(U64)
        for lv in range(1, LEVELS + 1):
            at, m = _places(key[left], lv, size[left])
            hit = (self.filter[first[left] + at.astype(np.int64)] & m) == m
            left = left[hit]
            if not len(left):
                break
            out[left] = lv
        return out


def _least_level(per: np.ndarray, cost: np.ndarray, most: int) -> int:
    """The least level from which all keys fit into ``most`` bytes."""
    total = np.cumsum((per * cost)[::-1])[::-1]
    fits = np.flatnonzero(total <= most)
    return int(fits[0]) + 1 if len(fits) else LEVELS + 1


def fit(train: DataFrame, word_bytes: int = WORD_BYTES, filter_bytes: int = FILTER_BYTES, bits: int | None = None, fan: int = FAN_BITS) -> tuple[Model, DataFrame]:
    """(model, all counts as ``count`` returns them) from the texts of ``train``. ``bits``: there are 2**bits parts; by default as the texts' bytes ask for."""
    size = train.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 8).alias("n"), F.count("*").alias("docs")).first()
    if bits is None:
        bits = min(MOST_BITS, max(6, int(np.ceil(np.log2(max(1, (size["n"] or 0) / PART_BYTES))))))
    counted = stored(count(train, bits, fan))
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(*(F.sum(F.col("levels")[i]).alias(f"l{i}") for i in range(LEVELS)), F.sum("total").alias("total")).toArrow().to_pylist()}
    per = {k: np.array([sums[k][f"l{i}"] if k in sums else 0 for i in range(LEVELS)], np.int64) for k in (0, 1)}
    model = Model(bits, sums[0]["total"] if 0 in sums else 0, int(per[0].sum()), size["docs"])
    model.word_level = _least_level(per[0], np.full(LEVELS, 16), word_bytes)
    model.pair_level = _least_level(per[1], np.arange(1, LEVELS + 1) * ITEM_BITS / 8 + 0.01, filter_bytes)

    def top(batches: Iterator[pa.RecordBatch], word_level: int = model.word_level, pair_level: int = model.pair_level) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                counts = np.frombuffer(zlib.decompress(r["counts"]), "<u8").astype(np.int64)
                keys, lv = _unpacked(r["keys"], 5 if r["kind"] else 8), level(counts)
                if r["kind"]:
                    a, c = bloom(keys, lv, pair_level).tobytes(), b""
                else:
                    a, c = keys[lv >= word_level].tobytes(), counts[lv >= word_level].tobytes()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array([r["kind"]], pa.int32()), pa.array([r["part"]], pa.int32()), pa.array([a], pa.binary()), pa.array([c], pa.binary())], ["kind", "part", "a", "c"])

    # At most word_bytes and filter_bytes reach the driver.
    got = counted.select("kind", "part", "keys", "counts").mapInArrow(top, "kind int, part int, a binary, c binary").toArrow()
    kinds, parts = got.column("kind").to_numpy(), got.column("part").to_numpy()
    order = np.argsort(parts, kind="stable")
    at = [i for i in order.tolist() if kinds[i] == 0]
    if at:
        model.words = np.concatenate([np.frombuffer(got.column("a")[i].as_buffer(), U64) for i in at])
        model.counts = np.concatenate([np.frombuffer(got.column("c")[i].as_buffer(), np.int64) for i in at])
    model.first, model.size = np.zeros(1 << bits, np.int64), np.ones(1 << bits, np.int64)
    blocks = [np.zeros(1, U64)]  # one empty word stands for parts without bigrams
    end = 1
    for i in (i for i in order.tolist() if kinds[i] == 1):
        own = np.frombuffer(got.column("a")[i].as_buffer(), U64)
        model.first[parts[i]], model.size[parts[i]] = end, len(own)
        blocks.append(own)
        end += len(own)
    model.filter = np.concatenate(blocks)
    del got, blocks
    pa.default_memory_pool().release_unused()
    return model, counted


def score(docs: DataFrame, model: Model, counted: DataFrame, held_out: Column, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    whole_words, whole_pairs = model.word_level == 1, model.pair_level == 1
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        norm = np.log10(m.n + m.v + 1)
        for b in batches:
            for i, j, data, offs in slices(b.column("text")):
                _, _, h, per = words(data, offs, SPACE_WORDS)
                own, before, row = tokens(h, per)
                n = j - i
                u, at = np.unique(own, return_inverse=True)
                found = m.word_counts(u)
                c = found[at]
                context = np.empty(len(own), np.int64)
                context[1:] = c[:-1]
                context[before == START] = m.docs
                away = (c == 0) if not whole_words else np.zeros(len(own), bool)
                open_ = away.copy()
                open_[1:] |= away[:-1] & (before[1:] != START)
                h2 = pairs(before, own)
                u2, at2 = np.unique(h2, return_inverse=True)
                lv = m.pair_levels(u2)[at2]
                p, full = _term(m.n + m.v + 1, c, context, lv, mu)
                known = np.bincount(row, c > 0, n)
                base = np.bincount(row, np.log10(found + 1.0)[at], n) - (per + 1) * norm
                cols = [b.column("doc_id").slice(i, n), b.column("row").slice(i, n), b.column("held_out").slice(i, n), pa.array((per + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.bincount(row, np.where(open_, 0.0, full), n))]
                one, many, ends, number = _distinct(away, own, row, n)
                cols += _listed(ends, own[one].view(np.int64), many)
                one, many, ends, _ = _distinct(~open_ & (lv == 0) & (context > 0) if not whole_pairs else np.zeros(len(own), bool), h2, row, n)
                cols += _listed(ends, h2[one].view(np.int64), many, p[one].astype(np.float32), context[one].astype(np.float32))
                number_before = np.zeros_like(number)
                number_before[1:] = np.where(before[1:] != START, number[:-1], 0)
                one, many, ends, _ = _distinct(open_, h2, row, n)
                keys = h2[one].view(np.int64) * (0 if whole_pairs else 1)
                cols += _listed(ends, keys, many, lv[one].astype(np.int32), number[one], number_before[one], c[one], context[one])
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "held_out", "n_tokens", "n_known", "base_score", "score", *_LISTS])
        trim()

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    out = picked.mapInArrow(run, f"doc_id long, row long, held_out boolean, n_tokens long, n_known long, base_score double, score double, {_fields(_LISTS)}")
    if not (whole_words and whole_pairs):
        out = _with_rest(stored(out), model, counted, mu)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _fields(names: Iterable[str]) -> str:
    return ", ".join(f"{k} array<{_LISTS[k]}>" for k in names)


def _term(total: int, c: np.ndarray, context: np.ndarray, lv: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """(prior mass, log10 of the smoothed probability) of words of count ``c`` behind words of count ``context``, by their bigrams' levels."""
    p = mu * (c + 1) / total
    return p, np.log10(np.minimum(level_count(lv), context) + p) - np.log10(context + mu)


def _distinct(where: np.ndarray, key: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's distinct keys at the places of ``where``: (a place, how often it stands there, ends of the rows, every place's number among its row's keys from 1, or 0)."""
    at = np.flatnonzero(where)
    order = at[np.lexsort((key[at], row[at]))]
    k, r = key[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    ends = np.searchsorted(r[first], np.arange(n + 1))
    number = np.zeros(len(key), np.int32)
    number[order] = np.cumsum(new) - ends[r]
    return order[first], np.diff(np.append(first, len(k))).astype(np.int32), ends, number


def _listed(ends: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in values]


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, their rows) of a list column."""
    per = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), per)


def _closed(out: DataFrame, model: Model, there: DataFrame, mu: float) -> DataFrame:
    """row, what exact counts of the words outside the table add to its n_known (k), base_score (b) and score (s), and its bigrams that are still to be joined."""
    total, whole_pairs = model.n + model.v + 1, model.pair_level == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            many, word_row = _flat(b.column("word_n"))
            begin = np.searchsorted(word_row, np.arange(n))
            word_c = np.zeros(len(many), np.int64)
            got, got_row = _flat(b.column("pos"))
            word_c[begin[got_row] + got] = _flat(b.column("c"))[0]
            k = np.bincount(word_row, many * (word_c > 0), n)
            base = np.bincount(word_row, many * np.log10(word_c + 1.0), n)

            def counts(number: np.ndarray, rows: np.ndarray, begin: np.ndarray = begin, word_c: np.ndarray = word_c) -> np.ndarray:
                """What the join gave a row for its word of that number; 0 if nothing."""
                return word_c[np.where(number > 0, begin[rows] + number - 1, 0)]

            h2, row = _flat(b.column("open"))
            many, lv, own, before, c, context = (_flat(b.column(f"open_{x}"))[0] for x in ("n", "lv", "word", "before", "c", "context"))
            c = np.where(own != 0, counts(own, row), c)
            context = np.where(before != 0, counts(before, row), context)
            p, full = _term(total, c, context, lv, mu)
            left = np.flatnonzero((lv == 0) & (context > 0)) if not whole_pairs else np.zeros(0, np.int64)
            lists = _listed(np.searchsorted(row[left], np.arange(n + 1)), h2[left], many[left], p[left].astype(np.float32), context[left].astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(k.astype(np.int64)), pa.array(base), pa.array(np.bincount(row, many * full, n)), *lists], ["row", "k", "b", "s", "pairs", "pair_n", "pair_v", "pair_c"])
        trim()

    # The joins carry a word's number in its row, not the word.
    asked = out.where(F.size("words") > 0).select("row", F.posexplode("words").alias("pos", "key"))
    got = asked.join(there.select("key", "c"), "key").groupBy("row").agg(F.collect_list(F.struct("pos", "c")).alias("got"))
    rows = out.where(F.size("open") > 0).select("row", "word_n", *(k for k in _LISTS if k.startswith("open"))).join(got, "row", "left")
    rows = rows.withColumns({x: F.coalesce(F.col(f"got.{x}"), F.array().cast(f"array<{kind}>")) for x, kind in (("pos", "int"), ("c", "long"))}).drop("got")
    return rows.mapInArrow(run, f"row long, k long, b double, s double, {_fields(('pairs', 'pair_n', 'pair_v', 'pair_c'))}")


def _with_rest(out: DataFrame, model: Model, counted: DataFrame, mu: float) -> DataFrame:
    """Adds what the counts outside the broadcast tables say about each document."""
    bits, least = model.bits, (model.word_level, model.pair_level)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                counts = np.frombuffer(zlib.decompress(r["counts"]), "<u8").astype(np.int64)
                few = level(counts) < least[r["kind"]]
                keys = _unpacked(r["keys"], 5 if r["kind"] else 8)[few]
                if r["kind"]:
                    keys = keys | (U64(r["part"]) << U64(40))
                yield pa.RecordBatch.from_arrays([pa.array([r["kind"]] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(counts[few])], ["kind", "key", "c"])

    done = out.select("doc_id", "row", "held_out", "n_tokens", "n_known", "base_score", "score")
    add = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    kept = ("doc_id", "row", "held_out", "n_tokens")
    missing = [out]

    def rest_of(kind: int) -> DataFrame:
        return counted.where(F.col("kind") == kind).select("kind", "part", "keys", "counts").mapInArrow(rest, "kind int, key long, c long")

    if least[0] > 1:
        closed = stored(_closed(out, model, rest_of(0), mu))
        missing.append(closed)
        done = done.join(closed.select("row", "k", "b", "s"), "row", "left").select(*kept, add("n_known", "k"), add("base_score", "b"), add("score", "s"))
    if least[1] > 1:
        # At most MOST_BITS and 40 bits, so a bigram's part and the rest of its hash fit a long.
        folded = F.shiftrightunsigned(F.col("k.pairs"), 64 - bits) * F.lit(1 << 40) + F.shiftrightunsigned(F.shiftleft(F.col("k.pairs"), bits), 24)
        probes = [x.select("row", F.explode(F.arrays_zip("pairs", "pair_n", "pair_v", "pair_c")).alias("k")).select("row", folded.alias("key"), F.col("k.pair_n").alias("n"), F.col("k.pair_v").cast("double").alias("v"), F.col("k.pair_c").cast("double").alias("context")) for x in missing]
        lv = F.floor(F.log2("c")) + 1
        likely = F.least(F.when(lv <= 1, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), lv - 1) * 1.2), F.col("context"))
        asked = probes[0] if len(probes) == 1 else probes[0].unionByName(probes[1])
        more = asked.join(rest_of(1).select("key", "c"), "key").groupBy("row").agg(F.sum(F.col("n") * F.log10(1 + likely / F.col("v"))).alias("s"))
        done = done.join(more, "row", "left").select(*kept, "n_known", "base_score", add("score", "s"))
    return done


def report(docs: DataFrame, modulus: int = 7, held: int = 2, word_bytes: int = WORD_BYTES, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Scores every document with a model of those whose crc32(doc_id as text) mod ``modulus`` is not ``held``."""
    out = crc_mod(F.col("doc_id"), modulus) == held
    model, counted = fit(docs.where(~out), word_bytes, filter_bytes)
    return score(docs, model, counted, out)
