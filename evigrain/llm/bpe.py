"""Byte-pair encoding of many short pieces at once, in numpy.

Merges are looked up in an open-addressing table (pair of ids -> rank and new id). A
batch of pieces of about one length is a matrix with one column a piece: each step
merges, in every piece, the leftmost pair of least rank, exactly as the sequential
algorithm does, and only the two pairs beside it are looked up again. Pieces over
``MOST`` bytes go to the library's own model.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd

from .common import names

MOST = 64
WIDTHS = (4, 8, 16, 32, MOST)
KEPT = 1 << 18  # pieces that a worker remembers, some 20 MB
CHUNK = 16384
TABLE_BITS = 19
NONE = np.uint32(0xFFFFFFFF)
EMPTY = np.uint32(0xFFFFFFFF)
PAD = np.uint32(0xFFFF)


def byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (n[0] numbers), first[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte string, place of each code's first one); equal names ``h`` are confirmed on the bytes."""
    code, kept = pd.factorize(h)
    first = np.empty(len(kept), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    twin = first[code]
    wrong = lengths[twin] != lengths
    again = np.flatnonzero(~wrong & (twin != np.arange(len(code))))
    wrong[again] = ~equal(data, starts[again], data, starts[twin[again]], lengths[again])
    wrong = np.flatnonzero(wrong)
    if len(wrong):  # two strings of one name: the later ones get codes of their own
        code = code.copy()
        code[wrong] = len(first) + np.arange(len(wrong))
        first = np.concatenate([first, wrong])
    return code, first


def equal(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Are the byte strings of these lengths the same? Without a byte, yes."""
    same = a[ragged(a_starts, lengths)] == b[ragged(b_starts, lengths)]
    out = np.ones(len(lengths), bool)
    if not same.all():
        out[np.repeat(np.arange(len(lengths)), lengths)[~same]] = False
    return out


class Kept:
    """A bounded table from byte strings (by name, confirmed on their bytes) to short arrays of ids.

    When it is full, what was not met again since the last time goes; all of it if that is less than half.
    """

    def __init__(self, most: int):
        self.most, self.bits = most, int(most - 1).bit_length() + 1
        self.clear()

    def clear(self) -> None:
        self.place = np.full(1 << self.bits, -1, np.int32)
        self.names = np.zeros(0, np.uint64)
        self.used = np.zeros(0, bool)
        self.raw, self.raw_at, self.raw_n = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.ids_at, self.ids_n = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each string's entry, or -1."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.names):
            return out
        left, at = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            own = self.place[at].astype(np.int64)
            same = (own >= 0) & (self.names[own] == h[left])
            out[left[same]] = own[same]
            go = (own >= 0) & ~same
            left, at = left[go], (at[go] + 1) & ((1 << self.bits) - 1)
        hit = np.flatnonzero(out >= 0)
        own = out[hit]
        wrong = self.raw_n[own] != lengths[hit]
        rest = np.flatnonzero(~wrong)
        wrong[rest] = ~equal(self.raw, self.raw_at[own[rest]], data, starts[hit[rest]], lengths[hit[rest]])
        out[hit[wrong]] = -1
        self.used[own[~wrong]] = True
        return out

    def add(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Keep strings that find() doesn't know. Those over the bound, or of a name that is there, are left out."""
        if len(self.names) + len(h) > self.most:
            self._make_room()
        few = np.arange(len(h))[: self.most - len(self.names)]
        few = few[lengths[few] <= MOST]
        base = len(self.names)
        raw_at = len(self.raw) + np.cumsum(lengths[few]) - lengths[few]
        ids_at = len(self.ids) + np.cumsum(n[few]) - n[few]
        where = np.cumsum(n) - n
        self.raw = np.concatenate([self.raw, data[ragged(starts[few], lengths[few])]])
        self.ids = np.concatenate([self.ids, ids[ragged(where[few], n[few])]])
        for name, x in (("names", h[few]), ("used", np.zeros(len(few), bool)), ("raw_at", raw_at), ("raw_n", lengths[few]), ("ids_at", ids_at), ("ids_n", n[few])):
            setattr(self, name, np.concatenate([getattr(self, name), x]))
        self._enter(np.arange(base, len(self.names)))

    def _enter(self, entries: np.ndarray) -> None:
        at = (self.names[entries] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entries):
            free = np.flatnonzero(self.place[at] < 0)
            _, pick = np.unique(at[free], return_index=True)
            pick = free[pick]
            self.place[at[pick]] = entries[pick]
            rest = np.ones(len(entries), bool)
            rest[pick] = False
            entries, at = entries[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _make_room(self) -> None:
        keep = np.flatnonzero(self.used)
        if not len(keep) or len(keep) > self.most // 2:
            self.clear()
            return
        old = dict(self.__dict__)
        self.clear()
        self.add(old["names"][keep], old["raw"], old["raw_at"][keep], old["raw_n"][keep], old["ids"][ragged(old["ids_at"][keep], old["ids_n"][keep])], old["ids_n"][keep])


class Merges:
    """The merges of a byte-level BPE model of the tokenizers library, with ids below 65,535."""

    def __init__(self, tok):
        model = json.loads(tok.to_str())["model"]
        vocab = model["vocab"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix") or max(vocab.values()) >= int(PAD):
            raise ValueError("not a byte-level BPE model of 16-bit ids")
        suffix = model.get("end_of_word_suffix") or ""
        self.letters, self.model = byte_letters(), tok.model
        self.own = np.array([vocab[c] for c in self.letters], np.uint32)
        self.last = np.array([vocab[c + suffix] for c in self.letters], np.uint32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        value = np.array([k << 16 | vocab[a + b] for k, (a, b) in enumerate(pairs)], np.uint32)
        self.keys, self.values = np.full(1 << TABLE_BITS, EMPTY), np.full(1 << TABLE_BITS, NONE)
        left = np.arange(len(key))
        at = self._slot(key)
        while len(left):  # the first of those that want a free slot gets it, the others try the next one
            free = self.keys[at] == EMPTY
            _, pick = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            pick = pick[free[pick]]
            self.keys[at[pick]], self.values[at[pick]] = key[left[pick]], value[left[pick]]
            rest = np.ones(len(left), bool)
            rest[pick] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << TABLE_BITS) - 1)
        self.kept = Kept(KEPT)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        key = key ^ (key >> np.uint32(15))
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 16 | new id of each pair, NONE if it doesn't merge."""
        key = (a << np.uint32(16)) | b
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], NONE)
        left = np.flatnonzero((there != key) & (there != EMPTY))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << TABLE_BITS) - 1)
            there = self.keys[at]
            same = there == key[left]
            out[left[same]] = self.values[at[same]]
            go = ~same & (there != EMPTY)
            left, at = left[go], at[go]
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of ids of each); no piece may be empty. Equal pieces are encoded once."""
        h = names(data, starts, starts + lengths)
        code, first = distinct(data, starts, lengths, h)
        h, at, size = h[first], starts[first], lengths[first]
        found = self.kept.find(h, data, at, size)
        new = np.flatnonzero(found < 0)
        made, made_n = self.encode(data, at[new], size[new])
        n = np.empty(len(first), np.int64)
        n[new], old = made_n, np.flatnonzero(found >= 0)
        n[old] = self.kept.ids_n[found[old]]
        where = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), np.uint16)
        ids[ragged(where[new], made_n)] = made
        ids[ragged(where[old], n[old])] = self.kept.ids[ragged(self.kept.ids_at[found[old]], n[old])]
        self.kept.add(h[new], data, at[new], size[new], made, made_n)
        many = n[code]
        return ids[ragged(where[code], many)], many

    def encode(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without a memory."""
        n = len(starts)
        counts = np.ones(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # pieces, matrix of their ids
        low = 0
        for width in WIDTHS:
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for k in range(0, len(own), CHUNK):
                self._merged(data, own[k : k + CHUNK], starts, lengths, width, done)
        for rows, m in done:
            counts[rows] = (m != PAD).sum(axis=0)
        long = np.flatnonzero(lengths > MOST)
        whole = [[t.id for t in self.model.tokenize("".join([self.letters[b] for b in data[starts[i] : starts[i] + lengths[i]].tolist()]))] for i in long.tolist()]
        counts[long] = [len(x) for x in whole]
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint16)
        for rows, m in done:
            for j in range(len(m)):
                live = m[j] != PAD
                if not live.any():
                    break
                out[first[rows[live]] + j] = m[j][live]
        for i, x in zip(long.tolist(), whole, strict=True):
            out[first[i] : first[i] + len(x)] = x
        return out, counts

    def _merged(self, data: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, done: list) -> None:
        n, at = lengths[rows], starts[rows]
        s = np.full((width, len(rows)), PAD, np.uint32)
        for j in range(width):
            live = np.flatnonzero(n > j)
            byte = data[at[live] + j]
            s[j, live] = np.where(n[live] == j + 1, self.last[byte], self.own[byte])
        r = np.full((width, len(rows)), NONE, np.uint32)  # the last row stays NONE
        for j in range(width - 1):
            live = np.flatnonzero(n > j + 1)
            r[j, live] = self.ranks(s[j, live], s[j + 1, live])
        while True:
            least = r.min(axis=0)
            active = least != NONE
            some = int(active.sum())
            if some < 0.75 * len(rows) or not some:
                ended = np.flatnonzero(~active)
                done.append((rows[ended], s[:, ended].astype(np.uint16)))
                go = np.flatnonzero(active)
                if not len(go):
                    return
                rows, s, r, least = rows[go], s[:, go], r[:, go], least[go]
            else:
                least[~active] = NONE - np.uint32(1)  # matches no pair
            new = least & np.uint32(0xFFFF)
            past = np.zeros(len(rows), bool)
            place = np.full(len(rows), -1)
            for j in range(len(s) - 1):
                hit = (r[j] == least) & ~past
                s[j] = np.where(past, s[j + 1], np.where(hit, new, s[j]))
                past |= hit
                place[hit] = j
                r[j] = np.where(past, r[j + 1], r[j])
            s[-1, past] = PAD
            r[-1] = NONE
            if (s[-1] == PAD).all() and len(s) > 1:
                s, r = s[:-1], r[:-1]
                r[-1] = NONE
            for shift in (-1, 0):
                live = np.flatnonzero((place + shift >= 0) & (place + shift < len(s) - 1))
                p = place[live] + shift
                a, b = s[p, live], s[p + 1, live]
                r[p, live] = np.where(b == PAD, NONE, self.ranks(a, b))
