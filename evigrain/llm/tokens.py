"""Token ids of whole texts by vectorised byte-pair encoding over a public tokenizer.

``word_bpe_49k`` normalises character by character (NFC, white space, lower
case) and its pre-tokenizer never joins anything across white space, nor do its
special strings hold any. So the ids of a text are the ids of its runs between
ASCII white space, one after the other. A slice's distinct runs (64-bit names,
confirmed on their bytes) are encoded once and their ids dealt to all places.

A run of printable Latin-1 characters needs no normaliser but lower case; the
tokenizer's own pattern is a few comparisons of character classes there, and
``bpe.Merges`` encodes all its pieces together. Any other run (other scripts,
controls, special strings) goes through the whole library. Memory is bounded by a
slice, or by one longer text, and by the pieces that ``bpe.Kept`` remembers.
"""

from __future__ import annotations

import os

import numpy as np

from .bpe import Merges, distinct, ragged
from .common import SPACE_WORDS, U64, cache, mix, words

SLICE = 1 << 20  # bytes of text that are encoded at once

LETTER, NUMBER, OTHER = 1, 2, 3


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library(path: str):
    c = cache()
    if ("library", path) not in c:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        c["library", path] = t
    return c["library", path]


def _ascii() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, class) of each byte."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    kind = np.full(256, OTHER, np.uint8)
    kind[97:123], kind[48:58] = LETTER, NUMBER
    return low, kind


def _second(lead: int) -> np.ndarray:
    """Class of a two-byte character behind the lead byte C2 or C3."""
    kind = np.full(256, LETTER if lead == 0xC3 else OTHER, np.uint8)
    if lead == 0xC3:
        kind[[0x97, 0xB7]] = OTHER
    else:
        kind[[0xAA, 0xB5, 0xBA]] = LETTER
        kind[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
    return kind


LOWER, KIND = _ascii()
KIND_C2, KIND_C3 = _second(0xC2), _second(0xC3)


def pieces(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the pattern ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` cuts lower-case printable Latin-1 runs into; ``heads``: where runs start."""
    n = len(data)
    kind = KIND[data]
    tail = (data & 0xC0) == 0x80
    at = np.flatnonzero(tail)
    kind[at] = kind[at - 1] = np.where(data[at - 1] == 0xC3, KIND_C3[data[at]], KIND_C2[data[at]])
    head = np.zeros(n + 1, bool)
    head[heads] = head[n] = True
    begin = head[:n].copy()
    begin[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    begin[at] = False
    quote = np.flatnonzero(data == 39)
    if len(quote):
        quote = quote[head[quote] | (kind[quote - 1] != OTHER)]
        text = np.concatenate([data, np.zeros(3, np.uint8)])
        inside = lambda k: ~head[np.minimum(quote + k, n)]
        a, b = text[quote + 1], text[quote + 2]
        one = inside(1) & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = inside(1) & inside(2) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for found, size in ((quote[one], 2), (quote[two], 3)):
            for k in range(1, size):
                begin[found + k] = False
            after = found + size
            begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Ids of the texts of a slice."""

    def __init__(self, path: str):
        self.tok = library(path)
        if self.tok.get_vocab_size(with_added_tokens=True) > 65536:
            raise ValueError("the vocabulary needs more than 16 bits an id")
        self.merges = Merges(self.tok)

    def __call__(self, data: np.ndarray, offs: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows in it); ``end`` is put behind each row."""
        starts, ends, h, per = words(data, offs, SPACE_WORDS)
        lengths = ends - starts
        low = LOWER[data]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may begin a special string, which is told apart by case
        if len(special):
            at = np.unique(np.searchsorted(starts, special, "right") - 1)
            h[at] = mix(at.astype(U64))
        code, first = distinct(low, starts, lengths, h)
        ids, n = self._encoded(data, low, starts[first], lengths[first])
        where = np.cumsum(n) - n
        many = n[code]
        own = ids[ragged(where[code], many)]
        sums = np.concatenate([[0], np.cumsum(many)])
        rows = sums[np.concatenate([[0], np.cumsum(per)])]
        if end is None:
            return own, rows
        out = np.empty(len(own) + len(per), np.uint16)
        rows += np.arange(len(rows))
        closing = rows[1:] - 1
        out[closing] = end
        inner = np.ones(len(out), bool)
        inner[closing] = False
        out[inner] = own
        return out, rows

    def _encoded(self, data: np.ndarray, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs one after the other, number of ids of each)."""
        flat = low[ragged(starts, lengths)]
        heads = np.cumsum(lengths) - lengths
        before = np.zeros_like(flat)
        before[1:] = flat[:-1]
        bad = (flat < 0x21) | (flat == 0x7F) | (flat >= 0xC4) | ((before == 0xC2) & (flat < 0xA1)) | ((before == 60) & (flat == 124))
        bad[heads[(flat[heads] >= 0x21) & (flat[heads] < 0x7F)]] = False
        odd = np.zeros(len(starts), bool)
        odd[np.searchsorted(heads, np.flatnonzero(bad), "right") - 1] = True
        odd_at = np.flatnonzero(odd)
        if len(odd_at):
            flat = flat[np.repeat(~odd, lengths)]
            heads = np.cumsum(lengths[~odd]) - lengths[~odd]
        flat = flat.copy()
        upper = np.flatnonzero((flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97) & (flat[:-1] == 0xC3)) + 1
        flat[upper] += 32
        n = np.zeros(len(starts), np.int64)
        ids = np.zeros(0, np.uint16)
        if len(flat):
            cut = pieces(flat, heads)
            ids, per = self.merges(flat, cut, np.diff(np.append(cut, len(flat))))
            sums = np.concatenate([[0], np.cumsum(per)])
            n[~odd] = np.diff(sums[np.append(np.searchsorted(cut, heads), len(cut))])
        if not len(odd_at):
            return ids, n
        texts = [bytes(data[starts[i] : starts[i] + lengths[i]]).decode("utf-8") for i in odd_at.tolist()]
        whole = [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint16) for t in texts]
        n[odd_at] = [len(x) for x in whole]
        out = np.empty(int(n.sum()), np.uint16)
        where = np.cumsum(n) - n
        out[ragged(where[~odd], n[~odd])] = ids
        out[ragged(where[odd_at], n[odd_at])] = np.concatenate(whole)
        return out, n


def encoder(path: str) -> Encoder:
    c = cache()
    if ("encoder", path) not in c:
        c["encoder", path] = Encoder(path)
    return c["encoder", path]
