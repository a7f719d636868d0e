"""Token counts by a compiled finite-state tokenizer.

Two deterministic machines:

* The pre-tokenizer pattern of byte-level BPE is a table over eleven character
  classes and twelve states. A transition says whether a pre-token starts at this
  character, or (one character late, for the pattern's look-ahead and for
  contractions) at the one before it.
* Byte-pair encoding inside a pre-token. The encoding of a prefix is that of a shorter
  prefix and one last token, the only one that ends there and encodes, together with
  the token before it, to just these two. So a state is what still matters of a prefix:
  for each place where a token may have begun, its node in the vocabulary's trie, the
  token that ends before it and how many tokens fewer there were. A transition by a byte
  is annotated with the tokens that it emits (less than none if earlier ones merge).
  Transitions are compiled from the vocabulary's merges as texts first ask for them, in
  an open-addressing table of bounded size.

Texts run through the first machine in chunks at once: every chunk's map from
start state to end state is computed for all states together, the maps compose by
a parallel prefix scan, and a second run from the then known states reads the
outputs. The start of a pre-token sends every state of the second machine to its
start, so a map of (state, count) that holds one is constant: the pre-tokens of a slice
run side by side, one byte a step, equal ones (confirmed on their bytes) once, and a
text's count is the sum of the annotations met. A text may be cut anywhere, so one long
text is as parallel as many.

Texts that hold the library's special string go to the library whole, as it takes
them out before any pattern. Odd cases: null and empty texts have 0 bytes and 0
tokens; repeated rows are counted each; a very long text is a slice of its own; there
are no ties; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import byte_letters, distinct
from .common import MULT, U64, cache, doc_frame, names, slices, trim
from .tokens import library

CHUNK = 64
MOST = 1 << 20  # transitions that a worker keeps; beyond it they are compiled again
SLICE = 1 << 20  # bytes of text that are counted at once
LETTER, STMD, RV, E, ELL, NUMBER, QUOTE, OTHER, BLANK, SPACE, CUT = range(11)
S_END, S_L, S_N, S_P, S_W1, S_O1, S_WK, S_OK, S_A, S_RV, S_ELL, S_C = range(12)
HERE, BEFORE = 1, 2


def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by state * 11 + class."""
    to, out = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    letters = (LETTER, STMD, RV, E, ELL)
    fresh = {**dict.fromkeys(letters, S_L), NUMBER: S_N, QUOTE: S_A, OTHER: S_P, BLANK: S_W1, SPACE: S_O1, CUT: S_END}

    def starts(state: int, extra: int = 0) -> None:
        """Any class begins a pre-token."""
        for c, s in fresh.items():
            to[state, c], out[state, c] = s, (HERE | extra) if c != CUT else extra

    for s in (S_END, S_L, S_N, S_P, S_A, S_C):
        starts(s)
    for c in letters:
        to[S_L, c], out[S_L, c] = S_L, 0
    to[S_N, NUMBER], out[S_N, NUMBER] = S_N, 0
    for s in (S_P, S_A):  # punctuation goes on; a quote inside it is no contraction
        for c in (QUOTE, OTHER):
            to[s, c], out[s, c] = S_P, 0
    to[S_A, STMD], out[S_A, STMD] = S_C, 0
    to[S_A, RV], out[S_A, RV] = S_RV, 0
    to[S_A, ELL], out[S_A, ELL] = S_ELL, 0
    for s, done in ((S_RV, E), (S_ELL, ELL)):  # the letter before waits: a contraction, or a word of its own
        for c in range(11):
            to[s, c], out[s, c] = to[S_L, c], out[S_L, c] | BEFORE
        to[s, done], out[s, done] = S_C, 0
    for s, extra in ((S_W1, 0), (S_WK, BEFORE)):  # a last blank joins what follows
        for c, n in fresh.items():
            to[s, c], out[s, c] = (S_P if n == S_A else n), extra
    for s, extra in ((S_O1, HERE), (S_OK, HERE | BEFORE)):  # another white space stands alone
        for c, n in fresh.items():
            to[s, c], out[s, c] = n, extra
    for s in (S_W1, S_WK, S_O1, S_OK):
        to[s, BLANK], to[s, SPACE] = S_WK, S_OK
        out[s, BLANK] = out[s, SPACE] = out[s, CUT] = 0
    return to.reshape(-1), out.reshape(-1)


def classes() -> np.ndarray:
    """Class of every code point; 0x110000 is the cut between texts."""
    c = cache()
    if "pretoken_classes" not in c:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.full(0x110001, OTHER, np.uint8)
        for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                if b - a == len(m[0]) - 1:
                    out[a : b + 1] = value
                else:
                    out[[ord(x) for x in m[0]]] = value
        for text, value in (("stmd", STMD), ("rv", RV), ("e", E), ("l", ELL), ("'", QUOTE), (" ", BLANK)):
            for x in text:
                out[ord(x)] = value
        out[0x110000] = CUT
        c["pretoken_classes"] = out
    return c["pretoken_classes"]


def outputs(kinds: np.ndarray) -> np.ndarray:
    """Output of the transition at each symbol, from S_END, by composed chunk maps."""
    to, out = machine()
    n = len(kinds)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, CUT, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    maps = np.tile(np.arange(12, dtype=np.int16) * 11, (lanes, 1))
    wide = to.astype(np.int16) * 11
    for k in range(CHUNK):
        maps = wide[maps + steps[k][:, None]]
    gap = 1  # after a round, maps[i] covers the chunks i-2*gap+1 .. i
    maps //= 11
    while gap < lanes:
        later = maps[gap:]
        maps = np.concatenate([maps[:gap], np.take_along_axis(later, maps[:-gap], axis=1)])
        gap *= 2
    state = np.zeros(lanes, np.int16)
    state[1:] = maps[:-1, S_END]
    state *= 11
    got = np.empty((CHUNK, lanes), np.uint8)
    for k in range(CHUNK):
        at = state + steps[k]
        got[k] = out[at]
        state = wide[at]
    return got.T.reshape(-1)[:n]


class Transducer:
    """States and transitions of byte-pair encoding, compiled when they are first asked for."""

    def __init__(self, tok):
        vocabulary = json.loads(tok.to_str())["model"]["vocab"]
        byte = {c: i for i, c in enumerate(byte_letters())}
        self.model, self.names = tok.model, {i: s for s, i in vocabulary.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node of the trie
        self.token, self.inner = [-1], {0}  # token that ends at a node; nodes that have children
        for name, i in vocabulary.items():
            node = 0
            for c in name:
                self.inner.add(node)
                key = node << 8 | byte[c]
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = i
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[bytes, int] = {}
        self.chains: list[bytes] = []
        self.keys, self.values, self.filled = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, np.int64), 0
        self.state([0, -1, 0])

    def state(self, chain: list[int]) -> int:
        """``chain``: node, token before, tokens before less those now, for each place where a token may have begun."""
        raw = struct.pack(f"{len(chain)}i", *chain)
        at = self.states.get(raw)
        if at is None:
            at = self.states[raw] = len(self.chains)
            self.chains.append(raw)
        return at

    def together(self, a: int, b: int) -> bool:
        """Does token ``b`` behind token ``a`` (-1: nothing) stay as it is?"""
        known = self.pairs.get((a, b))
        if known is None:
            text = self.names[b] if a < 0 else self.names[a] + self.names[b]
            known = self.pairs[a, b] = [t.id for t in self.model.tokenize(text)] == ([b] if a < 0 else [a, b])
        return known

    def compiled(self, key: int) -> int:
        """state << 8 | byte -> next state << 10 | emitted + 512."""
        chain = memoryview(self.chains[key >> 8]).cast("i").tolist()
        byte, out, last, emitted = key & 255, [], -1, 0
        for i in range(0, len(chain), 3):
            node = self.child.get(chain[i] << 8 | byte)
            if node is None:
                continue
            if last < 0 <= self.token[node] and self.together(chain[i + 1], self.token[node]):
                last, emitted = self.token[node], chain[i + 2] + 1
            if node in self.inner:
                out += (node, chain[i + 1], chain[i + 2])
        if last < 0:
            raise ValueError("no token of the vocabulary ends here")
        for i in range(2, len(out), 3):
            out[i] -= emitted
        return self.state([*out, 0, last, 0]) << 10 | emitted + 512

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U64) * MULT >> U64(65 - len(self.keys).bit_length())).astype(np.int64)

    def look(self, keys: np.ndarray) -> np.ndarray:
        out, left, at = np.empty(len(keys), np.int64), np.arange(len(keys)), self.slot(keys)
        missing = []
        while len(left):
            there = self.keys[at]
            same = there == keys[left]
            out[left[same]] = self.values[at[same]]
            missing.append(left[there < 0])
            go = ~same & (there >= 0)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        new = np.concatenate(missing) if missing else left
        if len(new):
            asked, code = np.unique(keys[new], return_inverse=True)
            made = np.array([self.compiled(k) for k in asked.tolist()], np.int64)
            self.enter(asked, made)
            out[new] = made[code]
        return out

    def enter(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New transitions, no key twice."""
        if self.filled + len(keys) > len(self.keys) // 2:
            size = 1 << int(2 * (self.filled + len(keys))).bit_length()
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.keys, self.values, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        self.filled += len(keys)
        at = self.slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, pick = np.unique(at[free], return_index=True)
            pick = free[pick]
            self.keys[at[pick]], self.values[at[pick]] = keys[pick], values[pick]
            rest = np.ones(len(keys), bool)
            rest[pick] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each byte string: the sum of what its transitions emit."""
        if self.filled > MOST:
            self.clear()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -k, "left"))
            v = self.look(state[:live] << 8 | data[starts[:live] + k])
            state[:live] = v >> 10
            total[:live] += (v & 1023) - 512
        out = np.empty_like(total)
        out[order] = total
        return out


class Counter:
    """Tokens of each text of a slice."""

    def __init__(self, path: str):
        self.tok = library(path)
        self.machine = Transducer(self.tok)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        raw = data.tobytes()
        total = np.zeros(n, np.int64)
        if not raw:
            return total
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
        first = np.searchsorted(lead, offs)  # code point of each text's start
        where = np.arange(len(points)) + np.repeat(np.arange(n), np.diff(first))  # one cut after each text
        kinds = np.full(len(points) + n, CUT, np.uint8)
        kinds[where] = classes()[points]
        o = outputs(kinds)
        begin = (o & HERE).astype(bool)
        begin[:-1] |= (o[1:] & BEFORE).astype(bool)
        starts = lead[np.flatnonzero(begin[where])]
        lengths = np.diff(np.append(starts, len(data)))
        row = np.searchsorted(offs, starts, "right") - 1
        code, once = distinct(data, starts, lengths, names(data, starts, starts + lengths))
        counts = self.machine.counts(data, starts[once], lengths[once])
        total += np.bincount(row, counts[code], minlength=n).astype(np.int64)
        for s in self.special:
            if s in raw:
                for i in range(n):
                    own = raw[offs[i] : offs[i + 1]]
                    if s in own:
                        total[i] = len(self.tok.encode(own.decode("utf-8"), add_special_tokens=False).ids)
        return total


def counter(path: str) -> Counter:
    c = cache()
    if ("counter", path) not in c:
        c["counter", path] = Counter(path)
    return c["counter", path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            for i, j, data, offs in slices(b.column(1), SLICE):
                n = count(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        trim()

    return doc_frame(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
