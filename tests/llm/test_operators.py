"""The other operators against brute force, libraries and round trips, with awkward rows in every table."""

import hashlib
import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import base64
import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrain.llm import decontaminate, fingerprints, huffman, langid, lm, packing, pii, token_counts, tokens, warc

WORD_BPE, BYTE_BPE = tokens.public_path("word_bpe_49k.json"), tokens.public_path("byte_bpe_50k.json")
#: Names that the operators use themselves.
EXTRA = "key string, row long, score double, lang_pred string, piece int, start long, length long, bucket int, _salt int, _hit boolean, ids binary, keys array<long>"
AWKWARD = [None, "", " ", "\n\t", "a", "A a", "é", "日本語 テキスト。", "naïve café ½ ﬁ", "<|endoftext|> x <s>", "don't we'll I'VE", "a\x00b\x01c", "😀👍🏽 ok", "x" * 300, "word " * 4000, "tab\tnew\r\nline  double", "3.14 1,000 2024-01-02", "ß ẞ İ ı", "​zero‍width", "é combining"]


def frame(spark, texts, first=0):
    rows = [(i + first, t) for i, t in enumerate(texts)] + [(first, texts[0]), (None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for f in EXTRA.split(", "):
        name, kind = f.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(3)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by(rows):
    return sorted(rows, key=str)


# --- 1 fingerprints ---------------------------------------------------------------------------


def test_fingerprints(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(3000))
    df = frame(spark, [*AWKWARD, long, long, "prefix " + long])
    order = sorted(rows_of(df), key=lambda r: (fingerprints.NO_ID if r[0] is None else r[0], r[1] or ""))
    out = fingerprints.report(df).collect()
    want = Counter()
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        e = fingerprints.edited_text(t or "", nxt or "")
        want[d, len(t or ""), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    prints = defaultdict(set)
    texts = dict((d, t or "") for d, t in order if d is not None)
    for r in out:
        if r.doc_id is not None:
            prints[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    same, shifted = (fingerprints.sketches([x.encode()]) for x in (long, "prefix " + long))
    assert fingerprints.likeness(same, shifted)[0] > 0.8 and fingerprints.likeness(same, fingerprints.sketches([b"quite another text " * 90]))[0] < 0.2


def test_phrases_do_not_depend_on_neighbours():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, n, dtype=np.uint8)) for n in (1, 2, 5, 50, 900, 4000)]
    alone = [fingerprints.shown(*fingerprints.sketches([t]))[0] for t in texts]
    assert alone == fingerprints.shown(*fingerprints.sketches(texts)) and alone[::-1] == fingerprints.shown(*fingerprints.sketches(texts[::-1]))


M64 = (1 << 64) - 1


def mix64(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def parsed(symbols, keys):
    """One level of the parse, symbol by symbol: names of the phrases. ``keys``: what labels start from."""
    runs = [[symbols[0], keys[0], 1]]
    for x, k in zip(symbols[1:], keys[1:]):
        if k == runs[-1][1]:
            runs[-1][2] += 1
        else:
            runs.append([x, k, 1])
    names = [x if n == 1 else mix64((x + n * 0x9E3779B97F4A7C15) & M64) for x, _, n in runs]
    label = [k for _, k, _ in runs] if keys is not symbols else names
    toss = lambda own, before: 2 * ((own ^ before) & -(own ^ before)).bit_length() - 2 + (own >> (((own ^ before) & -(own ^ before)).bit_length() - 1) & 1)
    for step in range(4):
        first = label[0] ^ 1 if step or keys is not symbols else label[0] ^ M64
        label = [toss(x, b) for x, b in zip(label, [first, *label[:-1]])]
    n = len(names)
    cuts = [0] + [i for i in range(1, n - 1) if label[i] > label[i - 1] and label[i] > label[i + 1]] + [n]
    out = []
    for a, e in zip(cuts, cuts[1:]):
        h = sum(x * pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i, x in enumerate(names[a:e]))
        out.append(mix64((h + (e - a) * 0x9E3779B97F4A7C15) & M64))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_parse_equals_a_plain_parser(seed):
    r = np.random.default_rng(seed)
    texts = [bytes(r.integers(97, 97 + int(a), int(n), dtype=np.uint8)) for n, a in zip(r.integers(1, 400, 12), r.integers(1, 20, 12), strict=True)]
    byte = [(mix64(b * 0x9E3779B97F4A7C15 & M64) | 1) for b in range(1, 257)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    names, got_offs = fingerprints._phrases(np.array(byte, np.uint64)[data], data, offs)
    want = [parsed([byte[b] for b in t], list(t)) for t in texts]
    for _ in range(3):
        assert [names[got_offs[i] : got_offs[i + 1]].tolist() for i in range(len(texts))] == want
        names, got_offs = fingerprints._phrases(names, None, got_offs)
        want = [parsed(w, w) for w in want]


def test_likeness_of_edited_texts_has_no_cliff():
    """One changed word leaves texts alike at every length, also where the level of the sketch changes."""
    r = np.random.default_rng(2)
    worst = 1.0
    for n in range(30, 160, 2):
        w = ["".join(map(chr, r.integers(97, 123, int(k)))) for k in r.integers(2, 9, n)]
        v = list(w)
        v[n // 2] = "changed"
        worst = min(worst, float(fingerprints.likeness(fingerprints.sketches([" ".join(w).encode()]), fingerprints.sketches([" ".join(v).encode()]))[0]))
    assert worst > 0.4


def test_fingerprints_of_a_hot_id(spark, monkeypatch):
    """A third of the rows without an id, over several ranges: the order stays, and the next text with it."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 4000)
    rows = [(None if i % 3 == 0 else i, hashlib.sha256(b"%d" % i).hexdigest() * (i % 4)) for i in range(600)]
    order = sorted(rows, key=lambda r: (fingerprints.NO_ID if r[0] is None else r[0], r[1]))
    want = Counter((d, hashlib.sha256(fingerprints.edited_text(t, n).encode()).hexdigest()) for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    out = fingerprints.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in out) == want


# --- 3, 6, 7: tokens ------------------------------------------------------------------------------


def ids(path, text):
    return tokens.library(path).encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_packing(spark):
    df = frame(spark, [*AWKWARD, "long words here " * 1500])
    want = Counter()
    for d, t in rows_of(df):
        own = [*ids(WORD_BPE, t), 0]
        for k, s in enumerate(range(0, len(own), 2048)):
            part = own[s : s + 2048]
            want[d, k, s, len(part), crc(part)] += 1
    out = packing.pack(df, WORD_BPE, 0, 2048).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in out) // 2048) + 2


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_a_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 101, 400).tolist()
    plan = packing.best_fit(dict(Counter(lengths)), 100)
    used, placed = Counter(), Counter()
    counts = Counter(lengths)
    for i, (length, rank, first, q, base) in enumerate(plan):
        end = plan[i + 1][1] if i + 1 < len(plan) and plan[i + 1][0] == length else counts[length]
        for k in range(end - rank):
            used[first + k // q] += length
            placed[length] += 1
    assert placed == counts and max(used.values()) <= 100
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(100 - n)
    assert len(used) <= len(rooms) + 1


def test_token_files(spark):
    df = frame(spark, AWKWARD)
    out = huffman.round_trip(df, WORD_BPE, 2).collect()
    want = Counter((d, len(x := [*ids(WORD_BPE, t), 2]), crc(x)) for d, t in rows_of(df))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)


def test_code_lengths_are_limited_and_complete():
    counts = np.zeros(1 << 16, np.int64)
    counts[:40] = [1 << min(i, 40) for i in range(40)]
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert (lengths[:40] > 0).all() and lengths.max() <= huffman.LIMIT and (2.0**-used).sum() <= 1
    one = np.zeros(1 << 16, np.int64)
    one[7] = 5
    assert huffman.code_lengths(one)[7] == 1


def test_token_counts(spark):
    odd = ["".join(chr(32 + (i * 7 + j * j) % 95) for j in range(i)) for i in range(0, 200, 7)]
    odd += [chr(c) * 3 + " " + chr(c) for c in (0x85, 0xA0, 0x2028, 0x3000, 0x0301, 0x0661, 0x1F600, 0xFE0F, 0x200D, 0xAD)]
    odd += ["'s 'S 'd'll", "  two  spaces ", " \n \n x", "a  \n", "<|endoftext|>", "x<|endoftext|>y", "1234567", "__a__", string.printable * 3]
    df = frame(spark, AWKWARD + odd)
    want = Counter((d, len((t or "").encode()), len(ids(BYTE_BPE, t)), len(ids(BYTE_BPE, t)) > 1024) for d, t in rows_of(df))
    out = token_counts.token_counts(df, BYTE_BPE, 1024).collect()
    assert Counter(tuple(r) for r in out) == want


@pytest.mark.parametrize("seed", range(3))
def test_transducer_equals_the_library(seed, monkeypatch):
    """Counts of random byte strings, and of long ones, also when the machine has to forget."""
    r = random.Random(seed)
    machine = token_counts.Transducer(tokens.library(BYTE_BPE))
    monkeypatch.setattr(token_counts, "MOST", 3000)
    letters = token_counts.byte_letters()
    forgot = False
    for alphabet in (b"etaoin shr", b" the and ing", bytes(range(256)), b"=-_ \n", b"Aa1 \xc3\xa9"):
        own = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(300)] + [bytes(r.choice(alphabet) for _ in range(600))]
        raw = np.frombuffer(b"".join(own), np.uint8)
        n = np.array([len(x) for x in own])
        before = machine.filled
        got = machine.counts(raw, np.cumsum(n) - n, n)
        forgot |= machine.filled < before
        assert got.tolist() == [len(machine.model.tokenize("".join(letters[b] for b in x))) for x in own]
    assert forgot


# --- 4 decontamination -----------------------------------------------------------------------------

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def leaks(docs, items, window):
    found = [(i, ALNUM.findall(lower(t))) for i, t in items]
    out = Counter()
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        hit, names = [False] * len(w), set()
        for i, own in found:
            n = min(window, len(own))
            for a in range(len(own) - n + 1) if n else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == own[a : a + n]:
                        names.add("" if i is None else str(i))
                        hit[b : b + n] = [True] * n
        out[d, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)] += 1
    return out


def test_decontamination(spark):
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "x1"]
    passage = r.choice(vocabulary, 40).tolist()
    docs = [" ".join([*r.choice(vocabulary, 15), *passage[a : a + n], *r.choice(vocabulary, 6)]) for a, n in ((0, 40), (3, 10), (5, 9), (20, 11), (30, 10), (0, 0))]
    docs += ["one two three", "ONE, two; three!", "one one one one one one one one one one one one one one", *AWKWARD[:14]]
    items = [(1, " ".join(passage)), (2, "One-two three"), (10, "one " * 12), (3, ""), (4, None), (None, " ".join(passage[3:20])), (1, " ".join(passage)), (9, "...")]
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(1))
    want = leaks(rows_of(df), items, 10)
    assert Counter(tuple(r) for r in decontaminate.report(df, bench, 10).collect()) == want
    for block in (1 << 20, 0):  # broadcast, and a shuffle of fingerprints
        full = decontaminate.contamination(df, bench, 10, block).collect()
        digest = lambda r: (r.doc_id, r.n_words, int(np.unpackbits(np.frombuffer(r.hits, np.uint8)).sum()), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r.hits) > 0)
        assert Counter(map(digest, full)) == want
        clean = decontaminate.clean(df, bench, 10, block)
        assert clean.columns == df.columns
        assert Counter(r.doc_id for r in clean.collect()) == Counter(a for (a, b, c, d, e, f), n in want.items() if not f for _ in range(n))
        assert decontaminate.contamination(df.where("false"), bench, 10, block).collect() == []
    joined = decontaminate._joined(df, decontaminate._items(bench), 10, chunk_bytes=200)[1].collect()  # several chunks a document
    assert {(r.hits, tuple(r["items"])) for r in joined} == {(r.hits, tuple(r["items"])) for r in full if r.hits}
    none = decontaminate.report(df, bench.where("false"), 10).collect()
    assert len(none) == len(rows_of(df)) and not any(r.contaminated for r in none)


# --- 5 personal data -------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PERSONAL = ["mail a.b@x.org, or c@d.e.f!", "@a.b a@b a@b.c@d.e x@@y.z", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.4 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12345678 +1234567890123456 +49 30 1234567", "call 555-123-4567 today", 'api_key="sk_9f8Xa7Qw3ErT5yUi2oPl4kJh"', "contact: joe [at] site [dot] com", "total 1000 of 20-30 in 2024-01-02", "é+49 30 1234567é a@b.cé", "1 2 3 4 5 6 7 8 9 0 1 2 3", "host fe80:0000:0000:0000:0202:b3ff:fe1e:8329"]


def base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def test_personal_data(spark):
    df = frame(spark, AWKWARD + PERSONAL)
    texts = defaultdict(list)
    for d, t in rows_of(df):
        texts[d].append(t or "")
    for r in pii.report(df).collect():
        own = base(texts[r.doc_id][0])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in own) for k in ("email", "ip", "card", "phone")]
        assert not line or set(line.split(",")) <= set(r.spans.split(","))


def test_trees_find_what_the_patterns_miss_and_leave_dates_alone():
    model = pii.trained()
    added = lambda t: {k for k, _, _ in set(pii.all_spans(t, model)[1]) - set(pii.all_spans(t, model)[0])}
    assert "secret" in added(PERSONAL[6]) and "email" in added(PERSONAL[7])
    assert not added(PERSONAL[8])
    rows = pii.synthetic(2000, seed=99)
    p = pii.probability(model, [r[1] for r in rows], np.array([pii.features(t, k, s, e) for t, k, s, e, _ in rows]))
    right = np.mean((p >= 0.5) == np.array([r[4] for r in rows], bool))
    assert right > 0.9


def test_thresholds_are_calibrated_by_kind():
    model = pii.trained()
    rows = pii.synthetic(6000, seed=5)
    kinds, y = np.array([r[1] for r in rows]), np.array([r[4] for r in rows])
    p = pii.probability(model, kinds.tolist(), np.array([pii.features(t, k, s, e) for t, k, s, e, _ in rows]))
    for k in pii.KINDS:
        taken = (kinds == k) & (p >= model["least"][k])
        assert taken.sum() > 50 and y[taken].mean() > 0.9, k
    assert len(set(model["least"].values())) > 1


def test_long_keys_and_keys_without_digits():
    model = pii.trained()
    for key in ("aZ9_" * 60, "Qx7Lm2Pz8Rt4Vn6Wk1Ys3Hb5" * 8):
        text = f'token = "{key}" and more'
        assert ("secret", 9, 9 + len(key)) in pii.all_spans(text, model)[1]
    assert pii.candidates("KeyWithoutAnyDigitInside here", []) == [("secret", 0, 24)]


@pytest.mark.parametrize("seed", range(20))
def test_chosen_spans_are_greedy(seed):
    r = np.random.default_rng(seed)
    found = [("phone", int(a), int(a) + int(n)) for a, n in zip(r.integers(0, 300, 120), r.integers(1, 25, 120), strict=True)]
    p = r.integers(0, 6, 120) / 5
    taken = []
    for i in sorted(range(120), key=lambda i: (-p[i], found[i][1], found[i][2])):
        if p[i] >= 0.4 and all(found[i][2] <= s or found[i][1] >= e for _, s, e in taken):
            taken.append(found[i])
    assert pii.chosen(found, p, {"phone": 0.4}) == taken


def test_many_candidates_take_time_in_proportion():
    model = pii.trained()

    def took(n):
        text = " ".join(f"call 555-{i % 900 + 100}-{i % 9000 + 1000}" for i in range(n))
        began = time.process_time()
        pii.all_spans(text, model)
        return time.process_time() - began

    took(500)
    assert took(8000) < 8 * took(2000)


def test_redaction_keeps_columns(spark):
    df = frame(spark, PERSONAL + [None])
    out = pii.redacted(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "mail [EMAIL], or [EMAIL]!" and got[0].n_chars == len(got[0].text)
    assert got[len(PERSONAL)].text is None


# --- 8 WARC -----------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    inside = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n y"
    rows = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "http://x/ y", None), (4, "u", ""), (5, "u", inside), (6, "u", inside), (7, "u", "é日" * 5000), (8, "u", "\r\n\r\nWARC/1.1\r\n"), (9, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "winner": F.lit(2), "value": F.lit(3)}).repartition(2)
    last = {}
    for p, _, h in rows:
        last[h or ""] = max(p, last.get(h or "", p))
    want = set()
    for p, _, h in rows:
        raw = (h or "").encode()
        winner = last[h or ""]
        want.add((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if winner == p else "revisit", None if winner == p else winner))
    assert {tuple(r) for r in warc.round_trip(df).collect()} == want
    least = {r.page_id: r.record_type for r in warc.round_trip(df, f"{tmp_path}/w", least=20).collect()}
    assert least[1] == least[2] == "response" and least[5] == "revisit"
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:  # splits in the middle of records
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        cut = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, f"{tmp_path}/w").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len(cut) == len(rows) and {c[:3] for c in cut} == {w[:3] for w in want}
    assert warc.round_trip(df.where("false")).collect() == []


def test_warc_headers_of_any_length(spark, tmp_path):
    rows = [(i, "http://x/" + " é"[i % 2] * (70_000 if i in (3, 4) else 5), f"<p>{i}</p>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    assert {r.page_id for r in warc.round_trip(df).collect()} == set(range(8))


def test_warc_pages_of_one_id(spark):
    """A page is a revisit for its own payload, not for that of another page with its id."""
    rows = [(5, "u", "A"), (5, "u", "B"), (7, "u", "A"), (6, "u", "C"), (6, "u", "D"), (8, "u", "C"), (9, "u", "D")]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    sha = {h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in "ABCD"}
    want = [(5, "A", 7), (5, "B", None), (7, "A", None), (6, "C", 8), (6, "D", 9), (8, "C", None), (9, "D", None)]
    assert Counter((r.page_id, r.payload_digest, r.refers_to) for r in out) == Counter((p, sha[h], w) for p, h, w in want)


def test_warc_of_very_many_magics(spark, tmp_path):
    """Headers inside a payload that claim much of it cost no bytes each, and a wrong payload is seen."""
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900000\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    rows = [(1, "u", "<p>"), (2, "u", fake * 12_000), (3, "http://x/" + "y" * (1 << 20), "<q>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    began = time.time()
    out = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(df, f"{tmp_path}/w").collect()}
    assert out == {p: (len(h.encode()), warc.digest(h.encode())) for p, _, h in rows} and time.time() - began < 120
    raw = b"".join(warc.record(i, "u", b"<p>%d" % i, warc.digest(b"<p>%d" % i), None, False) + b"\r\n\r\n" for i in range(3))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f").write_bytes(raw.replace(b"<p>1", b"<p>7"))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"{tmp_path}/x").collect()


@pytest.mark.parametrize("tail", [b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 50\r\n\r\nx\r\n\r\n", b"WARC/1.1\r\nno header\r\n\r\n", b"x"])
def test_warc_chain_that_stops(spark, tmp_path, tail):
    """A file with bytes that no record covers is an error, not a shorter table."""
    whole = b"".join(warc.record(i, "u", b"<p>", warc.digest(b"<p>"), None, False) + b"\r\n\r\n" for i in range(3))
    (tmp_path / "sound").write_bytes(whole)
    assert warc.read(spark, str(tmp_path)).count() == 3
    (tmp_path / "broken").write_bytes(whole + tail)
    with pytest.raises(ValueError, match="file's size"):
        warc.read(spark, str(tmp_path))
    (tmp_path / "broken").write_bytes(tail + whole)
    with pytest.raises(ValueError, match="file's size"):
        warc.read(spark, str(tmp_path))


# --- 10 language --------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model = langid.fit(langid.train_split(docs))
    out = langid.predict(docs, langs, model).join(docs.select("doc_id", "lang"), "doc_id")
    out = out.where((F.crc32(F.col("doc_id").cast("string")) % 4 == 2) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.right > 0.9 and 0 <= r.lo <= r.hi <= 1


def bayes(train, texts, buckets=1 << 15, smoothing=0.5):
    """(language, posterior) of each text by plain counting."""

    def grams(text):
        low = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
        for k in (1, 2, 3, 4):
            for i in range(len(low) - k + 1):
                own, h = low[i : i + k], 0
                if all(b == 32 for b in own) or k > 1 and own[0] == own[1] == 32:
                    continue
                for b in own:
                    h = (h * 0x9E3779B1 + b + 1) & 0xFFFFFFFF
                h = ((h ^ h >> 15) * 0x85EBCA77) & 0xFFFFFFFF
                yield (h ^ h >> 13) % buckets

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in train:
        docs[lang] += 1
        counts[lang].update(grams(text))
    names, out = sorted(docs), []
    for t in texts:
        own = Counter(grams(t))
        logs = [math.log(docs[k] / sum(docs.values())) + sum(n * math.log((counts[k][g] + smoothing) / (sum(counts[k].values()) + smoothing * buckets)) for g, n in own.items()) for k in names]
        best = logs.index(max(logs))
        letters = any(c.isalpha() for c in t or "")
        out.append((names[best] if letters else "und", 1 / sum(math.exp(x - logs[best]) for x in logs) if letters else 0.0))
    return out


def test_language_is_naive_bayes(spark):
    train = [("the cat and the dog", "en"), ("a house of wood", "en"), ("der Hund und die Katze", "de"), ("el perro y el gato", "es"), ("la niña come", "es"), ("and so on", "en"), (None, "en")]
    texts = ["the dog", "die Hand", "la", "x", "  zz  the", "ñ", "É", None, "12", "wood und gato", "the " * 3000]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(train)], "doc_id long, text string, lang string")
    out = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *langid.fit(df)).collect()
    for r, (lang, p) in zip(sorted(out, key=lambda r: r.doc_id), bayes(train, texts), strict=True):
        assert r.lang_pred == lang and abs(r.score - p) < 1e-3, (texts[r.doc_id], r, p)
    nothing = langid.predict(df.where("false"), *langid.fit(df))
    assert nothing.collect() == [] and nothing.columns == ["doc_id", "lang_pred", "score"]


def test_language_of_awkward_rows(spark):
    df = frame(spark, [*AWKWARD, "the cat and the dog went to the house", "12 34 !?"])
    langs, model = langid.fit(df)
    out = {r.doc_id: r for r in langid.predict(df, langs, model).collect()}
    for d, t in rows_of(df):
        letters = any(c.isalpha() for c in t or "")
        assert out[d].lang_pred == ("en" if letters else "und") and (letters or out[d].score == 0)
    kept = langid.recognised(df, langs, model)
    assert kept.columns == df.columns and kept.where(F.col("text").isNull()).count() == 0
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, *none).collect()} == {"und"}


# --- empty tables, registration ---------------------------------------------------------------------


def test_empty_documents(spark):
    df = frame(spark, ["a"]).where("false")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for out in (fingerprints.report(df), lm.report(df), packing.pack(df, WORD_BPE), decontaminate.report(df, bench), pii.report(df), huffman.round_trip(df, WORD_BPE), token_counts.token_counts(df, BYTE_BPE)):
        assert out.collect() == []


def test_every_operator_is_registered():
    from evigrain.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
