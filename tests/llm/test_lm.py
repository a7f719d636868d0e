"""Language-model scores against exact counts and a brute-force model."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evigrain.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score double"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute(rows):
    seqs = [(d, [*WORD.findall(lower(t)), "</s>"]) for d, t in rows]
    uni, bi, docs = Counter(), Counter(), 0
    for d, s in seqs:
        if not held(d):
            docs += 1
            uni.update(s)
            bi.update(zip(["<s>", *s], s))
    n, v = sum(uni.values()), len(uni)
    quant = lambda c: 0 if c == 0 else 1 if c == 1 else 1.2 * 2 ** int(math.log2(c))
    out = []
    for d, s in seqs:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s)
        full = 0.0
        for a, b in zip(["<s>", *s], s):
            c1 = docs if a == "<s>" else uni[a]
            full += math.log10(min(quant(bi[a, b]), c1) + lm.MU * (uni[b] + 1) / (n + v + 1)) - math.log10(c1 + lm.MU)
        out.append((d, held(d), len(s), sum(uni[w] > 0 for w in s), n, base, full))
    return out


def texts():
    words = ["Alpha", "beta", "gamma", "delta\x00x", "é", "ZETA", "eta"]
    rows = [(i, " ".join(words[(i * k + k * k // 3) % 7] + (str(i % 11) if k % 4 == 0 else "") for k in range(i % 40))) for i in range(150)]
    return rows + [(200, None), (201, ""), (201, ""), (202, "beta beta\tbeta\nbeta"), (203, "word " * 3000), (204, "unseen1 unseen2"), (None, "beta gamma")]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1.0) for d, t in rows], SCHEMA).repartition(3)


def compared(spark, rows, least, **bounds):
    got = sorted(map(tuple, lm.report(frame(spark, rows), **bounds).collect()), key=str)
    want = sorted(brute(rows), key=str)
    key = lambda r: (str(r[0]), r[2])
    close = 0
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        close += abs(g[6] - w[6]) <= 0.02 * abs(w[6])
    assert close >= least * len(want)


def test_whole_model(spark):
    compared(spark, texts(), 0.95)


@pytest.mark.parametrize("bounds", [{}, {"word_bytes": 16 * 20, "filter_bytes": 200}])
def test_very_many_parts(spark, bounds):
    """Forced far beyond what the texts ask for: coarse ranges first, then their parts; the scores stay those of the model."""
    docs = frame(spark, texts())
    out = lm.crc_mod(F.col("doc_id"), 7) == 2
    few = {tuple(r) for r in lm.score(docs, *lm.fit(docs.where(~out)), out).collect()}
    model, counted = lm.fit(docs.where(~out), bits=11, fan=3, **bounds)
    many = {tuple(r) for r in lm.score(docs, model, counted, out).collect()}
    assert len(few) == len(many)
    key = lambda r: (str(r[0]), r[2:])
    same = sum(a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=0.02) for a, b in zip(sorted(few, key=key), sorted(many, key=key), strict=True))
    assert same >= 0.95 * len(few)
    with pytest.raises(ValueError, match="too many"):
        lm.count(docs, 24)


def test_no_document_trains(spark):
    rows = [(d, "a b c") for d in range(60) if held(d)]
    out = lm.report(frame(spark, rows)).collect()
    assert len(out) == len(rows) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in out)


def test_empty_table(spark):
    assert lm.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_beyond_the_bounds_come_by_join(spark):
    """Small tables: base scores stay exact, and a filter without room gives the same counts from the join."""
    rows = texts()
    compared(spark, rows, 0.0, word_bytes=200)
    compared(spark, rows, 0.97, filter_bytes=0)
    compared(spark, rows, 0.95, filter_bytes=300)
    compared(spark, rows, 0.0, word_bytes=0, filter_bytes=0)


def test_scores_do_not_depend_on_the_word_table(spark):
    """Words outside the table, trained or not, count as in the whole model, also as contexts."""
    rows = texts() + [(i, f"beta unseen{i} gamma once{i} once{i} Alpha") for i in range(300, 340)]
    key = lambda r: (str(r.doc_id), r.n_tokens)
    whole = sorted(lm.report(frame(spark, rows)).collect(), key=key)
    for word_bytes in (0, 200):
        for a, b in zip(sorted(lm.report(frame(spark, rows), word_bytes=word_bytes).collect(), key=key), whole, strict=True):
            assert a[:5] == b[:5] and a.score == pytest.approx(b.score, rel=1e-9)
    compared(spark, rows, 1.0, word_bytes=0, filter_bytes=0)


def test_table_and_filter_stay_within_their_bounds(spark):
    model, _ = lm.fit(frame(spark, texts()), word_bytes=400, filter_bytes=300)
    assert model.words.nbytes + model.counts.nbytes <= 400
    assert model.filter.nbytes <= 300 + 8 * (len(model.size) + 1)


def test_held_out_text_scores_better_than_by_words_alone(spark):
    rows = [(i, " ".join(f"w{(i + k) % 50} follows" for k in range(30))) for i in range(300)]
    out = lm.report(frame(spark, rows)).where(F.col("held_out")).collect()
    assert out and all(r.score > r.base_score for r in out)
