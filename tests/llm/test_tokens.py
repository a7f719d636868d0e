"""The vectorised encoder against the library, and ranges of keys."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigrain.llm import bpe, huffman, tokens
from evigrain.llm.common import U64, dealt, mix, names, range_bounds, slices

WORD_BPE = tokens.public_path("word_bpe_49k.json")


def encoded(texts, end=None):
    out = []
    for a, b, data, offs in slices(pa.array(texts, pa.string()), 1 << 14):
        ids, at = tokens.encoder(WORD_BPE)(data, offs, end)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(b - a)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_encoder_equals_the_library(seed):
    r = random.Random(seed)
    alphabet = "ab stmdrevl'' 1²é×ÀÉ!?.<|>\n\tΏx²½ABS\x00\x1c 日é"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "Don't 's 'st it's '' ''s !!'s I'LL we've'd you're", "x" * 300 + " " + "1" * 200, "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>", "L'ÉTÉ ÀÞß × ÷ ªºµ", "é" * 100]
    lib = tokens.library(WORD_BPE)
    assert encoded(texts) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert encoded(texts[:9], 7) == [[*lib.encode(t, add_special_tokens=False).ids, 7] for t in texts[:9]]


def test_pieces_of_one_name_are_told_apart(monkeypatch):
    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    starts, n = np.array([0, 4, 8]), np.array([4, 4, 4])
    code, first = bpe.distinct(data, starts, n, np.zeros(3, U64))
    assert code[0] == code[2] != code[1] and first[code[1]] == 1
    kept = bpe.Kept(4)
    kept.add(np.zeros(1, U64), data, starts[:1], n[:1], np.array([5, 6], np.uint16), np.array([2]))
    assert kept.find(np.zeros(3, U64), data, starts, n).tolist() == [0, -1, 0]
    for k in range(40):  # it forgets, and stays right
        raw = np.frombuffer(b"%04d" % k, np.uint8)
        h = names(raw, np.array([0]), np.array([4]))
        assert kept.find(h, raw, np.array([0]), np.array([4]))[0] == -1
        kept.add(h, raw, np.array([0]), np.array([4]), np.array([k], np.uint16), np.array([1]))
        at = kept.find(h, raw, np.array([0]), np.array([4]))[0]
        assert kept.ids[kept.ids_at[at]] == k and len(kept.names) <= 4


@pytest.mark.parametrize("per", [400, 20])  # one level of quantiles, two levels
def test_ranges_of_keys(spark, per):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("key"), F.lit(1).alias("n"))
    bounds = range_bounds(df, "key", F.col("n"), 30_000, per)
    key = np.array([r.key for r in df.collect()])
    where = dealt(bounds, key, mix(np.arange(len(key), dtype=U64)))
    order = np.lexsort((key, where))
    assert (np.diff(key[order]) >= 0).all()  # ranges are in the order of keys
    assert max(Counter(where.tolist()).values()) < 12 * per
    assert len(np.unique(where[key == 7])) > 10_000 / per / 3


def test_token_files_of_a_hot_id(spark, tmp_path):
    """Very many rows of one id, and of none, are dealt to several files."""
    df = spark.range(60_000).select(F.when(F.col("id") < 20_000, F.lit(5)).when(F.col("id") > 20_000, F.lit(None)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1).cast("string"), 512)).alias("text"))
    out = huffman.round_trip(df, WORD_BPE, 2, str(tmp_path), least=1 << 19).toPandas().sort_values("start")
    assert len(list((tmp_path / "blocks").glob("bucket=*"))) > 8
    assert len(out) == 60_000 and (out.start.to_numpy() == np.concatenate([[0], out.n_tokens.cumsum().to_numpy()[:-1]])).all()
    assert out.doc_id.isna().to_numpy()[:39_999].all() and (out.doc_id.to_numpy()[39_999:59_999] == 5).all()
