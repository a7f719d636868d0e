"""The analyser and BM25 against SQLite FTS5 itself."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from evigrain.functions import analyze
from evigrain.operators import lexical

TEXTS = [
    "Dengue warning signs include persistent vomiting and abdominal pain.",
    "Hypertensive patients' blood pressures should be measured repeatedly; measuring twice is recommended.",
    "Caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed",
    "relational conditional valency hesitancy digitizer conformably radically differently vilely analogously",
    "vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility",
    "triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner",
    "adjustable defensible irritant replacement adjustment dependent adoption communism activate angularity homologous effective bowdlerize",
    "probate rate cease controll roll happy sky dying analogy biology generalization a an of be",
    "café naïve Ångström señor straße Übergröße a_b snake_case x2 3.14 10mg ² Ⅷ",
    "", "!!!", "ab abc", "running runs runner ran", "Ünïcödé Ñandú ÇA",
]


def fts(texts):
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(body, tokenize='porter unicode61 remove_diacritics 2')")
    c.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(texts, 1)))
    return c


def fts_tokens(texts):
    c = fts(texts)
    c.execute("create virtual table v using fts5vocab(t, instance)")
    out = {i: [] for i in range(1, len(texts) + 1)}
    for term, doc, _, offset in c.execute("select term, doc, col, offset from v order by doc, offset"):
        out[doc].append(term)
    return [out[i] for i in sorted(out)]


def ours(text):
    return [analyze.stem(w) for w in analyze.tokens(text)]


def test_tokens_equal_fts5():
    for text, want in zip(TEXTS, fts_tokens(TEXTS), strict=True):
        assert ours(text) == want, text


def test_random_words_equal_fts5():
    r = random.Random(5)
    parts = ["re", "con", "stress", "ing", "ed", "ly", "ness", "ation", "ize", "izer", "al", "ful", "y", "ies", "s", "ement", "ion", "ous", "iviti", "bl", "at", "ee", "o", "t", "l", "ll", "tt", "ational", "logi", "enci", "e"]
    words = ["".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(4000)]
    got = fts_tokens([w for w in words])
    wrong = [(w, ours(w), g) for w, g in zip(words, got, strict=True) if ours(w) != g]
    assert not wrong, wrong[:10]


def test_analyze_column(spark):
    df = spark.createDataFrame([(1, "Measuring pressures"), (2, None)], "i int, t string").select("i", analyze.analyze(F.col("t")).alias("a"))
    assert [r.a for r in df.orderBy("i").collect()] == [["measur", "pressur"], []]


@pytest.mark.parametrize("query", ["blood pressure", "signs signs warning", "measuring the patients", "café", "controlling happiness"])
def test_bm25_equals_fts5(spark, query):
    texts = [t for t in TEXTS if t] * 2 + ["filler number %d text" % i for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "chunk_id int, t string").select("chunk_id", F.lit("s").alias("source_id"), analyze.analyze(F.col("t")).alias("terms"))
    q = spark.createDataFrame([(1, query)], "query_id int, q string")
    q = q.select("query_id", analyze.analyze(F.array_join(lexical.query_terms(F.col("q"), analyze.casefold(F.col("q"))), " ")).alias("terms"))
    got = {r.chunk_id: r.score for r in lexical.bm25(docs, q).collect()}
    words = [w for w in query.split() if w != "the"]
    match = " OR ".join(f'"{w}"' for w in words)
    want = {i: -s for i, s in fts(texts).execute("select rowid, bm25(t) from t where t match ?", (match,))}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], rel=1e-9)


def test_query_terms(spark):
    df = spark.createDataFrame([(1, "What is the BLOOD pressure pressure?"), (2, "what is the"), (3, "!!"), (4, " ".join(f"w{i}" for i in range(50)))], "i int, q string")
    got = {r.i: r.t for r in df.select("i", lexical.query_terms(F.col("q")).alias("t")).collect()}
    assert got[1] == ["blood", "pressure", "pressure"] and got[2] == ["what", "is", "the"] and got[3] == [] and len(got[4]) == 30


def test_source_filter_keeps_global_statistics(spark):
    docs = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["x"]), (3, "b", ["z"]), (4, "b", ["w"]), (5, "b", ["v"])], "chunk_id int, source_id string, terms array<string>")
    q = spark.createDataFrame([(1, ["x"])], "query_id int, terms array<string>")
    whole = {r.chunk_id: r.score for r in lexical.bm25(docs, q).collect()}
    only = {r.chunk_id: r.score for r in lexical.bm25(docs, q, sources=("a",)).collect()}
    assert only == {1: whole[1]}


def test_valid_query(spark):
    df = spark.createDataFrame([(1, "a  b\n"), (2, " "), (3, "x" * 501)], "i int, q string")
    assert [r.v for r in df.orderBy("i").select(lexical.valid_query(F.col("q")).alias("v")).collect()] == ["a b", None, None]
