"""Line cleaning, headings, tokens, tags and ids on known facts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from evigrain.functions import analyze, text
from evigrain.operators import pages


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "line, want",
    [("high‑risk   group", "high-risk group"), ("a\t b\x00c ", "a bc"), ("ﬁne １２", "fine 12"), ("—x−", "-x-"), ("", ""), ("  ", "")],
)
def test_normalize_line(spark, line, want):
    assert one(spark, line, lambda c: text.normalize_line(analyze.nfkc(c))) == want


@pytest.mark.parametrize("line, want", [("National Standard Treatment Guidelines 17", "National Standard Treatment Guidelines <PAGE_NUMBER>"), ("Chapter 12345", "Chapter 12345"), ("17", "17")])
def test_canonical_line(spark, line, want):
    assert one(spark, line, text.canonical_line) == want


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd", "a\x1cb\x1db\x1ec", "a\x85b c d\n\n", "\n"])
def test_split_lines_as_python(spark, value):
    assert one(spark, value, text.split_lines) == value.splitlines()


@pytest.mark.parametrize(
    "line, heading, hard",
    [
        ("KEY RECOMMENDATION: SCREENING", True, False),
        ("This is ordinary explanatory text.", False, False),
        ("(USA).", False, False),
        ("ANNEXURE 3: FORMULARY", True, True),
        ("Section 4 of it", True, True),
        ("1.2: Aims", True, False),
        ("1.2 Aims", False, False),
        ("A", False, False),
        ("X" * 141, False, False),
        ("ÀÉÎÕÜÀÉÎ", True, False),
    ],
)
def test_headings(spark, line, heading, hard):
    assert one(spark, line, text.is_section_heading) is heading
    assert one(spark, line, text.is_hard_heading) is hard


@pytest.mark.parametrize("value, want", [("", 0), ("one two", 3), ("a.b", 4), ("straße_1 ²!", 4), ("\x1c", 0), ("a" * 50, 2)])
def test_token_estimate(spark, value, want):
    assert one(spark, value, text.estimate_tokens) == want


def test_sentences(spark):
    assert one(spark, "One. Two? (Three) four. five! 6 x", text.sentences) == ["One.", "Two?", "(Three) four. five!", "6 x"]
    assert one(spark, "", text.sentences) == []


@pytest.mark.parametrize("value, want", [("Initial dosages include 5 mg in an emergency.", ["dosage_content", "emergency_content"]), ("urgent referral", ["emergency_content"]), ("5 grams", []), ("2.5ML", ["dosage_content"])])
def test_safety_tags(spark, value, want):
    assert one(spark, value, text.safety_tags) == want


def test_chunk_id_keeps_long_page_numbers(spark):
    got = one(spark, "body", lambda c: text.chunk_id(F.lit("s"), F.lit(7), F.lit(12345), c))
    assert got == "s:p0007-p12345:" + hashlib.sha256(b"s|7|12345|body").hexdigest()[:16]


def test_shortened_and_redacted(spark):
    assert one(spark, "abcdef", lambda c: text.shortened(c, 3)) == "abc…"
    assert one(spark, "abc", lambda c: text.shortened(c, 3)) == "abc"
    assert one(spark, "see https://x.y/z?k=AIzaQ end AIza_k-1", text.redacted_diagnostic) == "see [url-redacted] end [key-redacted]"


RAW = "source_id string, page_number int, text string, image_count int"


def test_repeated_lines_and_cleaning(spark):
    rows = [("s", i, "\n".join(["Heading", f"Body topic number-{i}", f"Different content number-{i}", str(i), "Repeated document footer"]), 0) for i in range(1, 6)]
    lined = pages.page_lines(spark.createDataFrame(rows, RAW))
    assert {(r.line, r.n_pages) for r in pages.repeated_lines(lined).collect()} == {("Heading", 5), ("Repeated document footer", 5)}
    out = {r.page_number: r for r in pages.clean_pages(spark.createDataFrame(rows, RAW)).collect()}
    assert out[2].text == "Body topic number-2\nDifferent content number-2" and out[2].extraction_status == "low_text"


def test_repeated_lines_with_page_numbers(spark):
    rows = [("s", i, f"Alpha {'abcde'[i - 1]}\nNational Standard Treatment Guidelines {i}", 0) for i in range(1, 6)]
    lined = pages.page_lines(spark.createDataFrame(rows, RAW))
    assert [r.line for r in pages.repeated_lines(lined).collect()] == ["National Standard Treatment Guidelines <PAGE_NUMBER>"]


def test_cleaned_counts_positions_over_all_lines(spark):
    row = spark.createDataFrame([(["12", "Recommendation", "2", "Supporting text", "Repeated footer"], ["Repeated footer"])], "lines array<string>, r array<string>")
    assert row.select(pages.cleaned(F.col("lines"), F.col("r")).alias("t")).first()["t"] == "Recommendation\n2\nSupporting text"


def test_page_status_and_report(spark):
    rows = [(9, 2), (2000, 0), (0, 0), (10, 0), (0, 1)]
    df = spark.createDataFrame([("s", i + 1, c, m) for i, (c, m) in enumerate(rows)], "source_id string, page_number int, character_count int, image_count int")
    df = df.withColumn("extraction_status", pages.page_status(F.col("character_count"), F.col("image_count")))
    assert [r.extraction_status for r in df.orderBy("page_number").collect()] == ["image_review_required", "ok", "empty", "low_text", "image_review_required"]
    r = pages.extraction_report(df).first()
    assert (r.total_pages, r.pages_with_text, r.empty_pages, r.image_review_pages, r.total_characters) == (5, 4, [3], [1, 5], 2019)
    assert (r.minimum_characters, r.median_characters, r.maximum_characters) == (9, 10.0, 2000)


def test_null_text_is_an_empty_page(spark):
    out = pages.clean_pages(spark.createDataFrame([("s", 1, None, 0)], RAW)).first()
    assert (out.text, out.character_count, out.extraction_status) == ("", 0, "empty")


def test_registered_queries_apply_nfkc(spark, tmp_path):
    """Ligatures, full-width and other compatibility characters, which the SQL side can't fold."""
    import unicodedata

    from evigrain.plans import corpus_queries, retrieval_queries

    texts = ["ﬁne ｌｉｎｅ  ①\n½ cup\u2011high\tx", "plain\u00a0text ﬀ", None]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda x: re.sub(r"[ \t]+", " ", unicodedata.normalize("NFKC", x).replace("\0", "").translate({ord(c): "-" for c in "‐‑‒–—−"})).strip()
    want = {(i, n, fold(x)) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"), 1) if t}
    assert {tuple(r) for r in corpus_queries.line_normalize(spark, str(tmp_path)).collect()} == want
    asked = "Ｗｈａｔ ｄｏｓｅ of the tablet should I take?"
    spark.createDataFrame([(1, 1, "user", asked)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: r for r in retrieval_queries.input_guardrails(spark, str(tmp_path)).collect()}
    assert got[1001].category == "dosage"
    assert {r.id: r.query for r in retrieval_queries.normalize_query(spark, str(tmp_path)).collect()}[1001] == unicodedata.normalize("NFKC", asked)


def test_nfkc_sends_only_what_it_may_change_to_python(spark):
    """The stable characters change nothing, alone or beside another; all others are normalised as before."""
    import re
    import unicodedata

    stable = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", analyze.STABLE) + "]")
    kept = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and stable.match(chr(c))]
    assert len(kept) > 20000
    for x in kept:
        assert unicodedata.normalize("NFKC", x) == x and not unicodedata.combining(x)
        assert unicodedata.normalize("NFKC", "a" + x) == "a" + x and unicodedata.normalize("NFKC", "か" + x) == "か" + x
    texts = [None, "", "Ünïcode façade", "ﬁne", "e\u0301", "a\u00a0b…", "\u1100\u1161", "ｶﾞ", "か\u3099", "ok\n½"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", analyze.nfkc(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in d.collect()] == [(t, None if t is None else unicodedata.normalize("NFKC", t)) for t in texts]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN RLIKE" in plan or "CASE WHEN t" in plan


def test_pages_are_cleaned_without_a_shuffle_of_their_texts(spark):
    """A source of any size is no single task: only its few repeated lines travel."""
    rows = [("s" if i % 4 else "t", i, f"Head\nbody {i} x{i}\n\0 \n\u00a0\n{i}" if i != 7 else " \0\n\x1c\u2028 ", 0) for i in range(40)]
    d = spark.createDataFrame(rows, "source_id string, page_number int, text string, image_count int")
    lined = pages.page_lines(d)
    assert all(r.filled == any(x != "" for x in r.lines) and r.ends == r.lines[:3] + r.lines[max(len(r.lines) - 3, 0):] for r in lined.collect())
    out = pages.clean_pages(d)
    assert {r.page_number: r.text for r in out.collect()} == {i: "" if i == 7 else f"body {i} x{i}" for i in range(40)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
