"""Chunking, page ranges, audit and manifest."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evigrain import config, schemas
from evigrain.config import Chunking
from evigrain.functions import analyze
from evigrain.operators import audit, chunking, lexical
from evigrain.sources import files, manifest, store

SMALL = Chunking(1, 40, 60, 80, 10, ("empty", "image_review_required"))
PAGES = "source_id string, page_number int, text string, extraction_status string"


def sentences(n, word="alpha"):
    return "\n".join(f"This is {word} sentence number {i} about guideline content." for i in range(n))


def inputs(spark, rows, excluded=(), ranges=(), source="s"):
    pages = spark.createDataFrame([(source, *r) for r in rows], PAGES)
    m = spark.createDataFrame([(source, "Title", "Pub", "Cat", "2020", "en", list(excluded), [{"start": a, "end": b} for a, b in ranges])], "source_id string, title string, publisher string, category string, document_date string, language string, exclude_pages_from_index array<int>, include_page_ranges array<struct<start:int,end:int>>")
    d = spark.createDataFrame([(source, "https://u", "abc")], "source_id string, final_url string, sha256 string")
    return pages, m, d


def chunks(spark, rows, conf=SMALL, **rules):
    return chunking.build_chunks(*inputs(spark, rows, **rules), conf).orderBy("chunk_ordinal").collect()


def test_limits_and_skipped_page(spark):
    out = chunks(spark, [(1, "KEY RECOMMENDATION: SCREENING\n" + sentences(44), "ok"), (2, "text", "image_review_required")])
    assert len(out) > 3 and all(c.estimated_tokens <= 80 for c in out)
    assert all(c.pages == [1] for c in out) and {c.sections[0] for c in out} == {"KEY RECOMMENDATION: SCREENING"}
    assert len({c.chunk_id for c in out}) == len(out)


def test_overlap_repeats_the_last_units(spark):
    out = chunks(spark, [(1, sentences(20), "ok")])
    first, second = out[0].text, out[1].text
    assert second.split(".")[0] in first


def test_no_heading_only_chunk(spark):
    out = chunks(spark, [(1, "SECTION ONE HEADING\nSECOND HEADING LINE\n" + sentences(2), "ok")])
    assert len(out) == 1 and out[0].sections == ["SECTION ONE HEADING", "SECOND HEADING LINE"]


def test_excluded_pages_and_ranges(spark):
    out = chunks(spark, [(1, sentences(12), "ok"), (2, sentences(12, "beta"), "ok")], excluded=[1])
    assert {c.page_start for c in out} == {2}
    out = chunks(spark, [(i, sentences(12, f"w{i}"), "ok") for i in range(1, 5)], ranges=[(2, 3)])
    assert {p for c in out for p in c.pages} == {2, 3}


def test_page_gap_closes_a_chunk(spark):
    out = chunks(spark, [(1, sentences(9), "ok"), (2, "", "image_review_required"), (3, sentences(9, "beta"), "ok")])
    assert not any(1 in c.pages and 3 in c.pages for c in out)


def test_inverted_range_is_an_error(spark):
    with pytest.raises(Exception, match="invalid page range"):
        chunks(spark, [(1, "a", "ok")], ranges=[(3, 2)])


def test_long_sentence_is_split_and_oversized_word_reported(spark):
    out = chunks(spark, [(1, " ".join(f"word{i}" for i in range(300)), None)])
    assert all(c.estimated_tokens <= 80 for c in out)
    odd = "!" * 200
    pages, m, d = inputs(spark, [(1, odd, "ok")])
    report = chunking.chunk_report(chunking.build_chunks(pages, m, d, SMALL), SMALL).first()
    assert (report.chunks, report.above_maximum) == (1, 1)
    with pytest.raises(Exception, match="hard token limit"):
        chunking.build_chunks(pages, m, d, SMALL, strict=True).collect()


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, sentences(i % 5 + 1, f"w{i}"), "ok") for i in range(1, 30)]
    pages, m, d = inputs(spark, rows)
    a = sorted(r.chunk_id for r in chunking.build_chunks(pages.repartition(7), m, d, SMALL).collect())
    b = sorted(r.chunk_id for r in chunking.build_chunks(pages.coalesce(1), m, d, SMALL).collect())
    assert a == b


def test_null_text_and_no_pages(spark):
    assert chunks(spark, [(1, None, "ok"), (2, "", "ok")]) == []
    pages, m, d = inputs(spark, [(1, "x", "ok")])
    assert chunking.build_chunks(pages.where("false"), m, d, SMALL).collect() == []


def corpus(spark, ranges=((1, 5),), page=3):
    pages, m, d = inputs(spark, [(page, sentences(6), "ok")], ranges=[(1, 9)])
    made = chunking.build_chunks(pages, m, d, SMALL)
    rules = inputs(spark, [], ranges=list(ranges))[1]
    return made, rules, d


def test_audit_passes_and_fails_on_ranges(spark):
    c, m, d = corpus(spark, ((3, 5),))
    report = {r.source_id: r for r in audit.gate(c, m, d, SMALL).collect()}
    assert report[None].errors == 0 and report["s"].chunks == report["s"].unique_chunk_ids
    c, m, d = corpus(spark, ((3, 5),), page=6)
    with pytest.raises(audit.AuditError, match="outside_ranges"):
        audit.gate(c, m, d, SMALL)


@pytest.mark.parametrize(
    "column, value, code",
    [
        ("title", "'x'", "title_mismatch"),
        ("source_url", "'x'", "url_mismatch"),
        ("source_sha256", "'x'", "hash_mismatch"),
        ("text", "' '", "empty_text"),
        ("estimated_tokens", '1', "stale_token_count"),
        ("pages", 'array(3, 3)', "pages_not_sorted_unique"),
        ("page_end", '4', "page_bounds_mismatch"),
        ("safety_tags", "array('odd')", "unknown_tags"),
        ("text", 'cast(null as string)', "missing_fields"),
        ("chunk_id", "'same'", "duplicate_chunk_id"),
    ],
)
def test_audit_codes(spark, column, value, code):
    c, m, d = corpus(spark)
    c = c.withColumn(column, F.expr(value))
    c = c.unionByName(c.withColumn("chunk_ordinal", F.col("chunk_ordinal") + 100)) if code == "duplicate_chunk_id" else c
    found = {e for r in audit.chunk_errors(c, m, d, SMALL).collect() for e in r.errors}
    assert code in found


def test_audit_counts_identical_rows_and_absent_columns(spark):
    c, m, d = corpus(spark)
    n = c.count()
    again = c.unionByName(c).unionByName(c)
    assert audit.duplicate_ids(again).count() == 2 * n and audit.duplicate_ids(c).count() == 0
    assert audit.chunk_errors(again, m, d, SMALL).where(F.array_contains("errors", "duplicate_chunk_id")).count() == 2 * n
    for column in ("title", "pages", "safety_tags", "publisher"):
        rows = audit.chunk_errors(c.drop(column), m, d, SMALL).collect()
        assert len(rows) == n and all(r.errors == ["missing_fields"] for r in rows)
    with pytest.raises(audit.AuditError):
        audit.chunk_errors(c.drop("source_id"), m, d, SMALL)


def test_audit_sources(spark):
    c, m, d = corpus(spark)
    assert audit.orphans(c, m.withColumn("source_id", F.lit("other"))).first().source_id == "s"
    missing = audit.missing_sources(c, m.withColumn("source_id", F.lit("other")), d).first()
    assert (missing.source_id, missing.no_chunks, missing.no_metadata) == ("other", True, True)


def write(tmp_path, documents):
    p = tmp_path / "sources.json"
    p.write_text(json.dumps({"manifest_version": 1, "documents": documents}))
    return str(p)


DOC = {"source_id": "a", "title": "T", "publisher": "P", "document_date": "2020", "version": "1", "license_status": "L", "status": "active", "include_page_ranges": [[1, 2], [4, 4]], "extra": 1}


def test_manifest(spark, tmp_path):
    m = manifest.load_manifest(spark, write(tmp_path, [DOC, DOC | {"source_id": "b"}])).orderBy("source_id").collect()
    assert [(r.start, r.end) for r in m[0].include_page_ranges] == [(1, 2), (4, 4)]


@pytest.mark.parametrize("documents", [[], [DOC, DOC], [{k: v for k, v in DOC.items() if k != "license_status"}], [DOC | {"status": "draft"}], [DOC | {"source_id": None}]])
def test_manifest_errors(spark, tmp_path, documents):
    with pytest.raises(manifest.ManifestError):
        manifest.load_manifest(spark, write(tmp_path, documents))


@pytest.mark.parametrize(
    "url, ok",
    [
        ("https://ncvbdc.mohfw.gov.in/x.pdf", True),
        ("https://NCVBDC.mohfw.gov.in:443/x.pdf", True),
        ("http://ncvbdc.mohfw.gov.in/x.pdf", False),
        ("https://example.com/x.pdf", False),
        ("https://ncvbdc.mohfw.gov.in.evil.com/x.pdf", False),
        ("https://user:pw@ncvbdc.mohfw.gov.in/x.pdf", False),
        ("https://ncvbdc.mohfw.gov.in:8443/x.pdf", False),
        (None, False),
    ],
)
def test_url_allowed(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(manifest.url_allowed(F.col("u")).alias("o")).first().o is ok


@pytest.mark.parametrize("name, ok", [("a.pdf", True), ("a.PDF", True), ("d/a.pdf", False), ("a.txt", False), (".pdf", False), (None, False)])
def test_filename_allowed(spark, name, ok):
    assert spark.createDataFrame([(name,)], "u string").select(manifest.filename_allowed(F.col("u")).alias("o")).first().o is ok


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"plain")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_binary(spark, f"{tmp_path}/*.pdf").collect()}
    assert got["a.pdf"].ok and not got["b.pdf"].ok
    meta = spark.createDataFrame([("a", got["a.pdf"].sha256.upper())], "source_id string, sha256 string")
    have = spark.createDataFrame([("a", got["a.pdf"].sha256), ("b", "x")], "source_id string, sha256 string")
    assert {(r.source_id, r.matches) for r in files.verify_checksums(have, meta).collect()} == {("a", True), ("b", False)}
    raw = files.read_pages(spark.createDataFrame([("a", b"p1\fp2 l")], "source_id string, content binary"), lambda b: [(p.split(" "), 0) for p in b.decode().split("\f")])
    assert [(r.page_number, r.lines) for r in raw.collect()] == [(1, ["p1"]), (2, ["p2", "l"])]


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "é", None, 0, "ok")], schemas.PAGE)
    files.write_jsonl(df, f"{tmp_path}/out")
    assert files.read_jsonl(spark, f"{tmp_path}/out", schemas.PAGE).collect() == df.collect()
    (tmp_path / "bad.jsonl").write_text('{"source_id": "s"}\n\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", schemas.PAGE).collect()
    assert json.loads(files.report_json(df))["character_count"] is None


def test_cases(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"dataset_version": 1, "cases": [{"case_id": "x", "query": "q", "expected_source_id": "s", "relevant_pages": [1, 2]}]}))
    assert files.read_cases(spark, str(p), schemas.EVAL_RETRIEVAL).first().relevant_pages == [1, 2]


def test_index_round_trip(spark, tmp_path):
    path = f"{tmp_path}/i"
    c = spark.createDataFrame([("c1", "s", ["a", "b", "a"]), ("c2", "t", ["b"])], "chunk_id string, source_id string, terms array<string>")
    with pytest.raises(FileNotFoundError):
        store.read_index(spark, path)
    assert store.write_index(store.Index(c), path) == {"chunk_count": 2, "mode": "lexical"}
    first = store.read_index(spark, path)
    assert first.chunks.count() == 2
    asked = spark.createDataFrame([(1, ["a"]), (2, ["b", "b"]), (3, ["z"])], "query_id int, terms array<string>")
    ranked = lambda x: sorted(map(tuple, lexical.bm25(x, asked).collect()))
    assert ranked(first.lexical) == ranked(c) != []
    assert "PartitionFilters: [isnotnull(shelf" in lexical.bm25(first.lexical, asked)._jdf.queryExecution().toString()
    with pytest.raises(store.BuildError):
        store.write_index(store.Index(c.union(c)), path)
    # A version that isn't complete doesn't count, and an older one stays readable while a newer one comes.
    os.makedirs(f"{path}/v99999999999999999999/chunks")
    assert store.read_index(spark, path).chunks.count() == 2
    store.write_index(store.Index(c.where("chunk_id = 'c1'"), analyser=analyze.analyze), path)
    assert store.read_index(spark, path).chunks.count() == 1 and first.chunks.count() == 2
    assert store.read_index(spark, path).analyser is analyze.analyze


@pytest.mark.parametrize("kind, change", [(config.Chunking, {"overlap_estimated_tokens": 200}), (config.Chunking, {"minimum_estimated_tokens": 0}), (config.Generation, {"temperature": 2}), (config.Generation, {"maximum_validation_attempts": 4}), (config.Retrieval, {"embedding": {"dimensions": 3}}), (config.Retrieval, {"reranking": {"enabled": False}}), (config.Retrieval, {"augmentation": {"correction_threshold": 0.1}}), (config.Retrieval, {"unknown": 1}), (config.Retrieval, {"search": {"final_results": 50}})])
def test_config_bounds(tmp_path, kind, change):
    p = tmp_path / "c.json"
    p.write_text("{}")
    config.load(kind, str(p))
    p.write_text(json.dumps(change))
    with pytest.raises(config.ConfigError):
        config.load(kind, str(p))


def test_stored_index_of_texts_has_few_files_and_a_terms_task_of_bounded_size(spark, tmp_path):
    """No terms column: the analyser's words of the texts; equal to terms that are given; files don't grow with shuffle partitions."""
    from evigrain.functions import analyze
    from evigrain.operators import lexical, scoring
    from evigrain.sources import store

    rows = [(f"c{i}", f"s{i % 2}", None if i == 5 else f"running word{i} the word{i % 7} The") for i in range(60)]
    d = spark.createDataFrame(rows, "chunk_id string, source_id string, text string")
    asked = spark.createDataFrame([(1, ["word3", "the"]), (2, ["run", "running"])], "query_id int, terms array<string>")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for made in (lexical.plain_terms, analyze.analyze):
            whole = d.withColumn("terms", made(F.coalesce("text", F.lit(""))))
            path = str(tmp_path / made.__name__)
            store.write_index(store.Index(d, analyser=made), path)
            got = store.read_index(spark, path)
            assert sum(1 for _ in (tmp_path / made.__name__).rglob("postings/*/part-*.parquet")) <= store.SHELVES
            assert {(r.n_docs, round(r.avgdl, 9)) for r in got.lexical.stats.collect()} == {(r.n_docs, round(r.avgdl, 9)) for r in lexical.corpus_stats(whole).collect()}
            want = sorted(map(tuple, lexical.ranked(lexical.bm25(whole, asked), "chunk_id", 3, 6).select("query_id", "chunk_id", "score", "rank").collect()))
            assert sorted(map(tuple, scoring.topk(got.lexical, asked, 3, decimals=6).select("query_id", "chunk_id", "score", "rank").collect())) == want != []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def odd_pages(rng, n):
    """Pages with gaps, equal numbers, skipped and blank ones, hard and soft headings, numbered paragraphs and sentences that make the packer drop units."""
    number, out = 0, []
    for _ in range(n):
        number += rng.choice([0, 1, 1, 1, 1, 1, 2, 5])
        lines = []
        for _ in range(rng.randrange(5)):
            kind = rng.randrange(16)
            words = " ".join(rng.choice(["alpha", "beta,", "Gamma", "(x)", "7"]) for _ in range(rng.choice([1, 4, 8, 25, 58])))
            lines.append({0: "Section  %d" % rng.randrange(3), 1: "SOME LOUD HEADING %d" % rng.randrange(3), 2: "", 3: "(a) " + words, 4: "Annexure 1", 5: words}.get(kind, words + rng.choice([".", ". Then more. ", "?", "!"])))
        out.append({"source_id": "s", "page_number": number, "text": rng.choice(["\n", "\r\n", "\u2028"]).join(lines) if rng.random() < 0.95 else None, "kept": rng.random() < 0.93})
    return out


def stitched(rows, span, conf):
    """What fold_pages does with ranges, without Spark."""
    ends = sorted({r["page_number"] for r in rows})[span - 1 :: span]
    ranged = [r | {"range": sum(e < r["page_number"] for e in ends)} for r in rows]
    names = [c.split()[0] for c in chunking.STORED.split(", ")]
    made = [dict(zip(names, r, strict=True)) for r in chunking._ranges(ranged, conf, False)]
    seams = [dict(zip(names, r, strict=True)) for r in chunking._stitch([r for r in made if r["kind"] == "seam"], conf, False)]
    patches = {r["range"]: r for r in seams if r["kind"] == "patch"}
    out = [r for r in seams if r["kind"] == "seam"]
    inner = [r for r in made if r["kind"] == "inner"]
    for r in inner:
        p = patches[r["range"]]
        r["dropped"] += p["dropped"] if r["seq"] == p["units"] - 1 else 0
        r["seq"] += p["seq"]
        r["sections"] = list(dict.fromkeys(x or p["sections"][0] for x in r["sections"]))
    return sorted((r["source_id"], r["seq"], r["page_start"], r["page_end"], r["pages"], r["sections"], r["text"], r["units"], r["dropped"]) for r in out + inner), len(inner)


def test_ranges_of_a_source_give_the_chunks_of_one_fold():
    inner = drops = merged = 0
    for seed in range(300):
        rng = random.Random(seed)
        rows = odd_pages(rng, rng.choice([1, 3, 30, 120]))
        conf = SMALL if seed % 3 else Chunking(1, 30, 60, 64, 10)
        want = list(chunking._fold(rows, conf, False))
        for span in (1, 4, 11, 40):
            got, n = stitched(rows, span, conf)
            assert got == want, (seed, span)
            inner += n
        drops += sum(r[-1] for r in want)
        merged += bool(want)
    assert inner > 1000 and drops > 50 and merged > 200


def test_large_source_is_dealt_by_ranges(spark):
    """A source over the span isn't one task: each range reads its pages, and one fold sees the seams only."""
    rng = random.Random(1)
    rows = [r | {"source_id": s} for s, n in (("big", 400), ("small", 20), (None, 150)) for r in odd_pages(rng, n)]
    for r in rows:
        r["text"] = None if r["text"] is None else f"Page {r['page_number']} {r['text']}"
    rows = list({(r["source_id"], r["page_number"]): r for r in rows}.values())
    pages = spark.createDataFrame([(r["source_id"], r["page_number"], r["text"], r["kept"]) for r in rows], "source_id string, page_number int, text string, kept boolean").repartition(5)
    want = sorted(map(repr, chunking._fold(rows, SMALL, False)))
    large = {s: len(ends) + 1 for s, ends in chunking.large_sources(pages, 40)}
    assert set(large) == {"big", None} and large["big"] >= 8 and large[None] >= 3
    got = chunking.fold_pages(pages, SMALL, span=40)
    assert got.columns == [c.split()[0] for c in chunking.FOLDED.split(", ")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert sorted(repr(tuple(r)) for r in chunking.fold_pages(pages, SMALL).collect()) == want
    tasks = chunking._ranges(({**r, "range": r["page_number"] // 100} for r in rows if r["source_id"] == "big"), SMALL, False)
    seams = sum(r[0] == "seam" for r in tasks)
    assert seams < 200
