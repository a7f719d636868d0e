"""Sources and sinks: round trips, nulls, empty tables, and the registered queries on a small folder."""

import hashlib

import pytest

from evigrain.plans import source_queries
from evigrain.sources import files, manifest, store

PAGES = "page_id bigint, url string, html string"


def test_work_folders_are_new_and_beside_the_checkpoints(spark):
    a, b = store.work_folder(spark), store.work_folder(spark)
    assert a != b and a.startswith(spark.sparkContext.getCheckpointDir())


def test_json_lines_keep_nulls_and_empty_tables(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "a\n\"b\" é"), (3, "a\n\"b\" é")]
    for i, want in enumerate((rows, [])):
        files.write_jsonl(spark.createDataFrame(want, "k int, v string"), f"{tmp_path}/{i}")
        got = files.read_jsonl(spark, f"{tmp_path}/{i}", "k int, v string")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_a_line_that_is_no_json_stops_the_job(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"k": 1}\n\n{"k": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path), "k int").collect()


def test_checksums_of_absent_or_null_entries_do_not_match(spark):
    have = spark.createDataFrame([("a", "0f"), ("b", "0f"), ("c", None), ("d", "0f")], "source_id string, sha256 string")
    want = spark.createDataFrame([("a", "0F"), ("b", "1f"), ("c", "0f")], "source_id string, sha256 string")
    assert dict(files.verify_checksums(have, want).collect()) == {"a": True, "b": False, "c": False, "d": False}


def test_checksum_query_of_small_pages(spark, tmp_path):
    rows = [(1, "u1", "x"), (2, "u2", "x"), (3, "u3", None), (4, "u4", "")]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = dict(source_queries.QUERIES["checksum_matches"](spark, str(tmp_path)).collect())
    assert got == {"1": False, "2": True, "3": False, "4": True}


def test_binary_files_are_hashed_and_checked(spark, tmp_path):
    """A file without bytes has no row: Spark's scan skips it."""
    bodies = {"a.pdf": b"%PDF-1", "b.pdf": b"<html>", "c.pdf": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.ok) for r in files.read_binary(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha256(b).hexdigest(), b.startswith(b"%PDF")) for n, b in bodies.items() if b}


def test_manifest_rules(spark, tmp_path):
    for name, text in {"none": '{"documents": []}', "lacking": '{"documents": [{"source_id": "a", "status": "active"}]}'}.items():
        (tmp_path / name).write_text(text)
        with pytest.raises(manifest.ManifestError):
            manifest.load_manifest(spark, str(tmp_path / name))


def test_stored_search_equals_search_of_the_texts(spark, tmp_path):
    from evigrain.plans import retrieval_queries

    docs = [(i, t, "en", s, len(t or "")) for i, (t, s) in enumerate([("red fox red", "s1"), ("blue fox", "s2"), (None, "s1"), ("", "s2"), ("red fox red", "s1")])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red blue"), (2, "absent"), (3, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stored = {(r.query_id, int(r.chunk_id), r.score, r.rank) for r in source_queries.QUERIES["stored_index_search"](spark, str(tmp_path)).collect()}
    plain = {(r.query_id, r.doc_id, r.score, r.rank) for r in retrieval_queries.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    assert stored == plain and len(stored) == 3
