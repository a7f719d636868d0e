"""Registered queries over the sources and sinks: each writes a table in a source's format and reads it back, or checks files, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..schemas import MANIFEST_DOCUMENT
from ..sources import files, manifest
from ..sources.store import Index, read_index, work_folder, write_index
from .corpus_queries import table
from .retrieval_queries import SQL_BM25, doc_texts, item_terms

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT doc_id, quality, toxic FROM labels")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as JSON lines and back, by the labels' schema."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    path = f"{work_folder(spark)}/labels.jsonl"
    files.write_jsonl(labels, path)
    return files.read_jsonl(spark, path, ", ".join(f"{c} {t}" for c, t in labels.dtypes))


@query("SELECT CAST(page_id AS VARCHAR) AS source_id, html IS NOT NULL AND NOT ends_with(url, '1') AS matches FROM pages")
def checksum_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file; its metadata hold the digest in upper case, or, where the url ends in 1, that of the url."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    wrong = F.sha2(F.col("url").cast("binary"), 256)
    metadata = p.select("source_id", F.upper(F.when(F.endswith("url", F.lit("1")), wrong).otherwise(F.col("sha256"))).alias("sha256"))
    return files.verify_checksums(p.select("source_id", "sha256"), metadata)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS source_id, n_name AS title, CAST(n_regionkey AS VARCHAR) AS category, CAST(n_regionkey + 1 AS INTEGER) AS excluded_page,
CAST(n_nationkey + 1 AS INTEGER) AS range_start, CAST(n_nationkey + 9 AS INTEGER) AS range_end FROM nation""")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the documents of one manifest file, checked and read; a manifest is small by its kind."""
    key, zone = F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int")
    known = {"source_id": key.cast("string"), "title": F.col("n_name"), "category": zone.cast("string"), "status": F.lit("active"), "exclude_pages_from_index": F.array(zone + 1), "include_page_ranges": F.array(F.array(key + 1, key + 9))}
    names = [f.strip().split(" ")[0] for f in MANIFEST_DOCUMENT.split(",")]
    row = F.struct(*[known.get(n, F.lit("x")).alias(n) for n in names])
    path = f"{work_folder(spark)}/manifest"
    table(spark, sf_dir, "nation").agg(F.collect_list(row).alias("documents")).write.json(path)
    span = F.col("include_page_ranges")[0]
    return manifest.load_manifest(spark, path).select("source_id", "title", "category", F.col("exclude_pages_from_index")[0].alias("excluded_page"), span["start"].alias("range_start"), span["end"].alias("range_end"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS case_id, n_name AS query, n_regionkey = 1 AS expected_accept FROM nation")
def eval_cases_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the cases of one evaluation file."""
    row = F.struct(F.col("n_nationkey").cast("string").alias("case_id"), F.col("n_name").alias("query"), (F.col("n_regionkey") == 1).alias("expected_accept"))
    path = f"{work_folder(spark)}/cases"
    table(spark, sf_dir, "nation").agg(F.collect_list(row).alias("cases")).write.json(path)
    return files.read_cases(spark, path, "case_id string, query string, expected_accept boolean")


@query(f"WITH {SQL_BM25} SELECT term, df FROM df")
def stored_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' index, written as a version, and the terms that the newest version holds."""
    chunks = doc_texts(spark, sf_dir).withColumn("chunk_id", F.col("doc_id").cast("string"))
    path = f"{work_folder(spark)}/index"
    write_index(Index(chunks), path)
    return read_index(spark, path).lexical.terms.select("term", "df")


@query(f"""WITH {SQL_BM25} SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, score,
row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM scored) WHERE rank <= 20""")
def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items against the stored postings, read by the terms they ask for."""
    path = f"{work_folder(spark)}/index"
    write_index(Index(doc_texts(spark, sf_dir).withColumn("chunk_id", F.col("doc_id").cast("string"))), path)
    return scoring.topk(read_index(spark, path).lexical, item_terms(spark, sf_dir), 20, decimals=6).select("query_id", "chunk_id", "score", "rank")
