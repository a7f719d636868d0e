"""JSON lines, binary files and their checks, page extraction, and report output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import RAW_PAGE


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Spark's commit protocol makes the whole folder appear at once; nulls are written."""
    df.write.option("ignoreNullFields", False).json(path)


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ``cases`` of an evaluation file."""
    return spark.read.schema(f"cases array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline("cases"))


def report_json(report: DataFrame) -> str:
    """A one-row report as JSON, nulls included."""
    row = report.limit(1).select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("j")).first()
    return row["j"] if row else "{}"


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, size_bytes, sha256, ok, content: ``ok`` wants the magic bytes and at most the size limit. Spark's scan gives no row for a file without bytes."""
    files = spark.read.format("binaryFile").load(path)
    ok = (F.col("length") <= fixed.MAX_FILE_BYTES) & (F.substring("content", 1, 4) == F.lit(fixed.PDF_MAGIC).cast("binary"))
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(ok, F.lit(False)).alias("ok"), "content")


def verify_checksums(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """``files`` (source_id, sha256) against ``metadata`` (source_id, sha256): source_id, matches."""
    want = metadata.select("source_id", F.lower("sha256").alias("want"))
    return files.join(want, "source_id", "left").select("source_id", F.coalesce(F.col("sha256") == F.col("want"), F.lit(False)).alias("matches"))


def read_pages(files: DataFrame, extract: Callable[[bytes], list[tuple[list[str], int]]]) -> DataFrame:
    """Raw pages of ``files`` (source_id, content) by an injected extractor: bytes -> (lines, images) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, content in zip(b.column("source_id").to_pylist(), b.column("content"), strict=True):
                got = extract(content.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * len(got), pa.string()), pa.array(range(1, len(got) + 1), pa.int32()), pa.array([p[0] for p in got], pa.list_(pa.string())), pa.array([p[1] for p in got], pa.int32())],
                    ["source_id", "page_number", "lines", "image_count"],
                )

    return files.select("source_id", "content").mapInArrow(run, RAW_PAGE)
