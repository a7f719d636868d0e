"""The manifest of source documents and the predicates on its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..schemas import MANIFEST_DOCUMENT


class ManifestError(ValueError):
    """The manifest is empty, ambiguous or incomplete."""


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a document; page ranges as structs(start, end). Raises when a rule is broken."""
    rows = spark.read.schema(f"documents array<struct<{MANIFEST_DOCUMENT}>>").option("multiLine", True).json(path).select(F.inline("documents"))
    return checked(rows).withColumn("include_page_ranges", F.transform(F.coalesce("include_page_ranges", F.array()), lambda r: F.struct(r[0].alias("start"), r[1].alias("end"))))


def checked(rows: DataFrame) -> DataFrame:
    missing = lambda c: F.col(c).isNull() if c in rows.columns else F.lit(True)
    tests = [F.count_if(missing(c)).alias(c) for c in fixed.MANIFEST_REQUIRED]
    got = rows.agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("ids"), F.count_if(~F.col("status").eqNullSafe("active")).alias("inactive"), *tests).first()
    if not got["n"]:
        raise ManifestError("the manifest has no documents")
    if got["ids"] != got["n"]:
        raise ManifestError("every document needs a source_id of its own")
    lacking = [c for c in fixed.MANIFEST_REQUIRED if got[c]]
    if lacking:
        raise ManifestError(f"documents lack {', '.join(lacking)}")
    if got["inactive"]:
        raise ManifestError("a document is not active")
    return rows


def url_allowed(url: Column, hosts: tuple[str, ...] = fixed.ALLOWED_HOSTS) -> Column:
    """https, an exact host of the list, no credentials, standard port."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":[0-9]*$", ""))
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    ok = url.rlike(r"^(?i:https)://") & host.isin(*hosts) & ~F.contains(authority, F.lit("@")) & port.isin("", "443")
    return F.coalesce(ok, F.lit(False))


def filename_allowed(name: Column) -> Column:
    """A plain file name that ends in .pdf."""
    return F.coalesce(name.rlike(r"(?i)^[^/\\]*[^/\\.][^/\\]*\.pdf$"), F.lit(False))


def page_indexed(page: Column, excluded: Column, ranges: Column) -> Column:
    """Neither excluded, nor outside the ranges where there are any; an inverted range is an error."""
    bad = F.exists(ranges, lambda r: (r["start"] > r["end"]) | (r["start"] < 1))
    inside = (F.size(ranges) < 1) | F.exists(ranges, lambda r: page.between(r["start"], r["end"]))
    kept = ~F.array_contains(F.coalesce(excluded, F.array().cast("array<int>")), page) & (ranges.isNull() | inside)
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("invalid page range")).cast("boolean")).otherwise(kept)
