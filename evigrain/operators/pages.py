"""Page cleaning: repeated headers and footers, page numbers, status, extraction report.

Nothing here explodes a whole page: only the first and last three lines of a page are
cut to lines and counted, and a page is cleaned where it lies, by one array expression
that looks lines up in its source's set of repeated lines (at most 30, as each stands
on a fifth of the pages): the sets go to the pages, so a large source is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analyze, fixed, text


def page_lines(pages: DataFrame, nfkc: bool = True) -> DataFrame:
    """``pages`` (source_id, page_number, text) with normalised ``lines``, the ``ends`` of them that may repeat, and whether the page is ``filled``; what isn't asked for isn't computed."""
    raw = F.coalesce(F.col("text"), F.lit(""))
    body = analyze.nfkc(raw) if nfkc else raw
    edge = fixed.BOUNDARY_LINES
    # Columns one by one: each is named more than once below, and must not be made anew each time.
    # NFKC makes no blank of another character, nor the other way: a page is filled before as it is after, and pages are counted without it.
    pages = pages.withColumns({"_body": body, "filled": raw.rlike(r"(?U)[^\s\x1c-\x1f\x00]")}).withColumn("_raw", text.split_lines(F.col("_body")))
    n = F.size("_raw")
    ends = F.concat(F.slice("_raw", 1, edge), F.slice(F.col("_raw"), F.greatest(n - (edge - 1), F.lit(1)), F.lit(edge)))
    pages = pages.withColumns({"lines": F.transform("_raw", text.normalize_line), "ends": F.transform(ends, text.normalize_line)})
    return pages.drop("_body", "_raw")


def repeated_lines(lined: DataFrame) -> DataFrame:
    """source_id, line, n_pages of boundary lines on at least max(3, a fifth) of the pages that aren't empty."""
    filled = lined.where("filled")
    own = F.array_distinct(F.transform("ends", text.canonical_line))
    own = F.filter(own, lambda x: (x != "") & ~text.is_page_number(x))
    counted = filled.select("source_id", F.explode(own).alias("line")).groupBy("source_id", "line").agg(F.count("*").alias("n_pages"))
    total = filled.groupBy("source_id").agg(F.count("*").alias("total"))
    least = F.greatest(F.lit(fixed.REPEATED_LEAST_PAGES), F.ceil(F.col("total") * F.lit(fixed.REPEATED_RATIO)))
    return counted.where(F.col("n_pages") >= fixed.REPEATED_LEAST_PAGES).join(total, "source_id").where(F.col("n_pages") >= least).select("source_id", "line", "n_pages")


def cleaned(lines: Column, repeated: Column) -> Column:
    """Kept lines of a page joined by newlines."""
    n = F.size(lines)
    at_edge = lambda i, k: (i < k) | (i >= n - k)
    kept = F.filter(
        lines,
        lambda x, i: (x != "")
        & ~(at_edge(i, fixed.BOUNDARY_LINES) & F.coalesce(F.array_contains(repeated, text.canonical_line(x)), F.lit(False)))
        & ~(at_edge(i, fixed.PAGE_NUMBER_EDGE_LINES) & text.is_page_number(x)),
    )
    return F.array_join(kept, "\n")


def page_status(chars: Column, images: Column) -> Column:
    few = chars < fixed.LOW_TEXT_CHARS
    return F.when(few & (images > 0), "image_review_required").when(chars == 0, "empty").when(few, "low_text").otherwise("ok")


def clean_pages(pages: DataFrame, nfkc: bool = True) -> DataFrame:
    """``pages`` (source_id, page_number, text, image_count) -> the page records."""
    lined = page_lines(pages, nfkc)
    sets = repeated_lines(lined).groupBy("source_id").agg(F.collect_list("line").alias("repeated"))
    joined = lined.join(F.broadcast(sets), "source_id", "left").withColumn("text", cleaned(F.col("lines"), F.col("repeated")))
    chars = F.length("text")
    return joined.select("source_id", "page_number", "text", chars.cast("int").alias("character_count"), F.col("image_count").cast("int").alias("image_count"), page_status(chars, F.col("image_count")).alias("extraction_status"))


def extraction_report(records: DataFrame) -> DataFrame:
    """Per source: page counts, page numbers by status, characters (over pages that have some)."""
    status, chars = F.col("extraction_status"), F.col("character_count")
    filled = F.when(chars > 0, chars)
    numbers = lambda s: F.sort_array(F.collect_list(F.when(status == s, F.col("page_number"))))
    return records.groupBy("source_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if(status != "empty").alias("pages_with_text"),
        numbers("empty").alias("empty_pages"),
        numbers("low_text").alias("low_text_pages"),
        numbers("image_review_required").alias("image_review_pages"),
        F.sum(chars.cast("long")).alias("total_characters"),
        F.coalesce(F.min(filled), F.lit(0)).alias("minimum_characters"),
        F.coalesce(F.median(filled), F.lit(0.0)).alias("median_characters"),
        F.coalesce(F.max(filled), F.lit(0)).alias("maximum_characters"),
    )


def line_sections(lines: DataFrame) -> DataFrame:
    """``lines`` (source_id, page_number, line_number, line): the heading in force at each line, carried forward over pages."""
    order = Window.partitionBy("source_id").orderBy("page_number", "line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stripped = text.strip(F.col("line"))
    heading = text.is_section_heading(F.col("line"))
    section = F.coalesce(F.last(F.when(heading, stripped), ignorenulls=True).over(order), F.lit(fixed.FIRST_SECTION))
    return lines.select("source_id", "page_number", "line_number", heading.alias("is_heading"), text.is_hard_heading(F.col("line")).alias("is_hard"), section.alias("section"))
