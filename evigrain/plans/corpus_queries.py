"""Registered queries over page cleaning, chunking, audit and sources, each with DuckDB SQL where it has one.

``documents`` stand for pages: ``source`` is the source, ``doc_id`` the page number,
``doc_id % 3`` the declared number of images. The queries apply NFKC, which DuckDB
lacks: their SQL equals them on texts that NFKC leaves alone (all of the given ones);
a test holds other characters against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import fixed, text
from ..operators import audit, chunking, pages
from ..sources import manifest

WS = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("page_number"), "text", (F.col("doc_id") % 3).cast("int").alias("image_count"))


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_estimate(x: str) -> str:
    return rf"CAST(ceil(len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\t-\r\x1c-\x1f \x{{85}}\p{{Z}}]')) * 1.15::DOUBLE) AS INTEGER)"


#: lines(source_id, page_number, images, lines): every document's normalised lines.
SQL_LINES = rf"""
raw AS (SELECT source AS source_id, CAST(doc_id AS INTEGER) AS page_number, CAST(doc_id % 3 AS INTEGER) AS images,
  string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM documents),
lines AS (SELECT source_id, page_number, images, list_transform(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END,
  lambda x: {sql_strip(r"regexp_replace(translate(replace(x, chr(0), ''), '‐‑‒–—−', '------'), '[ \t]+', ' ', 'g')")}) AS lines FROM raw)"""

_CANON = rf"regexp_replace(x, '{WS}+\d{{1,4}}$', ' <PAGE_NUMBER>')"
SQL_REPEATED = rf"""{SQL_LINES},
filled AS (SELECT * FROM lines WHERE len(list_filter(lines, lambda x: x <> '')) > 0),
edges AS (SELECT source_id, unnest(list_distinct(list_filter(list_transform(list_concat(lines[1:3], lines[greatest(len(lines) - 2, 1):len(lines)]), lambda x: {_CANON}),
  lambda x: x <> '' AND NOT regexp_matches(x, '^\d{{1,4}}$')))) AS line FROM filled),
totals AS (SELECT source_id, count(*) AS total FROM filled GROUP BY 1),
repeated AS (SELECT e.source_id, e.line, count(*) AS n_pages FROM edges e JOIN totals t USING (source_id) GROUP BY e.source_id, e.line, t.total
  HAVING count(*) >= greatest(3, ceil(t.total * 0.2::DOUBLE)))"""
SQL_RECORDS = rf"""{SQL_REPEATED},
sets AS (SELECT source_id, list(line) AS repeated FROM repeated GROUP BY 1),
bodies AS (SELECT source_id, page_number, images, array_to_string(list_filter(lines, lambda x, i: x <> ''
  AND NOT ((i <= 3 OR i > len(lines) - 3) AND coalesce(list_contains(repeated, {_CANON}), false))
  AND NOT ((i <= 2 OR i > len(lines) - 2) AND regexp_matches(x, '^\d{{1,4}}$'))), chr(10)) AS text FROM lines LEFT JOIN sets USING (source_id)),
records AS (SELECT source_id, page_number, text, CAST(length(text) AS INTEGER) AS character_count, images AS image_count,
  CASE WHEN length(text) < 150 AND images > 0 THEN 'image_review_required' WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 150 THEN 'low_text' ELSE 'ok' END AS extraction_status FROM bodies)"""


@query(f"SELECT doc_id, {sql_estimate('text')} AS estimated_tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("estimated_tokens"))


@query(f"WITH {SQL_LINES} SELECT page_number, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line_number, unnest(lines) AS line FROM lines")
def line_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = pages.page_lines(doc_pages(spark, sf_dir))
    return lined.select("page_number", F.posexplode("lines").alias("i", "line")).select("page_number", (F.col("i") + 1).alias("line_number"), "line")


@query(f"WITH {SQL_REPEATED} SELECT source_id, line, n_pages FROM repeated")
def repeated_boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.repeated_lines(pages.page_lines(doc_pages(spark, sf_dir)))


@query(f"WITH {SQL_RECORDS} SELECT source_id, page_number, text, character_count FROM records")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.clean_pages(doc_pages(spark, sf_dir)).select("source_id", "page_number", "text", "character_count")


@query(f"WITH {SQL_RECORDS} SELECT source_id, page_number, image_count, extraction_status FROM records")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.clean_pages(doc_pages(spark, sf_dir)).select("source_id", "page_number", "image_count", "extraction_status")


def _numbers(status: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(page_number) FILTER (extraction_status = '{status}')), ','), '')"


@query(f"""WITH {SQL_RECORDS} SELECT source_id, count(*) AS total_pages, count(*) FILTER (extraction_status <> 'empty') AS pages_with_text,
{_numbers('empty')} AS empty_pages, {_numbers('low_text')} AS low_text_pages, {_numbers('image_review_required')} AS image_review_pages,
CAST(sum(character_count) AS BIGINT) AS total_characters, coalesce(min(character_count) FILTER (character_count > 0), 0) AS minimum_characters,
coalesce(median(character_count) FILTER (character_count > 0), 0.0)::DOUBLE AS median_characters, coalesce(max(character_count) FILTER (character_count > 0), 0) AS maximum_characters
FROM records GROUP BY source_id""")
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = pages.extraction_report(pages.clean_pages(doc_pages(spark, sf_dir)))
    joined = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("empty_pages", "low_text_pages", "image_review_pages")}
    return report.withColumns(joined)


_HEADING = rf"""(length(s) BETWEEN 3 AND 140 AND ({' OR '.join(f"starts_with(lower(s), '{p}')" for p in fixed.HEADING_PREFIXES)} OR regexp_matches(s, '^\d+(?:\.\d+)*{WS}*:{WS}+[^\t-\r\x1c-\x1f \x{{85}}\p{{Z}}]')
 OR (len(regexp_extract_all(s, '\p{{L}}')) >= 8 AND len(regexp_extract_all(s, '\p{{Lu}}'))::DOUBLE / len(regexp_extract_all(s, '\p{{L}}')) >= 0.85::DOUBLE)))"""


@query(rf"""WITH {SQL_LINES}, numbered AS (SELECT page_number, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line_number, unnest(lines) AS s FROM lines),
marked AS (SELECT page_number, line_number, s, {_HEADING} AS is_heading FROM numbered)
SELECT CAST(page_number AS BIGINT) AS doc_id, line_number, is_heading, {' OR '.join(f"starts_with(lower(s), '{p}')" for p in fixed.HARD_HEADING_PREFIXES)} AS is_hard,
coalesce(last_value(CASE WHEN is_heading THEN s END IGNORE NULLS) OVER (PARTITION BY page_number ORDER BY line_number), 'Document overview') AS section FROM marked""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a source of its own here, so no window is larger than one document."""
    lined = pages.page_lines(doc_pages(spark, sf_dir)).select(F.col("page_number").cast("long").alias("source_id"), F.lit(1).alias("page_number"), F.posexplode("lines").alias("i", "line"))
    out = pages.line_sections(lined.withColumn("line_number", F.col("i") + 1))
    return out.select(F.col("source_id").alias("doc_id"), "line_number", "is_heading", "is_hard", "section")


@query(rf"""WITH parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)),
lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS ordinal, unnest(p) AS sentence FROM parts""")
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    return d.select("doc_id", (F.col("i") + 1).alias("ordinal"), "sentence")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source of one page: the fold needs no shuffle."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.lit(1).alias("page_number"), "text", F.lit(True).alias("kept"))
    return chunking.finished(chunking.fold_pages(d, Chunking(), one_page=True))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir).select("chunk_id", "source_id", "chunk_ordinal", "page_start", "page_end", "estimated_tokens", F.array_join("sections", "|").alias("sections"), F.array_join("safety_tags", ",").alias("safety_tags"), "text", "units", "dropped")


@query()
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_report(document_chunks(spark, sf_dir)).withColumn("safety_tag_counts", F.to_json("safety_tag_counts"))


@query()
def chunk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources of many pages, with an excluded page and page ranges."""
    records = pages.clean_pages(doc_pages(spark, sf_dir))
    status = F.col("extraction_status").isin(*Chunking().skip_extraction_statuses)
    out = chunking.fold_pages(records.withColumn("kept", ~status & (F.col("page_number") % 97 != 0)), Chunking(), keys=doc_pages(spark, sf_dir))
    return chunking.finished(out).select("chunk_id", "source_id", "chunk_ordinal", "page_start", "page_end", "estimated_tokens", "text", "dropped")


TAG_CASES = ("Initial dosages include 5 mg in an emergency.", "Titration once daily.", "An urgent referral is life-threatening.", "Ordinary text.", "Take 2.5 ml", "5 grams")
_VALUES = ", ".join(f"({-i - 1}, '{x}')" for i, x in enumerate(TAG_CASES))
_TAGS = f"""array_to_string(list_filter([CASE WHEN regexp_matches(text, '{fixed.re2(fixed.DOSAGE_AMOUNT)}') OR regexp_matches(text, '{fixed.re2(fixed.DOSAGE_LANGUAGE)}') THEN 'dosage_content' END,
CASE WHEN regexp_matches(text, '{fixed.re2(fixed.EMERGENCY_LANGUAGE)}') THEN 'emergency_content' END], lambda x: x IS NOT NULL), ',')"""


@query(f"SELECT doc_id, {_TAGS} AS safety_tags FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES}) v(doc_id, text))")
def safety_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(-i - 1, x) for i, x in enumerate(TAG_CASES)], "doc_id long, text string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(cases)
    return d.select("doc_id", F.array_join(text.safety_tags(F.col("text")), ",").alias("safety_tags"))


@query("SELECT doc_id, source || printf(':p%04d-p%04d:', doc_id, doc_id + 1) || substr(sha256(concat_ws('|', source, doc_id, doc_id + 1, text)), 1, 16) AS chunk_id FROM documents")
def stable_chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.chunk_id(F.col("source"), F.col("doc_id"), F.col("doc_id") + 1, F.col("text")).alias("chunk_id"))


@query("""SELECT source AS source_id, doc_id, NOT list_contains([3, 5], doc_id) AND (source NOT LIKE '%1' OR doc_id BETWEEN 10 AND 500 OR doc_id BETWEEN 600 AND 700) AS kept FROM documents""")
def page_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that end in 1 have two page ranges, the others none; pages 3 and 5 are excluded everywhere."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    ranges = F.when(F.col("source").endswith("1"), F.expr("array(named_struct('start', 10, 'end', 500), named_struct('start', 600, 'end', 700))")).otherwise(none)
    kept = manifest.page_indexed(F.col("doc_id").cast("int"), F.array(F.lit(3), F.lit(5)), ranges)
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), "doc_id", kept.alias("kept"))


def audit_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A chunk corpus with known faults: equal texts share an id; titles, counts, urls, hashes and page lists of some documents are wrong; the manifest lacks sources that end in 7."""
    d = table(spark, sf_dir, "documents")
    page = (F.col("doc_id") % 7 + 1).cast("int")
    chunks = d.select(
        F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("chunk_id"), F.col("source").alias("source_id"), F.col("doc_id").cast("int").alias("chunk_ordinal"),
        F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("source")).alias("title"),
        F.concat(F.lit("https://"), F.when(F.col("doc_id") % 17 == 0, F.lit("x")).otherwise(F.col("source"))).alias("source_url"), F.sha2(F.when(F.col("doc_id") % 19 == 0, F.lit("x")).otherwise(F.col("source")), 256).alias("source_sha256"),
        page.alias("page_start"), (page + F.when(F.col("doc_id") % 29 == 0, 1).otherwise(0)).alias("page_end"), F.when(F.col("doc_id") % 23 == 0, F.array(page, page)).otherwise(F.array(page)).alias("pages"), F.array(F.lit("S")).alias("sections"), F.coalesce("text", F.lit("")).alias("text"),
        (text.estimate_tokens(F.coalesce("text", F.lit(""))) + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("estimated_tokens"), text.safety_tags(F.coalesce("text", F.lit(""))).alias("safety_tags"), F.lit("p").alias("publisher"),
    )
    sources = d.select(F.col("source").alias("source_id")).distinct().where(~F.col("source_id").endswith("7"))
    rules = sources.select("source_id", F.col("source_id").alias("title"), F.array(F.lit(2)).alias("exclude_pages_from_index"), F.expr("array(named_struct('start', 1, 'end', 5))").alias("include_page_ranges"))
    return chunks, rules, sources.select("source_id", F.concat(F.lit("https://"), F.col("source_id")).alias("final_url"), F.sha2("source_id", 256).alias("sha256"))


SQL_AUDIT = f"""chunks AS (SELECT substr(sha256(coalesce(text, '')), 1, 16) AS chunk_id, source AS source_id, doc_id, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE source END AS title,
 CAST(doc_id % 7 + 1 AS INTEGER) AS page, coalesce(text, '') AS text, {_TAGS.replace('text,', "coalesce(text, ''),")} AS tags FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY source_id, doc_id) AS rn, {sql_estimate(sql_strip('text'))} AS tokens, {sql_estimate('text')} AS raw_tokens, {sql_strip('text')} AS body FROM chunks),
checked AS (SELECT *, (rn > 1)::INT + (title <> source_id)::INT + (body = '')::INT + (raw_tokens + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END <> tokens)::INT + (tokens > 400)::INT + (doc_id % 17 = 0)::INT + (doc_id % 19 = 0)::INT + (doc_id % 23 = 0)::INT + (doc_id % 23 <> 0 AND doc_id % 29 = 0)::INT + (page = 2)::INT + (page > 5)::INT AS errors
 FROM ranked WHERE source_id NOT LIKE '%7')"""


@query(f"""WITH {SQL_AUDIT} SELECT source_id, count(*) AS chunks, count(DISTINCT chunk_id) AS unique_chunk_ids, count(*) FILTER (tokens < 200) AS below_soft_minimum, CAST(sum(errors) AS BIGINT) AS errors,
count(*) FILTER (tags LIKE '%dosage_content%') AS dosage_content, count(*) FILTER (tags LIKE '%emergency_content%') AS emergency_content FROM checked GROUP BY ROLLUP (source_id)""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_report(audit.chunk_errors(*audit_inputs(spark, sf_dir)))


@query(f"WITH {SQL_AUDIT} SELECT chunk_id, source_id, CAST(doc_id AS INTEGER) AS chunk_ordinal FROM ranked WHERE rn > 1")
def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_ids(audit_inputs(spark, sf_dir)[0]).select("chunk_id", "source_id", "chunk_ordinal")


@query("SELECT DISTINCT source AS source_id FROM documents WHERE source LIKE '%7'")
def audit_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, rules, _ = audit_inputs(spark, sf_dir)
    return audit.orphans(chunks, rules)


@query("""SELECT m.source_id, m.source_id NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) AS no_chunks, m.source_id NOT IN (SELECT role FROM conversations WHERE role IS NOT NULL) AS no_metadata
FROM (SELECT DISTINCT source AS source_id FROM documents UNION SELECT DISTINCT role FROM conversations UNION SELECT DISTINCT lang FROM documents) m
WHERE m.source_id IS NOT NULL AND NOT (m.source_id IN (SELECT source FROM documents WHERE source IS NOT NULL) AND m.source_id IN (SELECT role FROM conversations WHERE role IS NOT NULL))""")
def audit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources have chunks and no metadata, roles metadata and no chunks, languages neither."""
    d, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    chunks, known = d.select(F.col("source").alias("source_id")), turns.select(F.col("role").alias("source_id"))
    rules = chunks.union(known).union(d.select(F.col("lang").alias("source_id"))).where("source_id IS NOT NULL").distinct()
    return audit.missing_sources(chunks, rules, known)


@query("""WITH c AS (SELECT 'part' || (item_id % 3) AS source_id, item_id, text FROM benchmark WHERE length(text) > 0)
SELECT source_id, count(*) AS chunks, count(DISTINCT item_id) AS unique_chunk_ids, CAST(0 AS BIGINT) AS errors FROM c GROUP BY ROLLUP (source_id)""")
def audit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound corpus, items as chunks of three sources, passes the gate."""
    d = table(spark, sf_dir, "benchmark").where("length(text) > 0").withColumn("source_id", F.concat(F.lit("part"), (F.col("item_id") % 3).cast("string")))
    one = F.lit(1)
    chunks = d.select(
        F.col("item_id").cast("string").alias("chunk_id"), "source_id", F.col("item_id").cast("int").alias("chunk_ordinal"), F.col("source_id").alias("title"), F.lit("u").alias("source_url"), F.lit("s").alias("source_sha256"), one.alias("page_start"), one.alias("page_end"),
        F.array(one).alias("pages"), F.array(F.lit("S")).alias("sections"), "text", text.estimate_tokens(text.strip(F.col("text"))).alias("estimated_tokens"), text.safety_tags(F.col("text")).alias("safety_tags"), F.lit("p").alias("publisher"),
    )
    sources = d.select("source_id").distinct()
    rules = sources.select("source_id", F.col("source_id").alias("title"), F.array().cast("array<int>").alias("exclude_pages_from_index"), F.array().cast("array<struct<start:int,end:int>>").alias("include_page_ranges"))
    report = audit.gate(chunks, rules, sources.select("source_id", F.lit("u").alias("final_url"), F.lit("s").alias("sha256")))
    return report.select("source_id", "chunks", "unique_chunk_ids", "errors")


@query(r"""SELECT page_id, regexp_matches(url, '^(?i:https)://') AND list_contains(['therin.example.net', 'm.ththth.example.net', 'thther.example.org', 'ththre.example.com'], lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', '')))
AND NOT contains(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@') AS allowed FROM pages""")
def url_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", manifest.url_allowed(F.col("url"), ("therin.example.net", "m.ththth.example.net", "thther.example.org", "ththre.example.com")).alias("allowed"))


@query(r"SELECT page_id, regexp_matches(regexp_extract(url, '[^/]*$') || '.PDF', '(?i)^[^/\\]*[^/\\.][^/\\]*\.pdf$') AS allowed FROM pages")
def filename_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", manifest.filename_allowed(F.concat(F.regexp_extract("url", "[^/]*$", 0), F.lit(".PDF"))).alias("allowed"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS text FROM documents")
def shortened_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text"), 300).alias("text"))


@query(r"SELECT page_id, substr(regexp_replace(regexp_replace(url || ' AIzaK3y.x ' || url, 'https?://[^\t-\r\x1c-\x1f \x{85}\p{Z}]+', '[url-redacted]', 'g'), '(?:AIza|AQ\.)[0-9A-Za-z._-]+', '[key-redacted]', 'g'), 1, 800) AS message FROM pages")
def redacted_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.col("url"), F.lit(" AIzaK3y.x "), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.redacted_diagnostic(message).alias("message"))
