"""Explicit schemas as DDL; nothing is inferred."""

PAGE = "source_id string, page_number int, text string, character_count int, image_count int, extraction_status string"
RAW_PAGE = "source_id string, page_number int, lines array<string>, image_count int"
MANIFEST_DOCUMENT = (
    "source_id string, title string, category string, publisher string, document_date string, version string, status string, "
    "license_status string, language string, pdf_url string, filename string, source_page string, "
    "exclude_pages_from_index array<int>, include_page_ranges array<array<int>>"
)
SOURCE_METADATA = (
    "source_id string, title string, publisher string, category string, document_date string, language string, source_page string, "
    "original_url string, final_url string, retrieved_at timestamp, content_type string, size_bytes bigint, sha256 string, etag string, last_modified string"
)
UNIT = "source_id string, unit_ordinal int, text string, page_start int, page_end int, section string, estimated_tokens int, break_before boolean, is_heading boolean"
CHUNK = (
    "chunk_id string, source_id string, title string, publisher string, category string, document_date string, language string, source_url string, source_sha256 string, "
    "page_start int, page_end int, pages array<int>, sections array<string>, text string, estimated_tokens int, safety_tags array<string>"
)
EMBEDDING_CACHE = "model string, dimensions int, chunk_id string, source_sha256 string, vector array<float>"
PAYLOAD = "status string, claims array<struct<text:string,chunk_ids:array<string>>>"
EVIDENCE = "query_id string, chunk_id string, source_id string, title string, source_url string, pages array<int>, text string, rerank_score double"
EVAL_RETRIEVAL = "case_id string, query string, expected_source_id string, relevant_pages array<int>"
EVAL_SAFETY = "case_id string, query string, expected_category string"
EVAL_CONFIDENCE = "case_id string, query string, expected_accept boolean"
EVAL_GROUNDING = "case_id string, claim string, evidence string, chunk_ids array<string>, support_score double, expected_valid boolean"
EVAL_OUTPUT = "case_id string, text string, expected_category string"
