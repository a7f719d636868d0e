"""String expressions: normalisation, token estimates, headings, sentences, tags, ids, overlap.

All are native Columns. Python's Unicode white space is Java's ``(?U)\\s`` and the
separators U+001C to U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"[\s\x1c-\x1f]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def any_prefix(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(F.lower(c), F.lit(p))
    return out


def split_lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end starts no further line."""
    lines = F.split(c, LINE_END)
    last = F.element_at(lines, -1) == ""
    return F.when(last, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def normalize_line(c: Column) -> Column:
    """Hyphens unified, NUL dropped, blanks and tabs collapsed. NFKC, which Spark lacks, comes before (``analyze.nfkc``)."""
    c = F.translate(c, fixed.HYPHENS + "\0", "-" * len(fixed.HYPHENS))
    return strip(F.regexp_replace(c, "[ \t]+", " "))


def canonical_line(c: Column) -> Column:
    """A normalised line with a trailing page number made anonymous."""
    return F.regexp_replace(c, rf"(?U){SPACE}+\d{{1,4}}$", fixed.PAGE_NUMBER_MARK)


def is_page_number(c: Column) -> Column:
    return c.rlike(r"(?U)^\d{1,4}$")


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?U)[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x1c-\x1f]"))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(token_count(c) * F.lit(fixed.TOKEN_FACTOR)).cast("int")


def is_section_heading(c: Column) -> Column:
    s = strip(c)
    n = F.length(s)
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    upper = F.regexp_count(s, F.lit(r"\p{Lu}"))
    shouted = (letters >= fixed.HEADING_MIN_LETTERS) & (upper / letters >= F.lit(fixed.HEADING_UPPER_SHARE))
    return n.between(fixed.HEADING_MIN_CHARS, fixed.HEADING_MAX_CHARS) & (any_prefix(s, fixed.HEADING_PREFIXES) | s.rlike("(?U)" + fixed.NUMBERED_HEADING) | F.coalesce(shouted, F.lit(False)))


def is_hard_heading(c: Column) -> Column:
    return any_prefix(strip(c), fixed.HARD_HEADING_PREFIXES)


def sentences(c: Column) -> Column:
    """Non-empty sentences of a paragraph, in order."""
    parts = F.transform(F.split(c, "(?U)" + fixed.SENTENCE_BOUNDARY), strip)
    return F.filter(parts, lambda s: s != "")


def safety_tags(c: Column) -> Column:
    dosage = c.rlike(fixed.java(fixed.DOSAGE_AMOUNT)) | c.rlike(fixed.java(fixed.DOSAGE_LANGUAGE))
    urgent = c.rlike(fixed.java(fixed.EMERGENCY_LANGUAGE))
    return F.array_compact(F.array(F.when(dosage, fixed.SAFETY_TAGS[0]), F.when(urgent, fixed.SAFETY_TAGS[1])))


def chunk_id(source_id: Column, start: Column, end: Column, text: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", source_id, start.cast("string"), end.cast("string"), text), 256)
    return F.concat(source_id, F.format_string(":p%04d-p%04d:", start, end), F.substring(digest, 1, 16))


def content_tokens(c: Column) -> Column:
    """Distinct lower-cased ASCII words of three letters or more that aren't stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))
    stop = F.array(*map(F.lit, fixed.CLAIM_STOPWORDS))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= fixed.CLAIM_MIN_TOKEN) & ~F.array_contains(stop, t)))


def claim_overlap(claim: Column, evidence: Column) -> Column:
    """Share of the claim's content words that the evidence has; 0 without any."""
    own = content_tokens(claim)
    shared = F.size(F.array_intersect(own, content_tokens(evidence)))
    return F.when(F.size(own) > 0, shared / F.size(own)).otherwise(F.lit(0.0))


def shortened(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def redacted_diagnostic(c: Column, most: int = 800) -> Column:
    """URLs and key-like strings hidden, then cut."""
    c = F.regexp_replace(c, r"(?U)https?://[^\s\x1c-\x1f]+", fixed.URL_MARK)
    return F.substring(F.regexp_replace(c, fixed.KEY_PATTERN, fixed.KEY_MARK), 1, most)
