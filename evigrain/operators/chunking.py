"""Pages to section-aware chunks.

Chunking is a fold over a source's pages in order. Rows are dealt by source and
sorted inside each partition, and the fold runs over that stream: a task holds the
open paragraph and two chunks, never a whole source. What doesn't depend on order
(page filters before, ids, tags and report after) is native.

A source of more than ``SPAN`` pages is dealt by ranges of pages. Between a range's first
fresh start (a page gap or hard heading, where the fold's state is surely reset: ``Cuts``)
and its last but one, its chunks are made where it lies. The pages before and after, its
seams, are folded by source with the seams of its other ranges; this also gives each range
the number of chunks before it, the section it begins in and the dropped units of its last
chunk. Pages without any fresh start stay one fold, in one task.

Sources of one page each need no shuffle at all (``one_page=True``).

Odd cases: null text is an empty page, a null status is ``ok``; a single word over
the hard limit becomes a chunk of its own, counted in the report (``strict`` raises
instead); units that the packing rule discards unseen are counted as ``dropped``.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions import fixed, text
from ..sources.manifest import page_indexed
from ..sources.store import work_folder

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(fixed.SENTENCE_BOUNDARY)
_PARAGRAPH = re.compile(fixed.NUMBERED_PARAGRAPH, re.IGNORECASE)
_HEADING = re.compile(fixed.NUMBERED_HEADING)

FOLDED = "source_id string, chunk_ordinal int, page_start int, page_end int, pages array<int>, sections array<string>, text string, units int, dropped int"
#: A range's chunks (``inner``, seq: number among them), and its seams: parts of pages, with ``kept`` null where its chunks stand (units: how many, dropped: of the chunk before, sections: the last heading). Then what the seams give: chunks (seq: number in the source) and a ``patch`` for each range.
STORED = "kind string, source_id string, range int, seq int, page_start int, page_end int, pages array<int>, sections array<string>, text string, units int, dropped int, kept boolean"
SPAN = 2048  # pages a range, about
MOST_RANGES = 1024  # of a source; a larger one has larger ranges


class ChunkingError(ValueError):
    """A unit is over the hard limit."""


class Unit(NamedTuple):
    text: str
    first: int
    last: int
    section: str
    tokens: int
    opens: bool
    heading: bool = False


def estimate(lexical: int) -> int:
    return math.ceil(lexical * fixed.TOKEN_FACTOR)


def lexical(s: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(s))


def heading(line: str) -> bool:
    if not fixed.HEADING_MIN_CHARS <= len(line) <= fixed.HEADING_MAX_CHARS:
        return False
    if line.lower().startswith(fixed.HEADING_PREFIXES) or _HEADING.match(line):
        return True
    letters = sum(map(str.isalpha, line))
    # Capitals that aren't letters are few: most lines fail without a look at each character.
    if letters < fixed.HEADING_MIN_LETTERS or sum(map(str.isupper, line)) / letters < fixed.HEADING_UPPER_SHARE:
        return False
    return sum(c.isupper() for c in line if c.isalpha()) / letters >= fixed.HEADING_UPPER_SHARE


def hard(line: str) -> bool:
    return line.lower().startswith(fixed.HARD_HEADING_PREFIXES)


def fragments(sentence: str, most: int) -> Iterator[tuple[str, int]]:
    """Pieces of whole words of at most ``most`` estimated tokens. A text's tokens are those of its words, so counts just add up."""
    words, whole = sentence.split(), estimate(len(_TOKEN.findall(sentence)))
    if whole <= most:
        if words:
            yield " ".join(words), whole
        return
    held, n = [], 0
    for word in words:
        own = lexical(word)
        if held and estimate(n + own) > most:
            yield " ".join(held), estimate(n)
            held, n = [], 0
        held.append(word)
        n += own
    if held:
        yield " ".join(held), estimate(n)


class Reader:
    """Lines of one source, page after page, to units."""

    def __init__(self, most: int):
        self.most, self.section = most, fixed.FIRST_SECTION
        self.lines: list[str] = []
        self.chars = self.first = self.last = 0

    def close(self) -> Iterator[Unit]:
        parts = [s for x in _SENTENCE.split(" ".join(self.lines).strip()) if (s := x.strip())]
        self.lines, self.chars = [], 0
        for i, sentence in enumerate(parts):
            for j, (piece, tokens) in enumerate(fragments(sentence, self.most)):
                yield Unit(piece, self.first, self.last, self.section, tokens, i == 0 and j == 0)

    def page(self, number: int, body: str) -> Iterator[Unit]:
        for raw in body.splitlines():
            line = raw.strip()
            if not line:
                continue
            if heading(line):
                yield from self.close()
                self.section = line
                yield Unit(line, number, number, line, estimate(lexical(line)), True, True)
                continue
            if self.lines and _PARAGRAPH.match(line):
                yield from self.close()
            if not self.lines:
                self.first = number
            self.last = number
            self.lines.append(line)
            self.chars += len(line)
            if self.chars >= fixed.PARAGRAPH_FLUSH_CHARS and line[-1] in ".?!":
                yield from self.close()


class Packer:
    """Units to chunks; the chunk before the open one is held back, as a short tail may join it."""

    def __init__(self, config: Chunking, strict: bool, follows: bool = False):
        self.c, self.strict = config, strict
        self.follows, self.lead = follows, 0  # chunks of the source went before; units dropped before the first seal, which count for the last of them
        self.open: deque[Unit] = deque()
        self.fresh: deque[bool] = deque()  # not yet part of any closed chunk
        self.size = self.dropped = 0
        self.held: list[Unit] | None = None

    def _seal(self, overlap: int) -> Iterator[list[Unit]]:
        if self.held is not None:
            yield self.held
        elif self.follows:
            self.lead, self.dropped = self.dropped, 0
        self.held = list(self.open)
        keep = size = 0
        while overlap and keep < len(self.held) and size < overlap:
            keep += 1
            size += self.held[-keep].tokens
        self.open = deque(self.held[len(self.held) - keep :])
        self.fresh = deque([False] * keep)
        self.size = size

    def add(self, u: Unit) -> Iterator[list[Unit]]:
        c = self.c
        if self.open:
            enough = self.size >= c.minimum_estimated_tokens
            # Pages come in order, so the last unit ends on the last page.
            if u.first > self.open[-1].last + 1 or (u.heading and (enough or (hard(u.text) and any(not x.heading for x in self.open)))):
                yield from self._seal(0)
            elif enough and self.size + u.tokens > c.target_estimated_tokens:
                yield from self._seal(c.overlap_estimated_tokens)
        while self.open and self.size + u.tokens > c.maximum_estimated_tokens:
            self.size -= self.open.popleft().tokens
            self.dropped += self.fresh.popleft()
        if u.tokens > c.maximum_estimated_tokens and self.strict:
            raise ChunkingError("a text unit is over the hard token limit")
        self.open.append(u)
        self.fresh.append(True)
        self.size += u.tokens

    def finish(self) -> Iterator[list[Unit]]:
        tail = list(self.open)
        if tail and self.held is not None and self.size < self.c.minimum_estimated_tokens:
            shared = next((k for k in range(min(len(tail), len(self.held)), 0, -1) if self.held[-k:] == tail[:k]), 0)
            merged = self.held + tail[shared:]
            if sum(u.tokens for u in merged) <= self.c.maximum_estimated_tokens:
                self.held, tail = merged, []
        if self.held is not None:
            yield self.held
        if tail:
            yield tail


def rendered(units: list[Unit]) -> str:
    out: list[str] = []
    for u in units:
        if out:
            out.append("\n\n" if u.opens else " ")
        out.append(u.text)
    return "".join(out).strip()


class Folding:
    """One source's rows, or some that follow each other, to (number, units, dropped) of its chunks."""

    def __init__(self, config: Chunking, strict: bool, follows: bool = False):
        self.c, self.strict = config, strict
        self.reader, self.packer, self.ordinal = Reader(config.maximum_estimated_tokens), Packer(config, strict, follows), 0

    def _numbered(self, chunks: Iterable[list[Unit]]) -> Iterator[tuple[int, list[Unit], int]]:
        for units in chunks:
            yield self.ordinal, units, self.packer.dropped
            self.packer.dropped = 0
            self.ordinal += 1

    def add(self, number: int, body: str | None, kept: bool) -> Iterator[tuple[int, list[Unit], int]]:
        for u in self.reader.page(number, body or "") if kept else self.reader.close():
            yield from self._numbered(self.packer.add(u))

    def finish(self) -> Iterator[tuple[int, list[Unit], int]]:
        yield from self.add(0, None, False)
        yield from self._numbered(self.packer.finish())

    def part(self, later: int = 0) -> Iterator[tuple[int, list[Unit], int]]:
        """All chunks so far, as a fresh start comes next; ``later`` units are dropped before the next chunk is closed."""
        yield from self.add(0, None, False)
        if self.packer.open:
            yield from self._numbered(self.packer._seal(0))
        self.packer.dropped += later
        if self.packer.held is not None:
            yield from self._numbered([self.packer.held])

    def resume(self, chunks: int, section: str | None) -> None:
        """After a part that other rows' ``chunks`` follow."""
        self.ordinal += chunks
        self.reader.section = section or self.reader.section
        self.packer = Packer(self.c, self.strict, True)


def described(units: list[Unit]) -> tuple:
    pages = sorted({p for u in units for p in range(u.first, u.last + 1)})
    return min(u.first for u in units), max(u.last for u in units), pages, list(dict.fromkeys(u.section for u in units)), rendered(units), len(units)


def _fold(rows: Iterable[dict], config: Chunking, strict: bool) -> Iterator[tuple]:
    """Rows (source_id, page_number, text, kept) sorted by source and page -> chunk rows."""
    for source, own in groupby(rows, key=lambda r: r["source_id"]):
        fold = Folding(config, strict)
        for r in own:
            for ordinal, units, dropped in fold.add(r["page_number"], r["text"], r["kept"]):
                yield source, ordinal, *described(units), dropped
        for ordinal, units, dropped in fold.finish():
            yield source, ordinal, *described(units), dropped


def parts(body: str) -> Iterator[list[str]]:
    """A page's lines that aren't blank, parted before its hard headings."""
    lines = [s for raw in body.splitlines() if (s := raw.strip())]
    lower, start = body.lower(), 0
    if any(p in lower for p in fixed.HARD_HEADING_PREFIXES):
        for i, line in enumerate(lines):
            if i and hard(line) and heading(line):
                yield lines[start:i]
                start = i
    yield lines[start:]


def closes(lines: list[str]) -> bool:
    """Surely no paragraph is open after these lines, whatever went before: the last is a heading, or ends a sentence and has enough characters with those that surely are of its paragraph."""
    if heading(lines[-1]):
        return True
    if lines[-1][-1] not in ".?!":
        return False
    chars = 0
    for i in range(len(lines) - 1, -1, -1):
        chars += len(lines[i])
        if chars >= fixed.PARAGRAPH_FLUSH_CHARS:
            return True
        if not i or _PARAGRAPH.match(lines[i]) or heading(lines[i - 1]) or lines[i - 1][-1] in ".?!":
            return False
    return False


class Cuts:
    """Fresh starts among a source's parts of pages in order: the packer surely begins a chunk without overlap, and no paragraph is open.

    So it is where no paragraph goes on over a page gap (the last page with lines is known, and the last unit, which is in the open
    chunk, ends there), and at a hard heading after a line of text (which is in the open chunk). Neighbours alone tell it.
    """

    def __init__(self):
        self.last: str | None = None
        self.number, self.closed = 0, False

    def fresh(self, number: int, lines: list[str], kept: bool) -> bool:
        if not kept:
            self.closed = True
        if not kept or not lines:
            return False
        found = False
        if self.last is not None:
            title = heading(lines[0])
            gap = number > self.number + 1
            found = gap and bool(self.closed or title or _PARAGRAPH.match(lines[0])) or title and hard(lines[0]) and not heading(self.last)
        self.last, self.number, self.closed = lines[-1], number, closes(lines)
        return found


def _range(rows: Iterable[dict], config: Chunking, strict: bool) -> Iterator[tuple]:
    """Sorted rows of one range -> its chunks and seams, as (kind, seq, ..., kept) of ``STORED``."""
    cuts, fold, n = Cuts(), Folding(config, strict, True), 0
    fold.reader.section = None  # that in which the range begins, not known here
    late: deque[list[tuple]] = deque()  # stretches from fresh start to fresh start; the last two stay seams, so that a short tail of the source finds the chunk that it may join
    for r in rows:
        kept = bool(r["kept"])
        for lines in parts(r["text"] or "") if kept else [[]]:
            if cuts.fresh(r["page_number"], lines, kept):
                late.append([])
                if len(late) == 3:
                    for earlier in late.popleft():
                        for ordinal, units, dropped in fold.add(*earlier):
                            yield "inner", ordinal, *described(units), dropped, None
            piece = r["page_number"], "\n".join(lines), kept
            if late:
                late[-1].append(piece)
            else:
                yield "seam", n, piece[0], None, None, None, piece[1], None, None, piece[2]
                n += 1
    for ordinal, units, dropped in fold.part():
        yield "inner", ordinal, *described(units), dropped, None
    if fold.ordinal:
        yield "seam", n, None, None, None, [fold.reader.section], None, fold.ordinal, fold.packer.lead, None
        n += 1
    for stretch in late:
        for number, body, kept in stretch:
            yield "seam", n, number, None, None, None, body, None, None, kept
            n += 1


def _ranges(rows: Iterable[dict], config: Chunking, strict: bool) -> Iterator[tuple]:
    """Rows sorted by source, range and page -> rows of ``STORED``; a source whose range is null is whole."""
    for (source, number), own in groupby(rows, key=lambda r: (r["source_id"], r["range"])):
        if number is None:
            for _, ordinal, *chunk in _fold(own, config, strict):
                yield "inner", source, None, ordinal, *chunk, None
        else:
            for kind, *rest in _range(own, config, strict):
                yield kind, source, number, *rest


def _stitch(rows: Iterable[dict], config: Chunking, strict: bool) -> Iterator[tuple]:
    """Seams sorted by source, range and seq -> their chunks, and a patch for the chunks of each range."""
    for source, own in groupby(rows, key=lambda r: r["source_id"]):
        fold, patch = Folding(config, strict), None

        def patched() -> Iterator[tuple]:
            if patch is not None:
                number, start, section, n = patch
                yield "patch", source, number, start, None, None, None, [section], None, n, fold.packer.lead, None

        for r in own:
            inner = r["kept"] is None
            for ordinal, units, dropped in fold.part(r["dropped"]) if inner else fold.add(r["page_start"], r["text"], r["kept"]):
                yield "seam", source, None, ordinal, *described(units), dropped, None
            if inner:
                yield from patched()
                patch = r["range"], fold.ordinal, fold.reader.section, r["units"]
                fold.resume(r["units"], r["sections"][0])
        for ordinal, units, dropped in fold.finish():
            yield "seam", source, None, ordinal, *described(units), dropped, None
        yield from patched()


def _rows_to_rows(df: DataFrame, made: Callable[[Iterator[dict]], Iterator[tuple]], kinds: str) -> DataFrame:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in kinds.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(0, b.num_rows, 64) for r in b.slice(i, 64).to_pylist())
        held: list[tuple] = []
        for row in made(rows):
            held.append(row)
            if len(held) == 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return df.mapInArrow(run, kinds)


def large_sources(keys: DataFrame, span: int) -> list[tuple]:
    """(source_id, page numbers that end its ranges but the last) of sources of more than ``span`` pages: a number for each range of the input."""
    shares = F.array(*[F.lit(i / MOST_RANGES) for i in range(1, MOST_RANGES)])
    found = keys.groupBy("source_id").agg(F.count("*").alias("n"), F.percentile_approx("page_number", shares).alias("at")).where((F.col("n") > span) & F.col("at").isNotNull())
    n = F.least(F.ceil(F.col("n") / span), F.lit(MOST_RANGES)).cast("int")
    ends = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.element_at("at", F.floor(i * MOST_RANGES / n).cast("int")))
    return [(r["source_id"], r["ends"]) for r in found.select("source_id", F.array_distinct(ends).alias("ends")).collect()]


def fold_pages(pages: DataFrame, config: Chunking, strict: bool = False, one_page: bool = False, keys: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """``pages`` (source_id, page_number, text, kept) -> the columns of ``FOLDED``. ``keys`` are their source_id and page_number where these can be had more cheaply; more rows than in ``pages`` don't matter."""
    config.validate()

    whole = lambda rows: _fold(rows, config, strict)
    by_key = F.col("source_id").cast("string").alias("source_id"), F.col("page_number").cast("int").alias("page_number")
    rows = pages.select(*by_key, "text", "kept")
    if one_page:
        return _rows_to_rows(rows, whole, FOLDED)
    large = large_sources((pages if keys is None else keys).select(*by_key), span)
    if not large:
        return _rows_to_rows(rows.repartition("source_id").sortWithinPartitions("source_id", "page_number"), whole, FOLDED)
    spark = pages.sparkSession
    ends = spark.createDataFrame(large, "large string, ends array<int>")
    number = F.when(F.col("ends").isNotNull(), F.size(F.filter("ends", lambda e: e < F.col("page_number"))))
    dealt = rows.join(F.broadcast(ends), F.col("source_id").eqNullSafe(F.col("large")), "left").select(*rows.columns, number.alias("range"))
    dealt = dealt.repartition("source_id", "range").sortWithinPartitions("source_id", "range", "page_number")

    def stored(df: DataFrame) -> DataFrame:
        path = work_folder(spark)
        df.write.partitionBy("kind").parquet(path)
        return spark.read.schema(STORED).parquet(path)

    made = stored(_rows_to_rows(dealt, lambda rows: _ranges(rows, config, strict), STORED))
    seams = made.where("kind = 'seam'").repartition("source_id").sortWithinPartitions("source_id", "range", "seq")
    seams = stored(_rows_to_rows(seams, lambda rows: _stitch(rows, config, strict), STORED))
    patches = seams.where("kind = 'patch'").select(F.col("source_id").alias("_source"), F.col("range").alias("_range"), F.col("seq").alias("_start"), F.col("sections")[0].alias("_section"), F.col("units").alias("_n"), F.col("dropped").alias("_dropped"))
    inner = made.where("kind = 'inner'").join(F.broadcast(patches), F.col("source_id").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")), "left")
    last = F.when(F.col("seq") == F.col("_n") - 1, F.col("_dropped"))
    inner = inner.withColumns({"seq": F.col("seq") + F.coalesce("_start", F.lit(0)), "dropped": F.col("dropped") + F.coalesce(last, F.lit(0)), "sections": F.array_distinct(F.transform("sections", lambda s: F.coalesce(s, F.col("_section"))))})
    columns = ["source_id", F.col("seq").alias("chunk_ordinal"), "page_start", "page_end", "pages", "sections", "text", "units", "dropped"]
    return inner.select(*columns).unionByName(seams.where("kind = 'seam'").select(*columns))


def build_chunks(pages: DataFrame, manifest: DataFrame, metadata: DataFrame, config: Chunking | None = None, strict: bool = False) -> DataFrame:
    """Page records, manifest and source metadata -> chunk records (schemas.CHUNK, plus chunk_ordinal, dropped)."""
    config = config or Chunking()
    rules = manifest.select("source_id", "exclude_pages_from_index", "include_page_ranges")
    status = F.coalesce(F.col("extraction_status"), F.lit("ok"))
    kept = page_indexed(F.col("page_number"), F.col("exclude_pages_from_index"), F.col("include_page_ranges")) & ~status.isin(*config.skip_extraction_statuses)
    folded = fold_pages(pages.join(rules, "source_id").withColumn("kept", kept), config, strict, keys=pages)
    about = manifest.select("source_id", "title", "publisher", "category", "document_date", "language").join(metadata.select("source_id", F.col("final_url").alias("source_url"), F.col("sha256").alias("source_sha256")), "source_id", "left")
    return finished(folded.join(about, "source_id"))


def finished(folded: DataFrame) -> DataFrame:
    """Adds what native expressions derive: id, estimated tokens, safety tags."""
    body = F.col("text")
    return folded.withColumns({"estimated_tokens": text.estimate_tokens(body), "safety_tags": text.safety_tags(body), "chunk_id": text.chunk_id(F.col("source_id"), F.col("page_start"), F.col("page_end"), body)})


def chunk_report(chunks: DataFrame, config: Chunking | None = None) -> DataFrame:
    """Per source: count, token minimum, median and maximum, chunks beyond the limits, tag counts, dropped units."""
    config = config or Chunking()
    t = F.col("estimated_tokens")
    tagged = lambda tag: F.count_if(F.array_contains("safety_tags", tag))
    return chunks.groupBy("source_id").agg(
        F.count("*").alias("chunks"),
        F.min(t).alias("minimum_tokens"),
        F.median(t).alias("median_tokens"),
        F.max(t).alias("maximum_tokens"),
        F.count_if(t < config.minimum_estimated_tokens).alias("below_minimum"),
        F.count_if(t > config.maximum_estimated_tokens).alias("above_maximum"),
        F.create_map(*[x for tag in fixed.SAFETY_TAGS for x in (F.lit(tag), tagged(tag))]).alias("safety_tag_counts"),
        F.sum("dropped").alias("dropped_units"),
    )
