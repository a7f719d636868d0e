"""WARC archives: written natively, split anywhere, verified by their record chain.

Writing: a record is one row of Spark's text writer with CR LF CR LF as line
separator, so files are plain WARC on any file system Spark knows.

Reading: the text reader cuts files at the magic ``WARC/1.1 CR LF`` and large files
into splits. Each task measures its split, parses a header behind every magic and
emits a candidate (offset, successor); payloads may hold the magic too. Offsets
become absolute with the sizes of the splits before. Inside a split a candidate's
chain is followed to where it leaves the split; over splits the chain from offset 0
follows by pointer jumping (doubling) on those exits. Only candidates on the chain
from the file's start are records; a chain that doesn't end at the file's size is an
error. Headers may have any length. A payload's digest is made again from its bytes
where a record lies in one split and follows another one there (or comes first); a
record that splits cut in two is taken by its header's digest.

Odd cases: null html is the empty payload and still a record; a null url has no
target header; null page ids are written as ``null`` and read back so; pages with
the same id are written each; a very long payload may span splits; an empty table
gives no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, trim

MAGIC = b"WARC/1.1\r\n"
FILE_RECORDS = 20_000
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record without its closing CR LF CR LF."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    name = "null" if page_id is None else page_id
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""])
    return MAGIC + head.encode() + block


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record a page. Of equal payloads of at least ``least`` bytes the largest page_id is the response; smaller payloads always are."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    names = stored(rows.select("page_id", "sha", F.octet_length("html").alias("n")))
    # Only payloads that occur again travel; most pages join an empty row of this table.
    again = stored(names.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("c")).where("c > 1").select("sha", "winner"))
    repeats = stored(names.select("page_id", "sha").join(again, "sha").where("page_id <> winner").select("page_id", "sha", "winner").distinct())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for page_id, url, html, winner in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "winner")), strict=True):
                    payload = html.encode()
                    out.append(record(page_id, url, payload, digest(payload), winner, winner is not None))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    marked = rows.join(repeats, ["page_id", "sha"], "left").select("page_id", "url", "html", "winner")
    built = marked.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    built.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(raw: bytes) -> tuple[int, dict] | None:
    """(bytes of the whole record, headers) of what stands behind a magic, or None."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", n, re.ASCII):
        return None
    return len(MAGIC) + end + 4 + int(n) + 4, fields


def _page(text: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", text)
    return int(m[1]) if m else None


def _fields(head: dict, body: bytes, whole: int) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, offset of the payload in the block. ``body``: the first bytes of the record's block of ``whole`` bytes."""
    kind = head.get("warc-type", "")
    size = skip = None
    http, blank, _ = body.partition(b"\r\n\r\n")
    m = re.search(rb"content-length: *([0-9]{1,15})", http, re.I)
    if kind == "response" and blank:
        skip = len(http) + 4
        size = whole - skip
    elif m:
        size = int(m[1])
    return _page(head.get("warc-record-id", "")), size, head.get("warc-payload-digest", "").removeprefix("sha1:"), kind, _page(head.get("warc-refers-to", "")), skip


_CANDIDATE = "file string, block long, at long, size long, leaves long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates by split, at offsets from the split's first byte; ``leaves`` is where its chain passes the split's end (or stops, null). A row with a null ``at`` gives the split's size in ``size``, the file's in ``leaves``."""
    parts = spark.read.option("lineSep", MAGIC.decode()).text(path)
    parts = parts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("whole"), F.col("value").cast("binary").alias("value"))
    names = [f.split()[0] for f in _CANDIDATE.split(", ")]

    def sound(pieces: list[bytes], starts: list[int], a: int, e: int, sha: str) -> bool:
        """Do the split's bytes a to e have this digest?"""
        h = hashlib.sha1()
        k = bisect_right(starts, a) - 1
        while a < e:
            part = pieces[k][a - starts[k] : e - starts[k]]
            h.update(part)
            a += len(part)
            k += 1
        return base64.b32encode(h.digest()).decode() == sha

    def finish(file: str, block: int, found: dict[int, tuple], pieces: list[bytes], starts: list[int], span: int, whole: int) -> pa.RecordBatch:
        leaves: dict[int, int | None] = {}
        for at in sorted(found, reverse=True):
            to = at + found[at][0]
            leaves[at] = to if to >= span else leaves.get(to)
        # A record follows another one, or comes first; other magics are not worth a digest.
        likely = {at + x[0] for at, x in found.items()} | {min(found, default=0)}
        rows = []
        for at, (size, body, x) in found.items():
            ok = None
            if at in likely and x[5] is not None and at + size <= span:
                ok = sound(pieces, starts, at + body + x[5], at + size - 4, x[2])
            rows.append((file, block, at, size, leaves[at], *x[:5], ok))
        rows.append((file, block, None, span, whole, *[None] * 6))
        types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, span, begun, whole = None, 0, False, 0
        found: dict[int, tuple] = {}  # at -> size, bytes of the header, fields
        pieces, starts = [], []  # the split's bytes, held once
        for b in batches:
            files, blocks, wholes = (b.column(c).to_pylist() for c in ("file", "block", "whole"))
            for file, block, size_, value in zip(files, blocks, wholes, b.column("value"), strict=True):
                raw = value.as_py()
                if (file, block) != now:
                    if now is not None:
                        yield finish(*now, found, pieces, starts, span, whole)
                    now, span, begun, whole, found, pieces, starts = (file, block), 0, block > 0, size_, {}, [], []
                # Behind a file's first bytes every piece follows a magic; a file's very first piece does not.
                piece = MAGIC + raw if begun else raw
                if begun and (got := parse(raw)):
                    size, head = got
                    body = raw.find(b"\r\n\r\n") + 4 + len(MAGIC)
                    found[span] = (size, body, _fields(head, piece[body : size - 4], size - 4 - body))
                pieces.append(piece)
                starts.append(span)
                span += len(piece)
                begun = True
        if now is not None:
            yield finish(*now, found, pieces, starts, span, whole)
        trim()

    return parts.mapInArrow(run, _CANDIDATE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records on each file's chain: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    every = stored(_candidates(spark, path))
    spans = every.where("at IS NULL").select("file", "block", F.col("size").alias("span"), F.col("leaves").alias("whole"))
    spans = stored(spans.select("file", "block", "span", "whole", (F.sum("span").over(Window.partitionBy("file").orderBy("block")) - F.col("span")).alias("base")))
    found = every.where("at IS NOT NULL").join(spans, ["file", "block"])
    # Entries: where a file begins, and where another split's chain may go on.
    jumps = found.select("file", (F.col("base") + F.col("at")).alias("here"), (F.col("base") + F.col("leaves")).alias("there"))
    landings = jumps.where("there IS NOT NULL").select("file", F.col("there").alias("here")).union(spans.select("file", F.lit(0).cast("long").alias("here"))).distinct()
    hop = first = stored(jumps.join(landings, ["file", "here"]).select("file", "here", "there"))
    reach = stored(hop.where("here = 0").select("file", "here"))
    while True:
        step = reach.join(hop, ["file", "here"]).where("there IS NOT NULL").select("file", F.col("there").alias("here"))
        more = stored(reach.union(step.join(hop.select("file", "here"), ["file", "here"], "left_semi")).distinct())
        if more.count() == reach.count():
            break
        reach = more
        nxt = hop.select("file", F.col("here").alias("there"), F.col("there").alias("beyond"))
        hop2 = hop.join(nxt, ["file", "there"], "left").select("file", "here", F.coalesce("beyond", F.lit(None).cast("long")).alias("there"))
        # A doubled pointer skips every second entry, so both halves of the doubling are kept: reach already holds the skipped ones.
        hop = stored(hop2)
    ends = reach.join(first, ["file", "here"]).select("file", F.col("there").alias("whole"))
    broken = spans.select("file", "whole").distinct().join(ends, ["file", "whole"], "left_anti").first()
    if broken:
        raise ValueError(f"{broken.file}: its records don't end at the file's size of {broken.whole} bytes")
    marked = found.join(reach.withColumn("entry", F.lit(True)), (found.file == reach.file) & (found.base + found["at"] == reach.here), "left").select(found.file, "block", "at", "size", "span", "entry", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def chain(t: pa.Table) -> pa.Table:
        at, size, entry = (t.column(c).to_pylist() for c in ("at", "size", "entry"))
        row = {a: i for i, a in enumerate(at)}
        keep = set()
        for i in [i for i, e in enumerate(entry) if e]:
            while i is not None and i not in keep:
                keep.add(i)
                i = row.get(at[i] + size[i])
        kept = t.take(pa.array(sorted(keep), pa.int64()))
        if pc.any(pc.equal(kept.column("sound"), False)).as_py():
            raise ValueError("a payload doesn't have the digest that its record names")
        return kept.select(out)

    return marked.groupBy("file", "block").applyInArrow(chain, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    spark = pages.sparkSession
    path = path or shared_dir(spark)
    write(pages, path, least)
    return read(spark, path)
