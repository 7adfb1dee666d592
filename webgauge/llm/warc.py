"""WARC archives: writing pages, and reading by boundary-chain verification.

Writing: a record per page, by Spark's text sink with the records' closing blank lines as line separator. Pages with
equal payloads are one response, that with the largest id, and revisits of it; only ids and digests are shuffled.

Reading: the files are split at every occurrence of the magic, wherever it stands, by Spark's text source, in parallel
within a file too. Each piece emits, from its headers, the offset at which its successor would begin. A payload may
hold the magic or whole records, so a piece is a record only if it can be reached from the file's start: pointer
jumping doubles the distance of every pointer each round and marks what is reached. A reached record that spans
several pieces is put together again from them.

Defined results: a null or empty page is a record with an empty payload; a null url is left out; a null id is a
response without an id. Rows that repeat an id and payload are responses each, or revisits each. Bytes that no chain
reaches (before the first record, after a broken one) are not records. An empty table writes no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webgauge.llm.shared import maybe_broadcast, scratch_dir, written

#: Fixed values of the format.
MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, valid boolean"
_FIELDS_ARROW = [
    ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.int64()),
    ("url", pa.string()),
    ("valid", pa.bool_()),
]
FIELDS = [k for k, _ in _FIELDS_ARROW]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [(h.as_py() or "").encode() for h in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(p) for p in payloads], pa.int64()), pa.array([digest(p) for p in payloads])], names=["page_id", "size", "digest"]
        )


def record(page_id: int | None, url: str | None, html: str, refers_to: int | None, date: str) -> str:
    """A record without its closing blank lines."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.encode('unicode_escape').decode() if any(c in url for c in chr(13) + chr(10)) else url}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        html = ""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(html.encode())}"]
    return "\r\n".join(head) + "\r\n\r\n" + http + html


def record_batches(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, url, html, refers_to, theirs in zip(*(batch.column(i) for i in range(5))):
            html, refers_to = html.as_py() or "", refers_to.as_py()
            if refers_to is not None and digest(html.encode()) != theirs.as_py():
                refers_to = None  # another payload under the same id
            out.append(record(page_id.as_py(), url.as_py(), html, refers_to, date))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Pages (page_id, url, html) to WARC files in the folder ``path``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = written(p.select("page_id", "html").mapInArrow(digest_batches, "page_id long, size long, digest string"), "digests")
    first = known.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    first = first.where("refers_to <> least").select("digest", "refers_to")
    later = written(known.join(first, "digest").where("page_id <> refers_to").select(F.col("page_id").alias("_id"), "refers_to", "digest").distinct(), "revisits")
    rows = p.join(maybe_broadcast(later, later.count()), F.col("page_id") == F.col("_id"), "left").select("page_id", "url", "html", "refers_to", "digest")
    rows.mapInArrow(partial(record_batches, date=date), "value string").write.option("lineSep", END.decode()).text(path)


def urn(value: bytes | None) -> int | None:
    text = (value or b"").strip(b"<> ").rpartition(b":")[2]
    return int(text) if text.lstrip(b"-").isdigit() else None


def headers(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, s, v in (line.partition(b":") for line in block.split(b"\r\n")) if s}


def parse(body: bytes) -> tuple[int | None, dict]:
    """Bytes after a magic to the record's size by its headers, magic and closing included, and its fields.

    Fields are filled only if the body holds the whole record; no size: these aren't a record's headers.
    """
    head, found, rest = body.partition(END)
    fields = headers(head) if found else {}
    if not fields.get(b"content-length", b"").isdigit() or b"warc-type" not in fields:
        return None, {}
    length = int(fields[b"content-length"])
    size = len(MAGIC) + len(head) + len(END) + length + len(END)
    if size != len(MAGIC) + len(body):
        return size, {}
    http, _, payload = rest[:length].partition(END)
    kind = fields[b"warc-type"].decode("latin-1")
    said = fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("latin-1")
    sized = headers(http).get(b"content-length", b"")
    own = kind != "revisit"
    return size, {
        "page_id": urn(fields.get(b"warc-record-id")),
        "payload_bytes": len(payload) if own else int(sized) if sized.isdigit() else None,
        "payload_digest": digest(payload) if own else said,
        "record_type": kind,
        "refers_to": urn(fields.get(b"warc-refers-to")),
        "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None,
        "valid": rest[length:] == END and (not own or said == digest(payload)),
    }


def piece_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(file, split, bytes after a magic) in the order of the file to each piece's place in the split, and its fields."""
    now, local, number = None, 0, 0
    for batch in batches:
        rows = []
        for file, split, body in zip(*(batch.column(i) for i in range(3))):
            place, body = (file.as_py(), split.as_py()), body.as_py() or b""
            if place != now:
                now, local, number = place, 0, 0
            size, fields = parse(body)
            rows.append({"file": place[0], "split": place[1], "number": number, "local": local, "length": len(body) + len(MAGIC), "size": size} | fields)
            local, number = local + len(body) + len(MAGIC), number + 1
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("body"))


def reachable(nodes: DataFrame) -> DataFrame:
    """file, at of the nodes (file, at, next) on the chain from each file's offset 0."""
    state = written(nodes.select("file", "at", F.col("next").alias("to"), (F.col("at") == 0).alias("hit")), "chain")
    while True:
        ahead = state.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        marks = state.where(F.col("hit") & F.col("to").isNotNull()).select("file", F.col("to").alias("at"), F.lit(True).alias("mark")).distinct()
        if marks.isEmpty():
            return state.where("hit").select("file", "at")
        moved = state.join(ahead, ["file", "to"], "left").select("file", "at", F.col("beyond").alias("to"), "hit")
        state = written(moved.join(marks, ["file", "at"], "left").select("file", "at", "to", (F.col("hit") | F.col("mark").isNotNull()).alias("hit")), "chain")


def whole_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse(MAGIC.join(b.as_py()))[1] for b in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files at ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url, valid."""
    place = [("file", pa.string()), ("split", pa.int64()), ("number", pa.int64()), ("local", pa.int64()), ("length", pa.int64()), ("size", pa.int64())]
    kinds = f"file string, split long, number long, local long, length long, size long, {_FIELDS}"
    found = written(pieces(spark, path).mapInArrow(partial(piece_batches, schema=pa.schema([*place, *_FIELDS_ARROW])), kinds), "pieces")
    # a split's place in its file: the bytes of the splits before it; a piece starts at the magic in front of it
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.groupBy("file", "split").agg(F.sum("length").alias("bytes")).withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    at = found.join(splits.select("file", "split", "base"), ["file", "split"]).withColumn("at", F.col("base") + F.col("local") - len(MAGIC))
    at = written(at.where("at >= 0"), "places")
    hit = reachable(at.where("size is not null").select("file", "at", (F.col("at") + F.col("size")).alias("next")))
    own = at.join(hit.withColumn("hit", F.lit(True)), ["file", "at"], "left")
    whole = own.where("hit and size = length")
    # a reached record with the magic inside: its pieces are those up to the next reached one
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    broken = own.where("hit and size > length").select("file").distinct()
    record_at = own.join(broken, "file", "left_semi").withColumn("_at", F.last(F.when(F.col("hit"), F.struct("at", "size", "length")), True).over(upto))
    parts = record_at.where("_at is not null and _at.size > _at.length and at < _at.at + _at.size")
    parts = written(parts.select("file", "split", "number", F.col("_at.at").alias("record"), "at"), "parts")
    n = parts.count()
    if n:
        need = written(pieces(spark, path).mapInArrow(partial(numbered_batches), "file string, split long, number long, body binary")
                       .join(maybe_broadcast(parts, n), ["file", "split", "number"]).select("file", "record", "at", "body"), "bodies")
        joined = need.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("p"))
        rest = joined.select(F.col("p.body").alias("bodies")).mapInArrow(partial(whole_batches, schema=pa.schema(_FIELDS_ARROW)), _FIELDS)
        return whole.select(*FIELDS).unionByName(rest)
    return whole.select(*FIELDS)


def numbered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, number = None, 0
    for batch in batches:
        numbers = []
        for place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            now, number = (place, 0) if place != now else (now, number + 1)
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), batch.column(2)], names=["file", "split", "number", "body"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as an archive in the shared folder and read back."""
    path = scratch_dir(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
