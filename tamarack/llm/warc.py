"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. Spark's text writer commits the archives, with an empty
member in place of line ends, so files are plain sequences of members in the shared store. The
reader lets Spark split the files by bytes with the gzip magic as the line separator: a task owns
what starts at a magic inside its range. Whether a magic really starts a member is told by decoding
it: header, deflate stream, CRC, then the WARC headers. A magic inside compressed data leaves two
fragments, which are joined again, in the task or, over the border of two ranges, after it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import _common as c

MAGIC = b"\x1f\x8b\x08"
LEVEL = 4


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY = gzip_member(b"")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    """value without what would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of the page refers_to, which repeats no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict | None:
    """The fields of a record; None if data isn't one."""
    head, end, rest = data.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    page = lambda v: int(m[1]) if v and (m := re.search(r"<urn:page:(-?\d+)>", v)) else None
    out = {"page_id": page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields.get("warc-type"), "refers_to": page(fields.get("warc-refers-to")), "payload": None}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(fields.get("x-payload-length", 0)), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    payload = block.partition(b"\r\n\r\n")[2] if out["record_type"] == "response" else block
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": base32_sha1(payload)}


class _Candidate:
    """What might be a member from the fragment number ``start`` on."""

    def __init__(self, start: int):
        self.start, self.end, self.z, self.data = start, None, zlib.decompressobj(31), []

    def alive(self, raw: bytes) -> bool:
        try:
            self.data.append(self.z.decompress(raw))
        except zlib.error:
            return False
        return True


def members(fragments: Iterator[tuple[tuple, bytes]]) -> Iterator[tuple[str, tuple, bytes]]:
    """("member", range, its data) of each gzip member in fragments (range, bytes after a magic).

    Every magic starts a candidate, which is fed with what follows until it ends with the right
    CRC or breaks. One that ends takes those that began inside it with it; an inner one waits for
    the outer ones. What can't be told within a range comes out as it went in: ("head", ...)
    fragments before the first member, ("tail", ...) those from a member that isn't at its end.
    """
    at, started, active, held, base = None, False, [], [], 0

    def passed(upto: int):
        """Lets go of the fragments before number upto, which belong to no candidate."""
        nonlocal base
        gone, held[:], base = held[: upto - base], held[upto - base :], upto
        return [] if started else [("head", at, f) for f in gone]

    def tails():
        return [("tail", at, f) for f in held[active[0].start - base :]] if active else []

    for where, fragment in fragments:
        if where != at:
            yield from tails()
            at, started, active, held, base = where, False, [], [], 0
        n, raw = base + len(held), MAGIC + fragment
        held.append(fragment)
        active = [x for x in [*active, _Candidate(n)] if x.end is not None or x.alive(raw)]
        for i, x in enumerate(active):
            if x.end is None and x.z.eof:
                x.end, active = n, active[: i + 1]
                break
        while active and active[0].end is not None:
            first = active.pop(0)
            yield from passed(first.start)
            started = True
            yield "member", at, b"".join(first.data)
            passed(first.end + 1)
        yield from passed(active[0].start if active else n + 1)
    yield from tails()


_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_OPEN = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("fragment", pa.binary())])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of each record in the archives at path.

    payload is null for revisits, whose size and digest are of the payload they refer to, and
    everywhere unless ``payloads``. File names must not end as those of Hadoop's codecs do (.gz),
    as Spark would decode those whole. Members that don't decode, and ones that hold no WARC
    record, are no rows.
    """
    text = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    rows = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("fragment"))

    def fragments(batches):
        last = None
        for b in batches:
            for *where, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if where[1] or where == last:  # a file's first fragment is what comes before any magic
                    yield where, v.as_py()
                last = where

    def kernel(batches):
        out, held, n = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in zip(_ARROW.names, _ARROW.types, strict=True)] + [pa.array([h[k] for h in held], t) for k, t in zip(_OPEN.names, _OPEN.types, strict=True)], schema=pa.schema([*_ARROW, *_OPEN]))
        none = dict.fromkeys(_OPEN.names)
        for seq, (kind, at, data) in enumerate(members(fragments(batches))):
            if kind == "member":
                if r := parsed(data):
                    out.append(r if payloads else r | {"payload": None})
                    held.append(none)
            else:
                out.append(dict.fromkeys(_ARROW.names))
                held.append({"file": at[0], "start": at[1], "seq": seq, "fragment": data})
            n += len(data)
            if n > 4 << 20:
                yield batch()
                out, held, n = [], [], 0
        yield batch()

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("seq", "ascending")])
        found = [parsed(data) for kind, _, data in members((0, v) for v in table["fragment"].to_pylist()) if kind == "member"]
        return pa.Table.from_pylist([r if payloads else r | {"payload": None} for r in found if r], schema=_ARROW)

    all_ = c.cut(rows.mapInArrow(kernel, f"{_FIELDS}, file long, start long, seq long, fragment binary"))
    names = _ARROW.names
    whole, open_ = all_.filter("fragment is null").select(names), all_.filter("fragment is not null").select(_OPEN.names)
    return whole if open_.isEmpty() else whole.union(open_.groupBy("file").applyInArrow(joined, _FIELDS))


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each row of pages to new files under path.

    Of rows with the same payload (UTF-8 of html, null as empty) of ``least`` bytes or more, that
    with the largest id is the response and the others revisit it; rows that repeat that id are
    responses too, as are rows whose group has no id. Payloads of any length are written whole. An
    empty table gives no records; other columns, whatever their names, aren't written.
    """
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    own = own.withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload"), "check": F.xxhash64("payload")})
    again = own.filter(F.col("bytes") >= least).groupBy("sha", "bytes", "check").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = own.join(c.maybe_broadcast(c.cut(again), 160), ["sha", "bytes", "check"], "left").select("id", "url", "payload", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")).alias("refers_to"))

    def kernel(batches):
        for b in batches:
            out, n = [], 0
            for page, url, payload, to in zip(*(x.to_pylist() for x in b.columns), strict=True):
                out.append(gzip_member(record(page, url, payload, to, date)))
                n += len(out[-1])
                if n > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = marked.mapInArrow(kernel, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """The records of pages, written to a new folder in the shared store, read back, and removed from there."""
    path = f"{c.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    out = read_warc(pages.sparkSession, path, payloads=False)
    c.emptied(pages.sparkSession, path)  # what was read is in a checkpoint
    return out
