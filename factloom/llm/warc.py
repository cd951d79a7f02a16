"""WARC archives with an index: written first, read back by coalesced byte ranges.

An archive is a file of gzip members, one a record, written by the task that holds its rows through Arrow's file
systems (local, HDFS, object stores), under a name that no other attempt uses. The index is what the tasks return;
once it is stored, only the files it names exist as far as readers are concerned, so a lost executor or a second attempt
leaves at most an unread file behind.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, lookup, scratch_path

#: Ranges of one archive closer than GAP are read at once, up to SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20
INDEX = "archive string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, record_id string, refers_to string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def line(value: object) -> str:
    """A header's value on one line of ASCII; everything else is percent-encoded."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{x:02X}" for x in m[0].encode("utf-8")), str(value))


def record(kind: str, record_id: str, url: str | None, sha1: str, payload: bytes | None, size: int, refers_to: str | None) -> bytes:
    """One WARC record. A revisit has the headers of the payload (digest and size) but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{quote(record_id, safe='')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{quote(refers_to, safe='')}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("ascii").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("ascii").split("\r\n")[1:]), payload


def decide(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Adds _sha1 (hex) and _first (the largest key among rows of equal payload, as text; null where all are null)."""
    marked = pages.withColumn("_sha1", F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary")))
    groups = marked.groupBy("_sha1").agg(F.max(key).alias("_first"), F.count("*").alias("_rows"))
    total = pages.count()
    return lookup(marked, groups.where("_rows > 1"), "_sha1", "_rows", total)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes archives under ``path`` and returns their stored index (INDEX), one row a record.

    Of rows with equal payloads (null: empty) that with the largest key is the response, the others revisit it. A row that
    repeats the response's key is a response too. If all keys of a group are null, each is a response. A null url is left
    out of the record. Long payloads are written whole. An empty table writes nothing.
    """
    rows = decide(pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(html).alias("h")), "k", "h")
    revisit = F.coalesce(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("k")), F.lit(False))
    rows = rows.select(F.col("k").cast("string").alias("k"), "u", F.when(~revisit, F.coalesce("h", F.lit(""))).cast("binary").alias("h"), F.length(F.coalesce("h", F.lit("")).cast("binary")).cast("long").alias("n"), F.unhex("_sha1").alias("s"), F.when(revisit, F.col("_first").cast("string")).alias("f"))

    def archive(batches):
        name, files, out, offset, done = f"part-{uuid.uuid4().hex}.warc.gz", None, None, 0, False
        try:
            for batch in batches:
                found = []
                for r in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                    kind, sha1 = "response" if r["f"] is None else "revisit", base64.b32encode(r["s"]).decode("ascii")
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = packer.compress(record(kind, r["k"] if r["k"] is not None else "none", r["u"], sha1, r["h"], r["n"], r["f"])) + packer.flush()
                    if out is None:
                        files, top = file_system(path)
                        files.create_dir(top, recursive=True)
                        out = files.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(raw)
                    found.append((f"{path}/{name}", offset, len(raw), r["u"], sha1, r["n"], kind, r["k"], r["f"]))
                    offset += len(raw)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], [x.split()[0] for x in INDEX.split(", ")])
            done = True
        finally:  # a task that fails or is stopped leaves no part of an archive
            if out is not None:
                out.close()
                if not done:
                    files.delete_file(f"{top}/{name}")

    return keep(rows.mapInArrow(archive, INDEX), "warc-index")


def ranges(found: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) pairs -> (begin, end, members) of the reads that cover them."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(found):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= span:
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), [*out[-1][2], i])
        else:
            out.append((offset, offset + length, [i]))
    return out


def read(index: DataFrame) -> DataFrame:
    """Reads the records that the rows of an index name: record_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    ``index`` may be any selection of a stored index. Its rows are dealt out by archive and region (so one long archive
    is read by many tasks), sorted by offset, and neighbouring ranges are read at once. Each record is checked against
    the index: its digest header, and for a response the digest and size of what was read. A null record id stays null; a
    revisit has a null payload, an empty response an empty one. Long records are read whole; a record named twice is read
    twice. An empty index gives an empty result. Other columns of the index are ignored.
    """
    region = F.floor(F.col("offset") / (4 * SPAN)).cast("int")
    dealt = index.withColumn("_region", region).repartition("archive", "_region").sortWithinPartitions("archive", "offset")
    fields = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"

    def fetch(batches):
        where, files, stream = None, None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                to = at
                while to < len(rows) and rows[to]["archive"] == rows[at]["archive"]:
                    to += 1
                mine, at_next = rows[at:to], to
                if mine[0]["archive"] != where:
                    if stream is not None:
                        stream.close()
                    where = mine[0]["archive"]
                    files, name = file_system(where)
                    stream = files.open_input_file(name)
                for begin, end, members in ranges([(r["offset"], r["length"]) for r in mine]):
                    stream.seek(begin)
                    raw = stream.read(end - begin)
                    found = []
                    for i in members:
                        r = mine[i]
                        warc, http, payload = parse(zlib.decompress(raw[r["offset"] - begin : r["offset"] - begin + r["length"]], 31))
                        sha1, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                        size = int(http["Content-Length"])
                        if sha1 != r["payload_digest"] or kind == "response" and (digest(payload) != sha1 or len(payload) != size):
                            raise ValueError(f"{where} at {r['offset']}: payload doesn't match its digest")
                        first = warc.get("WARC-Refers-To")
                        found.append((r["record_id"], r["url"], kind, first and unquote(first[len("<urn:page:") : -1]), sha1, size, payload if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], [x.split()[0] for x in fields.split(", ")])
                at = at_next
        if stream is not None:
            stream.close()

    return dealt.mapInArrow(fetch, fields)


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages and reads the archives back: key, payload_bytes, payload_digest, record_type, refers_to.

    Null or empty html: a payload of 0 bytes. A null key stays null and is a response. Of equal payloads the one with the
    largest key is the response; rows that repeat that key are responses each, and the others refer to it. Very long pages
    are written whole. An empty table gives an empty result. Other columns are ignored.
    """
    kind = pages.schema[key].dataType
    back = read(write(pages, scratch_path(spark, "warc"), key, url, html))
    return back.select(F.col("record_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
