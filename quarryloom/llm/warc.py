"""WARC archives: writing with segments and chunked framing, and reading back whole.

A record's block is an HTTP response whose body is framed in chunks. A block longer than a
segment is cut: a first record and continuation records that name it as their origin,
numbered, the last with the total length; they may lie in other files. Reading groups
continuations by origin, orders them by number, verifies the total length and decodes the
framing. Each record is a gzip member of its own, as archives have it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import shared, store

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
FILE_BYTES = 16 << 20
#: Archive bytes that are opened at once.
READ_BYTES = 16 << 10
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for a in range(0, len(payload), size):
        part = payload[a : a + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions are skipped, trailers end it. Raises ValueError where it breaks off."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk breaks off")
        parts.append(body[end + 2 : at])
        at += 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_records(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page: a revisit, or a response in as many segments as it needs."""
    common = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if page_id is not None:
        common.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        common.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    origin = f"<urn:x-record:{name}>"
    kind = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), kind], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, kind]
    if len(parts) == 1:
        return [record(first, block)]
    out = [record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:x-record:{name}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(more, part))
    return out


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        opener, parts = zlib.decompressobj(31), []
        while not opener.eof and at < len(view):
            parts.append(opener.decompress(view[at : at + READ_BYTES]))
            at += READ_BYTES
        at = min(at, len(view)) - len(opener.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(rest) < n:
            raise ValueError("a record breaks off")
        yield headers, rest[:n]


def body_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and the payload of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return headers, dechunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, size, names, count, n = [], 0, [], [], 0
        for batch in shared.text_pieces(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "last_id", "copies")), batch.column("html"), strict=True)
            for page_id, url, last, copies, html in rows:
                revisit = bool(copies and copies > 1 and page_id is not None and last is not None and page_id != last)
                for data in page_records(f"{part}-{n}", page_id, url, (html.as_py() or "").encode(), last, revisit):
                    if held and size + len(data) > FILE_BYTES:
                        names.append(store.put(folder, f"pages-{part:06d}-{len(names):06d}", b"".join(held)))
                        count.append(len(held))
                        held, size = [], 0
                    held.append(data)
                    size += len(data)
                n += 1
        if held:
            names.append(store.put(folder, f"pages-{part:06d}-{len(names):06d}", b"".join(held)))
            count.append(len(held))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(count, pa.int64())], ["name", "n_records"])

    return run


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each page; returns the list of files (name, n_records).

    The payload is the html in UTF-8, a null html is empty. Of pages with equal payloads
    the largest id is a response, the others revisit it. Rows with the largest id itself,
    if repeated, and rows with a null id are responses. A null url has no target. No pages
    give no file.
    """
    store.made(pages.sparkSession, folder)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    copied = rows.groupBy("sha").agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies")).where("copies > 1")
    # the file a record goes to is any; the join's skewed shards are split by Spark
    joined = rows.join(copied, "sha", "left").select("page_id", "url", "html", "last_id", "copies")
    return shared.written(shared.map_arrow(joined, _write(folder), "name string, n_records long"), "archives")


PAYLOAD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, valid boolean, payload binary"


def _whole(headers: dict[str, str], block: bytes, keep: bool) -> list:
    """The output row of a whole record. valid: its payload has the digest that the record names."""
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers["warc-type"]
    refers = headers.get("warc-refers-to", "").removeprefix("<urn:x-page:").removesuffix(">")
    row = [int(headers["warc-page-id"]) if "warc-page-id" in headers else None, headers.get("warc-target-uri"), kind, int(refers) if refers.lstrip("-").isdigit() else None]
    http, payload = body_of(block)
    if kind == "revisit":
        return [*row, int(http.get("content-length", 0)), said, True, None]
    found = digest(payload)
    return [*row, len(payload), found, not said or said == found, payload if keep else None]


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
_NAMES = [x.split()[0] for x in PAYLOAD.split(", ")]


def _parse(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, parts, size = [], [], 0

                def made() -> pa.RecordBatch:
                    whole = [x + [None, None, None, None, None] for x in rows] + [[None] * 8 + x for x in parts]  # noqa: B023
                    kinds = [*_KINDS, pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
                    names = [*_NAMES, "origin", "number", "total", "headers", "block"]
                    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in whole], kind) for k, kind in enumerate(kinds)], names)

                for headers, block in records(content.as_py()):
                    number = int(headers.get("warc-segment-number", 0))
                    if number:
                        total = headers.get("warc-segment-total-length")
                        parts.append([headers.get("warc-segment-origin-id", headers["warc-record-id"]), number, int(total) if total else None, list(headers.items()) if number == 1 else None, block])
                    elif headers["warc-type"] in ("response", "revisit"):
                        rows.append(_whole(headers, block, keep))
                    size += len(block)
                    if len(rows) + len(parts) >= shared.BATCH_ROWS or size >= shared.PIECE_BYTES:
                        yield made()
                        rows, parts, size = [], [], 0
                yield made()

    return run


def _assemble(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column("parts").to_pylist():
                parts.sort(key=lambda x: x["number"])
                block = b"".join(x["block"] for x in parts)
                total = parts[-1]["total"]
                whole = [x["number"] for x in parts] == list(range(1, len(parts) + 1)) and total == len(block)
                headers = dict(parts[0]["headers"] or {})
                if whole:
                    rows.append(_whole(headers, block, keep))
                else:
                    page = headers.get("warc-page-id")
                    rows.append([int(page) if page else None, headers.get("warc-target-uri"), headers.get("warc-type"), None, None, None, False, None])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(_KINDS)], _NAMES)

    return run


def read_pages(spark: SparkSession, folder: str, files: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each response and revisit of the listed files, with the payload if asked for.

    valid is false where segments are missing or doubled, where their length isn't the
    total, where the payload hasn't the digest that its record names, and for a revisit
    of a page that has no valid response with its digest among the files.
    """
    found = store.finished(spark, folder, files.select("name")).select("content")
    more = "origin string, number int, total long, headers map<string,string>, block binary"
    parsed = shared.written(shared.map_arrow(found, _parse(payload), f"{PAYLOAD}, {more}"), "records")
    segments = parsed.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "headers", "block")).alias("parts")).select("parts")
    whole = shared.written(parsed.where("origin is null").select(*_NAMES).union(shared.map_arrow(segments, _assemble(payload), PAYLOAD)), "pages")
    known = whole.where("record_type = 'response' and valid").select(F.col("page_id").alias("refers_to"), "payload_digest", F.lit(True).alias("same")).distinct()
    revisits = whole.where("record_type = 'revisit'").drop("valid").join(known, ["refers_to", "payload_digest"], "left").withColumn("valid", F.coalesce("same", F.lit(False)))
    return whole.where("record_type is null or record_type <> 'revisit'").union(revisits.select(*_NAMES))
