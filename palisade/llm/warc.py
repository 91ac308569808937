"""WARC: a deterministic sharded writer, and its reader.

Pages are range-sorted by id and each range is written as a run of files, a
gzip member a record, a new file once the compressed size is reached. The ranges
follow from the ids and sizes themselves (an exact histogram, cells with much in
them cut finer until they are small or hold a single id; an id with more than one
range's bytes gets several, by a hash of url and html), never from a sample. Headers
(record ids, lengths, digests) are made anew from the payload alone and files are
named by range and number, so equal input gives equal names and bytes. A page
whose payload another page with a smaller id has too becomes a revisit record
that names that page.

A task writes under a temporary name that no other attempt uses and renames
each file when it is whole; a manifest (one row a file: name, records, bytes,
SHA-1) written at the end says which files belong to the archive. What a lost
executor leaves behind is named by no manifest.

Null and empty html count as an empty payload; very long payloads are one record
each. Rows with one id are records of their own; of equal payloads under the
smallest id, the first by url, then as stored, is the response. A null id sorts
first, is written as an empty id, is always a response and is never referred to.
Columns other than id, url and html are ignored. An empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Store, shared_dir, shuffle_partitions, written

FILES = "part int, seq int, file string, n_records bigint, n_bytes bigint, sha1 string"
ROWS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint"
#: Compressed bytes after which a file is closed.
FILE_BYTES = 64 << 20
#: Every record bears this date: the tables have none, and the files must not depend on the clock.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id: int | None, digest: str, place: str = "") -> str:
    """``place`` tells apart what nobody refers to."""
    h = hashlib.md5(f"page:{page_id}:{digest}:{place}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters become %XX."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "") -> bytes:
    """One record, not yet compressed."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit, digest = refers_to is not None, digest32(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id, digest, place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member without name and time."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def members(f, chunk: int = 1 << 20):
    """(offset, bytes) of each member of a file, one at a time."""
    at, d, parts, held, pos = 0, zlib.decompressobj(31), [], b"", 0
    while True:
        if not held:
            held = f.read(chunk)
            if not held:
                if parts or pos != at:
                    raise ValueError("the file ends within a record")
                return
        parts.append(d.decompress(held))
        pos += len(held) - len(d.unused_data)
        held = d.unused_data
        if d.eof:
            yield at, b"".join(parts)
            at, d, parts = pos, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(h["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    return h, rest[:n]


#: Cells of the first histogram of ids, and those that a cell with too much in it is cut to.
CELLS, FINER = 4096, 64


def _cuts(low: int, high: int, n: int) -> list[int]:
    """Where cells 1, 2, ... of ``n`` equal cells of [low, high] begin."""
    return sorted({low + (high - low + 1) * k // n for k in range(1, n)} - {low})


def id_ranges(sizes: DataFrame, n: int) -> tuple[list[int], list[int]]:
    """First ids of all ranges but the first, and how many parts each range has,
    for about ``n`` parts of equal bytes. ``sizes``: page_id, bytes.

    Each round counts the bytes of every cell and cuts those cells finer that hold
    more than a part and more than one id; the driver sees one number a cell.
    """
    ends = sizes.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.sum("bytes").alias("bytes")).first()
    if ends.low is None:
        return [], [1]
    most = max(1, -(-ends.bytes // n))
    edges = [ends.low, *_cuts(ends.low, ends.high, CELLS)]
    while True:
        counted = {r[0]: r[1] for r in sizes.groupBy(_place(edges[1:])("page_id").alias("c")).agg(F.sum("bytes")).collect()}
        after = edges[1:] + [ends.high + 1]
        finer = [x for k, (a, b) in enumerate(zip(edges, after)) if counted.get(k, 0) > most and b - a > 1 for x in _cuts(a, b - 1, FINER)]
        if not finer:
            break
        edges = sorted({*edges, *finer})
    starts, parts, held = [], [1], 0
    for k, first in enumerate(edges):
        here = counted.get(k, 0)
        if k and (held + here > most or parts[-1] > 1):
            starts.append(first)
            parts.append(1)
            held = 0
        held += here
        parts[-1] = max(parts[-1], -(-held // most)) if after[k] - first == 1 else parts[-1]
    return starts, parts


def _place(starts: list[int]):
    """The number of the range that an id lies in; null ids lie in the first."""
    import numpy as np

    bounds = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def place(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy().astype(np.int64), "right")
        return pd.Series(out)

    return place


def _revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, url, h, r, refers_to) of the rows that aren't the first with their
    payload. Payloads that only one row has leave in the aggregation; what is
    joined is narrow, so a payload that a third of all rows have costs one skewed
    sort-merge join of short rows, which adaptive execution splits."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    narrow = pages.where((F.octet_length(payload) >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "h", "r", F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    shared = narrow.groupBy("digest").agg(F.min(F.struct("page_id", "url", "r")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("f.page_id").alias("refers_to"), F.col("f.r").alias("r0"))
    return narrow.join(shared, "digest").where("r <> r0").select("page_id", "url", "h", "r", "refers_to")


def write_warc(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES, min_revisit_bytes: int = 0, parts: int | None = None, bare_scan: bool = False) -> DataFrame:
    """Write all of ``pages`` (page_id, url, html) below ``root``; returns the manifest.

    ``parts``: ranges to write, about (the number of shuffle partitions). Pages are
    read several times: a plan other than a plain file scan (``bare_scan``) is
    written first.
    """
    spark = pages.sparkSession
    pages = pages.selectExpr("cast(page_id as bigint) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    if not bare_scan:
        pages = written(pages, f"{root}/input")
    pages = pages.withColumn("h", F.xxhash64("html")).withColumn("r", F.monotonically_increasing_id())
    starts, many = id_ranges(pages.select("page_id", (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).cast("bigint").alias("bytes")), parts or shuffle_partitions(spark))
    first = [sum(many[:k]) for k in range(len(many))]
    # The link of a page travels as a row of its own to the page's place, so that payloads are shuffled once.
    links = _revisits(pages, min_revisit_bytes).selectExpr("page_id", "url", "cast(null as string) as html", "h", "r", "refers_to", "0 as kind")
    rows = pages.selectExpr("page_id", "url", "html", "h", "r", "cast(null as bigint) as refers_to", "1 as kind").unionByName(links)
    rows = rows.withColumn("part", _place(starts)("page_id"))
    if sum(many) > len(many):
        # ids with more than one part's bytes
        several = F.create_map(*[F.lit(x) for k, m in enumerate(many) if m > 1 for x in (k, m)])
        salt = F.coalesce(F.pmod(F.xxhash64("url", "h"), F.try_element_at(several, F.col("part"))), F.lit(0)).cast("int")
    else:
        salt = F.lit(0)
    offset = F.from_json(F.lit(str(first)), "array<int>")
    rows = rows.withColumn("part", F.get(offset, F.col("part")) + salt)
    order = [F.col("part"), F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), F.col("h"), F.col("r"), F.col("kind")]
    dealt = rows.repartitionById(sum(many), "part").sortWithinPartitions(*order).select("part", "page_id", "url", "html", "refers_to", "kind")

    def write(batches):
        import uuid

        import pyarrow as pa

        store = Store(root)
        done, out, temp, size, count, sha, at, link, now = [], None, "", 0, 0, None, 0, None, None

        def finish():
            name = f"pages-{now:06d}-{sum(d[0] == now for d in done):04d}.warc.gz"
            out.close()
            store.put(temp, name)
            done.append((now, sum(d[0] == now for d in done), name, count, size, sha.hexdigest()))

        for b in batches:
            for part, page_id, url, html, refers_to, kind in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    if out is not None:
                        finish()
                        out = None
                    now, at = part, 0
                if not kind:
                    link = refers_to
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                # a record that may be referred to has no place in its name
                alone = link is not None or page_id is None or len(payload) < min_revisit_bytes
                raw = member(record(page_id, url, payload, link, f"{part}:{at}" if alone else ""))
                link, at = None, at + 1
                if out is None:
                    temp, size, count, sha = f"_tmp-{part:06d}-{uuid.uuid4().hex}", 0, 0, hashlib.sha1()
                    out = store.create(temp)
                out.write(raw)
                sha.update(raw)
                size += len(raw)
                count += 1
                if size >= file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if done:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], names=["part", "seq", "file", "n_records", "n_bytes", "sha1"])

    return written(dealt.mapInArrow(write, FILES), f"{root}/manifest")


def read_warc(files: DataFrame, root: str) -> DataFrame:
    """A row per record of the manifest's files, checked against its headers."""
    n = shuffle_partitions(files.sparkSession)

    def read(batches):
        import pyarrow as pa

        store = Store(root)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for name in b.column(0).to_pylist():
                held = []
                with store.open(name) as f:
                    for at, raw in members(f):
                        h, block = parse(raw)
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and (len(body) != size or digest32(body) != digest):
                            raise ValueError(f"{name}: the record at {at} doesn't match its digest")
                        held.append((int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], size, digest, h["warc-type"], int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, name, at))
                        if len(held) >= 10_000:
                            yield batch(held)
                            held = []
                if held:
                    yield batch(held)

    # a task a file, and files of one range are spread
    return files.select("file", (F.col("part") + F.col("seq")).alias("at")).repartitionById(n, "at").select("file").mapInArrow(read, ROWS)


def warc_round_trip(pages: DataFrame, root: str | None = None, file_bytes: int = FILE_BYTES, min_revisit_bytes: int = 0, bare_scan: bool = False) -> DataFrame:
    """Write the archive, then read every record back."""
    root = root or shared_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, root, file_bytes, min_revisit_bytes, bare_scan=bare_scan), root)
