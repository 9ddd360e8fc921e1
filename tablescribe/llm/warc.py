"""WARC archives with deduplicated payloads, written and read by a byte index.

Every task writes an archive of its own, one gzip member per record, under a name that no other attempt uses; what it gives
to Spark is the index (path, offset, length, url, digest). So only the index of successful attempts names archives. Reading
selects records from the index, sorts them by path and offset, and fetches ranges that lie close together at once.
Archives lie below the shared folder and are reached through ``pyarrow.fs``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stores import store
from ..session import materialize, new_path
from .common import byte_batches, text_of

GAP = 64 << 10  # ranges closer than this are fetched together
FETCH = 8 << 20  # at most so many bytes at once, longer records apart
READ_BYTES = 16 << 20  # of archives that a reading task gets
_DATE = "1970-01-01T00:00:00Z"  # the tables have no time of capture


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(ident) -> str:
    return f"<urn:x-page:{'' if ident is None else ident}>"


def _line(value: str | None) -> str:
    """A header value: line breaks would end it."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value or "").strip()


def record(ident, url: str | None, payload: bytes, digest: str, refers_to, refers: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the response and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {_uri(ident)}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and the HTTP block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *fields = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
    return headers, rest[: int(headers["content-length"])]


def owners(df: DataFrame, *, key: str, html: str, least: int) -> DataFrame:
    """``df`` with the payload digest and ``owner``, the largest key of its equal payloads (null below ``least`` bytes)."""
    payload = F.encode(text_of(html), "UTF-8")
    rows = df.withColumn("__size", F.octet_length(payload)).withColumn("__sha", F.sha2(payload, 256))
    groups = rows.filter(F.col("__size") >= least).groupBy("__size", "__sha").agg(F.max(key).alias("__owner"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    return rows.join(groups, ["__size", "__sha"], "left")


def write_archives(df: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row below ``folder`` and return the index: key, path, offset, length, url, payload_digest, record_type.

    Of rows with equal payloads of at least ``least`` bytes, the one with the largest key is a response and the others are
    revisits of it; rows that repeat the largest key are responses as well. Null html is the empty payload, null urls are
    empty, null keys count as smallest; an empty table gives an empty index and no archive.
    """
    # The owner of each repeated payload is found by digest alone; only who revisits whom is then joined to the pages.
    small = owners(df.select(key, html), key=key, html=html, least=least).filter(F.col("__owner").isNotNull() & ~F.col(key).eqNullSafe(F.col("__owner")))
    revisits = small.select(F.col(key).alias("__k"), "__sha", "__owner").distinct()
    own = df.select(key, url, html).withColumn("__sha", F.sha2(F.encode(text_of(html), "UTF-8"), 256))
    rows = own.join(revisits, F.col(key).eqNullSafe(F.col("__k")) & (own["__sha"] == revisits["__sha"]), "left").select(key, url, html, F.col("__owner").alias("__owner"), revisits["__sha"].isNotNull().alias("__again"))
    schema = T.StructType(
        [df.schema[key]] + [T.StructField(n, k) for n, k in (("path", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("url", T.StringType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in byte_batches(batches, html, 8 << 20):
                if out is None:
                    system, local = store(path)
                    system.create_dir(local.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(local, compression=None)
                index = []
                for ident, link, page, owner, again in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    payload = (page or "").encode()
                    digest = sha1_base32(payload)
                    packer = zlib.compressobj(1, wbits=31)
                    data = packer.compress(record(ident, link, payload, digest, owner, again)) + packer.flush()
                    out.write(data)
                    index.append((ident, path, at, len(data), link, digest, "revisit" if again else "response"))
                    at += len(data)
                kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=schema.names)
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, schema), "warc-index")


def fetched(ranges: list[tuple[int, int]], gap: int = GAP, most: int = FETCH) -> list[tuple[int, int, list[int]]]:
    """(begin, end, positions) of reads that cover the sorted (offset, length) ranges, near ones together."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        end = offset + length
        if reads and offset - reads[-1][1] <= gap and max(end, reads[-1][1]) - reads[-1][0] <= most:
            begin, before, own = reads.pop()
            own.append(i)
            reads.append((begin, max(end, before), own))
        else:
            reads.append((offset, end, [i]))
    return reads


def read_records(index: DataFrame, *, key: str = "page_id") -> DataFrame:
    """The records that the rows of ``index`` name: key, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload as read; a payload that does not have the digest of its header
    fails the read. A revisit carries the digest and the size of the payload it stands for.
    """
    kind = index.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType())]
        + [T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType())]
    )

    def one(data: bytes) -> tuple:
        headers, block = parse(zlib.decompress(data, wbits=31))
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        refers = re.fullmatch(r"<urn:x-page:(.*)>", headers.get("warc-refers-to", ""))
        if headers["warc-type"] == "revisit":
            size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
            return headers["warc-target-uri"], None, size, digest, "revisit", refers[1] if refers else None
        if sha1_base32(payload) != digest:
            raise ValueError(f"{headers['warc-record-id']}: the payload does not have the digest of its header")
        return headers["warc-target-uri"], payload, len(payload), digest, "response", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            keys, paths = batch.column(key), batch.column("path").to_pylist()
            ranges = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            first = 0
            while first < len(paths):
                last = next((i for i in range(first, len(paths)) if paths[i] != paths[first]), len(paths))
                if paths[first] != path:
                    path = paths[first]
                    system, local = store(path)
                    source = system.open_input_file(local)
                for begin, end, own in fetched(ranges[first:last]):
                    data = source.read_at(end - begin, begin)
                    found = [one(data[ranges[first + i][0] - begin :][: ranges[first + i][1]]) for i in own]
                    rows = list(zip(*found))
                    arrays = [keys.take(pa.array([first + i for i in own]))] + [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                first = last

    # Tasks get stretches of archives of about equal bytes.
    size = index.agg(F.sum("length")).first()[0] or 0
    ordered = index.select(key, "path", "offset", "length").repartitionByRange(max(1, -(-size // READ_BYTES)), "path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(run, schema).withColumn("refers_to", F.expr(f"try_cast(refers_to AS {kind.simpleString()})"))


def archive_round_trip(df: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Every row of ``df`` written and read back, as :func:`read_records` returns it."""
    index = write_archives(df, new_path(df.sparkSession, "warc"), key=key, url=url, html=html, least=least)
    return read_records(index, key=key)
