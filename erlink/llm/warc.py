"""WARC archives, index first.

write() turns rows into WARC/1.1 records, a gzip member each, in segment files of the shared folder, and an index with a
row per record: file, offset, length, url, digest. The index is the authority: each task attempt writes files of its
own name, and only the index rows of attempts that Spark commits name their files, so retried and speculative tasks do
no harm. read() takes index rows, sorts them by file and offset, coalesces neighbouring byte ranges and reads each once.

Of records with equal payloads of at least min_bytes bytes, the one with the smallest id is a response and the others
are revisits without a body, which name it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erlink.llm.common import materialize, scratch_path, small

SEGMENT_BYTES = 64 << 20
RANGE_BYTES = 1 << 20
#: A task reads ranges of this many bytes at most, on average; there are READERS tasks for each core of the cluster at least.
READ_BYTES, READERS = 64 << 20, 3
#: Ranges that are at most this far apart are read together.
GAP_BYTES = 64 << 10
LEVEL = 1
#: The tables have no crawl time; a parameter of write().
DATE = "1970-01-01T00:00:00Z"
RECORD_ID = "urn:page:"

INDEX = "page_id bigint, record_type string, refers_to bigint, url string, payload_digest string, payload_bytes bigint, file string, offset bigint, length bigint"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A record, uncompressed. A revisit has only the HTTP head. Control characters of the url are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP header fields (names in lower case) and the payload of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    named = lambda block: {k.lower(): v for k, _, v in (x.partition(": ") for x in block.decode().split("\r\n")[1:])}
    fields = named(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, named(http), payload


def page_number(record_id: str | None) -> int | None:
    digits = (record_id or "").strip("<>").removeprefix(RECORD_ID)
    return int(digits) if digits else None


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Writes a record per row of pages and returns the index, itself a table of the shared folder.

    A null html is an empty payload; null urls get no target. Rows that repeat the smallest id of equal payloads are
    all responses. A null id can be a revisit, and is a response only if no equal payload has an id. An empty table
    writes no file and gives an empty index; very long payloads are one record each. Other columns are not read, so
    they may have any name.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    many = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = materialize(many.select("sha", "first_id"), "warc-copies")
    rows = rows.join(small(many, many.count(), 96), "sha", "left")  # no shuffle of the pages unless copies are very many
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= SEGMENT_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.encode()
                    digest = digest32(payload)
                    raw = record(page_id, url, payload, digest, refers_to, date)
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = pack.compress(raw) + pack.flush()
                    out.write(member)
                    index.append((page_id, "response" if refers_to is None else "revisit", refers_to, url, digest, len(payload), f"{folder}/{name}", at, len(member)))
                    at += len(member)
                if index:
                    page, kind, ref, urls, digests, sizes, files, offsets, lengths = zip(*index, strict=True)
                    whole = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((page, kind, ref, urls, digests, sizes, files, offsets, lengths), whole, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(index: DataFrame) -> DataFrame:
    """file, start, stop and the members (offset, length) of each range to read: neighbours within GAP_BYTES, up to RANGE_BYTES."""
    order = Window.partitionBy("file").orderBy("offset")  # a segment's records: bounded by its size
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order)
    far = F.coalesce(gap > GAP_BYTES, F.lit(True)) | (F.expr(f"offset div {RANGE_BYTES}") != F.lag(F.expr(f"offset div {RANGE_BYTES}")).over(order))
    numbered = index.select("file", "offset", "length", F.when(far, 1).otherwise(0).alias("new")).withColumn("range", F.sum("new").over(order))
    return numbered.groupBy("file", "range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of the records that index names.

    Bytes and digest of a response are counted and computed from what is read; a revisit has no body, so its payload is
    null and the two are those that its record states. payloads=False leaves the payload out. The ranges are dealt to
    tasks by their bytes, in turn, since the index says nothing of the size of what it names.
    """
    picked = ranges(index).select("file", "start", "stop", "members")
    held = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(READERS * index.sparkSession.sparkContext.defaultParallelism, -(-held // READ_BYTES))
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
    if not payloads:
        del kinds["payload"]

    def run(batches):
        for batch in batches:
            for file, start, stop, parts in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "members")), strict=True):
                store, path = open_store(file)
                with store.open_input_file(path) as f:
                    f.seek(start)
                    block = f.read(stop - start)
                rows = []
                for m in parts:
                    at = m["offset"] - start
                    fields, http, payload = parse(zlib.decompress(block[at : at + m["length"]], 31))
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    known = (int(http["content-length"]), said, None) if fields["warc-type"] == "revisit" else (len(payload), digest32(payload), payload)
                    rows.append((page_number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], page_number(fields.get("warc-refers-to")), *known))
                columns = list(zip(*rows, strict=True))[: len(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
    return picked.repartition(tasks).mapInArrow(run, schema + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the archives of pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row for every row of pages, repeated ones too; an empty table gives none. Null, very long and other values as in
    write() and read().
    """
    back = read(write(pages, id_col, url_col, html_col, min_bytes), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) s from pages),
d as (select *, min(page_id) over (partition by s) f, list_transform(range(0, 8), lambda i: ('0x' || substr(s, i * 5 + 1, 5))::bigint) v from p)
select page_id, strlen(h)::bigint payload_bytes,
  list_reduce(list_transform(v, lambda x: list_reduce(list_transform([32768, 1024, 32, 1], lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // q) % 32 + 1)::bigint, 1)), lambda a, b: a || b)), lambda a, b: a || b) payload_digest,
  case when page_id is not distinct from f then 'response' else 'revisit' end record_type, case when page_id is distinct from f then f end refers_to from d"""
