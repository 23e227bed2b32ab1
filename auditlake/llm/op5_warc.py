"""WARC archives: an index written first, then coalesced reads of byte ranges.

Each task writes its pages as records of its own archives, one gzip member each, and
returns the index row of every record: archive, offset, length, URL and digest.  An
archive's name is new for every attempt of a task, and only rows of attempts that
end well enter the index, so a lost executor leaves no half archive in it.  Payloads
that very many pages have find their response by broadcast and are dealt over all
tasks; no task gets all pages of one payload.  Readers take index rows in order of archive and offset and join near ranges into one read.

Defined cases: null html is an empty payload and null url an empty target; of pages
with equal payloads of at least 1000 bytes the largest page_id is the response; a
null page_id is smaller than any other; rows repeated with that largest page_id are
all responses; an empty table gives an empty result; columns other than page_id, url
and html are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import HEAVY, shared_path, stored

MIN_REVISIT_BYTES = 1000
#: An archive ends when it has so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Ranges with gaps up to the first are read together, up to the second.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: Bytes of an archive that one task reads together, and of all that a task reads, on average.
STRETCH_BYTES, TASK_BYTES = 4 << 20, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string"


def open_store(uri: str):
    """(file system, path) of a path in the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id, url: str, html: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, uncompressed."""
    # a URL must not end its header line
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(html)}"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if refers_to is None:
        block = head + html
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        block = head
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; fails if lengths or digest disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    payload = rest[:n].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError("payload and digest disagree")
    return fields, payload


def with_digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, html and digest, and refers_to, the page_id of the response if that is another page."""
    rows = pages.transform(with_digests)
    # only digests and ids are grouped; equal ids combine before the shuffle
    again = stored(rows.where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-again")
    total = again.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > F.lit(total)
    few = F.broadcast(again.where(heavy).select("digest", F.col("top").alias("heavy_top"), F.lit(True).alias("heavy")))  # fewer than HEAVY
    # pages of a heavy payload get keys that no other payload has, many of them, so that they do not meet in one task
    spread = F.concat_ws("-", "digest", F.xxhash64("page_id", "url", F.spark_partition_id()))
    rows = rows.join(few, "digest", "left").withColumn("key", F.when(F.col("heavy"), spread).otherwise(F.col("digest")))
    rows = rows.join(again.where(~heavy).select(F.col("digest").alias("key"), "top"), "key", "left")
    top = F.when(F.col("heavy"), F.col("heavy_top")).otherwise(F.col("top"))
    return rows.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(top), top).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes every page into archives below folder and returns the stored index."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    rows = with_responses(pages)

    def write(batches):
        store, path = open_store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    member = gzip.compress(record(page_id, url or "", (html or "").encode(), digest, refers_to, date), 5, mtime=0)
                    out.write(member)
                    index.append((name, at, len(member), page_id, url, digest))
                    at += len(member)
                if index:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*index, strict=True), kinds, strict=True)], ["archive", "offset", "length", "page_id", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]]):
    """(archive, start, end, records) from sorted (archive, offset, length)."""
    group: list[tuple[str, int, int]] = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - (group[-1][1] + group[-1][2]) > GAP_BYTES or row[1] + row[2] - group[0][1] > READ_BYTES):
            yield group[0][0], group[0][1], group[-1][1] + group[-1][2], group
            group = []
        group.append(row)
    if group:
        yield group[0][0], group[0][1], group[-1][1] + group[-1][2], group


def read_records(index: DataFrame, folder: str, html: bool = False) -> DataFrame:
    """The records that the index rows name; with html, their payloads as well."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * html

    def page(uri: str):
        text = uri.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def read(batches):
        store, path = open_store(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for archive, start, end, group in ranges(rows):
                with store.open_input_file(f"{path}/{archive}") as f:
                    data = f.read_at(end - start, start)
                out = []
                for _, offset, length in group:
                    fields, payload = parse(gzip.decompress(data[offset - start : offset - start + length]))
                    refers = fields.get("WARC-Refers-To")
                    out.append((page(fields["WARC-Record-ID"]), int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], page(refers) if refers else None) + ((payload.decode() if refers is None else None),) * html)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * html
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * html)

    # stretches of an archive, dealt into as many tasks as their bytes need, not as the index has bytes
    size = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    rows = index.select("archive", "offset", "length", stretch.alias("stretch"))
    ordered = rows.repartition(max(1, math.ceil(size / TASK_BYTES)), "archive", "stretch").sortWithinPartitions("archive", "offset")
    return ordered.drop("stretch").mapInArrow(read, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_records(write_archives(pages, folder), folder)


ORACLE = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT d, max(page_id) AS top FROM p WHERE n >= {MIN_REVISIT_BYTES} GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN t USING (d)
"""
