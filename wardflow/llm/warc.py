"""WARC archives with an index that is written first and then drives the reads.

Writing: each task streams its records into archives of its own, one gzip member per record, and
returns an index row (archive, offset, length, url, digest) for each. Archives get a fresh name per
attempt, and only the rows of attempts that succeed reach the index, so a lost executor leaves at
most a file nobody refers to.

Reading: index rows are dealt by archive and stretch, sorted by offset, and neighbouring records are
fetched with one byte-range read, up to READ_BYTES at a time. An archive is never read as a whole by
one task.

Equal payloads of at least MIN_BYTES: the one with the largest page_id is the response, the others
are revisits that carry its page_id. Ties on the largest page_id are all responses, and so are
payloads whose page_ids are all null. A null html is an empty payload, a null url has no target
line, a null page_id has no page line and reads back as null. Repeated rows are records of their own;
empty tables give no archive and no rows.

Archives lie in the folder named by spark.checkpoint.dir, opened with pyarrow's file systems (local
or mounted paths, HDFS, S3, GCS).
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wardflow.sources.layers import new_path, store

from .common import ROWS, pick

MIN_BYTES = 1000
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
#: Bytes of archives a task reads back, about.
TASK_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string"
BACK = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(name: str, page: dict) -> bytes:
    """One WARC record; a revisit has no block and names what it repeats."""
    payload = (page["html"] or "").encode()
    revisit = page["refers_to"] is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{page['digest']}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if page["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(page["url"], safe="%/:=&?~#+!$,;'@()*[]|"))
    if page["page_id"] is not None:
        lines.append(f"X-Page: {page['page_id']}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"X-Refers-To-Page: {page['refers_to']}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """Header fields and block of one compressed record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields | {"block": block}


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds digest (SHA-1) and refers_to: the page whose equal payload is the response, or null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pick(pages, "page_id", "url", "html").withColumns(
        {"digest": F.sha1(payload), "same": F.sha2(payload, 256), "size": F.octet_length(payload)}
    )
    groups = store(
        pages.filter(F.col("size") >= MIN_BYTES).groupBy("same")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "response"),
        "equal_payloads",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return pages.join(groups, "same", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of pages (page_id, url, html, digest, refers_to); returns the stored index."""
    arrow = to_arrow_schema(T._parse_datatype_string(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, archive, offset = None, "", 0
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    rows = []
                    for page in batch.slice(start, ROWS).to_pylist():
                        if out is None or offset >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            archive, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{base}/{archive}", compression=None)
                        member = gzip.compress(record(f"{archive}/{offset}", page), 6, mtime=0)
                        out.write(member)
                        kind = "response" if page["refers_to"] is None else "revisit"
                        rows.append((archive, offset, len(member), page["page_id"], page["url"], page["digest"], kind))
                        offset += len(member)
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            if out is not None:
                out.close()

    pages = pages.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))
    return store(pages.mapInArrow(run, INDEX), "warc_index")


def fetch(entries: list[tuple[str, int, int]], source) -> Iterator[bytes]:
    """The records of one stretch: (archive, offset, length) in order, read at once."""
    first = entries[0][1]
    data = source.read_at(entries[-1][1] + entries[-1][2] - first, first)
    for _, offset, length in entries:
        yield data[offset - first : offset - first + length]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that the index rows name and return what they say."""
    arrow = to_arrow_schema(T._parse_datatype_string(BACK))

    def said(member: bytes) -> tuple:
        found = parse(member)
        kind, digest = found["WARC-Type"], found["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(found["X-Payload-Length"])
        if kind == "response":
            size, own = len(found["block"]), hashlib.sha1(found["block"]).hexdigest()
            if own != digest:
                raise ValueError(f"payload of {found['WARC-Record-ID']} has digest {own}, not {digest}")
        page, refers = found.get("X-Page"), found.get("X-Refers-To-Page")
        return page and int(page), size, digest, kind, refers and int(refers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        opened, source = None, None

        def table(entries) -> pa.RecordBatch:
            nonlocal opened, source
            if entries[0][0] != opened:
                if source is not None:
                    source.close()
                opened, source = entries[0][0], system.open_input_file(f"{base}/{entries[0][0]}")
            rows = [said(m) for m in fetch(entries, source)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        stretch: list[tuple[str, int, int]] = []
        for batch in batches:
            for entry in zip(*[c.to_pylist() for c in batch.columns]):
                archive, offset, length = entry
                if stretch and (
                    archive != stretch[-1][0] or offset - stretch[-1][1] - stretch[-1][2] > GAP_BYTES
                    or offset + length - stretch[0][1] > READ_BYTES
                ):
                    yield table(stretch)
                    stretch = []
                stretch.append(entry)
        if stretch:
            yield table(stretch)
        if source is not None:
            source.close()

    # by the bytes to read, not by those of the index, which is some hundred times smaller
    total = index.agg(F.sum("length")).first()[0] or 0
    wanted = index.select("archive", "offset", "length", F.floor(F.col("offset") / READ_BYTES).alias("part"))
    dealt = wanted.repartition(int(total // TASK_BYTES) + 1, "archive", "part").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(run, BACK)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, then read every record back through the index."""
    folder = new_path(pages.sparkSession, "warc")
    return read_records(write_archives(with_revisits(pages), folder), folder)


def target_uri(fields: dict) -> str | None:
    return unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
