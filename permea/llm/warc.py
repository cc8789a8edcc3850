"""WARC archives that are written and read through an index.

Writing: each task writes the records of its rows to one archive of its own in the
shared folder, every record a gzip member, and returns the index: file, offset, length,
URL, digest and the record's kind.  Spark commits the index; an archive that a lost or
repeated task left behind is in no index row and so is never read.  A payload that an
earlier record holds (equal bytes, ``LEAST`` or more of them) becomes a ``revisit``
record, which names the response's page and has no payload.

Reading: the selected index rows are range partitioned by (file, offset).  Each
task opens an archive once, joins ranges with at most ``GAP`` bytes between them up to
``READ`` bytes (a longer record is a range of its own), reads each such range at once and
takes the records from it.  Every payload read is held against its digest.

Scale: the pages are read twice and never shuffled unless the repeated digests are too
many to broadcast; the digests alone are aggregated (partially, before the shuffle).
A digest of over a thousandth of all repeated rows (under 1000 of them) is broadcast in any
case, so no hot page gathers in one task.  Archives are opened with pyarrow's file
systems (local, HDFS, S3, GCS and Azure addresses).

Defined cases: NULL or empty html is an empty payload, always a response; equal payloads
under ``LEAST`` bytes are all responses; all rows with the smallest page id of a payload
are responses (a NULL id is larger than any); a NULL URL leaves its field out,
control characters and blanks in URLs are percent-encoded in the record (the index has
them as they are); repeated rows are records of their own; an empty table gives an
empty index; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permea.llm.common import slices
from permea.session import checkpoint_path, materialize

LEAST = 100
GAP, READ = 64 << 10, 4 << 20
#: Bytes of archives that a task reads.
TASK_BYTES = 16 << 20
#: Of rows without a time of their own.
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, "
         "file string, offset long, length long")


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri) if ":" in uri else f"file://{uri}")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None,
           revisit: bool = False) -> bytes:
    """One WARC/1.1 record with the HTTP head, and the payload unless it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)),
            ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """A record's fields, its payload, and the payload's length by its HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if version != "WARC/1.1" or len(rest) != n + 4:
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, payload, int(re.search(rb"Content-Length: (\d+)", http)[1])


def _decided(pages: DataFrame) -> DataFrame:
    """Rows with their digest and, where the payload stands under a smaller id, that id."""
    rows = pages.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn(
        "digest", F.sha2(F.col("html").cast("binary"), 256))
    repeated = materialize(rows.filter(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.max(F.col("page_id").isNull()).alias("null_id"),
        F.max("page_id").alias("last_id"), F.count("*").alias("n"))
        .filter((F.col("first_id") < F.col("last_id")) | (F.col("null_id") & F.col("first_id").isNotNull())), "warc-repeated")
    total = repeated.agg(F.sum("n")).first()[0]
    if not total:
        return rows.withColumn("first_id", F.lit(None).cast("long"))
    heavy = F.broadcast(repeated.filter(F.col("n") > total / 1000).select("digest", F.col("first_id").alias("heavy_id")))
    light = repeated.filter(F.col("n") <= total / 1000).select("digest", "first_id")
    # Rows that need no second join get keys of their own, which match nothing and spread.
    needs = F.col("heavy_id").isNull() & (F.col("payload_bytes") >= LEAST)
    rows = rows.join(heavy, "digest", "left").withColumn("light_key", F.when(needs, F.col("digest")).otherwise(
        F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    light = light.withColumnRenamed("digest", "light_key")
    return rows.join(light, "light_key", "left").withColumn("first_id", F.coalesce("heavy_id", "first_id"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Writes the archives into ``folder`` (one in the shared checkpoint folder if not given) and returns the index."""
    folder = folder or checkpoint_path(pages.sparkSession, f"warc-{uuid.uuid4().hex[:12]}")
    rows = _decided(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                                 F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= LEAST)
    rows = rows.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                for part in slices(batch, "html"):
                    if out is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    index = []
                    for row in part.to_pylist():
                        payload = row["html"].encode()
                        raw = record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["refers_to"] is not None)
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        out.write(member)
                        index.append((row["page_id"], row["url"], row["digest"], len(payload),
                                      "response" if row["refers_to"] is None else "revisit", row["refers_to"],
                                      f"{folder}/{name}", at, len(member)))
                        at += len(member)
                    cols = list(zip(*index, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                     [c.split()[0] for c in INDEX.split(", ")])
        finally:  # the index is committed after the archive is closed
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, INDEX), "warc-index")


def _ranges(rows: list[dict]) -> Iterator[tuple[int, int, list[dict]]]:
    """Joins the ranges of rows of one file, sorted by offset: start, end, rows."""
    start = end = None
    held: list[dict] = []
    for r in rows:
        first, last = r["offset"], r["offset"] + r["length"]
        if held and (first - end > GAP or last - start > READ):
            yield start, end, held
            held = []
        if not held:
            start, end = first, last
        end = max(end, last)
        held.append(r)
    if held:
        yield start, end, held


def read_records(index: DataFrame, where: Column | None = None, payloads: bool = True) -> DataFrame:
    """The selected records as their archives have them: page_id, url, record_type, digest,
    payload_bytes, refers_to and, with ``payloads``, the payload (NULL of a revisit)."""
    wanted = (index if where is None else index.filter(where)).select("file", "offset", "length")
    order = ["file", "offset"]
    total = wanted.agg(F.sum("length")).first()[0] or 0  # the index is small beside what it points to
    wanted = wanted.repartitionByRange(max(1, math.ceil(total / TASK_BYTES)), *order).sortWithinPartitions(*order)
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def one(raw: bytes) -> tuple:
        fields, payload, n = parse(zlib.decompress(raw, 31))
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response":
            n = len(payload)
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"a payload differs from its digest {digest}")
        number = lambda name: int(fields[name]) if name in fields else None
        return (number("X-Page-Id"), fields.get("WARC-Target-URI"), kind, digest, n, number("X-Refers-To-Page-Id"),
                payload if kind == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream = None, None
        try:
            for batch in batches:
                rows = batch.to_pylist()
                at = 0
                while at < len(rows):
                    file = rows[at]["file"]
                    to = next((i for i in range(at, len(rows)) if rows[i]["file"] != file), len(rows))
                    if file != name:
                        if stream is not None:
                            stream.close()
                        system, path = _file_system(file)
                        name, stream = file, system.open_input_file(path)
                    for start, end, held in _ranges(rows[at:to]):
                        stream.seek(start)
                        raw = stream.read(end - start)
                        found = [one(raw[r["offset"] - start:r["offset"] - start + r["length"]]) for r in held]
                        cols = list(zip(*found, strict=True))
                        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
                        if payloads:
                            arrays.append(pa.array(cols[6], pa.large_binary()).cast(pa.binary()))
                        yield pa.RecordBatch.from_arrays(arrays, names + ["payload"] * payloads)
                    at = to
        finally:
            if stream is not None:
                stream.close()

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
    return wanted.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def op13_indexed_warc(spark, sf_dir: str) -> DataFrame:
    from permea.llm.common import table
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
