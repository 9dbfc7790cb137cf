"""WARC archives with an index written first and coalesced range reads.

Writing: payload digests are aggregated to find groups of equal payloads, of which only those
of two and more come back to the pages: to where these lie while groups are few
(``MOST_BROADCAST``), else in a shuffle in which payloads move once. Then every task writes its pages to an archive in the shared folder, one gzip member per record, and
returns an index row (path, offset, length, url, digest) for each. Archive names hold the
task attempt, and the index only has rows of attempts that ended well, so archives of
lost or repeated attempts are never read.

Reading: index rows are range-partitioned and sorted by (path, offset); neighbours with
small gaps are fetched in one read and cut apart, whatever selection the index is
filtered to.

Defined cases
- null html: an empty payload; null url: an empty target.
- equal payloads under ``least_bytes`` are not linked.
- the record with the largest page_id of a group is the response; rows that repeat that
  page_id are responses too. In a group without any page_id all are responses.
- null page_id: written and returned like any other, with a null id.
- very long payloads: a record is in memory whole when it is written and read; reads of several
  records end at ``most`` bytes, a longer record is a read of its own.
- extra columns are not read, whatever their names. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MOST_BROADCAST, materialize, scratch_path

DATE = "2000-01-01T00:00:00Z"
INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string())])
INDEX_DDL = "path string, offset long, length long, url string, digest string"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head of its response, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of a record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return fields, head, payload


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _writer(folder: str, file_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, path, offset, count = None, None, 0, 0
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                page, url, html, digest, refers = (c[at].as_py() for c in batch.columns)
                if out is None or offset >= file_bytes:
                    if out is not None:
                        out.close()
                    store, inner = _open(path := f"{name}-{count:04d}.warc.gz")
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out, offset, count = store.open_output_stream(inner, compression=None), 0, count + 1
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = packer.compress(record(page, url, (html or "").encode(), digest, refers)) + packer.flush()
                out.write(raw)
                rows.append((path, offset, len(raw), url, digest))
                offset += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, INDEX)], schema=INDEX)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 1000, file_bytes: int = 1 << 30, level: int = 1) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the index.

    ``folder`` is a URI that all executors reach; the shared folder by default.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("content"), F.octet_length(html).alias("size"))
    # A group of copies is one row after the map-side combine; pages in it are told apart by skew-aware joins.
    groups = rows.where(F.col("size") >= least_bytes).groupBy("content").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("content", "top")
    groups = materialize(groups, "equal-payloads")
    groups = F.broadcast(groups) if groups.count() <= MOST_BROADCAST else groups.hint("shuffle_hash")
    rows = rows.join(groups, "content", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    rows = rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return materialize(rows.mapInArrow(_writer(folder, file_bytes, level), INDEX_DDL), "warc-index")


def _reader(gap: int, most: int):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def identity(value: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(found[1]) if found else None

    def cut(path: str, spans: list[tuple[int, int]]) -> Iterator[bytes]:
        store, inner = _open(path)
        with store.open_input_file(inner) as file:
            start, end = spans[0][0], max(a + n for a, n in spans)
            raw = file.read_at(end - start, start)
        for a, n in spans:
            yield zlib.decompress(raw[a - start : a - start + n], 31)

    def rows(path: str, spans: list[tuple[int, int]], urls: list) -> list[tuple]:
        found = []
        for raw, url in zip(cut(path, spans), urls):
            fields, head, payload = parse(raw)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            refers = identity(fields.get("WARC-Refers-To"))
            size = int(re.search(rb"Content-Length: (\d+)", head)[1])
            if refers is None and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                raise ValueError(f"a record of {path} doesn't have the payload that it names")
            found.append((identity(fields["WARC-Record-ID"]), url, size, digest, fields["WARC-Type"], refers, payload if refers is None else None))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, spans, urls = None, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows(path, spans, urls)), schema)], schema=schema)

        for batch in batches:
            for name, offset, length, url in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if spans and (name != path or offset > spans[-1][0] + spans[-1][1] + gap or offset + length - spans[0][0] > most):
                    yield flush()
                    spans, urls = [], []
                path = name
                spans.append((offset, length))
                urls.append(url)
        if spans:
            yield flush()

    return run


def read_archives(index: DataFrame, *, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """The records that ``index`` (or any selection of its rows) points at.

    Reads of up to ``most`` bytes cover records that lie at most ``gap`` bytes apart.
    A revisit's payload is null.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("path", "offset", "length", "url").repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")
    return rows.mapInArrow(_reader(gap, most), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_report(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives."""
    return read_archives(write_archives(pages)).drop("url", "payload")
