"""WARC archives: writing pages as gzip members, and a splittable reader.

Writing: one file a task, one gzip member a record, under a name of its own; only files that a finished task reports are
read, so a task that runs twice costs a stray file and no wrong record. Of records with equal payloads of at least
`least` bytes the one with the smallest page_id is a response, the others are revisits that refer to it.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic, takes a place as a member only if it
inflates to a WARC header, ends with a right checksum, and is followed by more members or the file's end; it then reads
member after member and owns those that start inside its range, past whose end it reads on as far as the last one goes.

Defined results: null html is the empty payload; a null page_id counts as larger than any other and comes back null (if
no equal payload has an id, all are responses); rows that repeat the smallest page_id are all responses; a page_id or
url may hold any text (header values are percent-encoded); other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
#: Members that must follow each other for the first one found in a range to be taken. Payloads written here are UTF-8,
#: which no gzip member is (its second byte is none), so one member would do; in archives from elsewhere a payload that holds
#: a longer chain of stored members, cut by a range's edge, would be taken for records.
CHAIN = 16
#: Ranges a task reads at most, where there are many.
RANGES = 8
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL as Spark writes it (file:/x, hdfs://..., s3a://...)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))


def record_id(page_id: str | None, digest: str, kind: str) -> str:
    """A record's id: drawn from its page and payload, so that a revisit can name the response it refers to."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def member(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit has the response's HTTP head, whose Content-Length tells the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block, kind = (http + payload, "response") if refers_to is None else (http, "revisit")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"{k}: {quote(v, safe=':/?&=#%~+,;@!$()*' if k == 'WARC-Target-URI' else '')}" for k, v in (("WARC-Target-URI", url and url.replace("%", "%25")), ("X-Page-ID", page_id), ("X-Refers-To-Page-ID", refers_to)) if v is not None]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def marked(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, html, digest, refers_to) of pages (page_id, html, url if any)."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"), html.alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= least)
    # Only digests that occur more than once reach the join; it can be split where one of them has many pages.
    copies = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    out = rows.join(copies.select("digest", "first"), "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 100) -> DataFrame:
    """Write the pages' records below a shared folder; (path, bytes, records) of the files."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        path, records, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
        out = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = out or files.open_output_stream(path, compression=None)
                text = lambda x: None if x is None or x != x else str(x)
                data = member(text(row.page_id), text(row.url), row.html.encode(), row.digest, text(row.refers_to))
                out.write(data)
                records, size = records + 1, size + len(data)
        if out:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path.rpartition('/')[2]}"], "bytes": [size], "records": [records]})

    rows = marked(pages, least).select(F.col("page_id").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return stored(rows.mapInPandas(run, "path string, bytes long, records long"), "warc-files")


class Source:
    """Bytes of a file by position. One block is held, so that what is read on from it costs no request.

    Up to `end`, where the reader's range ends, blocks are of `block` bytes; what lies behind comes in steps.
    """

    def __init__(self, path: str, end: int, block: int = 1 << 20, step: int = 1 << 14):
        files, name = opened(path)
        self.file, self.end, self.block, self.step = files.open_input_file(name), end, block, step
        self.size, self.start, self.held, self.fetched = self.file.size(), 0, memoryview(b""), 0

    def read(self, at: int, n: int = 0) -> memoryview:
        """n bytes from a place on, or without n some, up to a step; fewer where the file ends."""
        own = self.held[at - self.start :] if self.start <= at else self.held[:0]
        if len(own) < min(n or 1, self.size - at):
            wanted = max(n, min(self.block, max(self.step, self.end - at)))
            more = self.file.read_at(max(0, min(wanted - len(own), self.size - at - len(own))), at + len(own))
            self.fetched += len(more)
            self.held, self.start = memoryview(bytes(own) + more), at
            own = self.held
        return own[: n or self.step]


def inflate(source: Source, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at a place, and where the member ends; None if there is no such record."""
    unpack, parts, checked = zlib.decompressobj(31), [], False
    place = at
    try:
        while not unpack.eof:
            data = source.read(place)
            if not data:
                return None
            parts.append(unpack.decompress(data))
            place += len(data)
            if not checked and sum(map(len, parts)) >= 5:
                checked = True
                if not b"".join(parts[:2]).startswith(b"WARC/"):
                    return None
    except zlib.error:
        return None
    end = place - len(unpack.unused_data)
    return (b"".join(parts), end) if checked and (end == source.size or source.read(end, 3) == MAGIC) else None


def parsed(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.lower(): unquote(v.strip()) for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["warc-type"]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (digest != fields["warc-payload-digest"].removeprefix("sha256:") or length != len(payload)):
        raise ValueError(f"the payload of page {fields.get('x-page-id')} differs from its digest")
    return fields.get("x-page-id"), fields.get("warc-target-uri"), length, digest, kind, fields.get("x-refers-to-page-id"), payload


def chained(source: Source, at: int, end: int, n: int) -> list[tuple[bytes, int]]:
    """The members that follow each other from a place on, to the range's end or n of them, each with its end; none if they don't.

    A payload that is itself an archive may hold members in a stored block; where that block ends, their chain breaks.
    """
    out: list[tuple[bytes, int]] = []
    while at < end and len(out) < n:
        found = inflate(source, at)
        if found is None:
            return []
        out.append(found)
        at = found[1]
    return out


def records_in(path: str, start: int, end: int) -> Iterator[tuple]:
    """Records whose member starts in start..end of a file."""
    yield from records_of(Source(path, end), start, end)


def records_of(source: Source, start: int, end: int) -> Iterator[tuple]:
    at, sure = start, start == 0
    while at < end:
        if found := chained(source, at, end, 1 if sure else CHAIN):
            for record, at in found:  # noqa: B020
                yield parsed(record)
            sure = True
            continue
        sure = False
        at += 1  # no record here: on to the next magic
        while at < end:
            data = bytes(source.read(at, min(source.step, end - at) + 2))
            if (hit := data.find(MAGIC)) >= 0:
                at += hit
                break
            at += max(1, len(data) - 2)


def read_warc(spark: SparkSession, files: DataFrame, split: int = 32 << 20, payload: bool = True) -> DataFrame:
    """All records of files (path, bytes): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") / split)).cast("int")
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    ranges = ranges.select("path", (F.col("k") * F.lit(split).cast("long")).alias("start"), F.least("bytes", (F.col("k") + 1) * F.lit(split).cast("long")).alias("end"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for path, start, end in zip(batch["path"], batch["start"], batch["end"], strict=True):
                rows = []
                for row in records_in(path, int(start), int(end)):
                    rows.append(row if payload else (*row[:-1], None))
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    n_ranges = ranges.count()
    tasks = max(1, min(n_ranges, max(2 * spark.sparkContext.defaultParallelism, -(-n_ranges // RANGES))))
    return ranges.repartition(tasks).mapInPandas(run, RECORD)  # dealt in turn, so that each gets as many
