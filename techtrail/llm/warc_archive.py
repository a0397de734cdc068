"""Web archives: pages as WARC records, and a normaliser for archives that were compressed as one stream.

An archive that is one gzip stream can only be read from its beginning. The normaliser inflates such a stream once,
writes every record as a gzip member of its own, and beside the archive an index of the members' offsets; after that any record can be read by itself,
and a large archive by many tasks. Three steps, each a table of what it has written:

1. write_archives: a task writes its pages into archives of about ARCHIVE bytes, each one gzip stream;
2. normalise: an archive is one task's work, of which it holds one record at a time;
3. read_records: the indexes' rows are dealt by stretches of an archive, and members are read at their offsets.

Files get names of their own in each attempt of a task, and only those that a finished task has listed count, so a lost executor leaves files that nobody reads.
They are opened by pyarrow's file systems, in the folder that the session's spark.checkpoint.dir names or that the caller gives.

Of pages with equal payloads (equal SHA-256 and length) of at least LEAST bytes the one with the largest page_id is a response, and the others are revisits that refer to it, without the payload.

Defined cases: a null html is an empty payload; a null page_id is kept, and is a response unless a page with an id has the same payload; rows of one page_id and payload are all responses or all
revisits; a null url has no WARC-Target-URI; characters that a header can't hold are percent-encoded in it. No pages: no archives and no rows. A page's size is bounded by memory alone. An archive that ends early, or a
payload without its digest, raises ValueError. Only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techtrail.llm.common import stash, text_or_empty
from techtrail.sources.shared import new_path, remove_path

#: Payloads under this size are stored as often as they come.
LEAST = 1000

#: Bytes of records after which a task begins another archive.
ARCHIVE = 128 << 20

#: Bytes of an archive that are read by one task, about.
STRETCH = 8 << 20

#: Tasks of the normaliser, at most; each takes archive after archive.
TASKS = 10_000

#: Capture time of pages, which have none.
DATE = "1970-01-01T00:00:00Z"

# Formats of the archive and of the record of a repeated payload.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record's bytes; fields that are None are left out."""
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(page_id: str | None) -> str:
    return f"<{URN}{quote(page_id, safe='') if page_id is not None else ''}>"


def _page_of(name: str | None) -> str | None:
    found = (name or "").strip("<>").removeprefix(URN)
    return unquote(found) or None


def page_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A page as an HTTP response, without its payload where it refers to another page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = {
        "WARC-Record-ID": _name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=-._~|"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": _name(refers_to) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return record("revisit" if revisit else "response", fields, head if revisit else head + payload)


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_record(stream: BinaryIO) -> tuple[bytes, dict[str, str], int] | None:
    """The next record: its bytes, its fields (names in small letters) and where its block begins; None at the end."""
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    lines = []
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line.endswith(b"\n"):
            raise ValueError("the archive ends in a record's fields")
        lines.append(line)
    fields = _headers(lines)
    n = int(fields["content-length"])
    rest = stream.read(n + 4)
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the archive ends in a record's block")
    head = first + b"".join(lines) + line
    return head + rest, fields, len(head)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Writes rows (id, url, payload, digest, refers_to) into archives; a row (path, records, bytes) for each."""
    system, root = _open(folder)
    out = sink = path = None
    n = size = 0

    def listed() -> pa.RecordBatch:
        out.close()
        sink.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    for batch in batches:
        for i in range(batch.num_rows):
            page, url, payload, digest, refers = (batch.column(j)[i] for j in range(5))
            made = page_record(page.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers.as_py())
            if out is None:
                system.create_dir(root, recursive=True)
                path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                sink = system.open_output_stream(f"{root}/{path}", compression=None)
                out = gzip.GzipFile(filename="", mode="wb", compresslevel=1, fileobj=sink, mtime=0)
                out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            out.write(made)
            n, size = n + 1, size + len(made)
            if size >= limit:
                yield listed()
                out = None
    if out is not None:
        yield listed()


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """id, url, payload, digest, refers_to: the texts of pages (page_id, url, html), and the page that each one refers to, if any."""
    payload = text_or_empty("html").cast("binary")
    rows = pages.select(F.col("page_id").alias("id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("same"))
    copies = rows.where(F.col("n") >= least).groupBy("same", "n").agg(F.max("id").alias("last"), F.count("*").alias("times"))
    several = stash(copies.where("times > 1 and last is not null").select("same", "n", "last"))  # a table: Spark knows its size, and can split the rows of a payload with very many copies
    refers = F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last").cast("string"))
    return rows.join(several, ["same", "n"], "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.sha1("payload").alias("digest"), refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, limit: int = ARCHIVE) -> DataFrame:
    """path, records, bytes of archives of pages, each one gzip stream. They are written when this is called."""
    return stash(with_revisits(pages, least).mapInArrow(lambda batches: _write(batches, folder, limit), "path string, records long, bytes long"))


def split_members(source: BinaryIO, out: BinaryIO) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Inflates an archive once and writes each record as a member of its own: offset, length and fields of each."""
    offset = 0
    with gzip.GzipFile(fileobj=source, mode="rb") as stream:
        while (found := read_record(stream)) is not None:
            data, fields, _ = found
            member = gzip.compress(data, compresslevel=6, mtime=0)
            out.write(member)
            yield offset, len(member), fields
            offset += len(member)


def _normalise(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows (path) of archives: a row (path, records, bytes) for each that is written in their place."""
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    for batch in batches:
        for source in batch.column(0).to_pylist():
            of, place = _open(source)
            name, n, end = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            with of.open_input_stream(place, compression=None, buffer_size=1 << 20) as read, system.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as out:
                with system.open_output_stream(f"{root}/{name}.idx", compression=None, buffer_size=1 << 20) as index:
                    for offset, length, fields in split_members(read, out):
                        index.write(f"{offset}\t{length}\t{fields['warc-type']}\t{fields['warc-record-id']}\n".encode())
                        n, end = n + 1, offset + length
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([end], pa.int64())], names=["path", "records", "bytes"])


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """path, records, bytes of archives with a member for each record and an index, made of archives (path). They are written when this is called."""
    tasks = max(1, min(TASKS, archives.count()))
    return stash(archives.select("path").repartition(tasks).mapInArrow(lambda batches: _normalise(batches, folder), "path string, records long, bytes long"))


def read_index(normalised: DataFrame, folder: str) -> DataFrame:
    """path, offset, length, type, name of the members of archives that normalise has listed (path), from the indexes in their folder."""
    spark = normalised.sparkSession
    schema = "path string, offset long, length long, type string, name string"
    if normalised.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema("offset long, length long, type string, name string").option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.idx").csv(folder)
    rows = rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]+)\.warc\.gz\.idx$", 1))
    listed = normalised.select("path", F.regexp_extract("path", r"([0-9a-f]+)\.warc\.gz$", 1).alias("file"))
    return rows.join(listed, "file").select("path", "offset", "length", "type", "name")


def parse_member(data: bytes) -> tuple[str, str | None, str | None, str | None, int | None, str | None, bytes | None]:
    """type, page_id, url, refers_to, payload_bytes, digest and payload of a member; a revisit's size and digest are what its fields say, and it has no payload."""
    inflate = zlib.decompressobj(wbits=31)
    raw = inflate.decompress(data)
    if not inflate.eof or inflate.unused_data:
        raise ValueError("not one gzip member")
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = _headers(head.split(b"\r\n")[1:])
    block = block[: int(fields["content-length"])]
    kind = fields["warc-type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = int(_headers(http.split(b"\r\n")[1:]).get("content-length", 0))
    if kind == "response":
        if len(payload) != size or (digest and hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {fields['warc-record-id']} is not what its fields say")
        digest = hashlib.sha1(payload).hexdigest()
    return kind, _page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), _page_of(fields.get("warc-refers-to")), size, digest, payload if kind == "response" else None


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Rows (path, offset, length), sorted: members, read at their offsets."""
    names = ["record_type", "id", "url", "refers_to", "payload_bytes", "payload_digest", "payload"][: 7 if payloads else 6]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    opened = file = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(len(names))], names=names)

    for batch in batches:
        rows, held = [], 0
        for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path != opened:
                if file is not None:
                    file.close()
                system, place = _open(path)
                file, opened = system.open_input_file(place), path
            file.seek(offset)
            found = parse_member(file.read(length))
            rows.append(found[: len(names)])
            held += len(found[6] or b"") if payloads else 0
            if held > 16 << 20:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)
    if file is not None:
        file.close()


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """record_type, id, url, refers_to, payload_bytes, payload_digest (and payload) of the pages in an index, read member by member.

    Index rows are small beside what they point at, so the number of tasks comes from the members' lengths, which are added up when this is called.
    """
    pages = index.where("type in ('response', 'revisit')").select("path", "offset", "length")
    tasks = (pages.agg(F.sum("length")).first()[0] or 0) // STRETCH + 1
    dealt = pages.withColumn("stretch", F.floor(F.col("offset") / STRETCH)).repartition(tasks, "path", "stretch").sortWithinPartitions("path", "offset").drop("stretch")
    more = ", payload binary" if payloads else ""
    return dealt.mapInArrow(lambda batches: _read(batches, payloads), f"record_type string, id string, url string, refers_to string, payload_bytes long, payload_digest string{more}")


def op13_warc_members(spark, sf_dir):
    """Each page's record, read back from normalised archives, which are deleted then."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole, members = new_path(spark, "warc"), new_path(spark, "warc-members")
    archives = write_archives(pages, whole)
    normalised = normalise(archives, members)
    remove_path(spark, whole)
    kind = pages.schema["page_id"].dataType
    found = stash(read_records(read_index(normalised, members)).select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
    remove_path(spark, members)
    return found


ORACLE_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
r AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS last FROM p),
q AS (SELECT *, n >= {LEAST} AND last IS NOT NULL AND last IS DISTINCT FROM page_id AS again FROM r)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM q"""
