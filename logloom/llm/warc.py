"""WARC archives: written as one gzip stream per task, normalised to one member per record, and read back by an index.

write() gives each task's rows as WARC records inside one monolithic gzip stream, as many crawlers do: such a file can
only be read from its start. normalise() is the tool against that: it inflates the whole-file stream once, in pieces of
bounded size, finds each record by its Content-Length, and writes every record as a gzip member of its own, with a
sidecar index of (record id, offset, length, length when inflated). read() then opens members by their offsets.

Files go to a folder that all executors share, through pyarrow's file systems, so any scheme they know will do. Each is
written under a name of its own attempt and only named in the task's result once complete; an executor that is lost or a
second attempt leaves at most an unnamed file behind. What is listed, not what is in the folder, is read.

Deduplication: of records with equal payloads of at least SMALLEST bytes, the one with the least id is a response and
the others are revisits that hold no payload but refer to it; smaller payloads are all responses. Digests are grouped
with a combine before the shuffle, and only those that occur twice are joined back.

Nulls: a null payload is an empty one; a null url is left out of the record; rows with a null id are responses that
nothing refers to. Rows that repeat an id and a payload are written once each: the first is as
above, the repetitions are revisits to the same id. Ties, equal payloads of one id, are told apart by their urls, which
changes no result. A long payload is one record and is held by one task at a time. Only page_id, url and html are read, so
other columns do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, new_folder, stored

SMALLEST = 100
_PIECE = 1 << 20
#: Most bytes of members that are asked for at once.
_RUN = 8 << 20
#: Hadoop's names of stores, and pyarrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}
_DATE = "2024-01-01T00:00:00Z"  # a fixed date keeps files equal from run to run


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop path, and the path in it."""
    scheme, colon, rest = folder.partition("://")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}" if colon else folder)


def planned(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for a response) for each row of pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("size"))
    large = rows.where(F.col("size") >= smallest)
    twice = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    twice = stored(twice, "warc-twice")
    # Repetitions of the first id itself, only where the table repeats rows.
    again = stored(large.join(twice, "digest").where(F.col("page_id") == F.col("first")).groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("digest", F.lit(True).alias("again")), "warc-again")
    out = rows.join(twice, "digest", "left")
    repeated = not again.isEmpty()
    if repeated:
        out = out.join(again, "digest", "left")
        number = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        picked = out.where("again and page_id = first").withColumn("no", number)
        out = out.where("not coalesce(again and page_id = first, false)").withColumn("no", F.lit(1)).unionByName(picked)
    else:
        out = out.withColumn("no", F.lit(1))
    other = (F.col("page_id") != F.col("first")) | (F.col("no") > 1)
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", None if url is None else "".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(html))),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if revisit else head + html
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write(plan: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of planned() as monolithic gzip streams; gives file and records, one row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        fs.create_dir(f"{root}/mono", recursive=True)
        name, n, out, pack = f"mono/{uuid.uuid4().hex}.warc.gz", 0, None, zlib.compressobj(1, wbits=31)
        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*(b.column(k).to_pylist() for k in range(5))):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(pack.compress(_record(page_id, url, html.encode(), digest, refers_to)))
                n += 1
        if out:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return mapped(plan.select("page_id", "url", "html", "digest", "refers_to"), run, "file string, records long")


def _inflated(source) -> Iterator[bytes]:
    """The bytes inside a gzip file of one or more members, in pieces of bounded size."""
    z, data = zlib.decompressobj(wbits=31), b""
    while True:
        data = data or source.read(_PIECE)
        if not data:
            if not z.eof:
                raise ValueError("the gzip stream ends early")
            return
        if z.eof:
            z = zlib.decompressobj(wbits=31)
        piece = z.decompress(data, _PIECE)
        data = z.unconsumed_tail or z.unused_data
        if piece:
            yield piece
        while not z.eof and not data and piece and (piece := z.decompress(b"", _PIECE)):
            yield piece


def header(raw: bytes) -> dict[str, str]:
    """The fields of a WARC header, by lower-case name."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Header and whole bytes of each record; holds one record and one piece."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            x = next(pieces, None)
            if x is None:
                return False
            held.extend(x)
        return True

    while fill(1):
        seen = 0
        while (cut := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a WARC header ends early")
        fields = header(bytes(held[:cut]))
        size = cut + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("a WARC record ends early")
        yield fields, bytes(held[:size])
        del held[:size]


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each monolithic file with one member per record and a sidecar index; gives file, index and records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                stem = f"{name.removeprefix('mono/').removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                offset = n = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source, fs.open_output_stream(f"{root}/{stem}.warc.gz", compression=None) as out, fs.open_output_stream(f"{root}/{stem}.cdx", compression=None) as index:
                    for fields, raw in _records(_inflated(source)):
                        pack = zlib.compressobj(6, wbits=31)
                        member = pack.compress(raw) + pack.flush()
                        out.write(member)
                        index.write(f"{fields['warc-record-id']}\t{offset}\t{len(member)}\t{len(raw)}\n".encode())
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{stem}.warc.gz"]), pa.array([f"{stem}.cdx"]), pa.array([n], pa.int64())], ["file", "index", "records"])

    return mapped(files.select("file"), run, "file string, index string, records long")


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _members(source, entries: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, bytes]]:
    """Record id, inflated length and member of each entry; neighbours are read together, up to _RUN bytes."""
    at = 0
    while at < len(entries):
        end = at + 1
        while end < len(entries) and entries[end][1] == entries[end - 1][1] + entries[end - 1][2] and entries[end][1] + entries[end][2] - entries[at][1] <= _RUN:
            end += 1
        first = entries[at][1]
        raw = source.read_at(entries[end - 1][1] + entries[end - 1][2] - first, first)
        for record_id, offset, length, whole in entries[at:end]:
            yield record_id, whole, raw[offset - first : offset - first + length]
        at = end


def read(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and (if wanted) payload of every record, each member
    opened at the offset that the sidecar names. A response's payload is digested again and held against its header."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if payload else 5]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    def judged(record_id: str, whole: int, member: bytes, at: str) -> tuple:
        raw = zlib.decompress(member, wbits=31)
        cut = raw.index(b"\r\n\r\n")
        fields = header(raw[:cut])
        if len(raw) != whole or fields["warc-record-id"] != record_id:
            raise ValueError(f"the index does not fit {at} at {record_id}")
        held = raw[raw.index(b"\r\n\r\n", cut + 4) + 4 : -4]
        digest, n = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-payload-length"])
        if fields["warc-type"] == "response" and (hashlib.sha256(held).hexdigest() != digest or len(held) != n):
            raise ValueError(f"payload of {record_id} in {at} is damaged")
        return _number(record_id), n, digest, fields["warc-type"], _number(fields.get("warc-refers-to")), held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        for b in batches:
            for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{index}", compression=None) as lines:
                    entries = [(i, int(o), int(n), int(w)) for i, o, n, w in (x.split("\t") for x in lines.readall().decode().splitlines())]
                with fs.open_input_file(f"{root}/{name}") as source:
                    for record_id, whole, member in _members(source, entries):
                        row = judged(record_id, whole, member, name)
                        rows.append(row[: len(names)])
                        size += 64 + (len(row[5]) if payload else 0)
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return mapped(files.select("file", "index"), run, schema + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame, folder: str | None = None, smallest: int = SMALLEST, payload: bool = True) -> DataFrame:
    """Writes pages as WARC, normalises the archives and reads them back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    mono = stored(write(planned(pages, smallest), folder), "warc-mono")
    # One file of the list per task, so that the work of normalising and reading is spread as the writing was.
    n = max(1, mono.count())
    done = stored(normalise(mono.repartition(n), folder), "warc-files")
    fs, root = _opened(folder)
    if fs.get_file_info(f"{root}/mono").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/mono")
    return read(done.repartition(n), folder, payload)
