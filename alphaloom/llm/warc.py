"""WARC archives with a Zstandard dictionary: written by tasks, listed in a manifest, read back.

Each file begins with a skippable frame that holds the dictionary, and each record is a frame of its own. The
dictionary is trained once, on a bounded sample of the records. Files get names that no other attempt uses, and the
manifest (kept in the shared folder) lists those of the attempts that counted: a task that is run again leaves at
most a file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alphaloom.llm.sample import lowest_share
from alphaloom.llm.shared import cut, shared_dir

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
RECORDS = "page_id long, url string, record_type string, refers_to long, stated_bytes long, stated_digest string, payload binary"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or with refers_to a revisit, which has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http if refers_to is not None else http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def assign(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: a response).

    Of records with equal payloads of at least MIN_REVISIT bytes, those of the smallest page_id are responses (more than
    one only where that id repeats) and the others refer to it. A null html is an empty payload. A page without an id
    is a response. Other columns are not read.
    """
    own = pages.select(F.col(page_id).try_cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    first = own.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def train(pages: DataFrame, date: str, samples: int = 400, sample_bytes: int = 1 << 15, size: int = 1 << 16) -> bytes:
    """A dictionary from at most `samples` records of at most sample_bytes payload; empty if there are too few to train on."""
    fit = pages.where((F.octet_length("payload") > 0) & (F.octet_length("payload") <= sample_bytes))
    # ids first: payloads of the chosen ones only leave their tasks
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("hash", "page_id", "digest"))
    ids = fit.select("page_id", "digest").withColumn("hash", F.xxhash64("page_id", "digest"))
    ids = ids.where(lowest_share(F.col("hash"), F.lit(min(1.0, 4.0 * samples / max(1, fit.count()))))).distinct().withColumn("rank", rank).where(F.col("rank") <= samples).drop("hash")
    chosen = F.broadcast(ids.select(F.col("page_id").alias("_i"), F.col("digest").alias("_d"), "rank"))
    found = fit.join(chosen, F.col("page_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")))
    rows = found.groupBy("rank", "page_id", "digest").agg(F.min("url").alias("url"), F.min("payload").alias("payload")).collect()
    rows.sort(key=lambda r: r["rank"])
    texts = [record(r.page_id, r.url, bytes(r.payload), r.digest, None, date) for r in rows]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, texts)) // 4), texts).as_bytes() if len(texts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(pages: DataFrame, directory: str | None = None, date: str = "2020-01-01T00:00:00Z", level: int = 3, file_bytes: int = 1 << 30, **columns: str) -> DataFrame:
    """Writes an archive and returns its manifest: path, records, bytes. An empty table gives an empty manifest.

    directory: a URI that executors can write to; by default a new folder in the shared one. A file is closed when it
    has file_bytes. columns: names for page_id, url and html.
    """
    rows = assign(pages, **columns)
    directory = directory or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    base = pages.select(F.col(columns.get("page_id", "page_id")).try_cast("long").alias("page_id"), F.col(columns.get("url", "url")).cast("string").alias("url"), F.coalesce(F.col(columns.get("html", "html")).cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    dictionary = train(base, date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(directory)
        system.create_dir(root, recursive=True)
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True)
        out, listed = None, []

        def close() -> None:
            nonlocal out
            out.close()
            out = None

        for b in batches:
            ids, urls, payloads, digests, refers = b.columns
            for i in range(b.num_rows):
                if out is None:
                    path = f"{root.rstrip('/')}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(path, compression=None)
                    listed.append([path, 0, 0])
                    if dictionary:
                        listed[-1][2] += out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                data = compressor.compress(record(ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), refers[i].as_py(), date))
                out.write(data)
                listed[-1][1] += 1
                listed[-1][2] += len(data)
                if listed[-1][2] >= file_bytes:
                    close()
        if out is not None:
            close()
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*listed)], names=["path", "records", "bytes"])

    scheme = directory.split("://")[0] + "://" if "://" in directory else ""
    host = directory.split("://")[1].split("/")[0] if scheme and scheme != "file://" else ""
    # a file system's own paths leave out the scheme; those of object stores begin with the bucket
    prefix = scheme + (host if scheme in ("hdfs://", "viewfs://") else "")
    manifest = rows.mapInArrow(run, "path string, records long, bytes long").select(F.concat(F.lit(prefix), "path").alias("path"), "records", "bytes")
    return cut(manifest)


def parse(stream: io.RawIOBase | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header (lower-case names) and block of each record of an open archive file."""
    raw = io.BufferedReader(stream, 1 << 16) if not isinstance(stream, io.BufferedReader) else stream
    head = raw.peek(8)[:8]
    made = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        size = struct.unpack("<II", raw.read(8))[1]
        made = zstandard.ZstdCompressionDict(raw.read(size))
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=made).stream_reader(raw, read_across_frames=True), 1 << 16)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record was expected")
        header = {}
        while (line := plain.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            header[name.decode().lower()] = value.strip().decode()
        block = plain.read(int(header["content-length"]))
        plain.read(4)
        yield header, block


def read(manifest: DataFrame, batch_bytes: int = 1 << 22) -> DataFrame:
    """page_id, url, record_type, refers_to, stated_bytes, stated_digest, payload (null: a revisit) of each record.

    manifest: a column path. Stated figures are those of the record's headers.
    """

    def row(header: dict[str, str], block: bytes) -> list:
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        number = lambda k: int(header[k]) if k in header else None
        kind = header["warc-type"]
        return [number("x-page-id"), header.get("warc-target-uri"), kind, number("x-refers-to-page-id"), stated, header["warc-payload-digest"].removeprefix("sha256:"), payload if kind == "response" else None]

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, place = _open(path)
                held, size = [], 0
                with system.open_input_stream(place, compression=None) as f:
                    for header, block in parse(f):
                        if header["warc-type"] not in ("response", "revisit"):
                            continue
                        held.append(row(header, block))
                        size += len(block)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return manifest.select("path").mapInArrow(run, RECORDS)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM q
"""
