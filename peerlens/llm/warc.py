"""WARC archives through a chunked record table.

A payload travels as rows (record, chunk number, bytes) of bounded size.  Writer and reader are streams over such rows:
each keeps one running SHA-1 and one gzip stream per task, never a whole record.  Every chunk row carries the digest
of the payload up to and including it, so a reader can stop or resume a check at any chunk.

Archives are gzip members, one per record, in files of a bounded size below the shared folder; a task's attempt
writes names of its own, and only names in the manifest of a finished attempt are read.
"""

import base64
import hashlib
import posixpath
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from peerlens.llm.common import cut
from peerlens.session import run_dir

#: Tasks at most that read archives back.
READERS = 10_000
CHUNK_BYTES = 64 << 10
ARCHIVE_BYTES = 32 << 20
REVISIT_BYTES = 1000
_DATE = "2024-01-01T00:00:00Z"
_READ = 256 << 10

_MANIFEST = [("archive", pa.string()), ("page_id", pa.int64()), ("chunks", pa.int64()), ("offset", pa.int64())]
_CHUNKS = [
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("chunk_no", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_()), ("data", pa.binary()),
]


def _ddl(fields):
    names = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[k]}" for n, k in fields)


def _batch(fields, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def record_types(pages, least=REVISIT_BYTES):
    """`pages` as records: page_id, url, payload, payload_bytes, sha (hex), revisit, refers_to.

    Of records with equal payloads of `least` bytes or more, that with the largest page_id is the response.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    records = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha": F.sha1("payload")})
    marks = cut(records.select("page_id", "payload_bytes", "sha").filter(F.col("payload_bytes") >= least), "marks")
    shared = marks.groupBy("payload_bytes", "sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # Written, so that the join below has an exchange on both sides and a hot payload can be split.
    shared = cut(shared.filter("n > 1").select("payload_bytes", "sha", "first"), "shared")
    revisits = marks.join(shared, ["payload_bytes", "sha"]).filter("page_id IS NULL OR page_id <> first")
    revisits = revisits.filter("first IS NOT NULL").select(
        F.coalesce("page_id", F.lit(-(1 << 63))).alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")
    ).distinct()
    same = (F.coalesce("page_id", F.lit(-(1 << 63))) == F.col("_id")) & (F.col("sha") == F.col("_sha"))
    return records.join(cut(revisits, "revisits"), same, "left").select(
        "page_id", "url", "payload", "payload_bytes", "sha", F.col("refers_to").isNotNull().alias("revisit"), "refers_to"
    )


def chunk_table(records, chunk_bytes=CHUNK_BYTES):
    """A row per chunk of each record, in order and together; a revisit has one empty chunk."""
    size, body = F.lit(chunk_bytes), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("body") / size).cast("int") - 1))
    kept = ["page_id", "url", "payload_bytes", "sha", "revisit", "refers_to"]
    # Numbers are exploded, and each row takes its own piece: the chunks of a record are never together.
    numbered = records.select(*kept, body.alias("body")).select(*kept, "body", F.size(places).alias("chunks"), F.explode(places).alias("chunk_no"))
    return numbered.select(*kept, "chunks", "chunk_no", F.substring("body", F.col("chunk_no") * size + 1, size).alias("data"))


def _header_value(text):
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", text or "")


def _record_id(page_id):
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _head(row):
    """Header of a record, up to where its payload begins."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    body = len(http) + (0 if row["revisit"] else row["payload_bytes"])
    digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
    fields = [
        ("WARC-Type", "revisit" if row["revisit"] else "response"), ("WARC-Record-ID", _record_id(row["page_id"])),
        ("WARC-Date", _DATE), ("WARC-Target-URI", _header_value(row["url"])), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if row["revisit"]:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(row["refers_to"])),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(body))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n" + http).encode()


class _Archives:
    """The files of one task attempt; a new one begins between records once `limit` bytes are written."""

    def __init__(self, folder, limit):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.limit, self.out, self.name, self.at = limit, None, None, 0

    def begin(self):
        if self.out is not None and self.at >= self.limit:
            self.close()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.at = self.store.open_output_stream(posixpath.join(self.folder, self.name), compression=None), 0

    def write(self, data):
        self.out.write(data)
        self.at += len(data)

    def close(self):
        if self.out is not None:
            self.out.close()
            self.out = None


def _writer(folder, limit):
    def run(batches):
        files, pack, digest, offset = _Archives(folder, limit), None, None, 0
        for batch in batches:
            done = []
            heads = [batch.column(n).to_pylist() for n in ("page_id", "url", "payload_bytes", "sha", "revisit", "refers_to", "chunks", "chunk_no")]
            for page, url, size, sha, revisit, refers, chunks, number, data in zip(*heads, batch.column("data")):
                if number == 0:
                    files.begin()
                    offset, pack, digest = files.at, zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    row = {"page_id": page, "url": url, "payload_bytes": size, "sha": sha, "revisit": revisit, "refers_to": refers}
                    files.write(pack.compress(_head(row)))
                digest.update(data.as_py())
                files.write(pack.compress(data.as_py()))
                if number == chunks - 1:
                    files.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    if not revisit and digest.hexdigest() != sha:
                        raise ValueError(f"payload of page {page} changed on the way")
                    done.append((files.name, page, chunks, offset))
            if done:
                yield _batch(_MANIFEST, done)
        files.close()

    return run


def write_archives(pages, chunk_bytes=CHUNK_BYTES, archive_bytes=ARCHIVE_BYTES):
    """Write a record per row of `pages`; gives (folder, manifest: archive, page_id, chunks, offset).

    A NULL payload is an empty one; page_ids may be NULL or repeat (each row has its record).
    """
    folder = run_dir(pages.sparkSession, "warc")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    chunks = chunk_table(record_types(pages), chunk_bytes)
    return folder, cut(chunks.mapInArrow(_writer(folder, archive_bytes), _ddl(_MANIFEST)), "manifest")


class _Stream:
    """Decompressed bytes of one archive, read and given in bounded pieces."""

    def __init__(self, source):
        self.source, self.raw, self.buffer, self.unpack, self.ended = source, b"", b"", zlib.decompressobj(31), False

    def _more(self):
        if not self.raw:
            self.raw = self.source.read(_READ)
            if not self.raw:
                self.ended = True
                return
        self.buffer += self.unpack.decompress(self.raw, _READ)
        self.raw = self.unpack.unconsumed_tail
        if self.unpack.eof:
            self.raw = self.unpack.unused_data
            self.unpack = zlib.decompressobj(31)

    def until(self, mark):
        """Bytes before `mark`, which is skipped; None at the end of the archive."""
        while (at := self.buffer.find(mark)) < 0 and not self.ended:
            self._more()
        if at < 0:
            return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark):]
        return out

    def take(self, n, piece):
        """The next n bytes in pieces of `piece`."""
        while n:
            size = min(n, piece)
            while len(self.buffer) < size:
                if self.ended:
                    raise EOFError("archive ends inside a record")
                self._more()
            out, self.buffer = self.buffer[:size], self.buffer[size:]
            n -= size
            yield out


def _fields(head):
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _page(text):
    value = re.fullmatch(r"<urn:page:(.*)>", text)[1]
    return None if value == "null" else int(value)


def _records(stream, chunk_bytes, with_data):
    """Chunk rows of all records of an archive."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        http = stream.until(b"\r\n\r\n")
        left = int(warc["Content-Length"]) - len(http) - 4
        row = (_page(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], warc["WARC-Type"])
        if warc["WARC-Type"] == "revisit":
            whole = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            yield (*row, _page(warc["WARC-Refers-To"]), 0, int(_fields(http)["Content-Length"]), whole, True, None)
        else:
            digest, size, number = hashlib.sha1(), 0, 0
            for data in stream.take(left, chunk_bytes) if left else (b"",):
                digest.update(data)
                size += len(data)
                yield (*row, None, number, size, digest.hexdigest(), size == left, data if with_data else None)
                number += 1
        if b"".join(stream.take(4, 4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def _reader(folder, chunk_bytes, with_data):
    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                held, size = [], 0
                with store.open_input_stream(posixpath.join(path, name), compression=None) as source:
                    for row in _records(_Stream(source), chunk_bytes, with_data):
                        held.append(row)
                        size += 200 + len(row[-1] or b"")
                        if size > 4 << 20:
                            yield _batch(_CHUNKS, held)
                            held, size = [], 0
                if held:
                    yield _batch(_CHUNKS, held)

    return run


def read_archives(folder, manifest, chunk_bytes=CHUNK_BYTES, with_data=True):
    """Chunk rows of the archives in `manifest`: page_id, url, record_type, refers_to, chunk_no, payload_bytes and digest
    (up to and including the chunk; of the full payload for a revisit), last, data (None without `with_data`)."""
    archives = cut(manifest.select("archive").distinct(), "archives")
    # As many tasks as archives (a given number of parts is not merged): names are small, what they stand for is not.
    archives = archives.repartition(max(1, min(archives.count(), READERS)))
    return archives.mapInArrow(_reader(folder, chunk_bytes, with_data), _ddl(_CHUNKS))


def round_trip(pages):
    """Write `pages` and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    NULL html counts as empty; NULL ids never become the response of others; repeated rows are records each; an empty table
    gives an empty result; a very long payload travels in chunks; other columns are not read.
    """
    chunks = read_archives(*write_archives(pages), with_data=False)
    return chunks.filter("last").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )
