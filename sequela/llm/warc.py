"""WARC archives written and read in chunks, with a table of chunk rows between.

A payload goes through as rows (record, chunk number, bytes) and is hashed as it passes, so neither
the writer nor the reader holds more than a chunk of a record. The writer streams the rows of a
partition, sorted by record and chunk, into one archive in the shared folder; the reader streams an
archive back and gives the chunk rows again, the last of a record with the digest of the bytes
actually read.

A task that is run again writes an archive under a new name. Only archives in the manifest, which
lists what finished tasks wrote, are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.common import new_path, staged

CHUNK = 1 << 20
"""Characters of a payload in a row."""

READ = 1 << 20
MANIFEST = "path string, records long, bytes long"
CHUNKS = """page_id long, url string, record_type string, refers_to long, payload_bytes long,
payload_digest string, chunk int, last boolean, data binary"""


def open_folder(uri: str):
    """File system and path of a URI that every executor can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ── Which record is the response ─────────────────────────────────────────────────────────────


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, payload_bytes, sha1, record_type, refers_to``.

    Of records with equal payloads of at least ``least_bytes`` bytes the largest page_id is the
    response and the others are revisits of it; rows that repeat that page_id are responses too, and
    so are records of a payload whose page_ids are all null. Null html is an empty payload.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha1"))
    first = staged(rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes")
                   .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
                   .drop("n"), "responses")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(first, ["sha1", "payload_bytes"], "left").select(
        "page_id", "url", "html", "payload_bytes", "sha1",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("response")).alias("refers_to"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of each record (a record without payload has one, empty)."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length("html") / chunk)).cast("int")
    record = F.xxhash64("page_id", "url", "sha1", F.monotonically_increasing_id())
    rows = records.withColumn("record", record).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    body = F.when(F.col("record_type") == "response", F.substring("html", F.col("chunk") * chunk + 1, F.lit(chunk)))
    return rows.where("record_type = 'response' OR chunk = 0").select(
        "record", "chunk", (F.when(F.col("record_type") == "response", n).otherwise(1) == F.col("chunk") + 1).alias("last"),
        "page_id", "url", "record_type", "refers_to", "payload_bytes", "sha1", body.alias("data"))


# ── Writing ──────────────────────────────────────────────────────────────────────────────────


def _header(row: dict) -> bytes:
    name = "" if row["page_id"] is None else str(row["page_id"])
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(row['record']))}>",
             f"X-Page-Id: {name}",
             "WARC-Target-URI: " + (row["url"] or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"),
             f"X-No-URI: {int(row['url'] is None)}",
             f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(row['sha1']))}",
             f"X-Payload-Bytes: {row['payload_bytes']}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page: {row['refers_to']}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else row['payload_bytes']}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _writer(folder: str):
    def run(batches):
        out = at = None
        records = size = 0
        digest = None
        for batch in batches:
            data = batch.column(batch.schema.get_field_index("data"))
            rest = batch.drop_columns(["data"]).to_pylist()
            for i, row in enumerate(rest):
                if out is None:
                    system, path = open_folder(folder)
                    at = f"{folder}/{uuid.uuid4().hex}.warc"
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{at.rpartition('/')[2]}")
                if row["chunk"] == 0:
                    digest, left = hashlib.sha1(), row["payload_bytes"]
                    head = _header(row)
                    out.write(head)
                    size += len(head)
                    records += 1
                body = data[i].as_buffer() if data[i].is_valid else b""
                if body is not None and len(body):
                    out.write(body)
                    digest.update(body)
                    size += len(body)
                    left -= len(body)
                if row["last"]:
                    if row["record_type"] == "response" and (left or digest.hexdigest() != row["sha1"]):
                        raise ValueError(f"page {row['page_id']}: the chunks do not add up to the payload")
                    out.write(b"\r\n\r\n")
                    size += 4
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([records]), pa.array([size])], ["path", "records", "bytes"])
    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write an archive for each partition and return the manifest: ``path, records, bytes``."""
    folder = folder or new_path(pages.sparkSession, "archives")
    rows = chunked(classified(pages, least_bytes), chunk)
    rows = rows.sortWithinPartitions("record", "chunk")
    return staged(rows.mapInArrow(_writer(folder), MANIFEST), "manifest")


# ── Reading ──────────────────────────────────────────────────────────────────────────────────


def records(stream, read: int = READ):
    """Chunks of the records of a WARC stream as dicts; the last chunk of a record has its digest."""
    held = b""

    def more() -> bool:
        nonlocal held
        got = stream.read(read)
        held += got
        return bool(got)

    while True:
        while b"\r\n\r\n" not in held:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends inside a header")
                return
        head, _, held = held.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        left, digest, chunk = int(fields["Content-Length"]), hashlib.sha1(), 0
        while True:
            if not held and left and not more():
                raise ValueError("an archive ends inside a record")
            body, held = held[:min(left, read)], held[min(left, read):]
            left -= len(body)
            digest.update(body)
            yield fields, chunk, left == 0, body, digest.digest() if left == 0 else None
            chunk += 1
            if left == 0:
                break
        while len(held) < 4:
            if not more():
                raise ValueError("a record has no end mark")
        if held[:4] != b"\r\n\r\n":
            raise ValueError("a record is longer than its header says")
        held = held[4:]


def _reader(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, place = open_folder(path)
            with system.open_input_stream(place) as stream:
                rows, held = [], 0
                for fields, chunk, last, body, digest in records(stream):
                    revisit = fields["WARC-Type"] == "revisit"
                    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if last and not revisit and base32(digest) != told:
                        raise ValueError(f"{path}: a payload does not have its digest")
                    uri = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                    rows.append({
                        "page_id": int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None,
                        "url": None if fields["X-No-URI"] == "1" else uri, "record_type": fields["WARC-Type"],
                        "refers_to": int(fields["X-Refers-To-Page"]) if revisit else None,
                        "payload_bytes": int(fields["X-Payload-Bytes"]),
                        "payload_digest": (told if revisit else base32(digest)) if last else None,
                        "chunk": chunk, "last": last, "data": body})
                    held += len(body) + 200
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.int32()),
                    ("last", pa.bool_()), ("data", pa.binary())])


def read(manifest: DataFrame) -> DataFrame:
    """The chunk rows of the archives in a manifest: every record at least one row, its last chunk
    with the digest of the payload read (of a revisit: the digest its header gives)."""
    n = manifest.count()
    return manifest.select("path").repartition(max(1, n)).mapInArrow(_reader, CHUNKS)


def described(chunks: DataFrame) -> DataFrame:
    """One row a record, from its last chunk. ``payload_bytes`` is of the full payload also where a
    revisit holds none."""
    return chunks.where("last").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
