"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC 1.1.

An ARC file starts with a version block, whose second line names the version that
decides the fields of every later header line; each header line ends with the
declared length of what follows. The converter reads exactly that many bytes and
synthesises the WARC headers that ARC lacks: identifiers, ISO timestamps, record
types and payload digests. Records are gzip members of their own, so that one can
be read at its offset without the others.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, table, tidied
from .tokens import put_in_place, store_of

FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
SPACE = uuid.UUID("5f0c7a3e-8a51-5d0e-9a35-1f6b8c1f2d77")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 factorloom\n{' '.join({'url': 'URL', 'ip': 'IP-address', 'date': 'Archive-date', 'mime': 'Content-type', 'status': 'Result-code', 'checksum': 'Checksum', 'location': 'Location', 'offset': 'Offset', 'filename': 'Filename', 'length': 'Archive-length'}[f] for f in FIELDS[version])}\n".encode()
    more = {1: "", 2: f" 200 - - 0 {name}"}[version]
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, name: str, offset: int) -> bytes:
    more = {1: "", 2: f" 200 - - {offset} {name}"}[version]
    return f"{quote(url, safe=':/?#[]@!$&()*+,;=%~.-_') or 'about:blank'} 0.0.0.0 {date} text/html{more} {len(block)}\n".encode() + block + b"\n"


def members(stream):
    """(offset, compressed length, content) of each gzip member, one in memory at a time."""
    at, held = 0, b""
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            data = held or stream.read(CHUNK)
            held = b""
            if not data:
                if used:
                    raise ValueError(f"gzip member at {at} is cut off")
                return
            parts.append(z.decompress(data))
            used += len(data)
        held = z.unused_data
        used -= len(held)
        yield at, used, b"".join(parts)
        at += used


def parse_version(content: bytes) -> int:
    head, _, body = content.lstrip(b"\r\n").partition(b"\n")
    if not head.startswith(b"filedesc://"):
        raise ValueError("no ARC version block")
    version = int(body.split(None, 1)[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version} is unknown")
    return version


def parse_record(content: bytes, version: int) -> tuple[dict[str, str], bytes]:
    """The header line's fields and the block of the declared length."""
    head, _, rest = content.lstrip(b"\r\n").partition(b"\n")
    names, values = FIELDS[version], head.decode("utf-8").split(" ")
    if len(values) > len(names):  # old crawlers left spaces in URLs
        values = [" ".join(values[: len(values) - len(names) + 1]), *values[len(values) - len(names) + 1 :]]
    fields = dict(zip(names, values, strict=True))
    length = int(fields["length"])
    if len(rest) < length:
        raise ValueError(f"{fields['url']}: {length} bytes declared, {len(rest)} there")
    return fields, rest[:length]


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """An HTTP response's head (with its empty line), its headers in lower case, its payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head + gap, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def warc_record(fields: dict[str, str], block: bytes, digest: str, place: str, to_place: str | None = None, to_id: int | None = None) -> bytes:
    """A WARC record equivalent to an ARC record: a revisit, with the HTTP head alone, where to_place tells the record it refers to."""
    kind = "response" if to_place is None else "revisit"
    head, _, _ = http_parts(block)
    content = block if kind == "response" else head
    d = fields["date"]
    stamp = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, place)}>", f"WARC-Date: {stamp}", f"WARC-Target-URI: {fields['url']}", f"WARC-IP-Address: {fields['ip']}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(content).digest()).decode()}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(SPACE, to_place)}>", f"X-Refers-To-Page: {'-' if to_id is None else to_id}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def parse_warc(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:length]


def number(text: str) -> int | None:
    return None if text in ("", "-") else int(text)


class Archive:
    """A file that a task fills under a draft name and moves into place."""

    def __init__(self, uri: str, name: str, attempt: int):
        self.store, base = store_of(uri)
        self.store.create_dir(base, recursive=True)
        self.path, self.draft, self.at = f"{base}/{name}", f"{base}/{name}.{attempt}", 0
        self.out = self.store.open_output_stream(self.draft, compression=None)

    def add(self, data: bytes) -> None:
        data = gzipped(data)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        put_in_place(self.store, self.draft, self.path)


def write_arcs(df: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """Write rows as ARC files, a file per task, of version 1 and 2 in turn; returns (file, records). Null html is empty, a null URL about:blank."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))

    @tidied
    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId()
        name, version, n, arc = f"pages-{part:08d}.arc.gz", 1 + part % 2, 0, None
        for batch in batches:
            for page, url, html in zip(*batch.columns, strict=True):
                if arc is None:
                    arc = Archive(uri, name, task.taskAttemptId())
                    arc.add(version_block(version, name, date))
                payload = html.as_py().encode()
                key = page.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'-' if key is None else key}\r\n\r\n"
                arc.add(arc_record(version, url.as_py(), date, head.encode() + payload, name, arc.at))
                n += 1
        if arc is not None:
            arc.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"]), pa.array([n])], names=["file", "records"])

    return slim.mapInArrow(write, "file string, records long")


INDEX = "file string, at long, size long, version int, id long, bytes long, digest string"


def index_arcs(files: DataFrame, tasks: int) -> DataFrame:
    """A row per ARC record: where it lies, its id, and its payload's length and SHA-1."""

    @tidied
    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = store_of(file)
                rows, version = [], None
                with store.open_input_stream(path, compression=None) as stream:
                    for at, size, content in members(stream):
                        if version is None:
                            version = parse_version(content)
                            continue
                        _, block = parse_record(content, version)
                        _, headers, payload = http_parts(block)
                        rows.append((file, at, size, version, number(headers.get("x-page-id", "-")), len(payload), hashlib.sha1(payload).hexdigest()))
                        if len(rows) == 8192:
                            yield made(rows)
                            rows = []
                yield made(rows)

    def made(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "at", "size", "version", "id", "bytes", "digest"])

    return files.select("file").repartition(tasks).mapInArrow(read, INDEX)


def convert_arcs(index: DataFrame, uri: str, tasks: int, least: int = 1000) -> DataFrame:
    """Write WARC files of all indexed ARC records; returns (file, records).

    Of records with equal payloads of ``least`` bytes or more, the one with the
    largest id (then file and offset) is the response that the others revisit.
    """
    last = F.max(F.struct("id", "file", "at"))
    shared = index.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.count("*").alias("n"), last.alias("last")).where("n > 1")
    shared = stored(shared.select("digest", "bytes", F.col("last.id").alias("to_id"), F.col("last.file").alias("to_file"), F.col("last.at").alias("to_at")), "arc-shared")
    decided = index.join(shared, ["digest", "bytes"], "left")
    again = F.col("to_file").isNotNull() & ~((F.col("file") == F.col("to_file")) & (F.col("at") == F.col("to_at")))
    decided = decided.select("file", "at", "size", "version", "digest", F.when(again, F.col("to_id")).alias("to_id"), F.when(again, F.concat_ws(":", F.col("to_file"), F.col("to_at"))).alias("to_place"))
    decided = decided.repartition(tasks, "file").sortWithinPartitions("file", "at")

    @tidied
    def write(batches):
        from pyspark import TaskContext

        task, warc, n = TaskContext.get(), None, 0
        name = f"pages-{task.partitionId():08d}.warc.gz"
        opened, source = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if warc is None:
                    warc = Archive(uri, name, task.taskAttemptId())
                    info = b"software: factorloom\r\nformat: WARC File Format 1.1\r\n"
                    warc.add(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(SPACE, name)).encode() + b">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(info)).encode() + b"\r\n\r\n" + info + b"\r\n\r\n")
                if row["file"] != opened:
                    if source is not None:
                        source.close()
                    store, path = store_of(row["file"])
                    opened, source = row["file"], store.open_input_file(path)
                source.seek(row["at"])
                content = zlib.decompress(source.read(row["size"]), 31)
                fields, block = parse_record(content, row["version"])
                place = f"{row['file']}:{row['at']}"
                warc.add(warc_record(fields, block, row["digest"], place, row["to_place"], row["to_id"]))
                n += 1
        if source is not None:
            source.close()
        if warc is not None:
            warc.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{uri}/{name}"]), pa.array([n])], names=["file", "records"])

    return decided.mapInArrow(write, "file string, records long")


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warcs(files: DataFrame, tasks: int) -> DataFrame:
    """A row per response or revisit record; a response's length and digest come from its payload, a revisit's from its headers."""

    @tidied
    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = store_of(file)
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for _, _, content in members(stream):
                        fields, block = parse_warc(content)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        _, headers, payload = http_parts(block)
                        page, revisit = number(headers["x-page-id"]), fields["warc-type"] == "revisit"
                        told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        digest = told if revisit else hashlib.sha1(payload).hexdigest()
                        if digest != told:
                            raise ValueError(f"{file}: a payload does not have its digest")
                        rows.append((page, int(headers["content-length"]) if revisit else len(payload), digest, fields["warc-type"], number(fields["x-refers-to-page"]) if revisit else None))
                        if len(rows) == 8192:
                            yield made(rows)
                            rows = []
                yield made(rows)

    def made(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("file").repartition(tasks).mapInArrow(read, PAGES)


def tasks_for(files: DataFrame) -> int:
    """A task per file, as far as a job should go."""
    return max(1, min(files.count(), 20_000))


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """ARC files of df's rows, converted to WARC files; returns a row per record, read back from these.

    Null html is an empty payload, a null URL about:blank, a null id stays null.
    Repeated rows are records of their own: one of them is the response. An empty
    table gives no file and an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    arcs = stored(write_arcs(df, scratch(spark, "arc"), id_col, url_col, html_col), "arc-files")
    index = stored(index_arcs(arcs, tasks_for(arcs)), "arc-index")
    warcs = stored(convert_arcs(index, scratch(spark, "warc"), tasks_for(arcs)), "warc-files")
    return read_warcs(warcs, tasks_for(warcs))


def op10_warc(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM w
"""
