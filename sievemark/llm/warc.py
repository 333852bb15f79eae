"""WARC records in ZIP packages, and a reader that fetches records by range.

A package is a ZIP file with stored (not deflated) members: the records, each
its own gzip member, and an index of their offsets. The reader takes the end of
the file, follows the end record (and the ZIP64 locator and end record where
there are any) to the central directory, finds the members from it and reads the
index and then single records by range; nothing is extracted.

Packages lie in the shared folder, reached by its URI through pyarrow's file
systems. Every package has a name of its own (tasks with equal rows write
different files), and readers take only packages named by the table of archives,
so what a task left that ran again or was lost is never read.

A record's date is the start of its writing. An index line has the sortable form
of the URL, the date and a JSON object with place, digest and type.

Defined results: null html is an empty payload; a null page_id is written and
read as null and never referred to (it is the smallest only among nulls);
repeated rows with the smallest id of equal payloads are all responses; every
row has a record, however often it is repeated; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, drop, lookup, table, work_path

#: Payloads from this size on are deduplicated.
MIN_PAYLOAD = 100
#: Bytes of records in a package, and of a range that one read task takes.
PACKAGE, RANGE = 32 << 20, 4 << 20
#: Reading tasks a core of the cluster has at most.
TASKS = 16

UNDATED = "1970-01-01T00:00:00Z"

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = UNDATED) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": (url or "").replace("\r", " ").replace("\n", " "),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "text/html",
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        payload = b""
    head["Content-Length"] = str(len(payload))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode("utf-8") + payload + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("length of the record and of its content differ")
    return fields, rest[:n]


def sort_key(url: str | None) -> str:
    """Sortable form of a URL: host labels from last to first, then path and query, in lower case; '-' where there is no host."""
    try:
        u = urlsplit((url or "").strip())
        host = u.hostname or ""
    except ValueError:
        host = ""
    if not host:
        return "-"
    labels = host.removeprefix("www.").split(".")
    return re.sub(r"\s", "%20", (",".join(reversed(labels)) + ")" + (u.path or "/") + ("?" + u.query if u.query else "")).lower())


def index_line(entry: dict) -> str:
    """A line of the index: sort key, date, and the rest as JSON."""
    rest = {k: v for k, v in entry.items() if k != "date"} | {"mime": "text/html"}
    return f"{sort_key(entry.get('url'))} {re.sub('[^0-9]', '', entry.get('date', UNDATED))} {json.dumps(rest)}\n"


def package(members: list[bytes], entries: list[dict]) -> bytes:
    """ZIP file of records and their index, its lines in order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(zipfile.ZipInfo(RECORDS), b"".join(members))
        z.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(map(index_line, entries))))
    return out.getvalue()


def central_directory(f) -> dict[str, tuple[int, int]]:
    """Name -> (offset of its bytes, size) of the stored members of an open ZIP file."""
    size = f.size()
    tail = f.read_at(min(size, 65_557), max(0, size - 65_557))
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF or tail[at - 20 : at - 16] == b"PK\x06\x07":
        if tail[at - 20 : at - 16] == b"PK\x06\x07":
            (end64,) = struct.unpack_from("<Q", tail, at - 12)
            z = f.read_at(56, end64)
            if z[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", z, 32)
    directory, pos, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, packed, plain, n, m, k, offset = struct.unpack_from("<H8xIIHHH8xI", directory, pos + 10)
        name = directory[pos + 46 : pos + 46 + n].decode("utf-8")
        packed, plain, offset = _zip64(directory[pos + 46 + n : pos + 46 + n + m], packed, plain, offset)
        pos += 46 + n + m + k
        if method == 0:
            local = f.read_at(30, offset)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            out[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return out


def _zip64(extra: bytes, packed: int, plain: int, offset: int) -> tuple[int, int, int]:
    """Sizes and offset, from the ZIP64 field where the directory has all ones."""
    pos = 0
    while pos + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, pos)
        if kind == 1:
            at = pos + 4
            values = []
            for v in (plain, packed, offset):
                if v == 0xFFFFFFFF:
                    (v,) = struct.unpack_from("<Q", extra, at)
                    at += 8
                values.append(v)
            plain, packed, offset = values
        pos += 4 + n
    return packed, plain, offset


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write packages into ``folder``; rows (archive, records, bytes). Write this table before it is read: its rows are the packages that count."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed = table(pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes")), "warc-digests")
    first = keyed.where((F.col("bytes") >= min_payload) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    again = lookup(keyed.where(F.col("bytes") >= min_payload), first, ["digest"], "rows", max(1, keyed.count())).where("page_id > first")
    revisits = table(again.groupBy("page_id", "digest").agg(F.min("first").alias("refers_to")), "warc-revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        members, entries, size = [], [], 0
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

        def flush():
            nonlocal members, entries, size
            data = package(members, entries)
            name = uuid.uuid4().hex + ".wacz"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            n = len(entries)
            members, entries, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([len(data)], pa.int64())], ["archive", "records", "bytes"])

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(b.column(k).to_pylist() for k in range(5))):
                m = record(page_id, url, payload, digest, refers, date)
                entries.append({"url": url, "date": date, "digest": f"sha256:{digest}", "offset": size, "length": len(m), "filename": RECORDS})
                members.append(m)
                size += len(m)
                if size >= PACKAGE:
                    yield flush()
        if entries:
            yield flush()

    return rows.mapInArrow(run, "archive string, records long, bytes long")


def index(archives: DataFrame) -> DataFrame:
    """Rows (archive, offset, length) of all records, from directories and indexes alone."""

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                with _open(uri) as f:
                    members = central_directory(f)
                    start, _ = members[RECORDS]
                    at, n = members[INDEX]
                    entries = [json.loads(x.split(b" ", 2)[2]) for x in f.read_at(n, at).splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(entries)), pa.array([start + e["offset"] for e in entries], pa.int64()), pa.array([e["length"] for e in entries], pa.int64())],
                    ["archive", "offset", "length"],
                )

    return archives.select("archive").mapInArrow(run, "archive string, offset long, length long")


def _read_rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])


def read_tasks(stored: int, cores: int) -> int:
    """Tasks that read so many bytes: one for every RANGE, at most TASKS a core."""
    return max(1, min(math.ceil(stored / RANGE), TASKS * cores))


def read(entries: DataFrame, tasks: int) -> DataFrame:
    """Range-read the records in ``tasks`` tasks: page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest.

    The number of tasks goes by the bytes to be read, which the rows shuffled here (places of records) don't show.
    """
    ranges = entries.withColumn("range", F.floor(F.col("offset") / RANGE)).repartition(tasks, "archive", "range").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    number = lambda s: int(s[10:-1]) if s and s != "<urn:page:>" else None

    def run(batches):
        now, f = None, None
        for b in batches:
            rows: Iterator = zip(*(b.column(k).to_pylist() for k in range(3)))
            out, held = [], 0
            for uri, offset, length in rows:
                if held >= RANGE:  # payloads go out as they come, however many records a task has
                    yield _read_rows(out)
                    out, held = [], 0
                held += length
                if uri != now:
                    if f is not None:
                        f.close()
                    now, f = uri, _open(uri)
                head, payload = parse(f.read_at(length, offset))
                kind = head["WARC-Type"]
                stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != stated:
                    raise ValueError("payload and digest differ")
                out.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, number(head.get("WARC-Refers-To")), payload if kind == "response" else None, len(payload) if kind == "response" else None, stated))
            if out:
                yield _read_rows(out)

    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages, read them back, and resolve revisits by the responses they refer to."""
    spark = pages.sparkSession
    folder = work_path(spark, "warc")
    archives = table(write(pages, folder, **columns), "warc-archives")
    stored = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    got = table(read(index(archives), read_tasks(stored, spark.sparkContext.defaultParallelism)).drop("payload", "url"), "warc-read")
    delete(spark, folder)
    drop(archives)
    answers = got.where("record_type = 'response'")
    revisits = got.where("record_type = 'revisit'")
    wanted = revisits.groupBy(F.col("refers_to").alias("target"), F.col("payload_digest").alias("digest")).agg(F.count("*").alias("rows"))
    sizes = answers.groupBy(F.col("page_id").alias("target"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("found"))
    known = wanted.join(sizes, ["target", "digest"]).withColumnsRenamed({"target": "refers_to", "digest": "payload_digest"})
    resolved = lookup(revisits, known, ["refers_to", "payload_digest"], "rows", max(1, got.count())).withColumn("payload_bytes", F.col("found")).drop("found")
    columns_ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return answers.select(*columns_).unionByName(resolved.select(*columns_))
