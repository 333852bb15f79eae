"""Media columns: find out what bytes really are.

One Aho-Corasick pass over a value locates the magic numbers of all known
formats. At each place a validator of that format walks the structure and
returns the length or refuses, so a chance match in text or pixels is no hit. A
hit at the start corrects the declared type; hits anywhere are carved out.

The round trip :func:`store` and :func:`read_back` keeps texts as media of three
formats (which one goes by a hash of the text), half of them bare with a wrong
declared type, half inside a carrier with other magic numbers around. Reading back
sniffs the stored bytes and decodes what was carved by the type found; nothing
but the stored bytes is consulted, for the number of unpadded bytes too (UTF-8 has
no byte 255, the padding has no other).

Defined results: null content has no type and no hits; a declared type is kept
where nothing valid starts the content; of overlapping hits the earlier (then
longer) wins; repeated rows get equal results; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Samples of a row of the stored image; payloads are padded to a multiple of it.
ROW = 576
#: Bytes of output that a task holds before it hands on a batch.
FLUSH = 8 << 20

_PNG = b"\x89PNG\r\n\x1a\n"


def png_length(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, pos)
        kind, end = b[pos + 4 : pos + 8], pos + 12 + n
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return None


def gif_length(b: bytes, at: int) -> int | None:
    if len(b) < at + 13:
        return None
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    images = 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at if images else None
        if b[pos] == 0x2C and pos + 10 < len(b):
            flags, images = b[pos + 9], images + 1
            pos += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        elif b[pos] == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def jpeg_length(b: bytes, at: int) -> int | None:
    pos, scans = at + 2, 0
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at if scans else None
        (n,) = struct.unpack_from(">H", b, pos + 2)
        if n < 2:
            return None
        pos += 2 + n
        if mark == 0xDA:  # coded data runs to the next marker that is neither stuffing nor restart
            scans += 1
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
    return pos + 2 - at if scans and b[pos : pos + 2] == b"\xff\xd9" else None


def bmp_length(b: bytes, at: int) -> int | None:
    if len(b) < at + 30:
        return None
    size, reserved, data, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + (22 if header == 12 else 26))[0]
    ok = reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and planes == 1 and 14 + header <= data < size <= len(b) - at
    return size if ok else None


def riff_length(form: bytes, needed: tuple[bytes, ...]) -> Callable[[bytes, int], int | None]:
    def length(b: bytes, at: int) -> int | None:
        if len(b) < at + 12 or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        pos, seen = at + 12, set()
        while pos + 8 <= end:
            seen.add(b[pos : pos + 4])
            n = struct.unpack_from("<I", b, pos + 4)[0]
            pos += 8 + n + (n & 1)
        return end - at if pos in (end, end + 1) and any(n in seen for n in needed) else None

    return length


def ogg_length(b: bytes, at: int) -> int | None:
    pos, pages = at, 0
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        flags, n = b[pos + 5], b[pos + 26]
        size = 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos + size > len(b) or (pages == 0) != bool(flags & 2):
            return None
        pos, pages = pos + size, pages + 1
        if flags & 4:
            return pos - at
    return None


def mp4_length(b: bytes, at: int) -> int | None:
    at, pos, seen = at - 4, at - 4, set()
    if at < 0:
        return None
    while pos + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if not kind.isalnum() or n < 8 or pos + n > len(b):
            break
        seen.add(kind)
        pos += n
    return pos - at if b"moov" in seen or b"mdat" in seen else None


def pdf_length(b: bytes, at: int) -> int | None:
    stop = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    return end + 5 - at if end > 0 and b.rfind(b"startxref", at, end) > 0 else None


#: Magic bytes, offset of the value's start from them, type, validator. Fixed values of the formats.
FORMATS = (
    (_PNG, 0, "image/png", png_length),
    (b"GIF87a", 0, "image/gif", gif_length),
    (b"GIF89a", 0, "image/gif", gif_length),
    (b"\xff\xd8\xff", 0, "image/jpeg", jpeg_length),
    (b"BM", 0, "image/bmp", bmp_length),
    (b"RIFF", 0, "audio/wav", riff_length(b"WAVE", (b"data",))),
    (b"RIFF", 0, "image/webp", riff_length(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"RIFF", 0, "video/avi", riff_length(b"AVI ", (b"LIST",))),
    (b"OggS", 0, "audio/ogg", ogg_length),
    (b"ftyp", -4, "video/mp4", mp4_length),
    (b"%PDF-", 0, "application/pdf", pdf_length),
)


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.scan = ahocorasick.Automaton()
        for magic in {f[0] for f in FORMATS}:
            self.scan.add_word(magic.decode("latin-1"), (len(magic), [f for f in FORMATS if f[0] == magic]))
        self.scan.make_automaton()

    def hits(self, b: bytes | None) -> list[tuple[str, int, int]]:
        """(type, start, length) of the valid media in ``b``, in order, none inside another."""
        out, end = [], -1
        if b:
            for last, (n, formats) in self.scan.iter(b.decode("latin-1")):
                at = last - n + 1
                if at < end:
                    continue
                for _, shift, kind, length in formats:
                    if size := length(b, at):
                        out.append((kind, at + shift, size))
                        end = at + shift + size
                        break
        return out


def sniff(df: DataFrame, content: str, declared: str) -> DataFrame:
    """``df`` with ``media_type`` (detected, else declared), ``corrected`` and ``hits``; columns of these names are replaced."""

    @F.pandas_udf("array<struct<type:string,start:long,length:long>>")
    def find(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Sniffer()
        for batch in values:
            yield pd.Series([[{"type": k, "start": a, "length": n} for k, a, n in s.hits(None if v is None else bytes(v))] for v in batch], dtype=object)

    found = df.withColumn("hits", find(F.col(content)))
    start = F.expr("try_element_at(filter(hits, h -> h.start = 0), 1).type")
    return found.withColumn("media_type", F.coalesce(start, F.col(declared))).withColumn("corrected", F.coalesce(start != F.coalesce(F.col(declared), F.lit("")), F.lit(False)))


def write_image(payload: bytes) -> bytes:
    """PNG of 8-bit grey samples, ``ROW`` a line."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def read_image(png: bytes) -> np.ndarray:
    """Samples of an image that :func:`write_image` made, as rows."""
    pos, width, height, data = 8, 0, 0, []
    while pos < len(png):
        n, kind = struct.unpack_from(">I4s", png, pos)
        body = png[pos + 8 : pos + 8 + n]
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        pos += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are read")
    return lines[:, 1:]


def write_bmp(payload: bytes) -> bytes:
    """Bitmap of 8-bit grey samples, ``ROW`` a line, from the top."""
    colours = b"".join(bytes((k, k, k, 0)) for k in range(256))
    start = 54 + len(colours)
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(payload), 0, start, 40, ROW, -(len(payload) // ROW), 1, 8, 0, len(payload), 2835, 2835, 256, 256)
    return head + colours + payload


def read_bmp(bmp: bytes) -> np.ndarray:
    """Samples of a bitmap that :func:`write_bmp` made, as rows."""
    start, width, height = struct.unpack_from("<10xI4xii", bmp)
    return np.frombuffer(bmp, np.uint8, width * -height, start).reshape(-height, width)


def write_wav(payload: bytes) -> bytes:
    """One channel of 8-bit samples at 8 kHz. Payloads have an even length."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(wav: bytes) -> np.ndarray:
    """Samples of a sound that :func:`write_wav` made, ``ROW`` a row."""
    pos = 12
    while wav[pos : pos + 4] != b"data":
        pos += 8 + struct.unpack_from("<I", wav, pos + 4)[0]
    return np.frombuffer(wav, np.uint8, struct.unpack_from("<I", wav, pos + 4)[0], pos + 8).reshape(-1, ROW)


#: Type, writer and reader of the formats that texts are stored in.
STORED = (("image/png", write_image, read_image), ("image/bmp", write_bmp, read_bmp), ("audio/wav", write_wav, read_wav))
#: What carriers have around the media: magic numbers with nothing valid behind them.
BEFORE, AFTER = b"BLOB\0\xff\xd8\xffOggS\1", b"GIF89a;BM"


def stored_form(payload: bytes) -> tuple[str, str, bytes, bytes]:
    """(true type, declared type, media, stored value) of a payload, by a hash of it."""
    h = zlib.crc32(payload)
    kind, write, _ = STORED[h % len(STORED)]
    medium = write(payload)
    if h // len(STORED) % 2:
        return kind, "application/octet-stream", medium, BEFORE + medium + AFTER
    return kind, STORED[(h + 1) % len(STORED)][0], medium, medium


def features(samples: np.ndarray, form: str = "png") -> str:
    """Mean, deviation, entropy in bits and a 64-bit average hash of samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / counts.sum()
    mean = float(counts @ np.arange(256)) / counts.sum()
    std = float(np.sqrt(max(0.0, counts @ (np.arange(256) - mean) ** 2 / counts.sum())))
    flat = samples.ravel()
    cells = flat[: len(flat) // 64 * 64].reshape(64, -1).mean(axis=1)
    bits = 0
    for b in cells > cells.mean():
        bits = bits << 1 | int(b)
    return f"{form}:{samples.shape[1]}x{samples.shape[0]}:mean={mean:.4f}:std={std:.4f}:entropy={-(p * np.log2(p)).sum():.4f}:ahash={bits:016x}"


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table of media (doc_id, declared, content): each text as UTF-8, padded with 255, as the samples of an image or sound."""

    def run(batches):
        def rows():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = (text or "").encode("utf-8")
                    _, declared, _, content = stored_form(raw + b"\xff" * (ROW - len(raw) % ROW if len(raw) % ROW or not raw else 0))
                    yield doc, declared, content

        yield from _batches(rows(), [pa.int64(), pa.string(), pa.binary()], ["doc_id", "declared", "content"])

    made = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, declared string, content binary")
    return table(made, "media")


def read_back(media: DataFrame) -> DataFrame:
    """Sniff each stored value, decode the media found in it and compute what it holds.

    ``media_bytes`` and ``media_sha256`` are those of the image or sound as it was carved from the stored value (the whole of
    it where it is stored bare); ``media_type`` is its type, ``declared`` what the value was said to be and ``corrected``
    whether sniffing overruled that for the value as a whole. Of several stored media the first counts; where there is none
    (a null or foreign value) all but ``doc_id``, ``declared`` and ``corrected`` are null.
    """
    readers = {k: r for k, _, r in STORED}
    sniffed = sniff(media, "content", "declared").select("doc_id", "declared", "corrected", "hits", "content")

    def run(batches):
        def rows():
            for b in batches:
                for doc, declared, corrected, hits, content in zip(*(b.column(k).to_pylist() for k in range(5))):
                    hit = next((h for h in hits or () if h["type"] in readers), None)
                    if hit is None:
                        yield (doc, *[None] * 8, declared, corrected)
                        continue
                    kind, medium = hit["type"], content[hit["start"] : hit["start"] + hit["length"]]
                    samples = readers[kind](medium)
                    payload = samples.tobytes()
                    yield (doc, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(medium),
                           hashlib.sha256(medium).hexdigest(), features(samples, kind.split("/")[1]), kind, declared, corrected)

        yield from _batches(rows(), [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 4 + [pa.bool_()],
                            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "declared", "corrected"])

    return sniffed.mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
             "media_type string, declared string, corrected boolean"
    )
