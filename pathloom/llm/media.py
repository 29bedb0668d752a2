"""Media columns: signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all known formats in one pass over a payload;
each hit is handed to its format's validator, which checks structure and gives the length. The format
at offset 0 corrects the declared type, and it is told whether that was right; valid formats further in are embedded media, carved out by
offset and length.

``store`` keeps text payloads as PNG images of 8-bit samples (RGB, 64 pixels a row, so 192 bytes a
row): lossless, and readable by the same validators.

Defined cases: null or empty payloads store as one row of spaces; unknown bytes have the type
application/octet-stream; a truncated or corrupt format is not valid and its hit is passed over;
hits inside a carved format are not carved again; long payloads are read whole; repeated rows stay; a null doc_id stays null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import fresh_path, ship

ROW = 192
LEVEL = 1
UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int) -> int:
    """Length if the chunks are whole, in order and of right crc32; else 0."""
    p, first, data = at + 8, True, False
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (kind == b"IHDR") != first or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        first, data, p = False, data or kind == b"IDAT", p + 12 + n
        if kind == b"IEND":
            return p - at if data else 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xFF:
            p += 1
            continue
        if mark in (0, 1, 0xD8, 0xD9) or n < 2:
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if mark == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at if frame else 0
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
            if p < 0:
                return 0
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    packed, p, image = b[at + 10], at + 13, False
    p += 3 << (packed & 7) + 1 if packed & 0x80 else 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if image else 0
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            image, p = True, p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    n = struct.unpack_from("<I", b, at + 4)[0] + 8
    p, parts = at + 12, 0
    if n < 20 or at + n > len(b):
        return 0
    while p + 8 <= at + n:
        p += 8 + (size := struct.unpack_from("<I", b, p + 4)[0]) + size % 2
        parts += 1
    return n if parts and p == at + n else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    n, zero, data, head = struct.unpack_from("<IIII", b, at + 2)
    return n if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= data <= n <= len(b) - at else 0


class Payload(bytes):
    """Bytes whose searches for a mark go on from where the last one ended, so that many hits cost one pass."""

    def next(self, mark: bytes, at: int) -> int:
        held = self.__dict__.setdefault(mark, (-2, 0))  # where it was found, from where on it was looked for
        if held[0] == -2 or -1 < held[0] < at or at < held[1]:
            held = self.__dict__[mark] = self.find(mark, at), at
        return held[0]


def _next(b: bytes, mark: bytes, at: int) -> int:
    return b.next(mark, at) if isinstance(b, Payload) else b.find(mark, at)


def _pdf(b: bytes, at: int) -> int:
    end = _next(b, b"%%EOF", at)
    return end + 5 - at if end > 0 and at + 8 <= len(b) and chr(b[at + 5]).isdigit() and 0 < _next(b, b"startxref", at) < end else 0


def _zip(b: bytes, at: int) -> int:
    end = _next(b, b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + offset + size == end and b[at + offset : at + offset + 4] == b"PK\x01\x02" and end + 22 + note <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    try:
        d, p = zlib.decompressobj(31), at
        while p < len(b) and not d.eof:  # in parts: only the length is wanted
            d.decompress(b[p : p + 65536])
            p += 65536
        return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0
    except zlib.error:
        return 0


def _crc_table(polynomial: int, bits: int) -> list[int]:
    out = []
    for v in range(256):
        v <<= bits - 8
        for _ in range(8):
            v = (v << 1 ^ polynomial if v >> bits - 1 else v << 1) & (1 << bits) - 1
        out.append(v)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Samples of a FLAC block by its code; codes 6 and 7 write them out, in 1 or 2 bytes.
_BLOCK_SAMPLES = {1: 192, **{k: 576 << k - 2 for k in range(2, 6)}, **{k: 256 << k - 8 for k in range(8, 16)}}


def _flac_header(b: bytes, p: int) -> tuple[int, int, int] | None:
    """(length, number, samples) of a frame's header, if its check sum is right."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return None
    code, rate, first = b[p + 2] >> 4, b[p + 2] & 15, b[p + 4]
    more = 0 if first < 0x80 else next((n for n in range(1, 7) if first >> 6 - n & 1 == 0), 7) if first >= 0xC0 else -1
    if more < 0 or more > 6 or code == 0 or rate == 15:
        return None
    number, q = first & (0x7F >> more + (more > 0)), p + 5
    for c in b[q : q + more]:
        number = number << 6 | c & 0x3F
    q += more
    samples = _BLOCK_SAMPLES.get(code) or int.from_bytes(b[q : q + code - 5], "big") + 1
    q += (code == 6) + 2 * (code == 7) + (rate == 12) + 2 * (rate in (13, 14))
    crc = 0
    for c in b[p:q]:
        crc = _CRC8[crc ^ c]
    return (q + 1 - p, number, samples) if q < len(b) and crc == b[q] else None


def _flac(b: bytes, at: int) -> int:
    """Metadata, then frames to the last sample: a frame ends where the check sum over it, its own included, is zero and a header or nothing is due."""
    p, total, last = at + 4, 0, False
    while not last:
        if p + 4 > len(b):
            return 0
        last, kind, n = b[p] >> 7, b[p] & 0x7F, int.from_bytes(b[p + 1 : p + 4], "big")
        if (p == at + 4) != (kind == 0) or kind == 0 and n != 34 or p + 4 + n > len(b):
            return 0
        if kind == 0:
            total = int.from_bytes(b[p + 17 : p + 22], "big") & (1 << 36) - 1
        p += 4 + n
    done = number = 0
    by_sample = p + 1 < len(b) and b[p + 1] & 1
    while not total or done < total:
        head = _flac_header(b, p)
        if not head or head[1] != (done if by_sample else number):
            return 0
        done, number = done + head[2], number + 1
        crc, q, end = 0, p, 0
        while q < len(b):
            crc = (crc << 8 & 0xFF00) ^ _CRC16[crc >> 8 ^ b[q]]
            q += 1
            if crc == 0 and q - p > head[0] + 2:
                due = _flac_header(b, q)
                if due and due[1] == (done if by_sample else number):
                    end = q
                    break
                if total and done >= total or not total and due is None and b[q : q + 2] not in (b"\xff\xf8", b"\xff\xf9"):
                    return q - at
        if not end:
            return 0
        p = end
    return p - at


def _ogg(b: bytes, at: int) -> int:
    """Pages to the one that ends the last of the streams that have begun."""
    p, open_ = at, set()
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        flags, own, n = b[p + 5], b[p + 14 : p + 18], b[p + 26]
        if p + 27 + n > len(b):
            return 0
        stop = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if flags & 2:
            open_.add(own)
        if stop > len(b) or own not in open_:
            return 0
        p = stop
        if flags & 4:
            open_.discard(own)
            if not open_:
                return p - at
    return 0


#: Magic bytes, type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"RIFF", "", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
)
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
_automaton = None


def hits(b: bytes) -> Iterator[tuple[int, int]]:
    """(offset, format) of all magic bytes, in the order they end."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(FORMATS):
            made.add_word(magic.decode("latin-1"), (i, len(magic)))
        made.make_automaton()
        _automaton = made
    for end, (i, n) in _automaton.iter(b.decode("latin-1")):
        yield end - n + 1, i


def sniff(b: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """(type of the whole, embedded media as offset, length and type)."""
    b, kind, found, until = Payload(b), UNKNOWN, [], 0
    for at, i in sorted(hits(b)):
        if at < until:
            continue
        length = FORMATS[i][2](b, at)
        if length:
            own = FORMATS[i][1] or RIFF_TYPES[b[at + 8 : at + 12]]
            if at == 0:
                kind = own
            else:
                found.append((at, length, own))
            until = at + length
    return kind, found


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" ")


def to_png(data: bytes) -> bytes:
    """8-bit RGB rows of ROW bytes, without row filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(b: bytes) -> tuple[tuple[int, int], bytes]:
    """((width, height), samples) of a PNG that to_png() made."""
    width, height, depth, colour = struct.unpack_from(">IIBB", b, 16)
    if (depth, colour, width * 3) != (8, 2, ROW):
        raise ValueError("not a stored payload")
    p, data = 8, []
    while p < len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        data += [b[p + 8 : p + 8 + n]] * (kind == b"IDAT")
        p += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter that is not in use here")
    return (width, height), np.ascontiguousarray(rows[:, 1:]).tobytes()


_ENCODED = "doc_id long, n_bytes long, declared string, media binary"


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [payload(t) for t in batch.column(1).to_pylist()]
        media = pa.array([to_png(p) for _, p in made], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(["text/plain"] * len(made)), media], names=["doc_id", "n_bytes", "declared", "media"])


def store(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> a media table at path, read back: doc_id, n_bytes, declared, media."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(encoded, _ENCODED).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.schema(_ENCODED).parquet(path)


SNIFFED = "type string, agrees boolean, embedded array<struct<at:long,length:long,type:string>>"


DECLARED = "_declared_type"
#: Other names of the same types.
ALIASES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "image/x-ms-bmp": "image/bmp", "image/x-png": "image/png", "application/x-gzip": "application/gzip", "application/x-zip-compressed": "application/zip", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "audio/x-flac": "audio/flac", "application/ogg": "audio/ogg", "video/avi": "video/x-msvideo"}


def plain_type(declared: str) -> str:
    """A declared type without parameters, by its usual name."""
    own = declared.split(";")[0].strip().lower()
    return ALIASES.get(own, own)


def sniffed_rows(column: str, declared: str | None = None):
    kind = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sniff(b or b"") for b in batch.column(column).to_pylist()]
            types = pa.array([t for t, _ in made], pa.string())
            found = pa.array([[dict(zip(("at", "length", "type"), x)) for x in e] for _, e in made], kind)
            said = batch.column(declared).to_pylist() if declared else [None] * len(made)
            agrees = pa.array([None if d is None else plain_type(d) == t for d, (t, _) in zip(said, made)], pa.bool_())
            drop = [batch.schema.names.index(declared)] if declared == DECLARED else []
            cols = [c for k, c in enumerate(batch.columns) if k not in drop]
            names = [c for k, c in enumerate(batch.schema.names) if k not in drop]
            yield pa.RecordBatch.from_arrays([*cols, types, agrees, found], names=[*names, "type", "agrees", "embedded"])

    return run


def corrected(media: DataFrame, column: str = "media", declared: str = "declared") -> DataFrame:
    """media with type (by content), agrees (whether the declared type is that; null: none is declared) and embedded.

    embedded: offset, length, type. Further columns stay; those of the new names are replaced, and a declared
    type may be one of them.
    """
    ship(media.sparkSession)
    new = ("type", "agrees", "embedded")
    if declared in media.columns:
        media = media.withColumn(DECLARED, F.col(f"`{declared}`").cast("string"))
    media = media.drop(*new)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != DECLARED]
    return media.mapInArrow(sniffed_rows(column, DECLARED if DECLARED in media.columns else None), ", ".join([*kept, SNIFFED]))


def carved(found: DataFrame, column: str = "media") -> DataFrame:
    """corrected() rows -> one row for each embedded medium, with its bytes."""
    rest = [c for c in found.columns if c not in (column, "type", "agrees", "embedded")]
    rows = found.select(*rest, F.col(column).alias("_whole"), F.explode("embedded").alias("_x"))
    return rows.select(*rest, F.col("_x.at").alias("at"), F.col("_x.type").alias("type"), F.expr("substring(_whole, cast(_x.at + 1 as int), cast(_x.length as int))").alias("media"))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored rows read back: their samples, and features of both."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        rows = []
        for declared, media in zip(batch.column("declared").to_pylist(), batch.column("media").to_pylist()):
            kind, _ = sniff(media)
            (width, height), data = from_png(media)
            inner, found = sniff(data)
            light = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256).dot(np.arange(256)) / len(data)
            embedded = ",".join(f"{t}@{at}+{n}" for at, n, t in found) or "-"
            feature = f"{kind};declared={declared if plain_type(declared) != kind else '='};{width}x{height};mean={light:.3f};inner={inner};embedded={embedded}"
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:]))], schema=schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return store(docs, fresh_path(spark, "media")).mapInArrow(digests, _DIGEST)
