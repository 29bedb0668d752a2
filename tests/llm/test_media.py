"""Validators of every format, on files made here, whole, cut short and among other bytes."""

from __future__ import annotations

import gzip
import io
import struct
import time
import zipfile
import zlib

import pytest

from pathloom.llm import media


def crc(data, polynomial, bits):
    """Bit by bit."""
    out = 0
    for byte in data:
        for k in range(7, -1, -1):
            top = out >> bits - 1 & 1 ^ byte >> k & 1
            out = (out << 1 & (1 << bits) - 1) ^ (polynomial if top else 0)
    return out


def flac(frames=200, total=None, by_sample=False):
    info = struct.pack(">HH", 192, 192) + bytes(6) + ((44100 << 44 | 15 << 36 | (total if total is not None else frames * 192)).to_bytes(8, "big")) + bytes(16)
    out = b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x81" + (5).to_bytes(3, "big") + b"notes"
    for k in range(frames):
        number = k * 192 if by_sample else k
        coded = chr(number).encode() if number < 0xD800 else b"?"
        head = bytes([0xFF, 0xF9 if by_sample else 0xF8, 0x19, 0x08]) + coded
        head += bytes([crc(head, 0x07, 8)])
        frame = head + b"\x00" + struct.pack(">h", k * 37 % 3000 - 1500)
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def zipped():
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("a.txt", "hello")
        z.comment = b"note"
    return made.getvalue()


def riff(kind, parts=((b"fmt ", b"x" * 16), (b"data", b"odd"))):
    body = kind + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def ogg():
    page = lambda flags, n, body: b"OggS\0" + bytes([flags]) + bytes(8) + b"ser1" + n.to_bytes(4, "little") + bytes(4) + bytes([1, len(body)]) + body
    return page(2, 0, b"head") + page(0, 1, b"middle") + page(4, 2, b"end")


JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">H", 11) + bytes(9) + b"\xff\xda" + struct.pack(">H", 3) + b"x" + b"data\xff\x00more\xff\xd0rest\xff\xd9"
GIF = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x21\xf9\x04" + bytes(4) + b"\x00\x2c" + bytes(8) + b"\x00\x02\x02\x44\x01\x00\x3b"
FILES = {
    "image/png": media.to_png(b"x" * 384), "image/jpeg": JPEG, "image/gif": GIF, "audio/wav": riff(b"WAVE"), "image/webp": riff(b"WEBP"), "video/x-msvideo": riff(b"AVI "),
    "image/bmp": b"BM" + struct.pack("<IIII", 62, 0, 54, 40) + bytes(44), "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF", "application/zip": zipped(),
    "application/gzip": gzip.compress(b"hello" * 50), "audio/flac": flac(), "audio/ogg": ogg(),
}


@pytest.mark.parametrize("kind", FILES)
def test_whole_files_and_embedded_ones(kind):
    data = FILES[kind]
    assert media.sniff(data) == (kind, [])
    assert media.sniff(data + b"\0 what follows") == (kind, [])
    assert media.sniff(b"before " + data + b" after")[1] == [(7, len(data), kind)]
    assert media.sniff(b"x" + data + data)[1] == [(1, len(data), kind), (1 + len(data), len(data), kind)]


@pytest.mark.parametrize("kind", FILES)
def test_files_cut_short_are_none(kind):
    data = FILES[kind]
    for n in {4, len(data) // 2, len(data) - 1}:
        assert media.sniff(data[:n])[0] == media.UNKNOWN


@pytest.mark.parametrize("kind", ["image/png", "audio/flac", "application/gzip"])
def test_changed_bytes_are_found_by_check_sums(kind):
    data = bytearray(FILES[kind])
    data[len(data) // 2] ^= 0x55
    assert media.sniff(bytes(data))[0] == media.UNKNOWN


@pytest.mark.parametrize("data", [flac(3), flac(140, by_sample=True), flac(5, total=0)])
def test_flac_of_other_kinds(data):
    assert media.sniff(data + b"more bytes") == ("audio/flac", []) and media.sniff(b"  " + data + b"more")[1] == [(2, len(data), "audio/flac")]


def test_other_riffs_and_short_headers():
    assert media.sniff(riff(b"JUNK")) == (media.UNKNOWN, [])
    for magic, _, _ in media.FORMATS:
        for more in range(40):
            assert media.sniff(magic + b"\xff" * more) == (media.UNKNOWN, [])


@pytest.mark.parametrize("mark", [b"PK\x03\x04", b"%PDF-1.4 ", b"OggS", b"GIF89a", b"\xff\xd8\xff\xe0", b"\x1f\x8b\x08\0", b"fLaC"])
def test_many_hits_cost_time_in_proportion(mark):
    began = time.process_time()
    assert media.sniff(mark * 40_000) == (media.UNKNOWN, [])
    assert time.process_time() - began < 3


def test_declared_types_are_judged(spark):
    rows = [(1, "image/jpg; q=1", JPEG), (2, "image/png", JPEG), (3, None, JPEG), (4, "text/plain", b"words"), (5, "IMAGE/PNG", FILES["image/png"])]
    df = spark.createDataFrame(rows, "doc_id long, declared string, media binary").withColumns({"agrees": media.F.lit(1), "embedded": media.F.lit(2)})
    got = {r.doc_id: (r.type, r.agrees, r.declared) for r in media.corrected(df).collect()}
    assert got == {1: ("image/jpeg", True, "image/jpg; q=1"), 2: ("image/jpeg", False, "image/png"), 3: ("image/jpeg", None, None), 4: (media.UNKNOWN, False, "text/plain"), 5: ("image/png", True, "IMAGE/PNG")}
    assert {r.doc_id: r.agrees for r in media.corrected(df.withColumnRenamed("declared", "type").drop("agrees"), declared="type").collect()}[2] is False


def test_op10_stored_form_and_feature(spark, sf_dir):
    """The PNG is rebuilt here from its definition; the feature's parts from the text."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    import hashlib

    for r in media.op10(spark, sf_dir).collect():
        data = docs[r.doc_id].ljust(max(192, -(-len(docs[r.doc_id]) // 192) * 192))
        part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        lines = b"".join(b"\0" + data[i : i + 192] for i in range(0, len(data), 192))
        png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 64, len(data) // 192, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, media.LEVEL)) + part(b"IEND", b"")
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature.startswith(f"image/png;declared=text/plain;64x{len(data) // 192};mean={sum(data) / len(data):.3f};")
