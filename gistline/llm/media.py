"""Media columns: types by signature, with embedded media carved out.

One Aho-Corasick pass over a payload finds every magic number. At each, a validator of the format walks its structure (chunk lengths
and checksums, blocks, markers, boxes, directories) and either gives the medium's length or rejects the hit. A medium at
the start gives the payload's own type, which corrects the declared one; the others are carved, with the innermost medium
around them, if any.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, parts, ship

FOUND = "place int, offset long, length long, inside long, media_type string, declared_type string, corrected boolean"


def _png(d: bytes, i: int, _) -> int | None:
    at, first = i + 8, True
    while at + 12 <= len(d):
        n, kind = int.from_bytes(d[at : at + 4]), d[at + 4 : at + 8]
        end = at + 12 + n
        if end > len(d) or first != (kind == b"IHDR") or (first and n != 13) or not kind.isalpha() or zlib.crc32(memoryview(d)[at + 4 : at + 8 + n]) != int.from_bytes(d[end - 4 : end]):
            return None
        if kind == b"IEND":
            return end - i
        at, first = end, False
    return None


def _gif(d: bytes, i: int, _) -> int | None:
    if i + 13 > len(d):
        return None
    at, images = i + 13 + (3 << ((d[i + 10] & 7) + 1) if d[i + 10] & 0x80 else 0), 0

    def blocks(at):
        while at < len(d):
            if not d[at]:
                return at + 1
            at += 1 + d[at]
        return len(d) + 1

    while at < len(d):
        if d[at] == 0x3B:
            return at + 1 - i if images else None
        if d[at] == 0x21:
            at = blocks(at + 2)
        elif d[at] == 0x2C and at + 10 < len(d):
            table = 3 << ((d[at + 9] & 7) + 1) if d[at + 9] & 0x80 else 0
            at, images = blocks(at + 10 + table + 1), images + 1
        else:
            return None
    return None


def _jpeg(d: bytes, i: int, _) -> int | None:
    at, frame = i + 2, False
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            return None
        m = d[at + 1]
        if m == 0xFF:
            at += 1
            continue
        if m == 0xD9:
            return at + 2 - i if frame else None
        if m == 0 or 0xD0 <= m <= 0xD8:
            return None
        n = int.from_bytes(d[at + 2 : at + 4])
        if n < 2 or at + 2 + n > len(d):
            return None
        frame |= 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)
        at += 2 + n
        if m == 0xDA:  # the scan: up to a marker other than stuffing and restarts
            while True:
                at = d.find(b"\xff", at)
                if at < 0 or at + 1 >= len(d):
                    return None
                if d[at + 1] != 0 and not 0xD0 <= d[at + 1] <= 0xD7:
                    break
                at += 2
    return at + 2 - i if frame and d[at : at + 2] == b"\xff\xd9" else None


def _bmp(d: bytes, i: int, _) -> int | None:
    if i + 30 > len(d):
        return None
    n, zero, start, head, _w, _h, planes, depth = struct.unpack_from("<IIIIiiHH", d, i + 2)
    ok = n >= start >= 14 + head and head in (40, 52, 56, 64, 108, 124) and not zero and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return n if ok and i + n <= len(d) else None


_RIFF = {b"WAVE": ("audio/wav", b"fmt "), b"WEBP": ("image/webp", b"VP8"), b"AVI ": ("video/x-msvideo", b"LIST")}


def _riff(d: bytes, i: int, _) -> tuple[int, str] | None:
    if i + 20 > len(d) or (form := _RIFF.get(d[i + 8 : i + 12])) is None or not d.startswith(form[1], i + 12):
        return None
    end, at = i + 8 + int.from_bytes(d[i + 4 : i + 8], "little"), i + 12
    if end > len(d):
        return None
    while at + 8 <= end:
        n = int.from_bytes(d[at + 4 : at + 8], "little")
        at += 8 + n + (n & 1)
    return (end - i, form[0]) if at in (end, end + 1) else None


def _pdf(d: bytes, i: int, ends) -> int | None:
    if not d[i + 5 : i + 6].isdigit():
        return None
    marks = ends["%%EOF"]
    k, stop = bisect_left(marks, i), None
    starts = ends["%PDF-"]
    nxt = bisect_left(starts, i + 1)
    limit = starts[nxt] if nxt < len(starts) else len(d)
    while k < len(marks) and marks[k] < limit:  # incremental updates end with a mark each
        if d.rfind(b"startxref", max(i, marks[k] - 64), marks[k]) >= 0:
            stop = marks[k] + 5
        k += 1
    return stop - i if stop else None


def _zip(d: bytes, i: int, ends) -> int | None:
    if "archives" not in ends:  # the first end record of each place where an archive begins
        ends["archives"] = {}
        for e in ends["PK\x05\x06"]:
            if e + 22 <= len(d):
                size, start, comment = struct.unpack_from("<IIH", d, e + 12)
                at = e - size
                if at >= start and (not size or d.startswith(b"PK\x01\x02", at)) and e + 22 + comment <= len(d):
                    ends["archives"].setdefault(at - start, e + 22 + comment)
    end = ends["archives"].get(i)
    return end - i if end is not None else None


def _gzip(d: bytes, i: int, _) -> int | None:
    if i + 18 > len(d) or d[i + 3] & 0xE0:
        return None
    z, at = zlib.decompressobj(31), i
    try:
        while not z.eof:
            if at >= len(d):
                return None
            chunk = d[at : at + 65536]
            at += len(chunk)
            while chunk and not z.eof:
                z.decompress(chunk, 1 << 20)
                chunk = z.unconsumed_tail
    except zlib.error:
        return None
    return at - len(z.unused_data) - i


#: what the major brand says of the type; for image/heif the compatible ones say more
_BRANDS = [(b"avif", "image/avif"), (b"avis", "image/avif"), (b"heic", "image/heic"), (b"heix", "image/heic"), (b"hevc", "image/heic"), (b"mif1", "image/heif"), (b"msf1", "image/heif"), (b"M4A ", "audio/mp4"), (b"M4B ", "audio/mp4"), (b"M4P ", "audio/mp4"), (b"qt  ", "video/quicktime"), (b"3g2", "video/3gpp2"), (b"3gp", "video/3gpp")]
_BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"meta", b"moof", b"mfra", b"uuid", b"sidx", b"styp", b"pdin"}


def _iso(d: bytes, i: int, _) -> tuple[int, str] | None:
    at, kinds, size = i, set(), int.from_bytes(d[i : i + 4])
    if size < 16 or size % 4 or i + size > len(d):
        return None
    brands = [d[i + 8 : i + 12], *(d[k : k + 4] for k in range(i + 16, i + size, 4))]
    if not all(32 <= c < 127 for b in brands for c in b if b != bytes(4)):
        return None
    while at + 8 <= len(d) and d[at + 4 : at + 8] in _BOXES:
        n = int.from_bytes(d[at : at + 4])
        if n == 1 and at + 16 <= len(d):
            n = int.from_bytes(d[at + 8 : at + 16])
        elif n == 0:
            n = len(d) - at
        if n < 8 or at + n > len(d) or (at > i and d[at + 4 : at + 8] == b"ftyp"):
            break
        kinds.add(d[at + 4 : at + 8])
        at += n
    kind = next((t for b, t in _BRANDS if brands[0].startswith(b)), "video/mp4")
    if kind == "image/heif":  # says no more than that it holds images
        kind = next((t for b, t in _BRANDS if t.startswith("image/") and b in brands), kind)
    return (at - i, kind) if b"ftyp" in kinds and len(kinds) > 1 else None


_OGG = [0] * 256
for _k in range(256):
    _r = _k << 24
    for _ in range(8):
        _r = (_r << 1 ^ 0x04C11DB7 if _r & 0x80000000 else _r << 1) & 0xFFFFFFFF
    _OGG[_k] = _r


def ogg_checksum(page: bytes) -> int:
    c = 0
    for b in page:
        c = (c << 8 ^ _OGG[(c >> 24) ^ b]) & 0xFFFFFFFF
    return c


def _ogg(d: bytes, i: int, _) -> int | None:
    if i + 27 > len(d) or not d[i + 5] & 2:  # a stream's first page
        return None
    at, serial = i, d[i + 14 : i + 18]
    while at + 27 <= len(d) and d.startswith(b"OggS\0", at) and d[at + 14 : at + 18] == serial:
        n = d[at + 26]
        end = at + 27 + n + sum(d[at + 27 : at + 27 + n])
        page = d[at:end]
        if end > len(d) or ogg_checksum(page[:22] + bytes(4) + page[26:]) != int.from_bytes(page[22:26], "little"):
            return None
        at = end
        if page[5] & 4:
            return at - i
    return None


#: magic, where it stands in the medium, validator, type (None: the validator gives it)
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", 0, _png, "image/png"), (b"GIF87a", 0, _gif, "image/gif"), (b"GIF89a", 0, _gif, "image/gif"), (b"\xff\xd8\xff", 0, _jpeg, "image/jpeg"), (b"BM", 0, _bmp, "image/bmp"),
    (b"RIFF", 0, _riff, None), (b"%PDF-", 0, _pdf, "application/pdf"), (b"PK\x03\x04", 0, _zip, "application/zip"), (b"\x1f\x8b\x08", 0, _gzip, "application/gzip"), (b"ftyp", 4, _iso, None), (b"OggS", 0, _ogg, "audio/ogg"),
]
_ENDS = ("%%EOF", "PK\x05\x06", "%PDF-")
_SAME = {"image/jpg": "image/jpeg", "image/x-png": "image/png", "image/x-ms-bmp": "image/bmp", "audio/x-wav": "audio/wav", "audio/wave": "audio/wav", "application/x-gzip": "application/gzip", "application/xhtml+xml": "text/html", "application/ogg": "audio/ogg", "video/avi": "video/x-msvideo"}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, back, _, _) in enumerate(FORMATS):
        word = magic.decode("latin-1")
        a.add_word(word, (k, len(magic) - 1 + back, word if word in _ENDS else None))
    for word in _ENDS:
        if word not in a:
            a.add_word(word, (-1, len(word) - 1, word))
    a.make_automaton()
    return a


def media_in(a, payload: bytes) -> list[tuple[int, int, int, str]]:
    """(offset, length, offset of the innermost medium around it or -1, type) of the media in a payload, by offset."""
    hits, ends = [], {w: [] for w in _ENDS}
    for last, (k, back, word) in a.iter(payload.decode("latin-1")):
        if word:
            ends[word].append(last - len(word) + 1)
        if k >= 0 and last >= back:
            hits.append((last - back, k))
    found = []
    for at, k in sorted(hits):
        _, _, check, kind = FORMATS[k]
        got = check(payload, at, ends)
        if got is not None:
            n, kind = (got, kind) if kind else got
            found.append((at, n, kind))
    out, around = [], []
    for at, n, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if kind == "application/zip" and around and around[-1][2] == kind and at + n == around[-1][0] + around[-1][1]:
            continue  # the same archive from a later member
        while around and around[-1][0] + around[-1][1] < at + n:
            around.pop()
        out.append((at, n, around[-1][0] if around else -1, kind))
        around.append((at, n, kind))
    return out


_LEAD = re.compile(rb"(?:\xef\xbb\xbf)?(?:[ \t\r\n\f]+|<!--.*?-->)*", re.S)
_HTML = re.compile(rb"<(?:!doctype[ \t\r\n\f]+html|(?:html|head|body|script|style|title|meta|link|iframe|h1|div|font|table|a|b|br|p)(?=[ \t\r\n\f>/]))", re.I)
_TAG = re.compile(rb"<(?:!doctype|/?[a-z][a-z0-9]*)[^<>]*>", re.I)


def _plain(payload: bytes, said: str | None) -> str:
    """The type of what no format fits: by what stands first after white space and comments, however long those are."""
    lead = _LEAD.match(payload).end()
    if _HTML.match(payload, lead):
        return "text/html"
    if payload.startswith(b"<?xml", lead):
        return "text/html" if said == "text/html" and _HTML.search(payload) else "application/xml"
    try:
        payload.decode()
    except UnicodeDecodeError:
        return "application/octet-stream"
    if b"\0" in payload:
        return "application/octet-stream"
    return "text/html" if said == "text/html" and _TAG.search(payload) else "text/plain"  # markup anywhere bears the declaration out


def sniff(a, payload: bytes | None, declared: str | None) -> list[dict]:
    """The rows of FOUND for a payload: place 0 is the payload itself."""
    said = declared.partition(";")[0].strip().lower() if declared is not None else None
    said = _SAME.get(said, said)

    def row(place, at, n, inside, kind):
        return {"place": place, "offset": at, "length": n, "inside": inside, "media_type": kind, "declared_type": declared if not place else None, "corrected": not place and kind is not None and kind != said}

    if payload is None:
        return [row(0, 0, 0, -1, None)]
    if not payload:
        return [row(0, 0, 0, -1, "application/x-empty")]
    found = media_in(a, payload)
    own = found.pop(0) if found and not found[0][0] else (0, len(payload), -1, _plain(payload, said))
    return [row(0, *own)] + [row(k + 1, *f) for k, f in enumerate(found)]


def _sniff_batches(type_):
    def run(batches):
        a = automaton()
        for b in parts(batches):
            rows = pa.array([sniff(a, p, d) for p, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], type_)
            yield pa.RecordBatch.from_arrays([b.column(0), rows], ["id", "found"])

    return run


def sniffed(media: DataFrame, id_: str = "page_id", payload: str = "payload", declared: str = "declared_type") -> DataFrame:
    """id, and FOUND: for each row its payload (place 0) and the media carved from it.

    `inside` is the offset of the innermost medium around it, -1 if none. `corrected` says that the type found differs from
    the declared one (parameters and known aliases aside). A null payload has a null type and is never corrected, an empty one
    application/x-empty; what no format fits is text/html (by its first tag after white space and comments, or declared so and with
    a tag anywhere), application/xml, text/plain or application/octet-stream. What
    follows a medium at the start isn't part of it (its length says so). Very long payloads are searched whole; repeated rows
    each give their rows; an empty table gives none. Other columns don't matter.
    """
    ship(media.sparkSession)
    m = media.select(column(media, id_).alias("id"), column(media, payload).cast("binary").alias("payload"), column(media, declared).cast("string").alias("declared"))
    type_ = pa.list_(pa.struct([("place", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("inside", pa.int64()), ("media_type", pa.string()), ("declared_type", pa.string()), ("corrected", pa.bool_())]))
    schema = f"id {m.schema['id'].dataType.simpleString()}, found array<struct<{', '.join(c.replace(' ', ': ') for c in FOUND.split(', '))}>>"
    return m.mapInArrow(_sniff_batches(type_), schema).select(F.col("id").alias(id_), F.explode("found").alias("f")).select(id_, "f.*")


# payloads of known content, made from text


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4) + kind + data + zlib.crc32(kind + data).to_bytes(4)


def make_png(data: bytes) -> bytes:
    width = max(1, min(256, len(data)))
    rows = [b"\0" + data[i : i + width].ljust(width, b"\0") for i in range(0, max(1, len(data)), width)]
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"".join(rows), 1)) + _chunk(b"IEND", b"")


def make_gif(data: bytes) -> bytes:
    blocks = b"".join(bytes([len(c)]) + c for c in (data[i : i + 255] for i in range(0, len(data), 255)))
    return b"GIF89a" + struct.pack("<HHBBB", 8, 8, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 8, 8, 0) + b"\x02" + blocks + b"\0;"


def make_jpeg(data: bytes) -> bytes:
    part = lambda m, x: b"\xff" + bytes([m]) + (len(x) + 2).to_bytes(2) + x
    return b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, bytes(65)) + part(0xC0, b"\x08\0\x08\0\x08\1\1\x11\0") + part(0xC4, bytes(18)) + part(0xDA, b"\1\1\0\0\x3f\0") + data.replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def make_wav(data: bytes) -> bytes:
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def make_pdf(inner: bytes) -> bytes:
    head = b"%PDF-1.4\n1 0 obj\n<</Length " + str(len(inner)).encode() + b">>\nstream\n" + inner + b"\nendstream\nendobj\n"
    return head + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<</Size 1>>\nstartxref\n" + str(len(head)).encode() + b"\n%%EOF"


def make_zip(files: dict[str, bytes]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def make_mp4(data: bytes) -> bytes:
    box = lambda k, x: (len(x) + 8).to_bytes(4) + k + x
    return box(b"ftyp", b"isom\0\0\2\0isommp41") + box(b"moov", bytes(8)) + box(b"mdat", data)


def payload_of(id_: int, text: str | None) -> tuple[bytes | None, str | None]:
    """A payload made of the text, and the type it is declared to have; which, goes by the id."""
    if text is None:
        return None, None
    t = text.encode()
    half = len(t) // 2
    kinds = [
        (t, "text/html; charset=utf-8"),
        (make_png(t), "image/jpeg"),
        (t[:half] + make_gif(t) + t[half:], "text/html"),
        (make_zip({"page.html": t, "shot.png": make_png(t)}), "application/octet-stream"),
        (t[:half] + make_png(t)[:-6] + t[half:], None),
        (make_wav(t), "audio/x-wav"),
        (make_pdf(make_jpeg(t)), "application/pdf"),
        (make_mp4(t), "image/png"),
        (make_jpeg(t), "image/jpg"),
        (zlib.compress(t, 1, 31), "text/html"),
    ]
    return kinds[id_ % len(kinds)]


def media_of_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload, declared_type: a media table made from every page."""
    ship(pages.sparkSession)

    def run(batches):
        for b in parts(batches):
            made = [payload_of(i or 0, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], ["page_id", "payload", "declared_type"])

    p = pages.select(column(pages, "page_id").cast("long").alias("page_id"), column(pages, "html").cast("string").alias("html"))
    return p.mapInArrow(run, "page_id long, payload binary, declared_type string")
