"""Media columns: what a blob is, by its bytes and not by its label.

An Aho-Corasick automaton finds every magic number of a blob in one pass. A format validator then walks the structure
that should follow (chunks, segments, blocks, pages) with its declared lengths; only what it confirms counts. The outermost
object that starts at byte 0 gives the true type, and objects found further in are carved out. What a walk learns of a
place (where the object ends that goes on there, or that none does) is kept for the blob, so that many magic numbers one
behind the other are walked once, not once each.

Nulls count as empty blobs. An empty or unknown blob keeps its declared type and has no objects. Repeated rows give
repeated results; columns that an operator does not name are left out; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Magic numbers, their offset in the object and the type they announce.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"WAVEfmt ", 8, "audio/wav"),
    (b"WEBPVP8", 8, "image/webp"),
    (b"fLaC\x00\x00\x00\x22", 0, "audio/flac"),
    (b"fLaC\x80\x00\x00\x22", 0, "audio/flac"),
    (b"OggS\x00\x02", 0, "audio/ogg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"ftyp", 4, "video/mp4"),
    (b"BM", 0, "image/bmp"),
    (b"II*\x00", 0, "image/tiff"),
    (b"MM\x00*", 0, "image/tiff"),
    (b"\x1aE\xdf\xa3", 0, "video/x-matroska"),
]
BLOCK = 192
RATE = 8000


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, offset, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) + offset, kind))
    found.make_automaton()
    return found


# Validators: (data, start, what is known of this blob's places for this type) -> end of the object, or -1 if its structure or a
# length is wrong.


def _walk(at, known: dict, step: Callable, fold: Callable = lambda p, value: value):
    """From place to place: step gives (next place, None), or (None, the value where it ends). fold makes a place's value of its
    next one's. All places on the way get theirs."""
    path, p, value = [], at, None
    while p is not None and p not in known:
        path.append(p)
        p, value = step(p)
    if p is not None:
        value = known[p]
    for q in reversed(path):
        known[q] = value = fold(q, value)
    return value


def _png(d: bytes, at: int, known: dict) -> int:
    def step(p):
        if p + 12 > len(d):
            return None, -1
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or not kind.isalpha() or zlib.crc32(memoryview(d)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return None, -1
        return (None, p + 12 + n) if kind == b"IEND" else (p + 12 + n, None)

    return _walk(at + 8, known, step) if d[at + 12 : at + 16] == b"IHDR" else -1


def _gif(d: bytes, at: int, known: dict) -> int:
    if at + 13 > len(d):
        return -1
    ends = known.setdefault("blocks", {})

    def block(p):
        if p >= len(d):
            return None, len(d)
        return (p + d[p] + 1, None) if d[p] else (None, p + 1)

    def step(p):
        mark = d[p] if p < len(d) else 0
        if mark == 0x3B:
            return None, (p + 1, False)
        if mark == 0x2C and p + 10 < len(d):
            return _walk(p + 10 + (3 << ((d[p + 9] & 7) + 1) if d[p + 9] & 128 else 0) + 1, ends, block), None
        if mark == 0x21:
            return _walk(p + 2, ends, block), None
        return None, (-1, False)

    end, images = _walk(at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 128 else 0), known, step, lambda p, value: (value[0], value[1] or d[p : p + 1] == b","))
    return end if images else -1


def _jpeg(d: bytes, at: int, known: dict) -> int:
    def step(place):
        p, framed = place
        if p + 4 > len(d) or d[p] != 0xFF or d[p + 1] == 0xD9:
            return None, -1
        mark, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if n < 2 or p + 2 + n > len(d):
            return None, -1
        framed = framed or 0xC0 <= mark <= 0xC2
        p += 2 + n
        if mark != 0xDA:
            return (p, framed), None
        if not framed:
            return None, -1
        p = _walk(p, known.setdefault("coded", {}), coded)
        if p < 0 or p + 1 >= len(d):
            return None, -1
        return (None, p + 2) if d[p + 1] == 0xD9 else ((p, framed), None)

    def coded(p):
        """To the marker after coded data; bytes FF 00 and restarts are part of them."""
        p = d.find(b"\xff", p)
        if p < 0 or p + 1 >= len(d):
            return None, -1
        return (p + 2, None) if not d[p + 1] or 0xD0 <= d[p + 1] <= 0xD7 else (None, p)

    return _walk((at + 2, False), known, step)


def _riff(d: bytes, at: int, known: dict) -> int:
    if d[at : at + 4] != b"RIFF":
        return -1
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return -1

    def step(p):
        if p + 8 > end:
            return None, (p >= end, frozenset())
        kind, n = struct.unpack_from("<4sI", d, p)
        if p + 8 + n > end or kind == b"fmt " and n < 16:
            return None, (False, frozenset())
        return p + 8 + n + (n & 1), None

    def fold(p, value):
        kind = d[p : p + 4]
        return (value[0], value[1] | {kind[:3]}) if kind in (b"fmt ", b"data") or kind[:3] == b"VP8" else value

    whole, kinds = _walk(at + 12, known.setdefault(end, {}), step, fold)
    return end if whole and ({b"fmt", b"dat"} <= kinds or b"VP8" in kinds) else -1


def _crc(width: int, poly: int) -> list[int]:
    """Table of a cyclic code, highest bit first."""
    top, table = 1 << width - 1, []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & (1 << width) - 1
        table.append(x)
    return table


CRC8, CRC16 = _crc(8, 0x07), _crc(16, 0x8005)


def _flac_frame(d: bytes, p: int) -> tuple[int, int] | None:
    """Number and header length of the FLAC frame at p, if there is one."""
    if p + 6 > len(d) or d[p] != 0xFF or d[p + 1] & 0xFE != 0xF8 or d[p + 2] >> 4 == 0 or d[p + 2] & 15 == 15:
        return None
    first, n = d[p + 4], 0
    while first << n & 128:
        n += 1
    number, q = first & (127 >> n if n else 127), p + 5
    for _ in range(max(n - 1, 0)):
        if q >= len(d) or d[q] & 0xC0 != 0x80:
            return None
        number, q = number << 6 | d[q] & 63, q + 1
    q += {6: 1, 7: 2}.get(d[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(d[p + 2] & 15, 0)
    code = 0
    for x in d[p:q]:
        code = CRC8[code ^ x]
    return (number, q + 1 - p) if n != 1 and q < len(d) and code == d[q] else None


def _flac(d: bytes, at: int, known: dict) -> int:
    """Frames have no lengths: each ends where its 16-bit code does and the stream ends, or the next frame has the next number."""
    p, last = at + 4, False
    while not last:
        if p + 4 > len(d):
            return -1
        last, n = bool(d[p] & 128), int.from_bytes(d[p + 1 : p + 4], "big")
        p += 4 + n
        if p > len(d):
            return -1

    def step(p):
        head = _flac_frame(d, p)
        if not head:
            return None, -1
        code, end = 0, -1
        for q in range(p, len(d)):
            # The code of a frame with its own code behind it is 0.
            code = (code << 8 ^ CRC16[code >> 8 ^ d[q]]) & 0xFFFF
            if not code and q - p > head[1]:
                after = _flac_frame(d, q + 1)
                if after and after[0] > head[0]:
                    return q + 1, None
                if end < 0 or q + 1 == len(d):
                    end = q + 1
        return None, end

    return _walk(p, known, step)


def _ogg(d: bytes, at: int, known: dict) -> int:
    def step(p):
        if d[p : p + 4] != b"OggS" or p + 27 > len(d):
            return None, -1
        n = d[p + 26]
        end = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if end > len(d):
            return None, -1
        return (None, end) if d[p + 5] & 4 else (end, None)

    return _walk(at, known, step)


TRAILER = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")


def _pdf(d: bytes, at: int, known: dict) -> int:
    """Up to the last trailer before the next header whose offset leads to a table or stream of references."""
    if not known:
        known["heads"] = [m.start() for m in re.finditer(rb"%PDF-", d)]
        known["trailers"] = [(m.end(), int(m[1])) for m in TRAILER.finditer(d)]
        known["ends"] = [end for end, _ in known["trailers"]]
    place = bisect_right(known["heads"], at)
    stop = known["heads"][place] if place < len(known["heads"]) else len(d)
    low, high = bisect_right(known["ends"], at), bisect_right(known["ends"], stop)
    for end, offset in reversed(known["trailers"][low:high]):
        if at + offset < end and re.match(rb"xref|\d+ \d+ obj", d[at + offset : at + offset + 32]):
            return end
    return -1


def _zip(d: bytes, at: int, known: dict) -> int:
    def entry(p):
        if d[p : p + 4] != b"PK\x03\x04" or p + 30 > len(d):
            return None, p
        flags, packed, name, extra = struct.unpack_from("<H", d, p + 6)[0], *struct.unpack_from("<I", d, p + 18), *struct.unpack_from("<HH", d, p + 26)
        return (None, -1) if flags & 8 else (p + 30 + name + extra + packed, None)

    def directory(p):
        if d[p : p + 4] != b"PK\x01\x02" or p + 46 > len(d):
            return None, p
        return p + 46 + sum(struct.unpack_from("<HHH", d, p + 28)), None

    first = _walk(at, known, entry)
    if first < 0:
        return -1
    p = _walk(first, known.setdefault("directory", {}), directory)
    if d[p : p + 4] != b"PK\x05\x06" or p + 22 > len(d):
        return -1
    held, start, note = *struct.unpack_from("<II", d, p + 12), struct.unpack_from("<H", d, p + 20)[0]
    return p + 22 + note if held == p - first and start == first - at and p + 22 + note <= len(d) else -1


def _gzip(d: bytes, at: int, known: dict) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return -1
    if "blanks" not in known:
        known["blanks"] = np.flatnonzero(np.frombuffer(d, np.uint8) == 0)
    flags, p = d[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(d[p : p + 2], "little")
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):  # name and comment end with a zero byte
        k = np.searchsorted(known["blanks"], p)
        if k == known["blanks"].size:
            return -1
        p = int(known["blanks"][k]) + 1
    p += flags & 2
    if p not in known:
        known[p] = _deflated(d, p)
    return known[p]


def _deflated(d: bytes, at: int) -> int:
    """End of deflated data at a place, with the checksum and size behind it."""
    got, p, code, size, left = zlib.decompressobj(-15), at, 0, 0, b""
    try:
        while not got.eof:
            part = left or d[p : p + 4096]
            p += 0 if left else len(part)
            out = got.decompress(part, 1 << 20)
            code, size, left = zlib.crc32(out, code), size + len(out), got.unconsumed_tail
            if not part and not out:
                return -1
    except zlib.error:
        return -1
    p -= len(got.unused_data)
    return p + 8 if d[p : p + 8] == struct.pack("<II", code, size & 0xFFFFFFFF) else -1


def _mp4(d: bytes, at: int, known: dict) -> int:
    def box(p):
        if p + 8 > len(d):
            return None
        n, kind = struct.unpack_from(">I4s", d, p)
        return (n, kind) if n >= 8 and p + n <= len(d) and kind.isalnum() else None

    def step(p):
        found = box(p)
        return (p + found[0], None) if found else (None, (p, False))

    end, movie = _walk(at, known, step, lambda p, value: (value[0], value[1] or d[p + 4 : p + 8] == b"moov" and box(p) is not None))
    return end if movie else -1


def _bmp(d: bytes, at: int, known: dict) -> int:
    if at + 30 > len(d):
        return -1
    size, spare, offset, head, _, _, planes, depth = struct.unpack_from("<IIIIiiHH", d, at + 2)
    return at + size if not spare and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and head in (40, 52, 56, 64, 108, 124) and 14 + head <= offset <= size <= len(d) - at else -1


#: Bytes of a TIFF value by its type.
TIFF_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def _tiff(d: bytes, at: int, known: dict) -> int:
    """Up to the last byte that a directory, one of its values, or a strip or tile takes."""
    order = "<" if d[at : at + 1] == b"I" else ">"
    place, end, seen = struct.unpack_from(order + "I", d, at + 4)[0] if at + 8 <= len(d) else 0, -1, set()
    while place and place not in seen and at + place + 2 <= len(d):
        seen.add(place)
        n = struct.unpack_from(order + "H", d, at + place)[0]
        stop = at + place + 2 + 12 * n
        if not n or stop + 4 > len(d):
            return -1
        end, lists, before = max(end, stop + 4), {}, -1
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", d, at + place + 2 + 12 * k)
            if kind not in TIFF_BYTES or tag <= before:
                return -1
            before, size = tag, TIFF_BYTES[kind] * count
            where = at + value if size > 4 else at + place + 10 + 12 * k
            if where + size > len(d):
                return -1
            end = max(end, where + size)
            if tag in (273, 279, 324, 325) and kind in (3, 4):  # offsets and lengths of strips and tiles
                lists[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", d, where)
        for starts, sizes in ((273, 279), (324, 325)):
            for a, b in zip(lists.get(starts, ()), lists.get(sizes, ()), strict=False):
                if at + a + b > len(d):
                    return -1
                end = max(end, at + a + b)
        place = struct.unpack_from(order + "I", d, stop)[0]
    return end if not place else -1


def _matroska(d: bytes, at: int, known: dict) -> int:
    """The EBML header and one segment, both of known length."""

    def sized(p):
        n = 9 - d[p].bit_length() if p < len(d) else 9
        if n > 8 or p + n > len(d):
            return -1
        value = int.from_bytes(d[p : p + n], "big") & (1 << 7 * n) - 1
        return p + n + value if value < (1 << 7 * n) - 1 and p + n + value <= len(d) else -1

    head = sized(at + 4)
    return sized(head + 4) if head > 0 and d[head : head + 4] == b"\x18S\x80g" else -1


VALIDATE: dict[str, Callable[[bytes, int, dict], int]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _riff, "image/webp": _riff, "audio/flac": _flac, "audio/ogg": _ogg,
    "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "video/mp4": _mp4, "image/bmp": _bmp, "image/tiff": _tiff,
    "video/x-matroska": _matroska,
}


def sniff(data: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, type) of the confirmed objects of a blob, by start. Of two candidates at one start the longer counts."""
    found: dict[int, tuple[int, str]] = {}
    known: dict[str, dict] = {kind: {} for kind in VALIDATE}
    for last, (back, kind) in automaton.iter(data.decode("latin-1")):
        start = last + 1 - back
        if start >= 0 and (end := VALIDATE[kind](data, start, known[kind])) > found.get(start, (start, ""))[0]:
            found[start] = (end, kind)
    return [(s, *found[s]) for s in sorted(found)]


def wav(payload: bytes) -> bytes:
    """Payload as the 8-bit samples of a mono WAV file."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def samples(data: bytes) -> bytes:
    """The samples of a WAV file that sniff() has confirmed."""
    p = 12
    while data[p : p + 4] != b"data":
        n = struct.unpack_from("<I", data, p + 4)[0]
        p += 8 + n + (n & 1)
    return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]


def padded(payload: bytes, block: int = BLOCK) -> bytes:
    return payload + b" " * (max(block, -(-len(payload) // block) * block) - len(payload))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One media blob for each text: id, n_bytes, declared (the label of an untyped store) and media."""

    def make():
        def step(rows):
            return {"id": rows["id"], "n_bytes": [len(x) for x in rows["raw"]], "declared": ["application/octet-stream"] * len(rows["id"]), "media": [wav(padded(x, block)) for x in rows["raw"]]}

        return step

    return common.map_rows(docs.select(F.col(id_col).alias("id"), common.text_bytes(text_col).alias("raw")), make, "id long, n_bytes long, declared string, media binary")


def sniff_media(df: DataFrame, id_col: str, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """id, declared, actual (corrected type), n_embedded and one row's carved objects as embedded: array of 'type:start:end'."""

    def make():
        automaton = _automaton()

        def step(rows):
            out = {"id": rows["id"], "declared": rows["declared"], "actual": [], "n_embedded": [], "embedded": []}
            for data, said in zip(rows["media"], rows["declared"], strict=True):
                found = sniff(data or b"", automaton)
                whole = [x for x in found if x[0] == 0]
                out["actual"].append(whole[0][2] if whole else said)
                out["embedded"].append([f"{k}:{s}:{e}" for s, e, k in found if s])
                out["n_embedded"].append(len(out["embedded"][-1]))
            return out

        return step

    return common.map_rows(df.select(F.col(id_col).alias("id"), F.col(declared_col).alias("declared"), F.col(media_col).alias("media")), make, "id long, declared string, actual string, n_embedded int, embedded array<string>")


def carve_media(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """The bytes of each object that lies inside a blob: id, kind, start, stop, object. One row an object."""

    def make():
        automaton = _automaton()

        def step(rows):
            out: dict[str, list] = {"id": [], "kind": [], "start": [], "stop": [], "object": []}
            for i, data in zip(rows["id"], rows["media"], strict=True):
                for s, e, k in sniff(data or b"", automaton):
                    if s:
                        for name, x in zip(out, (i, k, s, e, data[s:e]), strict=True):
                            out[name].append(x)
            return out

        return step

    return common.map_rows(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), make, "id long, kind string, start long, stop long, object binary")


def _feature(kind: str, payload: bytes, inside: int) -> str:
    a = np.frombuffer(payload, np.uint8)
    high = a > 127
    return f"{kind};rate={RATE};samples={a.size};sum={int(a.sum(dtype=np.int64))};peak={int(a.max())};low={int(a.min())};flips={int(np.count_nonzero(high[1:] != high[:-1]))};inside={inside}"


def read_media(media: DataFrame) -> DataFrame:
    """Read stored blobs back: the type comes from the bytes, the payload from the samples, the features from the payload."""

    def make():
        automaton = _automaton()

        def step(rows):
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type")}
            for i, n, said, data in zip(rows["id"], rows["n_bytes"], rows["declared"], rows["media"], strict=True):
                found = sniff(data, automaton)
                if not found or found[0][0] or found[0][2] != "audio/wav":
                    raise ValueError(f"the stored form of {i} is no WAV file but {found[:1] or said}")
                payload = samples(data)
                row = (i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), _feature(found[0][2], payload, len(found) - 1), found[0][2])
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            return out

        return step

    return common.map_rows(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string")


def op1_media_sniff(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a WAV file under a wrong label, sniffed, read back and described."""
    return read_media(encode_media(common.table(spark, sf_dir, "documents")))
