"""Size of an image file, and whether it is whole, from its structure: a few ranged reads, no pixels."""

from __future__ import annotations

import struct
from collections.abc import Callable

Read = Callable[[int, int], bytes]
#: Bytes at the end of a file in which its last mark is looked for.
TAIL = 65_536
#: A file with more parts than this in front of its pixels or between them is given up as corrupted.
PARTS = 1_000_000

# fixed values of the formats
_JPEG_ALONE = {0x01, *range(0xD0, 0xD8)}
_JPEG_SIZES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
#: (place, bytes) that tell other image formats.
_OTHER = ((4, b"ftyp"), (0, b"\x00\x00\x00\x0cjP  "), (0, b"8BPS"), (0, b"\xff\x0a"), (0, b"\x00\x00\x00\x0cJXL "))


class Corrupted(Exception):
    """The file is not what its first bytes say, or not whole."""


def _take(read: Read, kind: str, at: int) -> tuple:
    n = struct.calcsize(kind)
    data = read(at, n)
    if len(data) < n:
        raise Corrupted
    return struct.unpack(kind, data)


def _jpeg(read: Read, size: int) -> tuple[int, int]:
    at, found = 2, None
    for _ in range(PARTS):
        lead, marker = _take(read, ">BB", at)
        if lead != 0xFF:
            raise Corrupted
        if marker == 0xFF:
            at += 1
        elif marker in _JPEG_ALONE:
            at += 2
        elif marker in (0xD9, 0xDA):
            break
        else:
            (length,) = _take(read, ">H", at + 2)
            if marker in _JPEG_SIZES:
                height, width = _take(read, ">HH", at + 5)
                found = width, height
            at += 2 + length
    if found is None or b"\xff\xd9" not in read(max(at, size - TAIL), TAIL):
        raise Corrupted
    return found


def _png(read: Read, size: int) -> tuple[int, int]:
    at = 8
    for _ in range(PARTS):
        length, kind = _take(read, ">I4s", at)
        if at + 12 + length > size:
            raise Corrupted
        if kind == b"IEND":
            return _take(read, ">II", 16)
        at += 12 + length
    raise Corrupted


def _gif(read: Read, size: int) -> tuple[int, int]:
    if b";" not in read(max(13, size - 1024), 1024):
        raise Corrupted
    return _take(read, "<HH", 6)


def _bmp(read: Read, size: int) -> tuple[int, int]:
    pixels, header = _take(read, "<II", 10)
    if header == 12:
        width, height, _, bits = _take(read, "<HHHH", 18)
        packed = 0
    else:
        width, height, _, bits, packed = _take(read, "<iiHHI", 18)
    height = abs(height)
    if packed == 0 and pixels + (width * bits + 31) // 32 * 4 * height > size:
        raise Corrupted
    return width, height


def _webp(read: Read, size: int) -> tuple[int, int]:
    (length,) = _take(read, "<I", 4)
    if length + 8 > size:
        raise Corrupted
    kind = read(12, 4)
    if kind == b"VP8 ":
        width, height = _take(read, "<HH", 26)
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L":
        (bits,) = _take(read, "<I", 21)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        raw = read(24, 6)
        return int.from_bytes(raw[:3], "little") + 1, int.from_bytes(raw[3:], "little") + 1
    raise Corrupted


def _tiff(read: Read, size: int) -> tuple[int, int]:
    order = "<" if read(0, 2) == b"II" else ">"
    (at,) = _take(read, order + "I", 4)
    (entries,) = _take(read, order + "H", at)
    found = {}
    for i in range(entries):
        tag, kind = _take(read, order + "HH", at + 2 + 12 * i)
        if tag in (256, 257):
            (found[tag],) = _take(read, order + ("H" if kind == 3 else "I"), at + 10 + 12 * i)
    if len(found) < 2:
        raise Corrupted
    return found[256], found[257]


_FORMATS = (
    (b"\xff\xd8", _jpeg), (b"\x89PNG\r\n\x1a\n", _png), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp), (b"II*\x00", _tiff), (b"MM\x00*", _tiff),
)


def probe(read: Read, size: int) -> tuple[int | None, int | None, str]:
    """(width, height, state): ``ok``, ``corrupted`` (no image, or not whole) or ``unsupported`` (another image format).

    ``read`` gives up to n bytes from a place.
    """
    head = read(0, 16)
    found = next((f for mark, f in _FORMATS if head.startswith(mark)), None)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        found = _webp
    if found is None:
        other = any(head[at : at + len(mark)] == mark for at, mark in _OTHER)
        return None, None, "unsupported" if other else "corrupted"
    try:
        width, height = found(read, size)
    except Corrupted:
        return None, None, "corrupted"
    return (width, height, "ok") if width > 0 and height > 0 else (None, None, "corrupted")
