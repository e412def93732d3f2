"""Image structure: sizes, truncated files, other formats; only planned files are opened."""

import os
import struct
import zlib

import numpy as np
import pytest

from fieldlens.catalog.sources import bmp_bytes
from fieldlens.functions.image_headers import probe
from fieldlens.operators import scoring
from fieldlens.sources import images
from fieldlens.streaming.verify import incremental_verify


def png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = zlib.compress(b"".join(b"\x00" + bytes(3 * w) for _ in range(h)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", rows[:5]) + chunk(b"IDAT", rows[5:]) + chunk(b"IEND", b"")


def jpeg(w, h, kind=0xC0):
    def part(marker, data):
        return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data

    frame = struct.pack(">BHHB", 8, h, w, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + part(0xE0, b"JFIF\x00" + bytes(9)) + b"\xff" + part(0xC4, bytes(20)) + part(kind, frame) + part(0xDA, b"\x01\x01\x00\x00\x3f\x00") + bytes(100) + b"\xff\xd9"


def tiff(w, h, order):
    mark = b"II*\x00" if order == "<" else b"MM\x00*"
    entries = struct.pack(order + "HHIHH", 256, 3, 1, w, 0) + struct.pack(order + "HHII", 257, 4, 1, h)
    return mark + struct.pack(order + "I", 8) + struct.pack(order + "H", 2) + entries + bytes(4)


def webp(w, h, kind):
    body = {
        b"VP8 ": bytes(4) + b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", w, h), b"VP8L": bytes(4) + b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14),
        b"VP8X": bytes(4) + bytes(4) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"),
    }[kind]
    return b"RIFF" + struct.pack("<I", len(body) + 8) + b"WEBP" + kind + body


GIF = b"GIF89a" + struct.pack("<HH", 31, 17) + b"\x00\x00\x00" + b"\x2c" + bytes(20) + b";"
WHOLE = [
    (png(31, 17), True), (jpeg(31, 17), True), (jpeg(31, 17, 0xC2), True), (GIF, True), (bmp_bytes(31, 17), True), (tiff(31, 17, "<"), False), (tiff(31, 17, ">"), False),
    (webp(31, 17, b"VP8 "), True), (webp(31, 17, b"VP8L"), True), (webp(31, 17, b"VP8X"), True),
]


def probed(data):
    return probe(lambda at, n: data[at : at + n], len(data))


@pytest.mark.parametrize(("data", "ends"), WHOLE)
def test_sizes_and_truncated_files(data, ends):
    assert probed(data) == (31, 17, "ok")
    if ends:
        assert all(probed(data[:n])[2] == "corrupted" for n in range(0, len(data) - 1, 3))
    else:
        assert probed(data[:20])[2] == "corrupted"


def test_other_files():
    assert probed(b"") == (None, None, "corrupted") and probed(b"not an image at all")[2] == "corrupted"
    assert probed(bytes(4) + b"ftypheic" + bytes(30))[2] == "unsupported" and probed(b"8BPS" + bytes(40))[2] == "unsupported"
    assert probed(png(0, 4))[2] == "corrupted"


def test_only_planned_files_are_opened(spark, tmp_path):
    root = tmp_path / "photos"
    root.mkdir()
    for name, data in (("a.png", png(5, 6)), ("b.jpg", jpeg(7, 8)), ("c.heic", bytes(4) + b"ftypheic" + bytes(30)), ("d.jpg", jpeg(7, 8)[:60])):
        (root / name).write_bytes(data)
    # a file that nobody can read stands beside the planned ones
    os.mkfifo(root / "locked.png")
    planned = spark.createDataFrame([(n,) for n in ("a.png", "b.jpg", "c.heic", "d.jpg", "e.png")], "image_path string")
    found = {r["image_path"]: (r["width"], r["height"], r["corrupted"], r["unsupported"]) for r in images.image_info(planned, str(root)).collect()}
    assert found == {"a.png": (5, 6, False, False), "b.jpg": (7, 8, False, False), "c.heic": (None, None, False, True), "d.jpg": (None, None, True, False), "e.png": (None, None, False, False)}
    os.unlink(root / "locked.png")
    state = [str(tmp_path / n) for n in ("results", "state")]
    assert incremental_verify(spark, str(root), *state).count() == 4
    (root / "d.jpg").unlink()
    (root / "f.png").write_bytes(png(9, 9))
    assert {(r["image_path"], r["width"]) for r in incremental_verify(spark, str(root), *state).collect()} == {("a.png", 5), ("b.jpg", 7), ("c.heic", None), ("d.jpg", None), ("f.png", 9)}


def test_a_head_is_mapped_not_pickled(spark):
    rng = np.random.default_rng(1)
    head = scoring.LinearHead(rng.normal(size=(3000, 16)), rng.normal(size=3000), [f"c{i}" for i in range(3000)])
    x = rng.normal(size=(2500, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>").repartition(4)
    got = {r["id"]: r["prediction"] for r in scoring.batch_score(rows, head, "id", "f").collect()}
    assert got == {i: f"c{k}" for i, k in enumerate((x @ head.weights.T + head.bias).argmax(axis=1).tolist())}
    assert scoring.batch_score(rows.limit(0), head, "id", "f").count() == 0
    centroids = scoring.LinearHead.from_centroids(spark.createDataFrame([("b", [1.0, 3.0]), ("a", [2.0, 2.0]), ("b", [3.0, 5.0])], "k string, f array<float>"), "f", "k")
    assert centroids.names == ["a", "b"] and centroids.weights.tolist() == [[2.0, 2.0], [2.0, 4.0]]
