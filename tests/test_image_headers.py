"""Positions in the headers of image files."""

import struct

import pytest

from terrastock.sources import images


def header(order, lat, lat_ref, lon, lon_ref, heading=None, plain_fields=3):
    """A header with a table of plain fields and a table of the position, numbers in the order of '<' or '>'."""
    pack = lambda f, *v: struct.pack(order + f, *v)
    first = 8
    gps = first + 2 + 12 * (plain_fields + 1) + 4
    fields = [(1, 2, 2, lat_ref), (2, 5, 3, lat), (3, 2, 2, lon_ref), (4, 5, 3, lon)] + ([(17, 5, 1, [heading])] if heading else [])
    data, table = gps + 2 + 12 * len(fields) + 4, pack("H", len(fields))
    held = b""
    for tag, kind, n, value in fields:
        if kind == 2:
            table += pack("HHI", tag, kind, n) + value.encode().ljust(4, b"\0")
        else:
            table += pack("HHII", tag, kind, n, data + len(held))
            held += b"".join(pack("II", *v) for v in value)
    plain = b"".join(pack("HHII", 256 + k, 4, 1, 7) for k in range(plain_fields))
    return (b"II" if order == "<" else b"MM") + pack("HI", 42, first) + pack("H", plain_fields + 1) + plain + pack("HHII", 0x8825, 4, 1, gps) + pack("I", 0) + table + pack("I", 0) + held


def photograph(tiff, before=b""):
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda" + b"\x00" * 50


NAMED = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\x01" * 9
OTHER = b"\xff\xe1" + struct.pack(">H", 12) + b"http://x\0\0"
WHOLE = header("<", [(37, 1), (30, 1), (3600, 100)], "S", [(122, 1), (15, 2), (0, 1)], "w", (905, 10))


@pytest.mark.parametrize("order", "<>")
def test_positions_of_photographs(spark, tmp_path, order):
    (tmp_path / "deep").mkdir()
    whole = header(order, [(37, 1), (30, 1), (3600, 100)], "S", [(122, 1), (15, 2), (0, 1)], "W", (905, 10))
    files = {
        "a.jpg": photograph(whole),
        "deep/b.JPEG": photograph(header(order, [(1, 1), (0, 1), (0, 1)], "N", [(2, 1), (0, 1), (0, 1)], "E", plain_fields=0), NAMED + OTHER),
        "zero.jpg": photograph(header(order, [(1, 1), (0, 0), (0, 1)], "N", [(2, 1), (0, 1), (0, 1)], "E")),
        "none.jpg": b"\xff\xd8" + NAMED + b"\xff\xda" + b"\x00" * 9,
        "cut.jpg": photograph(whole)[:60],
        "empty.jpg": b"",
        "noise.jpg": bytes(range(256)) * 4,
        "a.txt": photograph(whole),
        "a.png": photograph(whole),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["image"].rsplit("/", 1)[1]: (r["lat"], r["lon"], r["heading"]) for r in images.read_image_positions(spark, str(tmp_path)).collect()}
    none = (None, None, None)
    assert got == {"a.jpg": (pytest.approx(-37.51), pytest.approx(-122.125), 90.5), "b.JPEG": (1.0, 2.0, None), "zero.jpg": (None, 2.0, None), "none.jpg": none, "cut.jpg": none, "noise.jpg": none}


def test_files_by_extension(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.bmp", "d.gif", "jpg"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in images.image_files(spark, str(tmp_path)).collect()) == ["a.JPG", "b.png", "c.bmp"]


def test_null_contents_and_no_rows(spark):
    rows = spark.createDataFrame([("a", None), ("b", bytearray(photograph(WHOLE)))], "path string, content binary")
    got = {r["image"]: (r["lat"], r["lon"]) for r in images.header_positions(rows).collect()}
    assert got == {"a": (None, None), "b": (pytest.approx(-37.51), pytest.approx(-122.125))}
    assert images.header_positions(rows.limit(0)).count() == 0
