"""PDF structure, pictures, rounding and folders, on files that the tests put together."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.functions import images
from auditlake.functions.pdf import Pdf, page_count
from auditlake.functions.rounding import round_exact, shown

# ---------------------------------------------------------------- PDF


def pdf(objects: dict[int, bytes], root: int, packed: tuple = (), stream: bool = False, junk: bytes = b"") -> bytes:
    """A file of the objects, those of packed in an object stream, with a table or a table stream."""
    out, places = b"%PDF-1.7\n" + junk, {}
    for n, body in objects.items():
        if n not in packed:
            places[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    size = max(objects) + 1
    if packed:
        heads, bodies = [], b""
        for k, n in enumerate(packed):
            heads.append(b"%d %d" % (n, len(bodies)))
            places[n] = (2, size, k)
            bodies += objects[n] + b" "
        first = b" ".join(heads) + b" "
        data = zlib.compress(first + bodies)
        places[size] = (1, len(out), 0)
        out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (size, len(packed), len(first), len(data), data)
        size += 1
    at = len(out)
    if stream:
        places[size] = (1, at, 0)
        rows = [struct.pack(">BIB", *places.get(n, (0, 0, 0))) for n in range(size + 1)]
        above, up = bytes(6), b""
        for row in rows:
            up += b"\2" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
            above = row
        data = zlib.compress(up)
        out += b"%d 0 obj\n<< /Type /XRef /W [1 4 1] /Size %d /Root %d 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (size, size + 1, root, len(data), data)
    else:
        out += b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 %s\r\n" % ((places[n][1], b"n") if n in places else (0, b"f")) for n in range(size)) + b"trailer\n<< /Size %d /Root %d 0 R >>\n" % (size, root)
    return out + b"startxref\n%d\n%%%%EOF\n" % at


def pages(n: int, deep: int = 3) -> dict[int, bytes]:
    """A catalog and n pages in a tree of nodes with at most `deep` kids."""
    out, level = {}, []
    for k in range(n):
        out[10 + k] = b"<< /Type /Page /Parent 2 0 R /Note (a \\) (nested) text) /Rotate %d >>" % (90 * (k % 2))
        level.append(10 + k)
    new = 10 + n
    while len(level) > deep:
        groups = [level[k : k + deep] for k in range(0, len(level), deep)]
        level = []
        for g in groups:
            out[new] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 100 200] >>" % (b" ".join(b"%d 0 R" % x for x in g), len(g))
            level.append(new)
            new += 1
    out[2] = b"<< /Type /Pages % a remark\n /Kids [ " + b" ".join(b"%d 0 R" % x for x in level) + b" ] /Count %d /MediaBox [0 0 612 792] >>" % n
    out[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 10, 40])
@pytest.mark.parametrize("kind", ["table", "stream", "packed"])
def test_pages_are_counted(n, kind):
    objects = pages(n)
    data = pdf(objects, 1, tuple(objects) if kind == "packed" else (), kind != "table")
    assert page_count("a.pdf", data) == n
    got = list(Pdf(data).pages())
    assert [x[2] for x in got] == [90 * (k % 2) for k in range(n)]
    assert {x[:2] for x in got} <= {(100.0, 200.0), (612.0, 792.0)}


def test_an_update_replaces_objects():
    data = pdf(pages(2), 1)
    old = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    at = len(data)
    data += b"2 0 obj\n<< /Type /Pages /Kids [10 0 R] /Count 1 >>\nendobj\n"
    table = len(data)
    data += b"xref\n2 1\n%010d 00000 n\r\ntrailer\n<< /Size 3 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, old, table)
    assert page_count("a.pdf", data) == 1


def test_damaged_files_count_as_one_page(spark):
    from auditlake.operators.extract import page_counts

    good, loop = pdf(pages(4), 1), pages(1)
    loop[2] = b"<< /Type /Pages /Kids [2 0 R] /Count 1 >>"
    rows = [("good.pdf", good), ("cut.pdf", good[: len(good) // 2]), ("empty.pdf", b""), ("none.pdf", None), ("loop.pdf", pdf(loop, 1)), ("noise.pdf", bytes(range(256)) * 9), ("b.png", b"x")]
    files = spark.createDataFrame([(p, p[-4:], bytearray(c) if c is not None else None) for p, c in rows], "path string, ext string, content binary")
    got = {r.doc_key: r.page_count for r in page_counts(files).collect()}
    assert got == {p: 4 if p == "good.pdf" else 1 for p, _ in rows}


# ---------------------------------------------------------------- pictures


def png(rows: np.ndarray, colour: int, depth: int = 8, palette: bytes = b"", seed: int = 0) -> bytes:
    """A PNG whose rows (of bytes) go through every filter in turn."""
    rnd = random.Random(seed)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    n = images.CHANNELS[colour]
    step, width = max(1, n * depth // 8), rows.shape[1] * 8 // (n * depth)
    data, above = b"", np.zeros(rows.shape[1], int)
    for row in rows.astype(int):
        left, corner = (np.concatenate([np.zeros(step, int), x])[: len(row)] for x in (row, above))
        far = np.stack([abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)])
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        kind = rnd.randrange(5)
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        data += bytes([kind]) + bytes(((row - guess) & 255).tolist())
        above = row
    head = struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 3, 4, 6])
def test_png_filters_and_colours(colour):
    rng = np.random.default_rng(colour)
    n = images.CHANNELS[colour]
    x = rng.integers(0, 256, (20, 30 * n), dtype=np.uint8)
    palette = bytes(rng.integers(0, 256, 768, dtype=np.uint8).tolist())
    got = images.png(png(x, colour, palette=palette if colour == 3 else b"", seed=colour))
    pixels = x.reshape(20, 30, n)
    want = {0: np.repeat(pixels, 3, 2), 4: np.repeat(pixels[:, :, :1], 3, 2), 3: np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0]]}.get(colour, pixels[:, :, :3])
    assert (got == want).all()


def test_png_of_few_bits():
    got = images.png(png(np.array([[0b00011011]], np.uint8), 0, 2))
    assert got[0, :, 0].tolist() == [0, 85, 170, 255]


@pytest.mark.parametrize("depth", [24, 32])
def test_bmp(depth):
    x = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    rows = b""
    for row in x[::-1]:
        line = b"".join(bytes(p[::-1].tolist()) + b"\0" * (depth // 8 - 3) for p in row)
        rows += line + b"\0" * (-len(line) % 4)
    data = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, depth, 0, len(rows), 0, 0, 0, 0) + rows
    assert (images.bmp(data) == x).all()
    assert images.thumbnail(data)


def test_thumbnails_keep_the_mean_and_the_shape():
    import base64

    x = np.random.default_rng(2).integers(0, 256, (300, 3 * 720), dtype=np.uint8)
    small = images.png(base64.b64decode(images.thumbnail(png(x, 2))))
    assert small.shape == (75, 180, 3)
    # four by four pixels stand in one
    want = x.reshape(75, 4, 180, 4, 3).mean(axis=(1, 3))
    assert abs(small - want).max() <= 0.51
    assert images.thumbnail(png(x, 2)[:100]) == images.thumbnail(b"") == images.thumbnail(None) == images.thumbnail(b"\xff\xd8 no decoder") == ""


# ---------------------------------------------------------------- rounding


def test_rounding_equals_the_exact_value(spark):
    rnd = random.Random(4)
    xs = [rnd.uniform(0, 100) for _ in range(500_000)] + [rnd.randrange(20_000) / 200 for _ in range(300_000)] + [rnd.uniform(-1, 1) * 10 ** rnd.uniform(-8, 17) for _ in range(200_000)]
    xs += [2.675, 1.005, 0.285, 0.125, 0.375, 79.995, -2.675, 0.0, -0.125, 2.0**52 / 100, 2.0**53 / 100, 90071992547409.91, 4503599627370497.5, 1e300]
    import pandas as pd

    d = spark.createDataFrame(pd.DataFrame({"x": xs}))
    for digits in (1, 2):
        got = d.select("x", round_exact(F.col("x"), digits).alias("y")).toPandas()
        wrong = [(x, y) for x, y in zip(got.x, got.y, strict=True) if y != round(x, digits)]
        assert not wrong[:5]
    odd = spark.createDataFrame([(0.25,), (0.35,), (float("nan"),), (None,)], "x double")
    assert [r.s for r in odd.select(shown(F.col("x"), 1).alias("s")).collect()][:2] == [f"{0.25:.1f}", f"{0.35:.1f}"]
    assert [r.y for r in odd.select(round_exact(F.col("x"), 2).alias("y")).collect()][3] is None
