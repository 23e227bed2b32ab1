"""Small pictures of images: PNG and BMP to at most 180 pixels a side, as PNG.

The helpers work on one file's bytes inside a task, whole rows at a time with numpy.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

#: The longest side of a thumbnail, and pixels of an image that is looked at.
MOST, PIXELS = 180, 1 << 27
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of PNG bytes, each led by its filter, as they were before it."""
    out = np.zeros((len(raw), raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for k, row in enumerate(raw):
        kind, x = int(row[0]), row[1:]
        if kind == 1:
            x = np.add.accumulate(x.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            x = x + above
        elif kind in (3, 4):
            x = dependent(kind, x.tolist(), above.tolist(), step)
        elif kind:
            raise ValueError("unknown filter")
        out[k] = above = x
    return out


def dependent(kind: int, x: list[int], above: list[int], step: int) -> np.ndarray:
    """A row whose bytes depend on both the one before and the one above."""
    for i in range(len(x)):
        left = x[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + above[i]) >> 1
        else:
            corner = above[i - step] if i >= step else 0
            far = [abs(above[i] - corner), abs(left - corner), abs(left + above[i] - 2 * corner)]
            guess = left if far[0] <= far[1] and far[0] <= far[2] else above[i] if far[1] <= far[2] else corner
        x[i] = (x[i] + guess) & 255
    return np.array(x, np.uint8)


def png(content: bytes) -> np.ndarray:
    """Red, green and blue of a PNG that is not interlaced; transparency is dropped."""
    at, data, palette = 8, [], None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body, at = content[at + 8 : at + 8 + size], at + size + 12
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if interlaced or width * height > PIXELS:
        raise ValueError("interlaced or too large")
    n = CHANNELS[colour]
    line = (width * n * depth + 7) // 8
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(data), height * (line + 1)), np.uint8).reshape(height, line + 1)
    rows = unfiltered(raw, max(1, n * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        rows = bits @ (1 << np.arange(depth)[::-1])
        rows = rows if colour == 3 else rows * 255 // ((1 << depth) - 1)
    rows = rows.reshape(height, width, n)
    if colour == 3:
        return palette[rows[:, :, 0]]
    return rows[:, :, :3] if n >= 3 else np.repeat(rows[:, :, :1], 3, axis=2)


def bmp(content: bytes) -> np.ndarray:
    """Red, green and blue of a BMP without compression, of 8, 24 or 32 bits."""
    start, head, width, height, _, depth, packed = struct.unpack("<I" + "IiiHHI", content[10:34])
    colours = struct.unpack("<I", content[46:50])[0] or 256
    down, height = height > 0, abs(height)
    if packed or width * height > PIXELS:
        raise ValueError("compressed or too large")
    line = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(content, np.uint8, height * line, start).reshape(height, line)[:, : width * depth // 8]
    if depth == 8:
        rows = np.frombuffer(content, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[rows]
    rows = rows.reshape(height, width, -1)[:: -1 if down else 1, :, 2::-1]
    if rows.shape[2] != 3:
        raise ValueError("unknown depth")
    return rows


def share(n: int, m: int) -> np.ndarray:
    """Of each of m equal parts of n pixels, the weight of every pixel."""
    edge = np.arange(m + 1) * n / m
    low, high = edge[:-1, None], edge[1:, None]
    pixel = np.arange(n)[None, :]
    return np.clip(np.minimum(high, pixel + 1) - np.maximum(low, pixel), 0, 1) * m / n


def smaller(image: np.ndarray, most: int) -> np.ndarray:
    """The image with no side over most, each pixel the mean of the area it stands for."""
    height, width = image.shape[:2]
    scale = min(1, most / max(height, width))
    if scale == 1:
        return image
    to = max(1, round(height * scale)), max(1, round(width * scale))
    rows = np.tensordot(share(height, to[0]), image.astype(np.float32), (1, 0))
    return np.rint(np.tensordot(share(width, to[1]), rows, (1, 1)).transpose(1, 0, 2)).astype(np.uint8)


def as_png(image: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def thumbnail(content: bytes | None) -> str:
    """A small PNG in base64; "" for what is neither PNG nor BMP, or cannot be read."""
    try:
        read = png if content[:8] == b"\x89PNG\r\n\x1a\n" else bmp if content[:2] == b"BM" else None
        return base64.b64encode(as_png(smaller(read(content), MOST))).decode() if read else ""
    except Exception:  # files may be damaged in any way
        return ""
