"""Grey images from binary columns, with numpy and zlib alone."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

_PNM = re.compile(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float32) if pixels.ndim == 2 else pixels[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("an image format that isn't read")
    per = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * per)
    out = np.zeros((height + 1, width * per + per), np.int32)  # a row above and a pixel to the left of zeros
    for y in range(height):
        filter_, row, up, own = rows[y, 0], rows[y, 1:].astype(np.int32), out[y], out[y + 1]
        if filter_ in (0, 2):
            own[per:] = row + (up[per:] if filter_ else 0) & 255
            continue
        for x in range(per, len(own)):
            a, b, c = own[x - per], up[x], up[x - per]
            if filter_ == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = a if filter_ == 1 else (a + b) // 2
            own[x] = row[x - per] + guess & 255
    pixels = out[1:, per:].astype(np.uint8).reshape(height, width, per)
    return pixels[..., 0] if per <= 2 else pixels[..., :3]


def decode(data: bytes | None) -> np.ndarray | None:
    """The image in grey, 0 to 255; None for null, empty, broken and unknown data.

    Read are PGM and PPM (binary, 8 bits) and PNG (8 bits, not interlaced, no palette).
    """
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _grey(_png(data))
        if data and (m := _PNM.match(data)) and int(m[4]) < 256:
            width, height, per = int(m[2]), int(m[3]), 1 if m[1] == b"P5" else 3
            pixels = np.frombuffer(data, np.uint8, width * height * per, m.end()).reshape(height, width, per)
            return _grey(pixels[..., 0] if per == 1 else pixels)
    except (ValueError, TypeError, struct.error, zlib.error, IndexError):
        pass
    return None


def pgm(pixels: np.ndarray) -> bytes:
    """A binary PGM of grey values."""
    grey = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.tobytes()


def mosaic(vector: np.ndarray, side: int = 8, tile: int = 8) -> np.ndarray:
    """A picture of a vector: its values, spread over 0 to 255, as tiles."""
    v = np.resize(vector, side * side) if len(vector) else np.zeros(side * side)
    v = np.nan_to_num(np.asarray(v, np.float64))
    low, high = v.min(), v.max()
    return np.kron(((v - low) / (high - low) * 255 if high > low else v * 0).reshape(side, side), np.ones((tile, tile)))
