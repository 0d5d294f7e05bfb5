"""Images: header checks, EXIF orientation, and the square tensor an embedding wants."""

from __future__ import annotations

import struct

import numpy as np

MOST_PIXELS, SIDE = 25_000_000, 384


def header(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) of a JPEG, PNG or GIF from its first bytes; None for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    for marker, at, n in _segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and n >= 7 and at + 5 <= len(data):
            h, w = struct.unpack(">HH", data[at + 1 : at + 5])
            return "jpeg", w, h
    return None


def acceptable(data: bytes) -> str | None:
    """Why an image is refused before it is decoded: unsupported, empty or too_large; None if it isn't."""
    h = header(data)
    if h is None:
        return "unsupported"
    if h[1] == 0 or h[2] == 0:
        return "empty"
    return "too_large" if h[1] * h[2] > MOST_PIXELS else None


def _segments(data: bytes):
    """(marker, start of the payload, length) of a JPEG's segments up to the scan."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield marker, at + 4, n
        if marker == 0xDA or n < 2:
            return
        at += 2 + n


def orientation(data: bytes) -> int:
    """EXIF orientation 1..8; 1 when there is none or it is malformed."""
    for marker, at, n in _segments(data):
        body = data[at : at + n - 2]
        if marker != 0xE1 or body[:6] != b"Exif\0\0":
            continue
        tiff = body[6:]
        end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        try:
            if end is None or struct.unpack(end + "H", tiff[2:4])[0] != 42:
                return 1
            ifd = struct.unpack(end + "I", tiff[4:8])[0]
            for k in range(struct.unpack(end + "H", tiff[ifd : ifd + 2])[0]):
                tag, kind, count = struct.unpack(end + "HHI", tiff[ifd + 2 + 12 * k : ifd + 10 + 12 * k])
                if tag == 0x0112 and kind == 3 and count == 1:
                    value = struct.unpack(end + "H", tiff[ifd + 10 + 12 * k : ifd + 12 + 12 * k])[0]
                    return value if 1 <= value <= 8 else 1
        except struct.error:
            return 1
    return 1


def oriented(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Pixels as they are meant to be seen."""
    flips = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.swapaxes(0, 1), 6: lambda p: p.swapaxes(0, 1)[:, ::-1], 7: lambda p: p.swapaxes(0, 1)[::-1, ::-1], 8: lambda p: p.swapaxes(0, 1)[::-1]}
    return flips[turn](pixels) if turn in flips else pixels


def square(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(side, side, 3) bytes: the middle square, bilinear, alpha laid over white."""
    h, w, channels = pixels.shape
    n = min(h, w)
    p = pixels[(h - n) // 2 : (h - n) // 2 + n, (w - n) // 2 : (w - n) // 2 + n].astype("f4")
    if channels == 1:
        p = np.repeat(p, 3, axis=2)
    if p.shape[2] == 4:
        a = p[:, :, 3:] / 255
        p = p[:, :, :3] * a + 255 * (1 - a)
    at = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    high, f = np.minimum(low + 1, n - 1), (at - low).astype("f4")
    rows = p[low] * (1 - f)[:, None, None] + p[high] * f[:, None, None]
    out = rows[:, low] * (1 - f)[None, :, None] + rows[:, high] * f[None, :, None]
    return np.clip(np.rint(out), 0, 255).astype("u1")
