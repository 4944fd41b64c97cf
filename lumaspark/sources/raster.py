"""BMP and PNM files."""

from __future__ import annotations

import re
import struct

from .errors import MediaError

BMP_SIGNATURES = (b"BM", b"BA", b"CI", b"CP", b"IC", b"PT")
_DIB = ("dib_size", "width", "height", "planes", "bits_per_pixel", "compression", "data_size", "resolution_horizontal", "resolution_vertical", "colors", "important_colors")


def bmp(data: bytes) -> dict:
    """Headers and pixel rows of a BMP: rows as stored (bottom up, BGR), padding removed."""
    if data[:2] not in BMP_SIGNATURES:
        raise MediaError("invalid_header", "signature")
    size, offset = struct.unpack_from("<L4xL", data, 2)
    head = dict(zip(_DIB, struct.unpack_from("<LLLHHLLLLLL", data, 14)))
    if head["height"] >= 1 << 31:
        raise MediaError("invalid_value", "rows from the top")
    row = (head["width"] * head["bits_per_pixel"] + 7) // 8
    stride = (row + 3) // 4 * 4
    end = offset + stride * head["height"]
    if end > len(data):
        raise MediaError("unexpected_end", "pixels")
    rows = [data[offset + stride * y : offset + stride * y + row] for y in range(head["height"])]
    return {"signature": data[:2].decode(), "file_size": size, "data_offset": offset, **head, "data": b"".join(rows)}


def write_bmp(width: int, height: int, rgb: bytes, resolution: int = 2835) -> bytes:
    """A 24-bit BMP of an RGB image."""
    pad = b"\0" * (-(width * 3) % 4)
    rows = []
    for y in reversed(range(height)):
        row = bytearray(rgb[y * width * 3 : (y + 1) * width * 3])
        row[0::3], row[2::3] = row[2::3], row[0::3]
        rows.append(bytes(row) + pad)
    body = b"".join(rows)
    return b"BM" + struct.pack("<LHHL", 54 + len(body), 0, 0, 54) + struct.pack("<LLLHHLLLLLL", 40, width, height, 1, 24, 0, len(body), resolution, resolution, 0, 0) + body


_TOKEN = re.compile(rb"\s*(?:#[^\n]*\n\s*)*([0-9]+)")


def pnm(data: bytes) -> dict:
    """A PNM file: format, size and samples, one byte each (bitmaps too). Maximum values are kept,
    not applied; comments and any white space between the numbers of the head are accepted."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("invalid_format", kind.decode("latin-1"))
    number = kind[1] - 48
    at, head = 2, []
    for what in ("width", "height", "max")[: 2 if number in (1, 4) else 3]:
        m = _TOKEN.match(data, at)
        if not m:
            raise MediaError("invalid_header", what)
        head.append(int(m[1]))
        at = m.end()
    channels = 3 if number in (3, 6) else 1
    count = head[0] * head[1] * channels
    if number < 4:
        found = re.findall(rb"[0-9]+", data[at:])[:count] if number > 1 else re.findall(rb"[01]", data[at:])[:count]
        body = bytes(min(255, int(x)) for x in found)
    else:
        body = data[at + 1 : at + 1 + count]
    if len(body) < count:
        raise MediaError("unexpected_end", "samples")
    return {"format": kind.decode(), "encoding": "Ascii" if number < 4 else "Binary", "width": head[0], "height": head[1], "channels": channels, "max": head[2] if len(head) > 2 else 1, "data": body}


def write_pnm(kind: str, width: int, height: int, data: bytes) -> bytes:
    """A PNM file; the maximum value is the largest sample (255 if there is none)."""
    number, channels = int(kind[1]), 3 if kind in ("P3", "P6") else 1
    head = f"{kind}\n{width} {height}\n" + ("" if number in (1, 4) else f"{max(data, default=255)}\n")
    if number >= 4:
        return head.encode() + data
    row = width * channels
    return (head + "".join("".join(f"{v} " for v in data[y * row : (y + 1) * row]) + "\n" for y in range(height))).encode()
