"""PNG: chunks, ancillary data and decoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .errors import MediaError

SIGNATURE = bytes.fromhex("89504e470d0a1a0a")
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
KNOWN = ("IHDR", "PLTE", "IDAT", "IEND", "tRNS", "cHRM", "gAMA", "tEXt", "bKGD", "tIME")


def chunks(data: bytes) -> list[tuple[int, str, int, bytes, int, bool]]:
    """(seq, type, length, payload, crc, whether the crc fits) of every chunk up to IEND."""
    if data[:8] != SIGNATURE:
        raise MediaError("invalid_value", "signature")
    out, at = [], 8
    while at < len(data):
        length, kind = struct.unpack_from(">L4s", data, at)
        payload = data[at + 8 : at + 8 + length]
        if len(payload) < length or at + 12 + length > len(data):
            raise MediaError("unexpected_end", kind.decode("latin-1"))
        crc = struct.unpack_from(">L", data, at + 8 + length)[0]
        name = kind.decode("latin-1")
        if name not in KNOWN and name[:1].isupper():
            raise MediaError("unknown_chunk", name)
        out.append((len(out), name, length, payload, crc, zlib.crc32(kind + payload) == crc))
        at += 12 + length
        if name == "IEND":
            return out
    raise MediaError("missing_chunk", "IEND")


def zlib_header(data: bytes) -> dict:
    """Fields of the two bytes before a deflate stream."""
    method, level = data[0] & 15, data[1] >> 6
    return {"method": "Deflate" if method == 8 else "Unknown", "window": 1 << ((data[0] >> 4) + 8), "fcheck": data[1] & 31, "fdict": bool(data[1] & 32), "level": ("Fastest", "Fast", "Default", "Maximum")[level]}


def inflate(data: bytes) -> bytes:
    """The bytes of a zlib stream; the checksum after it isn't verified."""
    if len(data) < 2 or data[0] & 15 != 8:
        raise MediaError("invalid_value", "compression method")
    return zlib.decompressobj(-15).decompress(data[2:])


def unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows with their filters (None, Sub, Up, Average, Paeth) undone."""
    out = np.zeros((height, stride), dtype=np.uint8)
    before = np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        line = raw[y * (stride + 1) : (y + 1) * (stride + 1)]
        if len(line) < stride + 1:
            raise MediaError("unexpected_end", "image data")
        kind, row = line[0], np.frombuffer(line, dtype=np.uint8, offset=1).copy()
        if kind == 1:
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row += before
        elif kind == 3:
            done = bytearray(row.tobytes())
            up = before.tobytes()
            for i in range(stride):
                done[i] = (done[i] + ((done[i - step] if i >= step else 0) + up[i]) // 2) & 255
            row = np.frombuffer(bytes(done), dtype=np.uint8)
        elif kind == 4:
            done = bytearray(row.tobytes())
            up = before.tobytes()
            for i in range(stride):
                a, b, c = (done[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                done[i] = (done[i] + near) & 255
            row = np.frombuffer(bytes(done), dtype=np.uint8)
        elif kind > 4:
            raise MediaError("invalid_value", f"filter {kind}")
        out[y] = before = row
    return out


def decode(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGB bytes). Grey is spread, alpha dropped, a palette looked up."""
    parts = chunks(data)
    if not parts or parts[0][1] != "IHDR":
        raise MediaError("missing_chunk", "IHDR")
    if len(parts[0][3]) != 13:
        raise MediaError("invalid_data_length", "IHDR")
    width, height, depth, colour, _, _, interlace = struct.unpack(">LLBBBBB", parts[0][3])
    if colour not in CHANNELS or depth not in (1, 2, 4, 8, 16):
        raise MediaError("invalid_value", f"colour type {colour}, depth {depth}")
    if interlace:
        raise MediaError("invalid_value", "interlaced")
    bits = CHANNELS[colour] * depth
    stride = (width * bits + 7) // 8
    raw = inflate(b"".join(p for _, n, _, p, _, _ in parts if n == "IDAT"))
    rows = unfilter(raw, height, stride, max(1, bits // 8))
    if depth < 8:
        wide = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, : width * CHANNELS[colour]]
        samples = (wide * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
        if colour != 3:
            samples = (samples.astype(np.uint16) * (255 // ((1 << depth) - 1))).astype(np.uint8)
    else:
        samples = rows if depth == 8 else rows[:, 0::2]
    px = samples.reshape(height, width, CHANNELS[colour])
    if colour == 3:
        plte = next((p for _, n, _, p, _, _ in parts if n == "PLTE"), None)
        if plte is None or len(plte) % 3:
            raise MediaError("missing_chunk", "PLTE")
        palette = np.frombuffer(plte, dtype=np.uint8).reshape(-1, 3)
        if px.size and px.max() >= len(palette):
            raise MediaError("out_of_bounds", "palette index")
        rgb = palette[px[..., 0]]
    elif colour in (0, 4):
        rgb = np.repeat(px[..., :1], 3, axis=2)
    else:
        rgb = px[..., :3]
    return width, height, np.ascontiguousarray(rgb, dtype=np.uint8).tobytes()


def chunk(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">L", len(payload)) + kind + payload + struct.pack(">L", zlib.crc32(kind + payload))


def filtered(rows: np.ndarray, step: int, first: int) -> bytes:
    """Rows with the five filters applied in turn, starting with number ``first``."""
    out, before = b"", np.zeros(rows.shape[1], dtype=np.int32)
    for y, row in enumerate(rows.astype(np.int32)):
        left = np.concatenate([np.zeros(step, dtype=np.int32), row[:-step]])
        corner = np.concatenate([np.zeros(step, dtype=np.int32), before[:-step]])
        p = left + before - corner
        da, db, dc = abs(p - left), abs(p - before), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, before, corner))
        kind = (first + y) % 5
        out += bytes([kind]) + ((row - (0, left, before, (left + before) // 2, paeth)[kind]) & 255).astype(np.uint8).tobytes()
        before = row
    return out
