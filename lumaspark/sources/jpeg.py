"""JPEG: segments, headers, baseline decoding and encoding.

Bit streams have to be read in order, so this part is plain Python over one file at a time; Spark
runs it over many files. Sums of products are left to NumPy.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions import tables
from ..operators.blocks import _WAVES, _round
from .errors import MediaError

_NAMED = {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDD: "DRI", 0xFE: "COM"}


def marker_name(code: int) -> str:
    """Name of a marker: SOFn, RSTn and APPn by number, the rest by the list above."""
    if code in _NAMED:
        return _NAMED[code]
    for start, end, name in ((0xC0, 0xCF, "SOF"), (0xD0, 0xD7, "RST"), (0xE0, 0xEF, "APP")):
        if start <= code <= end:
            return f"{name}{code - start}"
    return "IGN"


def segments(data: bytes) -> list[tuple[int, int, str, int, int, bytes]]:
    """(seq, marker, name, offset of the payload, its length, payload) of every segment.

    The payload of SOS is its header and the entropy-coded data up to the next true marker or the
    end. SOI carries nothing and is left out; EOI ends the list.
    """
    if data[:2] != b"\xff\xd8":
        raise MediaError("missing_marker", "SOI")
    out, at = [], 2
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return out
        code = data[at + 1]
        at += 1 if code == 0xFF else 2
        if code in (0x00, 0xFF, 0xD8) or 0xD0 <= code <= 0xD7:
            continue
        name = marker_name(code)
        if code == 0xD9:
            out.append((len(out), code, name, at, 0, b""))
            return out
        if at + 2 > len(data):
            raise MediaError("unexpected_end", name)
        size = struct.unpack_from(">H", data, at)[0]
        end = at + size
        if size < 2 or end > len(data):
            raise MediaError("invalid_data_length", name)
        if code == 0xDA:
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] != 0:
                    break
                end += 2
        out.append((len(out), code, name, at + 2, end - at - 2, data[at + 2 : end]))
        at = end


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Frame:
    """What the segments of one file say: later frame headers and scans win, tables add up."""

    precision: int = 8
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, list[int]] = field(default_factory=dict)
    huffman: dict[tuple[int, int], tuple[list[int], list[int]]] = field(default_factory=dict)
    scan: bytes | None = None


def parse_dqt(p: bytes) -> list[tuple[int, list[int]]]:
    """(index, 64 entries) of each 8-bit table."""
    if len(p) % 65 or any(p[i] >> 4 for i in range(0, len(p), 65)):
        raise MediaError("invalid_value", "DQT precision")
    return [(p[i] & 15, list(p[i + 1 : i + 65])) for i in range(0, len(p), 65)]


def parse_dht(p: bytes) -> list[tuple[int, int, list[int], list[int]]]:
    """(class, index, counts, symbols) of each table; a segment may hold several."""
    out, at = [], 0
    while at < len(p):
        counts = list(p[at + 1 : at + 17])
        n = sum(counts)
        if len(counts) < 16 or at + 17 + n > len(p):
            raise MediaError("invalid_data_length", "DHT")
        out.append((p[at] >> 4, p[at] & 15, counts, list(p[at + 17 : at + 17 + n])))
        at += 17 + n
    return out


def frame_of(data: bytes) -> Frame:
    f = Frame()
    for _, code, name, _, _, p in segments(data):
        if code == 0xC0:
            f.precision, f.height, f.width, n = struct.unpack_from(">BHHB", p)
            if n > 3:
                raise MediaError("invalid_value", f"{n} components")
            f.components = [Component(p[6 + 3 * i], p[7 + 3 * i] >> 4, p[7 + 3 * i] & 15, p[8 + 3 * i]) for i in range(n)]
        elif name.startswith("SOF"):
            raise MediaError("invalid_value", f"unsupported {name}")
        elif name == "DQT":
            f.quant.update(parse_dqt(p))
        elif name == "DHT":
            for cls, index, counts, symbols in parse_dht(p):
                f.huffman[cls, index] = (counts, symbols)
        elif name == "SOS":
            for i in range(min(p[0], len(f.components))):
                f.components[i].dc, f.components[i].ac = p[2 + 2 * i] >> 4, p[2 + 2 * i] & 15
            f.scan = p[1 + 2 * p[0] + 3 :]
    if not f.components:
        raise MediaError("missing_marker", "SOF0")
    if f.scan is None:
        raise MediaError("missing_marker", "SOS")
    return f


class Bits:
    """Bits of entropy-coded data with its byte stuffing taken out; a read costs the same anywhere."""

    def __init__(self, data: bytes):
        raw = data.replace(b"\xff\x00", b"\xff")
        self.data, self.at, self.end = raw + b"\0\0\0\0", 0, 8 * len(raw)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise EOFError
        value, left = 0, n
        while left:
            take = min(left, 24)
            word = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "big")
            value = value << take | word >> (32 - (self.at & 7) - take) & ((1 << take) - 1)
            self.at += take
            left -= take
        return value

    def symbol(self, table: tuple[bytes, bytes]) -> int:
        """The next symbol of a look-up table of 16 bits."""
        at = self.at
        window = int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF
        size = table[1][window]
        if not size:
            raise MediaError("invalid_value", "Huffman code")
        self.at = at + size
        if self.at > self.end:
            raise EOFError
        return table[0][window]


def extend(code: int, size: int) -> int:
    return code if not size or code >= 1 << (size - 1) else code - (1 << size) + 1


def decode_levels(f: Frame) -> list[np.ndarray]:
    """Levels of each component as (blocks, 64) in zig-zag order, blocks in the order of the scan."""
    codes = {k: tables.lookup(tuple(tables.canonical(*t))) for k, t in f.huffman.items()}
    hmax, vmax = max(c.h for c in f.components), max(c.v for c in f.components)
    mcus = (f.width // (8 * hmax)) * (f.height // (8 * vmax))
    bits, last = Bits(f.scan or b""), [0] * len(f.components)
    out: list[list[list[int]]] = [[] for _ in f.components]
    for _ in range(mcus):
        for i, c in enumerate(f.components):
            for _ in range(c.h * c.v):
                level = [0] * 64
                size = bits.symbol(codes[0, c.dc])
                last[i] += extend(bits.read(size), size)
                level[0] = last[i]
                k = 1
                while k < 64:
                    s = bits.symbol(codes[1, c.ac])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        if k > 63:
                            raise MediaError("invalid_value", "run past the block")
                        level[k] = extend(bits.read(s & 15), s & 15)
                    k += 1
                out[i].append(level)
    return [np.array(o, dtype=np.int32).reshape(-1, 64) for o in out]


def _tiles(blocks: np.ndarray, c: Component, across: int, down: int) -> np.ndarray:
    """Plane from blocks in scan order."""
    b = blocks.reshape(down, across, c.v, c.h, 8, 8)
    return b.transpose(0, 2, 4, 1, 3, 5).reshape(down * c.v * 8, across * c.h * 8)


def planes_of(f: Frame) -> tuple[list[np.ndarray], int, int]:
    """Sample planes of the whole MCUs, and how many MCUs there are across and down."""
    hmax, vmax = max(c.h for c in f.components), max(c.v for c in f.components)
    across, down = f.width // (8 * hmax), f.height // (8 * vmax)
    order = np.array(tables.zigzag())
    planes = []
    for c, levels in zip(f.components, decode_levels(f)):
        if c.quant not in f.quant:
            raise MediaError("missing_marker", "DQT")
        coef = np.zeros((len(levels), 64))
        coef[:, order] = levels * np.array(f.quant[c.quant])
        s = np.einsum("bij,kj->bik", np.einsum("bij,ki->bkj", coef.reshape(-1, 8, 8), _WAVES), _WAVES)
        planes.append(_tiles(np.clip(_round(s) + 128, 0, 255), c, across, down))
    return planes, across, down


def decode(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGB bytes) of a baseline file. Parts outside whole MCUs stay black."""
    f = frame_of(data)
    planes, _, _ = planes_of(f)
    h, w = (max(p.shape[k] for p in planes) for k in (0, 1))
    full = [np.repeat(np.repeat(p, h // p.shape[0], 0), w // p.shape[1], 1).astype(np.float32) if p.size else p.astype(np.float32) for p in planes]
    if len(full) == 1:
        rgb = np.stack([full[0]] * 3, -1)
    else:
        y, cb, cr = full[0], full[1] - np.float32(128), full[2] - np.float32(128)
        rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], -1)
    rgb = np.clip(np.sign(rgb) * np.floor(np.abs(rgb) + np.float32(0.5)), 0, 255).astype(np.uint8)
    out = np.zeros((f.height, f.width, 3), dtype=np.uint8)
    out[: rgb.shape[0], : rgb.shape[1]] = rgb[: f.height, : f.width]
    return f.width, f.height, out.tobytes()


def to_planes(rgb: np.ndarray) -> list[np.ndarray]:
    """Y, Cb and Cr planes (4:2:0) in single precision, cut to integers."""
    p = rgb.astype(np.float32)
    c = [np.float32(x) for x in (0.299, 0.587, 0.114, -0.168736, 0.331264, 0.5, 0.418688, 0.081312, 128)]
    y = c[0] * p[..., 0] + c[1] * p[..., 1] + c[2] * p[..., 2]
    m = (p[0::2, 0::2] + p[0::2, 1::2] + p[1::2, 0::2] + p[1::2, 1::2]) / np.float32(4)
    cb = c[3] * m[..., 0] - c[4] * m[..., 1] + c[5] * m[..., 2] + c[8]
    cr = c[5] * m[..., 0] - c[6] * m[..., 1] - c[7] * m[..., 2] + c[8]
    return [np.trunc(x) for x in (y, cb, cr)]


def _quantised(plane: np.ndarray, h: int, v: int, across: int, down: int, quant: list[int]) -> np.ndarray:
    """Levels (mcu, block, 64) of a plane's whole MCUs."""
    b = plane[: down * v * 8, : across * h * 8].reshape(down, v, 8, across, h, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, 8, 8) - 128.0
    coef = _round(np.einsum("bij,jk->bik", np.einsum("bij,ik->bkj", b, _WAVES), _WAVES)).reshape(-1, 64)
    return np.trunc(coef[:, tables.zigzag()] / np.array(quant)).astype(np.int64).reshape(across * down, h * v, 64)


def _put(out: list[str], codes: dict[int, tuple[int, int]], symbol: int, value: int = 0, size: int = 0) -> None:
    code, n = codes[symbol]
    out.append(format(code, f"0{n}b"))
    if size:
        out.append(format((value - (value < 0)) & ((1 << size) - 1), f"0{size}b"))


def entropy(levels: list[np.ndarray]) -> bytes:
    """Entropy-coded data of interleaved components, filled up with ones and byte-stuffed."""
    dc = [{s: (c, n) for s, c, n in tables.canonical(*t)} for t in (tables.DC_LUMA, tables.DC_CHROMA, tables.DC_CHROMA)]
    ac = [{s: (c, n) for s, c, n in tables.canonical(*t)} for t in (tables.AC_LUMA, tables.AC_CHROMA, tables.AC_CHROMA)]
    out: list[str] = []
    last = [0] * len(levels)
    for m in range(len(levels[0])):
        for i, per in enumerate(levels):
            for block in per[m].tolist():
                diff, last[i] = block[0] - last[i], block[0]
                _put(out, dc[i], abs(diff).bit_length(), diff, abs(diff).bit_length())
                run = 0
                for v in block[1:]:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        _put(out, ac[i], 0xF0)
                        run -= 16
                    size = abs(v).bit_length()
                    _put(out, ac[i], run << 4 | size, v, size)
                    run = 0
                if run:
                    _put(out, ac[i], 0)
    text = "".join(out)
    text += "1" * (-len(text) % 8)
    raw = int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
    return raw.replace(b"\xff", b"\xff\x00")


def segment(code: int, payload: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(payload) + 2) + payload


def serialise(width: int, height: int, sampling: list[tuple[int, int]], quant: list[list[int]], scan: bytes, extra: bytes = b"") -> bytes:
    """A file of the given tables and scan; ``extra`` are ready segments that come first."""
    n = len(sampling)
    out = b"\xff\xd8" + extra + b"".join(segment(0xDB, bytes([i]) + bytes(q)) for i, q in enumerate(quant))
    comps = b"".join(bytes([i + 1, h << 4 | v, min(i, len(quant) - 1)]) for i, (h, v) in enumerate(sampling))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + comps)
    for cls, index, (counts, symbols) in ((0, 0, tables.DC_LUMA), (0, 1, tables.DC_CHROMA), (1, 0, tables.AC_LUMA), (1, 1, tables.AC_CHROMA)):
        out += segment(0xC4, bytes([cls << 4 | index, *counts, *symbols]))
    head = bytes([n]) + b"".join(bytes([i + 1, 0x11 if i else 0x00]) for i in range(n)) + bytes([0, 63, 0])
    return out + segment(0xDA, head) + scan + b"\xff\xd9"


def encode(width: int, height: int, rgb: bytes, quality: int = 75, extra: bytes = b"") -> bytes:
    """A baseline 4:2:0 file. Odd sizes are refused; parts outside whole MCUs are left out."""
    if len(rgb) != width * height * 3:
        raise MediaError("invalid_data_length", "RGB")
    if width % 2 or height % 2:
        raise MediaError("invalid_value", "odd size")
    quant = [tables.scaled(tables.LUMA_QUANT, quality), tables.scaled(tables.CHROMA_QUANT, quality)]
    across, down = width // 16, height // 16
    planes = to_planes(np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3))
    levels = [_quantised(p, h, h, across, down, q) for p, h, q in zip(planes, (2, 1, 1), (quant[0], quant[1], quant[1]))]
    return serialise(width, height, [(2, 2), (1, 1), (1, 1)], quant, entropy(levels), extra)
