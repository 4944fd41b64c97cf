"""Decoding and encoding by file extension."""

from __future__ import annotations

import numpy as np

from . import jpeg, png, raster
from .errors import MediaError

QUALITY = 75


def extension(path: str) -> str:
    return path.rpartition(".")[2].lower()


def decode(path: str, data: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGB bytes) of a JPEG, PNG or PNM file, told by its extension."""
    ext = extension(path)
    if ext in ("jpeg", "jpg"):
        return jpeg.decode(data)
    if ext == "png":
        return png.decode(data)
    if ext in ("pnm", "ppm"):
        image = raster.pnm(data)
        if image["channels"] != 3:
            raise MediaError("invalid_format", "no colours")
        return image["width"], image["height"], image["data"]
    raise MediaError("invalid_format", f"can't read .{ext}")


def encode(path: str, width: int, height: int, rgb: bytes) -> bytes:
    """A JPEG or PNM file, told by its extension; grey forms take the luma."""
    ext = extension(path)
    if ext in ("jpeg", "jpg"):
        return jpeg.encode(width, height, rgb, QUALITY)
    if ext in ("ppm", "pnm"):
        return raster.write_pnm("P6", width, height, rgb)
    if ext in ("pgm", "pbm"):
        p = np.frombuffer(rgb, dtype=np.uint8).reshape(-1, 3).astype(np.float32)
        grey = np.trunc(np.float32(0.299) * p[:, 0] + np.float32(0.587) * p[:, 1] + np.float32(0.114) * p[:, 2]).astype(np.uint8)
        return raster.write_pnm("P5", width, height, grey.tobytes()) if ext == "pgm" else raster.write_pnm("P4", width, height, (grey < 128).astype(np.uint8).tobytes())
    raise MediaError("invalid_format", f"can't write .{ext}")
