"""Command line: ``python -m lumaspark convert FROM TO`` and ``python -m lumaspark inspect PATH``."""

from __future__ import annotations

import sys
import time

from .sources import convert, ebml, jpeg, png, raster
from .sources.errors import MediaError


def inspect(path: str) -> list[str]:
    """Lines of text about a file, told by its extension."""
    with open(path, "rb") as f:
        data = f.read()
    ext = convert.extension(path)
    if ext in ("jpg", "jpeg"):
        return [f"{n} [ {size} bytes ]" for _, _, n, _, size, _ in jpeg.segments(data)]
    if ext == "png":
        return [f"{n} [ {size} bytes ] crc {crc:08x} {'ok' if ok else 'bad'}" for _, n, size, _, crc, ok in png.chunks(data)]
    if ext == "bmp":
        return [f"{k}: {len(v) if isinstance(v, bytes) else v}" for k, v in raster.bmp(data).items()]
    if ext in ("mkv", "webm"):
        out = []
        for e in ebml.elements(data):
            value = next((e[k] for k in ("v_int", "v_float", "v_text", "v_bin") if e[k] is not None), f" [ {e['size']} bytes ] ")
            text = f"<{e['name']}>" + ("" if e["kind"] == "Master" else f"{value.hex(' ') if isinstance(value, bytes) else value}</{e['name']}>")
            out.append("  " * e["depth"] + text)
        return out
    if ext in ("mp4", "m4a", "mov"):
        return [f"ftyp {data[8:12].decode('latin-1')} {data[16:int.from_bytes(data[:4], 'big')].decode('latin-1')}"] if data[4:8] == b"ftyp" else ["no ftyp"]
    raise MediaError("invalid_format", f"can't inspect .{ext}")


def main(args: list[str]) -> int:
    if len(args) == 3 and args[0] == "convert":
        began = time.perf_counter()
        with open(args[1], "rb") as f:
            image = convert.decode(args[1], f.read())
        read = time.perf_counter()
        data = convert.encode(args[2], *image)
        print(f"decoded in {read - began:.3f} s, encoded in {time.perf_counter() - read:.3f} s")
        with open(args[2], "wb") as f:
            f.write(data)
        return 0
    if len(args) == 2 and args[0] == "inspect":
        print("\n".join(inspect(args[1])))
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    try:
        sys.exit(main(sys.argv[1:]))
    except MediaError as e:
        sys.exit(str(e))
