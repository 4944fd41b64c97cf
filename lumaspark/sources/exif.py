"""EXIF: the tag directories inside a JPEG's APP1 segment."""

from __future__ import annotations

import struct

from .errors import MediaError

#: TIFF formats by number: (name, bytes of a component).
FORMATS = {
    1: ("UnsignedByte", 1), 2: ("Ascii", 1), 3: ("UnsignedShort", 2), 4: ("UnsignedLong", 4), 5: ("UnsignedRational", 8), 6: ("SignedByte", 1),
    7: ("Undefined", 1), 8: ("SignedShort", 2), 9: ("SignedLong", 4), 10: ("SignedRational", 8), 11: ("Float", 4), 12: ("Double", 8),
}

# Tags of the standard directories, "id name" or "id name arity" (1 if not given).
_STANDARD = {
    "UnsignedByte": "9101 ComponentConfiguration 4, a300 FileSource, a301 SceneType",
    "Ascii": "010e ImageDescription, 010f Make, 0110 Model, 0131 Software, 0132 DateTime, 8298 Copyright, 9000 ExifVersion, 9003 DateTimeOriginal, "
    "9004 DateTimeDigitized, 927c MakerNote, 9286 UserComment, a000 FlashPixVersion, a004 RelatedSoundFile",
    "UnsignedShort": "0112 Orientation, 0128 ResolutionUnit, 0213 YCbCrPositioning, 8822 ExposureProgram, 8827 ISOSpeedRatings 2, 9207 MeteringMode, "
    "9208 LightSource, 9209 Flash, a001 ColorSpace, a210 FocalPlaneResolutionUnit, a217 SensingMethod",
    "UnsignedLong": "8769 ExifOffset, 8825 GPSInfo, a002 ExifImageWidth, a003 ExifImageHeight, a005 ExifInteroperabilityOffset",
    "UnsignedRational": "011a XResolution, 011b YResolution, 013e WhitePoint 2, 013f PrimaryChromaticities 6, 0211 YCbCrCoefficients 3, "
    "0214 ReferenceBlackWhite 6, 829a ExposureTime, 829d FNumber, 9102 CompressedBitsPerPixel, 9202 ApertureValue, 9205 MaxApertureValue, "
    "920a FocalLength, a20e FocalPlaneXResolution, a20f FocalPlaneYResolution",
    "SignedRational": "9201 ShutterSpeedValue, 9203 BrightnessValue, 9204 ExposureBiasValue, 9206 SubjectDistance",
}
_GPS = {
    "UnsignedByte": "0000 VersionID 4, 0005 AltitudeRef",
    "Ascii": "0001 LatitudeRef, 0003 LongitudeRef, 0008 Satellites, 0009 Status, 000a MeasureMode, 000c SpeedRef, 000e TrackRef, 0010 ImgDirectionRef, "
    "0012 MapDatum, 0013 DestLatitudeRef, 0015 DestLongitudeRef, 0017 DestBearingRef, 0019 DestDistanceRef, 001d DateStamp",
    "UnsignedShort": "001e Differential",
    "UnsignedRational": "0002 Latitude 3, 0004 Longitude 3, 0006 Altitude, 0007 TimeStamp 3, 000b DOP, 000d Speed, 000f Track, 0011 ImgDirection, "
    "0014 DestLatitude 3, 0016 DestLongitude 3, 0018 DestBearing, 001a DestDistance, 001f HPositioningError",
}
ORIENTATIONS = {1: "Normal", 3: "Rotated180", 6: "Rotated90", 8: "Rotated270", 9: "Undefined"}
UNITS = {1: "None", 2: "Inch", 3: "Centimeter"}


def tag_dimension() -> list[tuple[str, int, str, int, str]]:
    """(directory, tag id, format, arity, name) of every known tag."""
    out = []
    for ifd, known in (("standard", _STANDARD), ("gps", _GPS)):
        for fmt, text in known.items():
            for item in text.split(", "):
                ident, name, *arity = item.split(" ")
                out.append((ifd, int(ident, 16), fmt, int(arity[0]) if arity else 1, name))
    return out


_NAMES = {(ifd, i, fmt): (arity, name) for ifd, i, fmt, arity, name in tag_dimension()}


def name_of(ifd: str, tag: int, fmt: str, count: int) -> str | None:
    """Name of a tag that has the format and arity it should have; texts may have any length."""
    arity, name = _NAMES.get(("gps" if ifd == "gps" else "standard", tag, fmt), (0, None))
    return name if fmt == "Ascii" or count == arity else None


def tags(payload: bytes) -> list[dict]:
    """All tags of an EXIF payload: ifd (ifd0, sub, gps), id, name, format, count, ints, text, error.

    A tag whose value runs past the end has an error and no value; the other tags are read all the same,
    and those of a directory that is cut off as far as it goes.

    Rationals are pairs of numerator and denominator. Whole-number formats fill ``ints``, texts and
    undefined bytes ``text``; floating-point and signed-byte values are told by count only.
    """
    if not payload.startswith(b"Exif\0\0"):
        raise MediaError("missing_element", "Exif")
    tiff = payload[6:]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        raise MediaError("invalid_value", "byte order")
    if struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        raise MediaError("invalid_value", "signature")
    out: list[dict] = []
    waiting = [("ifd0", struct.unpack_from(order + "L", tiff, 4)[0])]
    seen = set()
    while waiting:
        ifd, at = waiting.pop(0)
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for k in range(min(struct.unpack_from(order + "H", tiff, at)[0], (len(tiff) - at - 2) // 12)):
            tag, fmt, count = struct.unpack_from(order + "HHL", tiff, at + 2 + 12 * k)
            if fmt not in FORMATS:
                continue
            name, size = FORMATS[fmt]
            start = at + 10 + 12 * k
            if size * count > 4:
                start = struct.unpack_from(order + "L", tiff, start)[0]
            raw = tiff[start : start + size * count]
            ints = text = None
            if len(raw) < size * count:
                out.append({"ifd": ifd, "tag_id": tag, "name": name_of(ifd, tag, name, count), "format": name, "count": count, "ints": None, "text": None, "error": "unexpected_end"})
                continue
            if name in ("Ascii", "Undefined"):
                text = raw.replace(b"\0", b"").decode("utf-8", "replace")
            elif name in ("UnsignedByte", "UnsignedShort", "UnsignedLong", "SignedShort", "SignedLong"):
                ints = list(struct.unpack(f"{order}{count}{dict(UnsignedByte='B', UnsignedShort='H', UnsignedLong='L', SignedShort='h', SignedLong='l')[name]}", raw))
            elif name in ("UnsignedRational", "SignedRational"):
                ints = list(struct.unpack(f"{order}{2 * count}{'L' if name[0] == 'U' else 'l'}", raw))
            out.append({"ifd": ifd, "tag_id": tag, "name": name_of(ifd, tag, name, count), "format": name, "count": count, "ints": ints, "text": text, "error": None})
            if tag == 0x8769 and ints:
                waiting.append(("sub", ints[0]))
            elif tag == 0x8825 and ints:
                waiting.append(("gps", ints[0]))
    return out


def write(ifds: dict[str, list[tuple[int, int, int, bytes]]], order: str = ">") -> bytes:
    """An EXIF payload of directories with (tag, format, count, raw value) entries."""
    head = b"Exif\0\0" + (b"MM" if order == ">" else b"II") + struct.pack(order + "HL", 42, 8)
    ifds = {k: list(v) for k, v in ifds.items()}
    links = [("sub", 0x8769), ("gps", 0x8825)]
    size = lambda k: 2 + 12 * (len(ifds[k]) + (sum(n in ifds for n, _ in links) if k == "ifd0" else 0)) + 4
    length = lambda k: size(k) + sum(len(raw) for *_, raw in ifds[k] if len(raw) > 4)
    starts, at = {}, 8
    for k in ("ifd0", "sub", "gps"):
        if k in ifds:
            starts[k] = at
            at += length(k)
    out = b""
    for k in starts:
        entries = ifds[k] + ([(t, 4, 1, struct.pack(order + "L", starts[n])) for n, t in links if n in ifds] if k == "ifd0" else [])
        body, heap, free = b"", b"", starts[k] + size(k)
        for tag, fmt, count, raw in sorted(entries):
            body += struct.pack(order + "HHL", tag, fmt, count)
            if len(raw) > 4:
                body += struct.pack(order + "L", free + len(heap))
                heap += raw
            else:
                body += raw.ljust(4, b"\0")
        out += struct.pack(order + "H", len(entries)) + body + struct.pack(order + "L", 0) + heap
    return head + out
