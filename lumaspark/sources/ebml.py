"""EBML and Matroska: the element tree of a file, and its registry."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .errors import MediaError

# Elements of the EBML header, one a line: id (hexadecimal, with its marker bits), name, kind.
HEADER = """
BF Crc32 Binary
EC Void Binary
4281 DocTypeExtension Master
4282 DocType String
4283 DocTypeExtensionName String
4284 DocTypeExtensionVersion UnsignedInteger
4285 DocTypeReadVersion UnsignedInteger
4286 EbmlVersion UnsignedInteger
4287 DocTypeVersion UnsignedInteger
42F2 EbmlMaxIDLength UnsignedInteger
42F3 EbmlMaxSizeLength UnsignedInteger
42F7 EbmlReadVersion UnsignedInteger
1A45DFA3 Ebml Master
"""
# Elements of Matroska in the same form.
MATROSKA = """
80 ChapterDisplay Master
83 TrackType UnsignedInteger
85 ChapString Utf8
86 CodecID String
88 FlagDefault UnsignedInteger
91 ChapterTimeStart UnsignedInteger
92 ChapterTimeEnd UnsignedInteger
96 CueRefTime UnsignedInteger
98 ChapterFlagHidden UnsignedInteger
9A FlagInterlaced UnsignedInteger
9B BlockDuration UnsignedInteger
9C FlagLacing UnsignedInteger
9D FieldOrder UnsignedInteger
9F Channels UnsignedInteger
A0 BlockGroup Master
A1 Block Binary
A3 SimpleBlock Binary
A4 CodecState Binary
A5 BlockAdditional Binary
A6 BlockMore Master
A7 Position UnsignedInteger
AB PrevSize UnsignedInteger
AE TrackEntry Master
B0 PixelWidth UnsignedInteger
B2 CueDuration UnsignedInteger
B3 CueTime UnsignedInteger
B5 SamplingFrequency Float
B6 ChapterAtom Master
B7 CueTrackPositions Master
B9 FlagEnabled UnsignedInteger
BA PixelHeight UnsignedInteger
BB CuePoint Master
BF Crc32 Binary
D7 TrackNumber UnsignedInteger
DB CueReference Master
E0 Video Master
E1 Audio Master
E2 TrackOperation Master
E3 TrackCombinePlanes Master
E4 TrackPlane Master
E5 TrackPlaneUID UnsignedInteger
E6 TrackPlaneType UnsignedInteger
E7 Timestamp UnsignedInteger
E9 TrackJoinBlocks Master
EA CueCodecState UnsignedInteger
EC Void Binary
ED TrackJoinUID UnsignedInteger
EE BlockAddID UnsignedInteger
F0 CueRelativePosition UnsignedInteger
F1 CueClusterPosition UnsignedInteger
F7 CueTrack UnsignedInteger
FA ReferencePriority UnsignedInteger
FB ReferenceBlock SignedInteger
41A4 BlockAddIDName String
41E4 BlockAdditionMapping Master
41E7 BlockAddIDType UnsignedInteger
41ED BlockAddIDExtraData Binary
41F0 BlockAddIDValue UnsignedInteger
4254 ContentCompAlgo UnsignedInteger
4255 ContentCompSettings Binary
437C ChapLanguage String
437D ChapLanguageBCP47 String
437E ChapCountry String
4444 SegmentFamily Binary
4461 DateUTC Date
447A TagLanguage String
447B TagLanguageBCP47 String
4484 TagDefault UnsignedInteger
4485 TagBinary Binary
4487 TagString Utf8
4489 Duration Float
450D ChapProcessPrivate Binary
45A3 TagName Utf8
45B9 EditionEntry Master
45BC EditionUID UnsignedInteger
45DB EditionFlagDefault UnsignedInteger
45DD EditionFlagOrdered UnsignedInteger
465C FileData Binary
4660 FileMediaType String
466E FileName Utf8
467E FileDescription Utf8
46AE FileUID UnsignedInteger
47E1 ContentEncAlgo UnsignedInteger
47E2 ContentEncKeyID Binary
47E7 ContentEncAESSettings Master
47E8 AESSettingsCipherMode UnsignedInteger
4D80 MuxingApp Utf8
4DBB Seek Master
5031 ContentEncodingOrder UnsignedInteger
5032 ContentEncodingScope UnsignedInteger
5033 ContentEncodingType UnsignedInteger
5034 ContentCompression Master
5035 ContentEncryption Master
536E Name Utf8
5378 CueBlockNumber UnsignedInteger
53AB SeekId Binary
53AC SeekPosition UnsignedInteger
53B8 StereoMode UnsignedInteger
53B9 OldStereoMode UnsignedInteger
53C0 AlphaMode UnsignedInteger
54AA PixelCropBottom UnsignedInteger
54B0 DisplayWidth UnsignedInteger
54B2 DisplayUnit UnsignedInteger
54BA DisplayHeight UnsignedInteger
54BB PixelCropTop UnsignedInteger
54CC PixelCropLeft UnsignedInteger
54DD PixelCropRight UnsignedInteger
55AA FlagForced UnsignedInteger
55AB FlagHearingImpaired UnsignedInteger
55AC FlagVisualImpaired UnsignedInteger
55AD FlagTextDescriptions UnsignedInteger
55AE FlagOriginal UnsignedInteger
55AF FlagCommentary UnsignedInteger
55B0 Colour Master
55B1 MatrixCoefficients UnsignedInteger
55B2 BitsPerChannel UnsignedInteger
55B3 ChromaSubsamplingHorz UnsignedInteger
55B4 ChromaSubsamplingVert UnsignedInteger
55B5 CbSubsamplingHorz UnsignedInteger
55B6 CbSubsamplingVert UnsignedInteger
55B7 ChromaSitingHorz UnsignedInteger
55B8 ChromaSitingVert UnsignedInteger
55B9 ColourRange UnsignedInteger
55BA TransferCharacteristics UnsignedInteger
55BB Primaries UnsignedInteger
55BC MaxCLL UnsignedInteger
55BD MaxFALL UnsignedInteger
55D0 MasteringMetadata Master
55D1 PrimaryRChromaticityX Float
55D2 PrimaryRChromaticityY Float
55D3 PrimaryGChromaticityX Float
55D4 PrimaryGChromaticityY Float
55D5 PrimaryBChromaticityX Float
55D6 PrimaryBChromaticityY Float
55D7 WhitePointChromaticityX Float
55D8 WhitePointChromaticityY Float
55D9 LuminanceMax Float
55DA LuminanceMin Float
55EE MaxBlockAdditionID UnsignedInteger
5654 ChapterStringUID Utf8
56AA CodecDelay UnsignedInteger
56BB SeekPreRoll UnsignedInteger
5741 WritingApp Utf8
61A7 AttachedFile Master
6240 ContentEncoding Master
6264 BitDepth UnsignedInteger
63A2 CodecPrivate Binary
63C0 Targets Master
63C3 ChapterPhysicalEquiv UnsignedInteger
63C4 TagChapterUID UnsignedInteger
63C5 TagTrackUID UnsignedInteger
63C6 TagAttachmentUID UnsignedInteger
63C9 TagEditionUID UnsignedInteger
63CA TargetType String
6624 TrackTranslate Master
66A5 TrackTranslateTrackID Binary
66BF TrackTranslateCodec UnsignedInteger
66FC TrackTranslateEditionUID UnsignedInteger
67C8 SimpleTag Master
68CA TargetTypeValue UnsignedInteger
6911 ChapProcessCommand Master
6922 ChapProcessTime UnsignedInteger
6924 ChapterTranslate Master
6933 ChapProcessData Binary
6944 ChapProcess Master
6955 ChapProcessCodecID UnsignedInteger
69A5 ChapterTranslateID Binary
69BF ChapterTranslateCodec UnsignedInteger
69FC ChapterTranslateEditionUID UnsignedInteger
6E67 ChapterSegmentUID Binary
6EBC ChapterSegmentEditionUID UnsignedInteger
7373 Tag Master
7384 SegmentFilename Utf8
73A4 SegmentUuid Binary
73C4 ChapterUID UnsignedInteger
73C5 TrackUID UnsignedInteger
7446 AttachmentLink UnsignedInteger
75A1 BlockAdditions Master
75A2 DiscardPadding SignedInteger
7670 Projection Master
7671 ProjectionType UnsignedInteger
7672 ProjectionPrivate Binary
7673 ProjectionPoseYaw Float
7674 ProjectionPosePitch Float
7675 ProjectionPoseRoll Float
78B5 OutputSamplingFrequency Float
7BA9 Title Utf8
22B59C Language String
22B59D LanguageBCP47 String
23314F TrackTimestampScale Float
234E7A DefaultDecodedFieldDuration UnsignedInteger
23E383 DefaultDuration UnsignedInteger
258688 CodecName Utf8
2AD7B1 TimestampScale UnsignedInteger
2EB524 UncompressedFourCC UnsignedInteger
3C83AB PrevFilename Utf8
3CB923 PrevUUID Binary
3E83BB NextFilename Utf8
3EB923 NextUUID Binary
1043A770 Chapters Master
114D9B74 SeekHead Master
1254C367 Tags Master
1549A966 Info Master
1654AE6B Tracks Master
18538067 Segment Master
1941A469 Attachments Master
1C53BB6B Cues Master
1F43B675 Cluster Master
"""


def registry(*parts: str) -> dict[int, tuple[str, str]]:
    """id -> (name, kind); a later part adds to or overrides an earlier one."""
    rows = (line.split() for part in parts or (HEADER, MATROSKA) for line in part.splitlines() if line)
    return {int(ident, 16): (name, kind) for ident, name, kind in rows}


REGISTRY = registry()
#: Binary values up to this many bytes are read with the element, longer ones by position but for those
#: of the elements named.
EAGER, WHOLE = 20, ("TagBinary", "SegmentUuid", "SeekId")


_TOP = ("Ebml", "Segment")
#: Masters that may have an unknown size, and what ends them.
ENDS = {"Segment": _TOP, "Cluster": (*_TOP, "SeekHead", "Info", "Tracks", "Chapters", "Cluster", "Cues", "Attachments", "Tags")}


def vint(data: bytes, at: int) -> tuple[int, int, int]:
    """(length, value, raw) of a variable-size number."""
    if at >= len(data):
        raise EOFError
    length = 9 - data[at].bit_length()
    if length > 8:
        raise MediaError("invalid_vint")
    if at + length > len(data):
        raise EOFError
    raw = int.from_bytes(data[at : at + length], "big")
    return length, raw & ((1 << 7 * length) - 1), raw


def value_of(kind: str, raw: bytes) -> dict:
    """The typed fields of a value; numbers of no bytes are 0."""
    out: dict = {"v_int": None, "v_float": None, "v_text": None, "v_bin": None}
    if kind in ("UnsignedInteger", "SignedInteger", "Date"):
        if len(raw) > 8:
            raise MediaError("invalid_data_length", kind)
        out["v_int"] = int.from_bytes(raw, "big", signed=kind != "UnsignedInteger")
    elif kind == "Float":
        if len(raw) not in (0, 4, 8):
            raise MediaError("invalid_data_length", kind)
        out["v_float"] = struct.unpack(">f" if len(raw) == 4 else ">d", raw)[0] if raw else 0.0
    elif kind in ("String", "Utf8"):
        out["v_text"] = raw.rstrip(b"\0").decode("utf-8", "replace")
    else:
        out["v_bin"] = raw
    return out


def walk(data: bytes, known: dict[int, tuple[str, str]] | None = None, descend: set[str] | None = None) -> Iterator[tuple]:
    """The element tree as tuples (seq, parent_seq, depth, id, name, kind, position, data_offset, size), without values.

    :param known: the registry; elements it doesn't have are Binary with the name Unknown.
    :param descend: names of the masters to go into (all if None); others are one row each.

    Segments and clusters of unknown size, as live recordings have them, have a null size and end before
    the first element that can't be inside them; they are always gone into.
    """
    known = REGISTRY if known is None else known
    seq = 0
    # where to go on, the end, parent and depth there, and the master of unknown size around it
    stack: list[tuple] = [(0, len(data), None, 0, None)]
    while stack:
        at, end, parent, depth, around = stack.pop()
        if at >= end:
            continue
        id_length, _, ident = vint(data, at)
        size_length, size, _ = vint(data, at + id_length)
        offset = id_length + size_length
        name, kind = known.get(ident, ("Unknown", "Binary"))
        while around and name in ENDS.get(around[0], ()):
            _, parent, depth, around = around
        unknown = size == (1 << 7 * size_length) - 1
        if unknown and name not in ENDS:
            raise MediaError("invalid_value", "unknown size")
        if not unknown and at + offset + size > end:
            raise MediaError("unexpected_end", name)
        yield seq, parent, depth, ident, name, kind, at, offset, None if unknown else size
        if unknown:
            stack.append((at + offset, end, seq, depth + 1, (name, parent, depth, around)))
        else:
            stack.append((at + offset + size, end, parent, depth, around))
            if kind == "Master" and (descend is None or name in descend):
                stack.append((at + offset, at + offset + size, seq, depth + 1, None))
        seq += 1


def elements(data: bytes, known: dict[int, tuple[str, str]] | None = None, descend: set[str] | None = None, payload: bool = True) -> list[dict]:
    """The element tree as rows seq, parent_seq, depth, id, name, kind, position, data_offset, size, v_*, as ``walk`` gives them.

    :param payload: False leaves values out, so that only the structure is read.
    """
    out: list[dict] = []
    for seq, parent, depth, ident, name, kind, at, offset, size in walk(data, known, descend):
        row = {"seq": seq, "parent_seq": parent, "depth": depth, "id": ident, "name": name, "kind": kind, "position": at, "data_offset": offset, "size": size, "v_int": None, "v_float": None, "v_text": None, "v_bin": None}
        if payload and kind != "Master" and not (kind == "Binary" and size > EAGER and name not in WHOLE):
            row |= value_of(kind, data[at + offset : at + offset + size])
        out.append(row)
    return out


def blocks(data: bytes) -> list[tuple]:
    """(cluster_seq, seq, cluster_ts, position of its bytes, size) of every SimpleBlock; a tree or value that
    can't be read raises as in ``elements``."""
    found: list[tuple] = []
    stamps: dict[int | None, int] = {}
    for seq, parent, _, _, name, kind, at, offset, size in walk(data):
        if name == "SimpleBlock":
            found.append((parent, seq, at + offset, size))
        elif kind not in ("Master", "Binary"):
            value = value_of(kind, data[at + offset : at + offset + size])["v_int"]
            if name == "Timestamp":
                stamps[parent] = max(value, stamps.get(parent, value))
    return [(parent, seq, stamps.get(parent), at, size) for parent, seq, at, size in found]


LACING = ("None", "Xiph", "FixedSize", "Ebml")


def simple_block(raw: bytes) -> dict:
    """Header of a SimpleBlock: track, relative timestamp, flags and where its frame begins."""
    n, track, _ = vint(raw, 0)
    if n + 3 > len(raw):
        raise EOFError
    ts, flags = struct.unpack_from(">hB", raw, n)
    return {"track": track, "ts_rel": ts, "keyframe": bool(flags & 0x80), "invisible": bool(flags & 0x08), "lacing": LACING[flags >> 1 & 3], "discardable": bool(flags & 0x01), "frame_offset": n + 3, "frame_size": len(raw) - n - 3}


_IDS = {name: (ident, kind) for ident, (name, kind) in REGISTRY.items()}


def element(name: str, value: int | float | str | bytes | list[bytes]) -> bytes:
    """One element as bytes; masters take a list of elements."""
    ident, kind = _IDS[name]
    if isinstance(value, list):
        body = b"".join(value)
    elif isinstance(value, bytes):
        body = value
    elif isinstance(value, str):
        body = value.encode()
    elif kind == "Float":
        body = struct.pack(">d", value)
    else:
        body = int(value).to_bytes(max(1, ((int(value).bit_length() + (kind == "SignedInteger")) + 7) // 8), "big", signed=kind == "SignedInteger")
    n = next(k for k in range(1, 9) if len(body) < (1 << 7 * k) - 1)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + ((1 << 7 * n) | len(body)).to_bytes(n, "big") + body
