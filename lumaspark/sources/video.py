"""H.264 configuration records and NAL units, and MP4 box headers."""

from __future__ import annotations

import struct

from .errors import MediaError, attempt

# Names of the 32 NAL unit types, in the order of their numbers.
NAL_NAMES = (
    "Unspecified Slice Dpa Dpb Dpc IdrSlice Sei Sps Pps Aud EndSequence EndStream FillerData SpsExt Prefix SubSps Dps Reserved17 Reserved18 "
    "AuxiliarySlice ExtenSlice DepthExtenSlice Reserved22 Reserved23 Unspecified24 Unspecified25 Unspecified26 Unspecified27 Unspecified28 "
    "Unspecified29 Unspecified30 Unspecified31"
).split(" ")
PROFILES = {66: "Baseline", 77: "Main", 88: "Extended", 100: "High", 110: "High10", 122: "High422", 244: "High444"}
#: Profiles whose parameter sets tell the chroma format.
CHROMA_PROFILES = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)


def profile_name(profile: int, constraints: int) -> str:
    """Name of a profile; constraint set 1 makes a baseline stream a constrained one."""
    if profile == 66 and constraints & 0x40:
        return "ConstrainedBaseline"
    if profile not in PROFILES:
        raise MediaError("invalid_value", f"profile {profile}")
    return PROFILES[profile]


def nal_units(data: bytes, length_size: int = 4) -> list[tuple[int, int, str, int, bytes]]:
    """(seq, position, kind, size, payload with the header byte) of length-prefixed NAL units."""
    out, at = [], 0
    while at < len(data):
        if at + length_size > len(data):
            raise EOFError
        size = int.from_bytes(data[at : at + length_size], "big")
        unit = data[at + length_size : at + length_size + size]
        if not size or len(unit) < size:
            raise MediaError("invalid_data_length", "NAL unit")
        out.append((len(out), at, NAL_NAMES[unit[0] & 31], size, unit))
        at += length_size + size
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.text = "".join(f"{b:08b}" for b in data)
        self.at = 0

    def u(self, n: int) -> int:
        if self.at + n > len(self.text):
            raise EOFError
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def ue(self) -> int:
        zeros = self.text.find("1", self.at) - self.at
        if zeros < 0:
            raise EOFError
        self.at += zeros
        return self.u(zeros + 1) - 1


def sps(payload: bytes) -> dict:
    """Fields of a sequence parameter set (without its NAL header byte)."""
    b = _Bits(payload.replace(b"\0\0\3", b"\0\0"))
    out: dict = {"profile_idc": b.u(8), "constraint_sets": b.u(8), "level": b.u(8), "parameter_id": b.ue()}
    out |= dict.fromkeys(("chroma_format", "separate_colour_plane", "bit_depth_luma_minus8", "bit_depth_chroma_minus8", "qpprime_y_zero_transform_bypass", "seq_scaling_matrix_present"))
    if out["profile_idc"] in CHROMA_PROFILES:
        out["chroma_format"] = b.ue()
        if out["chroma_format"] == 3:
            out["separate_colour_plane"] = bool(b.u(1))
        out["bit_depth_luma_minus8"], out["bit_depth_chroma_minus8"] = b.ue(), b.ue()
        out["qpprime_y_zero_transform_bypass"], out["seq_scaling_matrix_present"] = bool(b.u(1)), bool(b.u(1))
        if out["seq_scaling_matrix_present"]:
            raise MediaError("invalid_value", "scaling matrix")
    out["log2_max_frame_num_minus4"], out["pic_order_cnt_type"] = b.ue(), b.ue()
    if out["pic_order_cnt_type"] == 1:
        raise MediaError("invalid_value", "picture order count type 1")
    out["log2_max_pic_order_cnt_lsb_minus4"] = b.ue() if out["pic_order_cnt_type"] == 0 else None
    out["max_num_ref_frames"], out["gaps_in_frame_num_value_allowed"] = b.ue(), bool(b.u(1))
    out["pic_width_in_mbs_minus1"], out["pic_height_in_map_units_minus1"] = b.ue(), b.ue()
    if not b.u(1):
        raise MediaError("invalid_value", "interlaced")
    out["direct_8x8_inference"] = bool(b.u(1))
    crop = bool(b.u(1))
    for side in ("left", "right", "top", "bottom"):
        out[f"crop_{side}"] = b.ue() if crop else None
    out["vui_present"] = bool(b.u(1))
    return out


def avcc(data: bytes) -> dict:
    """An AVC decoder configuration record with all its sequence parameter sets and the number of each; the
    name of a profile that isn't known is null."""
    if data[0] != 1:
        raise MediaError("invalid_value", f"version {data[0]}")
    out: dict = {"profile": attempt(profile_name, data[1], data[2])[0], "level": data[3], "nal_length_size": (data[4] & 3) + 1}
    at, sets = 6, {"sps": [], "pps": []}
    for what, n in (("sps", data[5] & 31), ("pps", None)):
        if n is None:
            n = data[at] & 31
            at += 1
        for _ in range(n):
            size = struct.unpack_from(">H", data, at)[0]
            unit = data[at + 2 : at + 2 + size]
            if len(unit) < size or not size:
                raise EOFError
            if NAL_NAMES[unit[0] & 31].lower() != what:
                raise MediaError("unexpected_element", NAL_NAMES[unit[0] & 31])
            sets[what].append(unit[1:])
            at += 2 + size
    return out | {"n_sps": len(sets["sps"]), "n_pps": len(sets["pps"]), "sps": [sps(u) for u in sets["sps"]]}


def write_bits(fields: list[tuple[str, int]]) -> bytes:
    """Bytes of fields ("u<n>", value) or ("ue", value), ended by a stop bit."""
    text = ""
    for kind, v in fields:
        text += f"{v:0{int(kind[1:])}b}" if kind[1:].isdigit() else f"{v + 1:b}".rjust(2 * (v + 1).bit_length() - 1, "0")
    text += "1"
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")
