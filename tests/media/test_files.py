"""Files: round trips and broken input."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumaspark.operators import media as M
from lumaspark.sources import ebml, exif, jpeg, png, raster, video
from lumaspark.sources.errors import MediaError
from lumaspark.sources.errors import attempt, failfast

IM = np.stack(np.broadcast_arrays(*[np.mgrid[0:32, 0:48][k] * m % 256 for k, m in ((1, 5), (0, 7), (1, 3))]), -1).astype(np.uint8)


def png_of(im, first=0, colour=2, depth=8):
    rows = im.reshape(im.shape[0], -1)
    head = struct.pack(">LLBBBBB", im.shape[1], im.shape[0], depth, colour, 0, 0, 0)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", zlib.compress(png.filtered(rows, max(1, rows.shape[1] // im.shape[1]), first))) + png.chunk(b"IEND", b"")


@pytest.mark.parametrize("first", range(5))
def test_png_filters(first):
    assert png.decode(png_of(IM, first))[2] == IM.tobytes()


def test_png_colours():
    grey = IM[..., :1]
    assert png.decode(png_of(grey, colour=0))[2] == np.repeat(grey, 3, axis=2).tobytes()
    alpha = np.concatenate([IM, grey], axis=2)
    assert png.decode(png_of(alpha, colour=6))[2] == IM.tobytes()
    stored = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">LLBBBBB", 48, 32, 8, 2, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(png.filtered(IM.reshape(32, -1), 3, 0), 0)) + png.chunk(b"IEND", b"")
    assert png.decode(stored)[2] == IM.tobytes()


def test_jpeg_round_trip():
    smooth = np.stack([np.add.outer(np.arange(32) * 3, np.arange(48) * 2) + 20] * 3, -1).astype(np.uint8)
    w, h, data = jpeg.decode(jpeg.encode(48, 32, smooth.tobytes(), 95))
    assert (w, h) == (48, 32)
    assert np.abs(np.frombuffer(data, np.uint8).reshape(32, 48, 3).astype(int) - smooth).mean() < 2
    w, h, data = jpeg.decode(jpeg.encode(50, 34, np.full((34, 50, 3), 200, np.uint8).tobytes()))
    assert np.frombuffer(data, np.uint8).reshape(34, 50, 3)[33, 49].tolist() == [0, 0, 0]  # outside whole MCUs


def test_jpeg_levels_survive():
    data = jpeg.encode(48, 32, IM.tobytes(), 50)
    f = jpeg.frame_of(data)
    again = [lv.reshape(6, -1, 64) for lv in jpeg.decode_levels(f)]
    assert jpeg.entropy(again) == f.scan


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200))
def test_garbage_never_escapes(data):
    for parse in (jpeg.decode, png.decode, raster.bmp, raster.pnm, ebml.elements, exif.tags, video.avcc, video.nal_units, ebml.simple_block):
        value, error = attempt(parse, data)
        assert (value is None) == (error is not None)


def test_pnm():
    for kind, im in (("P3", IM), ("P6", IM), ("P2", IM[..., 0]), ("P5", IM[..., 0])):
        p = raster.pnm(raster.write_pnm(kind, 48, 32, im.tobytes()))
        assert p["data"] == im.tobytes() and p["max"] == im.max()
    assert raster.pnm(b"P2 # note\n2\n1 9 7 8")["data"] == b"\7\x08"
    assert raster.write_pnm("P5", 0, 0, b"") == b"P5\n0 0\n255\n"


def test_bmp_padding():
    b = raster.bmp(raster.write_bmp(47, 32, IM[:, :47].tobytes()))
    assert b["data"] == IM[::-1, :47, ::-1].tobytes()


def test_exif_orders():
    for order in "<>":
        tags = exif.tags(exif.write({"ifd0": [(0x112, 3, 1, struct.pack(order + "H", 6)), (0x10F, 2, 3, b"ab\0")], "gps": [(6, 5, 1, struct.pack(order + "LL", 7, 2))]}, order))
        assert {t["name"]: t["ints"] or t["text"] for t in tags if t["name"] != "GPSInfo"} == {"Orientation": [6], "Make": "ab", "Altitude": [7, 2]}
    assert exif.name_of("ifd0", 0x112, "UnsignedLong", 1) is None


def test_errors(spark):
    good = png_of(IM)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"x")), (3, None), (4, bytearray(good[:-30]))], "id int, c binary")
    out = df.select("id", M.png_decode(F.col("c")).alias("r")).select("id", "r.error", F.col("r.value.width").alias("width"))
    assert {r["id"]: (r["error"], r["width"]) for r in out.collect()} == {1: (None, 48), 2: ("invalid_value: signature", None), 3: (None, None), 4: ("unexpected_end: IDAT", None)}
    assert failfast(out.where("id in (1, 3)")).count() == 2
    with pytest.raises(Exception, match="signature|unexpected_end"):
        failfast(out).collect()


def test_lazy_tree():
    data = ebml.element("Segment", [ebml.element("Void", b"\0" * 21), ebml.element("Info", [ebml.element("Duration", 1.5)])])
    assert [r["name"] for r in ebml.elements(data)] == ["Segment", "Void", "Info", "Duration"]
    assert ebml.elements(data)[1]["v_bin"] is None
    assert [r["name"] for r in ebml.elements(data, descend={"Segment"})] == ["Segment", "Void", "Info"]
    assert ebml.elements(data, payload=False)[3]["v_float"] is None
    assert len(ebml.registry()) >= 219


def test_block_flags():
    b = ebml.simple_block(b"\x81\xff\xfe\x8d" + b"frame")
    assert (b["track"], b["ts_rel"], b["keyframe"], b["invisible"], b["lacing"], b["discardable"], b["frame_size"]) == (1, -2, True, True, "FixedSize", True, 5)


def test_nothing_is_cut(spark):
    """Long tag values, deep paths, all parameter sets, and EXIF tags beside a broken one."""
    from pyspark.sql import functions as F

    from lumaspark.functions.tables import AC_CHROMA, AC_LUMA
    from lumaspark.operators import media as M
    from lumaspark.sources import fixtures

    values = [b"\1" * 21, b"\2" * (1 << 20), b""]
    tag = lambda k, v: ebml.element("SimpleTag", [ebml.element("TagName", k), ebml.element("TagBinary", v)])
    deep = ebml.element("TagName", "x")
    for _ in range(12):
        deep = ebml.element("SimpleTag", [deep])
    content = ebml.element("Segment", [ebml.element("Tags", [ebml.element("Tag", [ebml.element("Targets", []), *[tag(f"n{k}", v) for k, v in enumerate(values)]]), ebml.element("Tag", [ebml.element("Targets", [ebml.element("TagTrackUID", 7)]), deep])])])
    df = spark.createDataFrame([(1, bytearray(content))], "file_id int, content binary")
    tree = df.select("file_id", M.ebml_elements(F.col("content"))["value"].alias("e"))
    got = {r["name"]: r["bin"] for r in M.tags(tree.select("file_id", F.explode("e").alias("x")).select("file_id", "x.*"), "file_id").collect()}
    assert [bytes(got[f"n{k}"]) for k in range(2)] == values[:2]
    found = {r["path"] for r in tree.select(F.explode(M.paths(F.col("e"))).alias("p")).select("p.path").collect()}
    assert "Segment/Tags/Tag/" + "SimpleTag/" * 12 + "TagName" in found and "Segment" in found
    assert len(video.avcc(fixtures._avcc(5, 3))["sps"]) == 3
    odd = bytearray(fixtures._avcc(5, 3))
    odd[1] = 99
    assert video.avcc(bytes(odd))["profile"] is None and len(video.avcc(bytes(odd))["sps"]) == 3
    payload = exif.write({"ifd0": [(0x112, 3, 1, b"\0\6"), (0x110, 2, 6, b"model\0"), (0x10F, 2, 5, b"make\0")]})
    tags = {t["tag_id"]: t for t in exif.tags(payload[:-6])}
    assert tags[0x10F]["text"] == "make" and tags[0x112]["ints"] == [6] and tags[0x110]["error"] == "unexpected_end" and tags[0x10F]["error"] is None
    assert sorted(AC_LUMA[1]) == sorted(AC_CHROMA[1]) and sum(AC_LUMA[0]) == len(AC_LUMA[1]) == 162 == sum(AC_CHROMA[0])


def test_unknown_sizes():
    """Live recordings: a segment and clusters whose size isn't known, the same tree as with sizes."""
    block = lambda n: ebml.element("SimpleBlock", bytes([0x81, 0, n, 0]) + b"x" * n)
    parts = [("Info", [ebml.element("MuxingApp", "m")]), ("Cluster", [ebml.element("Timestamp", 1), block(3), block(4)]), ("Cluster", [ebml.element("Timestamp", 2), block(5)]), ("Tags", [])]
    live = lambda raw, n: raw[:n] + b"\x01" + b"\xff" * 7 + raw[n + 1 :]  # noqa: E731 - a size of one byte becomes an unknown one of eight
    sized = ebml.element("Segment", [ebml.element(k, v) for k, v in parts])
    body = b"".join(live(ebml.element(k, v), 4) if k == "Cluster" else ebml.element(k, v) for k, v in parts)
    got = ebml.elements(live(ebml.element("Segment", []), 4) + body)
    keep = lambda rows: [(r["seq"], r["parent_seq"], r["depth"], r["name"], r["v_int"], r["v_text"]) for r in rows]
    assert keep(got) == keep(ebml.elements(sized)) and [r["name"] for r in got if r["size"] is None] == ["Segment", "Cluster", "Cluster"]
    with pytest.raises(MediaError):
        ebml.elements(live(ebml.element("Info", []), 4))
