"""Folders of files: sources, the sink, conversion, streams and the command line."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspark.__main__ import inspect, main
from lumaspark.sources import ebml, png, raster
from lumaspark.sources.datasource import convert_files, decoded, extension, media_files
from lumaspark.streaming import files as S

IM = np.add.outer(np.arange(16) * 3, np.arange(16) * 5)[..., None].repeat(3, 2).astype(np.uint8)


@pytest.fixture
def folder(tmp_path):
    body = zlib.compress(png.filtered(IM.reshape(16, -1), 3, 0))
    data = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">LLBBBBB", 16, 16, 8, 2, 0, 0, 0)) + png.chunk(b"IDAT", body) + png.chunk(b"IEND", b"")
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.png").write_bytes(data)
    (src / "b.PPM").write_bytes(raster.write_pnm("P6", 16, 16, IM.tobytes()))
    (src / "broken.png").write_bytes(data[:40])
    (src / "note.txt").write_text("no image")
    return tmp_path


def test_extension(spark):
    df = spark.createDataFrame([("x/a.JPG",), ("b",), (".c/d",), (None,)], "p string")
    assert [r[0] for r in df.select(extension(F.col("p"))).collect()] == ["jpg", "", "", None]


def test_convert(spark, folder):
    out = {r["name"]: (r["width"], r["error"]) for r in decoded(media_files(spark, str(folder / "in"))).collect()}
    assert out["a"] == (16, None) and out["b"] == (16, None) and out["broken"][0] is None and out["broken"][1].startswith("unexpected_end")
    convert_files(spark, str(folder / "in"), str(folder / "out"), "ppm")
    assert sorted(os.listdir(folder / "out")) == ["a.ppm", "b.ppm"]
    assert raster.pnm((folder / "out" / "a.ppm").read_bytes())["data"] == IM.tobytes()
    convert_files(spark, str(folder / "out"), str(folder / "jpg"), "jpg")
    assert sorted(os.listdir(folder / "jpg")) == ["a.jpg", "b.jpg"]
    with pytest.raises(Exception, match="can't write"):
        convert_files(spark, str(folder / "in"), str(folder / "x"), "gif")


def test_convert_keeps_every_image(spark, folder):
    src = folder / "in"
    for name in ("x", "y z", "x/deep.er"):
        (src / name).mkdir()
        (src / name / "a.png").write_bytes((src / "a.png").read_bytes())
    failed = convert_files(spark, str(src), str(folder / "out"), "ppm").collect()
    assert [(os.path.basename(r["path"]), r["error"].split(":")[0].split()[0]) for r in failed] == [("broken.png", "unexpected_end")]
    files = sorted(str(p.relative_to(folder / "out")) for p in (folder / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert files == ["a.ppm", "b.ppm", "x/a.ppm", "x/deep.er/a.ppm", "y z/a.ppm"]
    convert_files(spark, f"{src}/x*/", str(folder / "glob"), "ppm")
    assert (folder / "glob" / "x" / "a.ppm").exists()
    convert_files(spark, f"{src}/a.png", str(folder / "single"), "ppm")
    assert os.listdir(folder / "single") == ["a.ppm"]
    (src / "x" / "a.ppm").write_bytes((src / "b.PPM").read_bytes())
    with pytest.raises(Exception, match="several images"):
        convert_files(spark, str(src), str(folder / "twice"), "ppm")
    assert not [p for p in (folder / "twice").rglob("*") if p.is_file()]


def test_stream(spark, folder):
    stream = S.parts(S.new_files(spark, str(folder / "in"), "*.png"), "png")
    q = stream.writeStream.format("memory").queryName("png_parts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("png_parts")
    assert {r["type"] for r in rows.where("path like '%a.png'").collect()} == {"IHDR", "IDAT", "IEND"}
    assert rows.where("error is not null").count() == 1
    n = S.counts(S.new_files(spark, str(folder / "in"), "*.png")).writeStream.format("memory").queryName("png_counts").outputMode("complete").trigger(availableNow=True).start()
    n.awaitTermination(60)
    assert spark.table("png_counts").agg(F.sum("n_files")).first()[0] == 2


def test_command_line(folder, capsys):
    assert main(["convert", str(folder / "in" / "a.png"), str(folder / "a.pgm")]) == 0
    assert raster.pnm((folder / "a.pgm").read_bytes())["format"] == "P5"
    assert [line.split()[0] for line in inspect(str(folder / "in" / "a.png"))] == ["IHDR", "IDAT", "IEND"]
    (folder / "v.mkv").write_bytes(ebml.element("Segment", [ebml.element("Info", [ebml.element("MuxingApp", "x")])]))
    assert inspect(str(folder / "v.mkv")) == ["<Segment>", "  <Info>", "    <MuxingApp>x</MuxingApp>"]
    assert main([]) == 2
    assert "decoded" in capsys.readouterr().out
