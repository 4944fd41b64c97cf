"""Units: spellings, distances and whole statements."""

import pytest
from pyspark.sql import functions as F

from lumaspark.core.queries import p3_dpi, p3_found
from lumaspark.core.units import number_in, reference_units, squeeze, squeezed, unit_aliases, unit_in, weighted_distance

SPELT = [("inch", 1.0), ("Inches", 1.0), ('"', 1.0), ("Zoll", 1.0), ("polegada", 1.0), ("centimetre", 2.54), ("Centimeter", 2.54), ("centimtere", 2.54), ("per mm", 25.4), ("pixels per metres", 0.0254), ("metre", 0.0254), ("ppm (per meter)", 0.0254), ("µm/px", 25400.0), ("micron pitch", 25400.0), ("um per pixel", 25400.0), ("dots per inches", 1.0), ("DPI", 1.0), ("m", 0.0254), ("mm", 25.4), ("furlong", None), ("q", None), ("", None)]


def test_aliases(spark):
    df = spark.createDataFrame([(s, "x") for s, _ in SPELT] + [(None, "x"), ("inch", "y")], "spelling string, name string")
    out = {r["spelling"]: r["factor"] for r in unit_aliases(df, "spelling", reference_units(spark)).collect()}
    assert out == {s: f for s, f in SPELT if f is not None}
    assert unit_aliases(df.limit(0), "spelling", reference_units(spark)).count() == 0


def test_brute_force(spark):
    """The index proposes every reference name that the distance accepts."""
    from lumaspark.core.units import REACH

    names = {r["name"]: (r["kind"], r["factor"]) for r in reference_units(spark).collect()}
    spelt = [s for s, _ in SPELT if s]
    got = {r["spelling"]: r["distance"] for r in unit_aliases(spark.createDataFrame([(s,) for s in spelt], "spelling string"), "spelling", reference_units(spark)).collect()}
    for s in spelt:
        q = squeeze(s)
        near = [weighted_distance(q, n) for n in names if weighted_distance(q, n) <= (0 if min(len(q), len(n)) < 4 else REACH * max(len(q), len(n)))]
        assert got.get(s) == pytest.approx(min(near)) if near else s not in got


def test_numbers(spark):
    df = spark.createDataFrame([("11,81 dots/mm",), (" 300 dpi",), ("x",), (None,), ("2.83",)], "t string")
    out = [tuple(r) for r in df.select(number_in(F.col("t")), unit_in(F.col("t"))).collect()]
    assert out == [(11.81, "dots/mm"), (300.0, "dpi"), (None, "x"), (None, None), (2.83, "")]


def test_squeeze(spark):
    df = spark.createDataFrame([(s,) for s, _ in SPELT], "s string")
    assert [r[0] for r in df.select(squeezed(F.col("s"))).collect()] == [squeeze(s) for s, _ in SPELT]


EXIF = "exif_row_id long, image_id long, tag_name string, fmt string, ints array<long>, text string, path string"


@pytest.fixture
def folder(spark, tmp_path):
    jfif = "struct<density_unit:smallint,x_density:int>"
    raw = [(1, (1, 300)), (2, (2, 118)), (3, (0, 72)), (4, None), (5, (1, 72)), (5, (1, 72)), (6, (1, 100)), (7, (1, 300)), (None, (1, 1))]
    tags = [(1, 1, "XResolution", "R", [1181, 10], None, "p"), (2, 1, "ResolutionUnit", "S", [3], None, "p"), (3, 2, "XResolution", "A", None, "2,83 dots/mm", "p"), (4, 2, "ResolutionUnit", "S", [2], None, "p"), (5, 3, "XResolution", "R", [72, 0], None, "p"), (6, 6, "XResolution", "A", None, "100", "p"), (7, 6, "ResolutionUnit", "A", None, "per cm", "p"), (8, 7, "XResolution", "R", [100, 1], None, "p"), (9, 7, "ResolutionUnit", "S", [1], None, "p"), (10, None, None, None, None, None, None)]
    tags += [(11, 4, "XResolution", "A", None, "84.7 µm/px", "p")]
    bmp = [(1, "a", 11811), (3, "a", 0), (4, "b", 310), (5, "zz", 9)]
    for name, rows, schema in (("raw_jpeg", raw, f"image_id long, jfif {jfif}"), ("exif_tag", tags, EXIF), ("dib_header", bmp, "image_id long, origin string, resolution_horizontal long"), ("origin", [("a", "m"), ("b", "inch")], "origin string, bmp_res_unit string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_statements(spark, folder):
    out = {r["image_id"]: tuple(None if x is None else round(x) for x in r[1:]) for r in p3_dpi(spark, folder).collect()}
    assert out == {1: (300, 300, 300), 2: (300, 72, None), 4: (None, 300, 310), 5: (72, None, None), 6: (100, 254, None), 7: (300, None, None)}
    assert sorted(r[0] for r in p3_found(spark, folder).collect()) == [2, 6]
