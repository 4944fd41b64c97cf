"""Moments: readings, zones, EM and pairs."""

from datetime import datetime, timezone

import numpy as np
import pytest

from lumaspark.core.moments import AMBIGUOUS, NAMES, mixture, normalise_moments, posteriors, read
from lumaspark.core.queries import p4_classes, p4_found


def utc(*t):
    return int(datetime(*t, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    ("text", "tz", "want"),
    [
        ("2023:07:08 17:15:10", "Europe/Berlin", utc(2023, 7, 8, 15, 15, 10)),
        ("2023:07:08 17:15:10 ", "Asia/Kathmandu", utc(2023, 7, 8, 11, 30, 10)),
        ("2022-01-02T05:09:22Z", None, utc(2022, 1, 2, 5, 9, 22)),
        ("2021:01:19 13:13:41+05:30", None, utc(2021, 1, 19, 7, 43, 41)),
        ("2024-12-31 05:46:04.49 +0900", None, utc(2024, 12, 30, 20, 46, 4)),
        ("20230425T063653Z", None, utc(2023, 4, 25, 6, 36, 53)),
        ("1687296330", None, 1687296330),
        ("1637238754277", None, 1637238754),
        ("03/12/2023 12:57:40 AM", "America/Denver", None),
        ("16. November 2024, 13:52:30", "UTC", utc(2024, 11, 16, 13, 52, 30)),
        ("27 de março de 2025 15:52:42", "UTC", utc(2025, 3, 27, 15, 52, 42)),
        ("Fri, 06 Oct 2023 15:31:00 +0545", None, utc(2023, 10, 6, 9, 46, 0)),
        ("2023-11-05 01:30:00 EDT", None, utc(2023, 11, 5, 5, 30, 0)),
        ("2023:11:05 01:30:00", "America/New_York", None),  # occurs twice
        ("2023:03:12 02:30:00", "America/New_York", None),  # is skipped
        ("2025:01:29 07:30:29 America/Los_Angeles", None, utc(2025, 1, 29, 15, 30, 29)),
        ("2022-08-09T06:04:19[Asia/Kathmandu]", None, utc(2022, 8, 9, 0, 19, 19)),
        ("2024:02:30 15:13:12", "UTC", None),
        ("2023:07:08 17:15", "UTC", None),
        ("2023:07:08", "UTC", None),
        ("17:15:10", "UTC", None),
        ("    :  :     :  :  ", "UTC", None),
        ("", "UTC", None),
        ("2023:07:08 17:15:10", None, None),
    ],
)
def test_read(text, tz, want):
    readings, _ = read(text, tz)
    if text.startswith("03/12"):
        assert {NAMES[k] for k, _, _ in readings} == {"dmy", "mdy"}
    else:
        assert [u for _, u, _ in readings if u is not None] == ([want] if want is not None else [])


def test_em():
    dmy, mdy = 1 << NAMES.index("dmy"), 1 << NAMES.index("mdy")
    marks = np.array([dmy, mdy, dmy | mdy])
    post = lambda counts, order: posteriors(marks, mixture(marks, np.array(counts), order))[2]
    assert post([90.0, 0.0, 60.0], None)[NAMES.index("dmy")] > 0.99
    assert post([50.0, 50.0, 60.0], None).max() == pytest.approx(0.5, abs=0.01)
    assert post([0.0, 0.0, 5.0], "mdy")[NAMES.index("mdy")] > 0.99
    assert post([9e6, 1e5, 6e6], "mdy")[NAMES.index("dmy")] > post([9e6, 1e5, 6e6], "dmy")[NAMES.index("mdy")]


def test_column(spark):
    rows = [(1, "d", "13/02/2023 10:00:00"), (2, "d", "03/02/2023 10:00:00"), (3, "u", "03/02/2023 10:00:00"), (4, "u", "02/02/2023 10:00:00"), (5, None, "2022-01-02T05:09:22Z"), (6, "d", None), (7, "d", ""), (8, "d", "x" * 100_000), (2, "d", "03/02/2023 10:00:00")]
    df = spark.createDataFrame(rows, "id int, origin string, text string").withColumnRenamed("id", "tz")
    src = spark.createDataFrame([("d", "UTC", "dmy"), ("u", "UTC", None)], "origin string, tz string, date_order string")
    df = df.withColumnRenamed("tz", "id")
    got = normalise_moments(df, "text", "origin", src).collect()
    out = {r["id"]: r["moment"] for r in got}
    assert len(got) == len(rows)
    assert out[2]["s"] == utc(2023, 2, 3, 10, 0, 0) and out[2]["format"] == "dmy"
    assert out[3]["s"] is None and out[3]["state"] == AMBIGUOUS
    assert out[4]["s"] == utc(2023, 2, 2, 10, 0, 0)
    assert out[5]["s"] == utc(2022, 1, 2, 5, 9, 22)
    assert [out[k]["state"] for k in (6, 7, 8)] == ["no_format"] * 3
    assert normalise_moments(df.limit(0), "text", "origin", src).count() == 0


def test_pairs(spark, tmp_path):
    t = "2023:07:08 17:15:10"
    tags = [(1, 1, "DateTime", "a", t), (2, 2, "DateTime", "a", "2023-07-08T17:15:10.9Z"), (2, 2, "DateTime", "a", "2023-07-08T17:15:10.9Z"), (3, 3, "DateTimeOriginal", "a", t), (4, 1, "DateTime", "a", t), (5, 4, "DateTime", "a", t), (6, 5, "DateTime", "a", t), (7, None, None, None, None)]
    images = [(1, "s"), (1, "s"), (2, "s"), (3, "s"), (4, None), (5, "other")]
    spark.createDataFrame(tags, "exif_row_id long, image_id long, tag_name string, origin string, text string").write.parquet(f"{tmp_path}/exif_tag.parquet")
    spark.createDataFrame(images, "image_id long, body_serial string").write.parquet(f"{tmp_path}/raw_jpeg.parquet")
    spark.createDataFrame([("a", "UTC", "dmy")], "origin string, tz string, date_order string").write.parquet(f"{tmp_path}/origin.parquet")
    assert {tuple(r) for r in p4_found(spark, str(tmp_path)).collect()} == {(1, 2), (2, 4)}


def test_classes_and_hot_moments(spark, tmp_path, monkeypatch):
    """A stuck clock: all pairs of a hot moment in parts, and its class without pairs."""
    from lumaspark.core import queries

    monkeypatch.setattr(queries, "PAIR_PART", 7)
    tags = [(k, k // 2, "DateTime", "a", "2023:07:08 17:15:10") for k in range(60)] + [(99, 50, "DateTime", "a", "2024:07:08 17:15:10")]
    spark.createDataFrame(tags, "exif_row_id long, image_id long, tag_name string, origin string, text string").write.parquet(f"{tmp_path}/exif_tag.parquet")
    spark.createDataFrame([(k, "s") for k in range(51)], "image_id long, body_serial string").write.parquet(f"{tmp_path}/raw_jpeg.parquet")
    spark.createDataFrame([("a", "UTC", "dmy")], "origin string, tz string, date_order string").write.parquet(f"{tmp_path}/origin.parquet")
    got = [tuple(r) for r in p4_found(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60) if a // 2 != b // 2]
    assert {tuple(r) for r in p4_classes(spark, str(tmp_path)).collect()} == {(k, 0, 58) for k in range(60)}
