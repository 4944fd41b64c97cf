"""Blocks of Matroska files: long files, odd files, and the files made of events."""

import struct
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumaspark.operators import media as M
from lumaspark.plans import containers
from lumaspark.sources import ebml, fixtures
from lumaspark.sources.ebml import element

START = datetime(2024, 1, 1)


def block(track, ts, flags=0, frame=b"x" * 30):
    return element("SimpleBlock", bytes([0x80 | track]) + struct.pack(">hB", ts, flags) + frame)


@pytest.fixture
def events(spark, tmp_path):
    """25,000 events of one file, more than a batch holds, three of others, and two that belong to none."""
    rows = [(k, START + timedelta(milliseconds=3449 * (k * 7919 % 25_000)), 50 * (k % 40) + 3, ("purchase", "view", None)[k % 3]) for k in range(25_000)]
    rows += [(30_000, START, 4, "view"), (30_001, START + timedelta(days=2), 4, "purchase"), (30_002, START + timedelta(days=2), 54, "click")]
    odd = [(30_003, None, 4, "view"), (30_004, START, None, "view")]
    spark.createDataFrame(rows + odd, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), rows


def test_no_row_holds_a_file_beside_a_block(spark, events):
    """A row of a block beside its whole file, joined or waiting for Python, takes the square of the file's size in disk."""
    folder, rows = events
    df = containers.mkv_blocks(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ArrowEvalPython" not in plan
    want = Counter()
    for ident, ts, user, kind in rows:
        since = ts - START
        want[since.days * 50 + user % 50, since.seconds + since.microseconds // 250_000 * 0.25, user % 3 + 1, kind == "purchase", 23 + ident % 7] += 1
    per_key = Counter()
    for (*key, size), n in want.items():
        per_key[(*key, "n")] += n
        per_key[(*key, "bytes")] += n * size
    got = Counter()
    for r in df.collect():
        key = r["file_id"], r["seconds"], r["track"], r["keyframe"]
        got[(*key, "n")] += r["n"]
        got[(*key, "bytes")] += r["frame_bytes"]
    assert got == per_key and df.agg(F.sum("n")).first()[0] == len(rows)
    kinds = {(r["file_id"], r["kind"]): r["n"] for r in containers.nal_units(spark, folder).groupBy("file_id", "kind").agg(F.sum("n").alias("n")).collect()}
    assert kinds[3, "Sei"] == 25_000 and kinds[3, "IdrSlice"] == 8334 and kinds[3, "Slice"] == 16_666 and kinds[104, "Sei"] == 2


def test_files_of_events(spark, events):
    folder, rows = events
    made = {r["file_id"]: bytes(r["content"]) for r in fixtures.mkv_files(spark, folder).collect()}
    assert sorted(made) == [3, 4, 104]
    ordered = sorted(((ts - START) // timedelta(milliseconds=250), ident, user, kind) for ident, ts, user, kind in rows[:25_000] for kind in [kind or ""])
    body = b""
    for q, ident, user, kind in ordered:
        units = [b"\x06" + b"\1" * 5, (b"\x65" if kind == "purchase" else b"\x41") + struct.pack(">Q", ident) + b"\0" * (ident % 7)]
        body += block(user % 3 + 1, q % 14400, 0x80 if kind == "purchase" else 0, b"".join(struct.pack(">L", len(u)) + u for u in units))
    found = ebml.blocks(made[3])
    assert b"".join(element("SimpleBlock", made[3][at : at + size]) for _, _, _, at, size in found) == body
    assert [stamp for _, _, stamp, _, _ in found] == [q // 14400 * 14400 for q, *_ in ordered]


def test_blocks_of_odd_files(spark):
    live = element("Cluster", [])[:4] + b"\x01" + b"\xff" * 7
    late = element("Cluster", [block(1, 1), element("Timestamp", 5), block(2, -2, 0x80), element("Timestamp", 4)])
    files = {
        "late": element("Segment", [late]),
        "none": element("Segment", [element("Cluster", [block(3, 1)])]),
        "live": element("Segment", [live + element("Timestamp", (1 << 64) - 1) + block(1, 7, frame=b""), live + element("Timestamp", 9) + block(1, 8)]),
        "bad block": element("Segment", [element("Cluster", [element("Timestamp", 1), element("SimpleBlock", b"\x81\0"), block(1, 2)])]),
        "cut": element("Segment", [late])[:-1],
        "bad value": element("Segment", [element("Info", [element("Duration", b"\0\0\0")]), late]),
        "empty": b"",
        "null": None,
    }
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "file string, content binary")
    cells = ("file", "cluster_seq", "seq", "cluster_ts", "track", "ts_rel", "keyframe", "lacing", "frame_size", "error")
    got = sorted((tuple(int(r[c]) if c == "cluster_ts" and r[c] is not None else r[c] for c in cells) for r in M.blocks(df, "file", "content").collect()), key=lambda r: (r[0], r[2]))
    assert got == [
        ("bad block", 1, 3, 1, None, None, None, None, None, "unexpected_end"),
        ("bad block", 1, 4, 1, 1, 2, False, "None", 30, None),
        ("late", 1, 2, 5, 1, 1, False, "None", 30, None),
        ("late", 1, 4, 5, 2, -2, True, "None", 30, None),
        ("live", 1, 3, (1 << 64) - 1, 1, 7, False, "None", 0, None),
        ("live", 4, 6, 9, 1, 8, False, "None", 30, None),
        ("none", 1, 2, None, 3, 1, False, "None", 30, None),
    ]
    raw = {(r["file"], r["seq"]): bytes(r["raw"]) for r in M.blocks(df, "file", "content").collect()}
    assert raw["late", 4] == b"\x82\xff\xfe\x80" + b"x" * 30 and raw["bad block", 3] == b"\x81\0"
    bare = M.blocks(df, "file", "content", raw=False)
    assert bare.columns == [c for c in M.blocks(df, "file", "content").columns if c != "raw"] and bare.count() == 7


def test_files_over_batches():
    """A file's events in several batches, with empty ones between."""
    import pyarrow as pa

    day, slot, q = np.array([0] * 5 + [1] * 4), np.array([1] * 3 + [2] * 4 + [3] * 2), np.arange(9)
    whole = pa.RecordBatch.from_pandas(pd.DataFrame({"day": day, "slot": slot, "q": q}))
    for cuts in ([9], [1, 2, 2, 3, 9], [0, 4, 6, 9], list(range(1, 10))):
        parts = [whole.slice(a, b - a) for a, b in zip([0, *cuts], cuts)]
        assert [(int(d[0]), int(s[0]), n.tolist()) for d, s, n in fixtures._by_file(iter(parts))] == [(0, 1, [0, 1, 2]), (0, 2, [3, 4]), (1, 2, [5, 6]), (1, 3, [7, 8])]
