"""Media files made from the supplied tables, so that every parser has input of known content.

All are built inside UDFs, one file per row, over the whole tables.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import exif, jpeg, png, raster, video
from .ebml import element

ORIENT = (1, 3, 6, 8)


def _png(i: int, rgb: bytes) -> bytes:
    im = np.frombuffer(rgb, dtype=np.uint8).reshape(16, 48)
    stream = zlib.compress(png.filtered(im, 3, i), 6)
    parts = [
        (b"IHDR", struct.pack(">LLBBBBB", 16, 16, 8, 2, 0, 0, 0)),
        (b"cHRM", struct.pack(">8L", *(i + k for k in range(8)))),
        (b"gAMA", struct.pack(">L", 45455 + i)),
        (b"bKGD", struct.pack(">3H", i % 256, 1, 2)),
        (b"tIME", struct.pack(">HBBBBB", 2020 + i % 5, 1 + i % 14, 1 + i % 28, i % 24, i % 60, i % 60)),
        (b"tEXt", f"Title\0Image {i}".encode()),
        (b"prVt", b"\1\2\3"),
        (b"IDAT", stream[:100]),
        (b"IDAT", stream[100:]),
        (b"IEND", b""),
    ]
    return png.SIGNATURE + b"".join(png.chunk(k, p) for k, p in parts)


def _palette_png(i: int, rgb: bytes) -> bytes:
    """A 4-bit image of the red samples' upper half over a palette of 16 colours."""
    index = np.frombuffer(rgb, dtype=np.uint8).reshape(16, 16, 3)[..., 0] >> 4
    packed = (index[:, 0::2] << 4 | index[:, 1::2]).astype(np.uint8)
    palette = bytes(x for k in range(16) for x in (k * 16, 255 - k * 16, (k + i) % 256))
    raw = b"".join(b"\0" + row.tobytes() for row in packed)
    parts = [(b"IHDR", struct.pack(">LLBBBBB", 16, 16, 4, 3, 0, 0, 0)), (b"PLTE", palette), (b"tRNS", b"\x80"), (b"IDAT", zlib.compress(raw, 0)), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(png.chunk(k, p) for k, p in parts)


def image_files(images: DataFrame) -> DataFrame:
    """(image_id, png, palette_png, bmp, ppm, pgm_ascii, jpeg) of 16x16 RGB images; the BMP lacks the
    last column, so that its rows are padded."""

    def build(ids: pd.Series, datas: pd.Series) -> pd.DataFrame:
        rows = []
        for i, d in zip(ids, datas):
            rgb = np.asarray(d, dtype=np.uint8).tobytes()
            im = np.frombuffer(rgb, dtype=np.uint8).reshape(16, 16, 3)
            rows.append((_png(i, rgb), _palette_png(i, rgb), raster.write_bmp(15, 16, im[:, :15].tobytes()), raster.write_pnm("P6", 16, 16, rgb), raster.write_pnm("P2", 16, 16, im[..., 1].tobytes()), jpeg.encode(16, 16, rgb, 75)))
        return pd.DataFrame(rows, columns=["png", "palette_png", "bmp", "ppm", "pgm_ascii", "jpeg"])

    files = F.pandas_udf(build, "png binary, palette_png binary, bmp binary, ppm binary, pgm_ascii binary, jpeg binary")
    return images.select("image_id", files(F.col("image_id"), F.col("data")).alias("f")).select("image_id", "f.*")


def _customer_jpeg(key: int, name: str, segment: str, nation: int) -> bytes:
    order = "<>"[key % 2]
    p = lambda fmt, *v: struct.pack(order + fmt, *v)
    text = lambda s: s.encode() + b"\0"
    ifds = {
        "ifd0": [
            (0x010F, 2, len(segment) + 1, text(segment)),
            (0x0110, 2, len(name) + 1, text(name)),
            (0x0112, 3, 1, p("H", ORIENT[key % 4])),
            (0x011A, 5, 1, p("LL", key + 1, 10)),
            (0x0128, 3, 1, p("H", 2 + key % 2)),
        ],
        "sub": [(0x9204, 10, 1, p("ll", -key, 3)), (0xA002, 4, 1, p("L", key)), (0xA300, 1, 1, b"\3")],
        "gps": [(0x0001, 2, 2, b"N\0"), (0x0006, 5, 1, p("LL", nation, 1))],
    }
    app0 = b"JFIF\0" + struct.pack(">HBHHBB", 0x0102, nation % 3, key % 1000 + 1, nation + 1, 0, 0)
    xmp = b"http://ns.adobe.com/xap/1.0/\0" + f"<x:xmpmeta><name>{name}</name></x:xmpmeta>".encode()
    extra = jpeg.segment(0xE0, app0) + jpeg.segment(0xE1, exif.write(ifds, order)) + jpeg.segment(0xE1, xmp) + jpeg.segment(0xE2, b"ICC_PROFILE\0\1\1") + jpeg.segment(0xFE, f"{segment} of {name}".encode() + b"\0")
    from ..functions import tables

    quant = [tables.scaled(tables.LUMA_QUANT, key % 100 + 1), tables.scaled(tables.CHROMA_QUANT, key % 100 + 1)]
    return jpeg.serialise(16 * (1 + nation % 3), 16 * (1 + key % 5), [(2, 2), (1, 1), (1, 1)], quant, b"\x12\xff\x00\x34", extra)


def customer_jpegs(spark: SparkSession, d: str) -> DataFrame:
    """(custkey, content): a JPEG per customer with JFIF, EXIF, XMP, ICC and a comment."""
    build = F.pandas_udf(lambda a, b, c, n: pd.Series([_customer_jpeg(*r) for r in zip(a, b, c, n)], dtype="object"), "binary")
    return spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("custkey"), build("c_custkey", "c_name", "c_mktsegment", "c_nationkey").alias("content"))


#: Quarter seconds of an hour.
HOUR = 14400


def _simple_blocks(q: np.ndarray, ids: np.ndarray, users: np.ndarray, keys: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A SimpleBlock per event, one after the other, and where each begins (with the end of all).

    Its frame has an SEI unit and a slice of the event's id and up to six zeros, with lengths of four bytes.
    """
    rows, pad = np.zeros((len(q), 35), np.uint8), ids % 7
    big = lambda values, kind: values.astype(kind)[:, None].view(np.uint8)
    rows[:, 0], rows[:, 1], rows[:, 2] = 0xA3, 0x80 | 27 + pad, 0x80 | users % 3 + 1
    rows[:, 3:5] = big(q % HOUR, ">i2")
    rows[:, 5] = np.where(keys, 0x80, 0)
    rows[:, 6:16] = np.frombuffer(struct.pack(">L", 6) + b"\x06" + b"\1" * 5, np.uint8)
    rows[:, 19], rows[:, 20] = 9 + pad, np.where(keys, 0x65, 0x41)
    rows[:, 21:29] = big(ids, ">u8")
    size = 29 + pad
    return rows[np.arange(35) < size[:, None]].tobytes(), np.concatenate([[0], np.cumsum(size)])


def _mkv(day: int, slot: int, q: np.ndarray, ids: np.ndarray, users: np.ndarray, keys: np.ndarray) -> bytes:
    """A file of events in the order of their quarter seconds ``q``."""
    file_id = day * 50 + slot
    uid = lambda n: (1 << 63) + file_id * 10 + n
    track = lambda n, kind, codec, *more: element("TrackEntry", [element("TrackNumber", n), element("TrackUID", uid(n)), element("TrackType", kind), element("CodecID", codec), *more])
    video_size = element("Video", [element("PixelWidth", 640 + slot), element("PixelHeight", 480)])
    tracks = element("Tracks", [track(1, 1, "V_MPEG4/ISO/AVC", video_size, element("CodecPrivate", _avcc(slot, slot + 1))), track(2, 2, "A_OPUS", element("Language", "de"), element("FlagLacing", 0)), track(3, 17, "S_TEXT/UTF8")])
    head = element("Info", [element("TimestampScale", 250_000_000), element("MuxingApp", "lumaspark"), element("WritingApp", f"day {day}"), element("SegmentUuid", struct.pack(">QQ", day, slot)), element("Duration", float(q[-1] + 1))])
    simple = lambda k, v: element("SimpleTag", [element("TagName", k), element("TagBinary" if isinstance(v, bytes) else "TagString", v)])
    tag = lambda targets, *items: element("Tag", [element("Targets", [element("TagTrackUID", u) for u in targets]), *items])
    tags = element("Tags", [
        tag([], simple("TITLE", "old"), simple("GONE", "x")),
        tag([], simple("TITLE", f"Day {day}"), simple("COUNT", str(len(q)))),
        tag([uid(1)], simple("BPS", "1"), simple("KEEP", b"\1\2" * 12)),
        tag([uid(1)], simple("BPS", str(slot))),
    ])
    flat, ends = _simple_blocks(q, ids, users, keys)
    cuts = [0, *(np.flatnonzero(np.diff(q // HOUR)) + 1), len(q)]
    clusters = [element("Cluster", [element("Timestamp", int(q[i]) // HOUR * HOUR), flat[ends[i] : ends[j]]]) for i, j in pairwise(cuts)]
    seek = lambda name, at: element("Seek", [element("SeekId", {"Info": b"\x15\x49\xa9\x66", "Tracks": b"\x16\x54\xae\x6b"}[name]), element("SeekPosition", at)])
    seek_head = element("SeekHead", [seek("Info", 1000 + slot), seek("Tracks", 2000 + slot)])
    header = element("Ebml", [element("EbmlVersion", 1), element("EbmlReadVersion", 1), element("EbmlMaxIDLength", 4), element("EbmlMaxSizeLength", 8), element("DocType", "matroska"), element("DocTypeVersion", 4), element("DocTypeReadVersion", 2)])
    return header + element("Segment", [seek_head, element("Void", b"\0" * 30), head, tracks, tags, *clusters])


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of each (day, slot) of sorted batches; those of one may lie in several batches."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        day, slot = columns[:2]
        cuts = [0, *(np.flatnonzero((np.diff(day) != 0) | (np.diff(slot) != 0)) + 1), len(day)]
        for i, j in pairwise(cuts if len(day) else []):
            if parts and (parts[0][0][0], parts[0][1][0]) != (day[i], slot[i]):
                yield [np.concatenate(c) for c in zip(*parts)]
                parts = []
            parts.append([c[i:j] for c in columns])
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def _build_mkv(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    send = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], names=["file_id", "content"])
    ids, files = [], []
    for day, slot, *events in _by_file(batches):
        ids.append(int(day[0]) * 50 + int(slot[0]))
        files.append(_mkv(int(day[0]), int(slot[0]), *events))
        if sum(map(len, files)) > 1 << 20:
            yield send()
            ids, files = [], []
    if ids:
        yield send()


def mkv_files(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, content): a Matroska file per day and slot of users, a cluster per hour, a block per event.

    The events of a file are brought together and sorted by Spark and come as columns, so that none is
    an object of its own; events without a time or a user have no file.
    """
    q = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) % 86_400_000_000) / 250_000).cast("int")
    e = table(spark, d, "events").select(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day"), (F.col("user_id") % 50).cast("int").alias("slot"), q.alias("q"), "event_id", "user_id", F.coalesce(F.col("event_type") == "purchase", F.lit(False)).alias("key"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e = e.where("day is not null and slot is not null").repartition(n, "day", "slot").sortWithinPartitions("day", "slot", "q", "event_id", "user_id", "key")
    return e.mapInArrow(_build_mkv, "file_id long, content binary")


def mp4_files(spark: SparkSession, d: str) -> DataFrame:
    """(nationkey, content): a file that begins with ftyp, per nation."""
    name = F.encode(F.rpad("n_name", 8, "_"), "UTF-8")
    number = lambda v: F.unhex(F.lpad(F.hex(v.cast("long")), 8, "0"))
    content = F.concat(number(F.lit(24)), F.encode(F.lit("ftyp"), "UTF-8"), F.substring(name, 1, 4), number(F.col("n_nationkey")), F.substring(name, 1, 8), F.unhex(F.lit("0000000866726565")))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("nationkey"), content.alias("content"))


AVC_PROFILES = (66, 77, 88, 100)


def _avcc(key: int, size: int) -> bytes:
    profile, constraints = AVC_PROFILES[key % 4], 0x40 if size % 2 else 0
    bits = [("u8", profile), ("u8", constraints), ("u8", 10 + size), ("ue", key % 4)]
    if profile == 100:
        bits += [("ue", 1), ("ue", 0), ("ue", 2), ("u1", 0), ("u1", 0)]
    bits += [("ue", 4), ("ue", 0), ("ue", 2), ("ue", size), ("u1", 1), ("ue", key % 120), ("ue", size % 60), ("u1", 1), ("u1", size % 3 == 0), ("u1", size % 2)]
    if size % 2:
        bits += [("ue", 0), ("ue", size), ("ue", 1), ("ue", 2)]
    raw = video.write_bits(bits + [("u1", 0)])
    sps = b"\x67" + raw.replace(b"\0\0\0", b"\0\0\3\0").replace(b"\0\0\1", b"\0\0\3\1")
    pps = b"\x68\xee\x3c\x80"
    n = 1 + key % 3
    return bytes([1, profile, constraints, 10 + size, 0xFC | size % 4, 0xE0 | n]) + n * (struct.pack(">H", len(sps)) + sps) + bytes([2]) + 2 * (struct.pack(">H", len(pps)) + pps)


def avcc_records(spark: SparkSession, d: str) -> DataFrame:
    """(partkey, content): an AVC configuration record per part."""
    build = F.pandas_udf(lambda k, s: pd.Series([_avcc(int(a), int(b)) for a, b in zip(k, s)], dtype="object"), "binary")
    return table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), build("p_partkey", "p_size").alias("content"))
