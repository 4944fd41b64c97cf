"""Media files as DataFrames: parsing UDFs and views over BINARY columns.

What must be read in order (segments, chunks, element trees) comes from one UDF per format, which
gives an array of rows and an error text; what has a fixed place is read by column expressions, so
Catalyst prunes the fields that nobody asks for. Null content gives no rows and no error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import bits
from ..sources import convert, ebml, exif, jpeg, png, raster, video
from ..sources.errors import attempt


def _parser(parse: Callable[[bytes], Any], schema: str):
    """UDF content -> struct<value: schema, error: string>."""

    def run(content: pd.Series) -> pd.DataFrame:
        done = [attempt(parse, None if c is None else bytes(c)) for c in content]
        return pd.DataFrame({"value": pd.Series([v for v, _ in done], dtype="object"), "error": pd.Series([e for _, e in done], dtype="object")})

    return F.pandas_udf(run, f"value {schema}, error string")


def _dicts(names: str, rows: list[tuple]) -> list[dict]:
    keys = names.split()
    return [dict(zip(keys, r)) for r in rows]


SEGMENT = "array<struct<seq:int,marker:int,name:string,offset:long,length:long,payload:binary>>"
TAG = "array<struct<ifd:string,tag_id:int,name:string,format:string,count:long,ints:array<decimal(20,0)>,text:string,error:string>>"
CHUNK = "array<struct<seq:int,type:string,length:long,payload:binary,crc:long,crc_ok:boolean>>"
ELEMENT = "array<struct<seq:int,parent_seq:int,depth:int,id:long,name:string,kind:string,position:long,data_offset:int,size:long,v_int:decimal(20,0),v_float:double,v_text:string,v_bin:binary>>"
NAL = "array<struct<seq:int,position:long,kind:string,size:long,payload:binary>>"
IMAGE = "struct<width:int,height:int,data:binary>"
BLOCK = "struct<track:long,ts_rel:int,keyframe:boolean,invisible:boolean,lacing:string,discardable:boolean,frame_offset:int,frame_size:long>"
BMP = "struct<signature:string,file_size:long,data_offset:long,dib_size:long,width:long,height:long,planes:int,bits_per_pixel:int,compression:long,data_size:long,resolution_horizontal:long,resolution_vertical:long,colors:long,important_colors:long,data:binary>"
PNM = "struct<format:string,encoding:string,width:int,height:int,channels:int,max:int,data:binary>"
SPS = (
    "struct<profile_idc:int,constraint_sets:int,level:int,parameter_id:long,chroma_format:long,separate_colour_plane:boolean,bit_depth_luma_minus8:long,bit_depth_chroma_minus8:long,"
    "qpprime_y_zero_transform_bypass:boolean,seq_scaling_matrix_present:boolean,log2_max_frame_num_minus4:long,pic_order_cnt_type:long,log2_max_pic_order_cnt_lsb_minus4:long,"
    "max_num_ref_frames:long,gaps_in_frame_num_value_allowed:boolean,pic_width_in_mbs_minus1:long,pic_height_in_map_units_minus1:long,direct_8x8_inference:boolean,"
    "crop_left:long,crop_right:long,crop_top:long,crop_bottom:long,vui_present:boolean>"
)
AVCC = f"struct<profile:string,level:int,nal_length_size:int,n_sps:int,n_pps:int,sps:array<{SPS}>>"


def jpeg_segments(content: Column) -> Column:
    return _parser(lambda b: _dicts("seq marker name offset length payload", jpeg.segments(b)), SEGMENT)(content)


def exif_tags(payload: Column) -> Column:
    def parse(b: bytes) -> list[dict]:
        return [t | {"ints": None if t["ints"] is None else [Decimal(i) for i in t["ints"]]} for t in exif.tags(b)]

    return _parser(parse, TAG)(payload)


def png_chunks(content: Column) -> Column:
    return _parser(lambda b: _dicts("seq type length payload crc crc_ok", png.chunks(b)), CHUNK)(content)


def ebml_elements(content: Column, descend: set[str] | None = None, payload: bool = True) -> Column:
    def parse(b: bytes) -> list[dict]:
        rows = ebml.elements(b, descend=descend, payload=payload)
        return [r | {"v_int": None if r["v_int"] is None else Decimal(r["v_int"])} for r in rows]

    return _parser(parse, ELEMENT)(content)


def simple_block(raw: Column) -> Column:
    return _parser(ebml.simple_block, BLOCK)(raw)


def nal_units(data: Column, length_size: int = 4) -> Column:
    return _parser(lambda b: _dicts("seq position kind size payload", video.nal_units(b, length_size)), NAL)(data)


def avcc(data: Column) -> Column:
    return _parser(video.avcc, AVCC)(data)


def bmp(content: Column) -> Column:
    return _parser(raster.bmp, BMP)(content)


def pnm(content: Column) -> Column:
    return _parser(raster.pnm, PNM)(content)


def _image(parse: Callable[[bytes], tuple[int, int, bytes]]):
    return _parser(lambda b: dict(zip(("width", "height", "data"), parse(b))), IMAGE)


def png_decode(content: Column) -> Column:
    return _image(png.decode)(content)


def jpeg_decode(content: Column) -> Column:
    return _image(jpeg.decode)(content)


def decode_file(path: Column, content: Column) -> Column:
    """struct<value: image, error> of a file told by its extension."""

    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        done = [attempt(lambda c, p: dict(zip(("width", "height", "data"), convert.decode(p, c))), None if c is None else bytes(c), p or "") for p, c in zip(paths, contents)]
        return pd.DataFrame({"value": pd.Series([v for v, _ in done], dtype="object"), "error": pd.Series([e for _, e in done], dtype="object")})

    return F.pandas_udf(run, f"value {IMAGE}, error string")(path, content)


def encode_file(path: Column, width: Column, height: Column, data: Column) -> Column:
    """struct<value: binary, error> of an image as the file its extension tells."""

    def run(paths: pd.Series, widths: pd.Series, heights: pd.Series, datas: pd.Series) -> pd.DataFrame:
        done = [attempt(lambda d, p, w, h: convert.encode(p, int(w), int(h), d), None if d is None else bytes(d), p or "", w, h) for p, w, h, d in zip(paths, widths, heights, datas)]
        return pd.DataFrame({"value": pd.Series([v for v, _ in done], dtype="object"), "error": pd.Series([e for _, e in done], dtype="object")})

    return F.pandas_udf(run, "value binary, error string")(path, width, height, data)


def text_of(data: Column) -> Column:
    """UTF-8 text; bytes that aren't become replacement characters."""
    return F.call_function("make_valid_utf8", data.cast("string"))


# ------------------------------------------------------------------ fields at fixed places


def jfif(p: Column) -> Column:
    """APP0: struct(version, density_unit, x_density, y_density, x_thumbnail, y_thumbnail)."""
    u = lambda at, n: bits.be_uint(p, at, n).cast("int")
    fields = F.struct(u(5, 2).alias("version"), u(7, 1).alias("density_unit"), u(8, 2).alias("x_density"), u(10, 2).alias("y_density"), u(12, 1).alias("x_thumbnail"), u(13, 1).alias("y_thumbnail"))
    return F.when(F.hex(F.substring(p, 1, 5)) == "4A46494600", fields)


def sof0(p: Column) -> Column:
    """SOF0: struct(precision, height, width, components array of (id, h, v, quant))."""
    u = lambda at, n: bits.be_uint(p, at, n).cast("int")
    comp = lambda i: F.struct(u(6 + 3 * i, 1).alias("id"), F.floor(u(7 + 3 * i, 1) / 16).cast("int").alias("h"), (u(7 + 3 * i, 1) % 16).alias("v"), u(8 + 3 * i, 1).alias("quant"))
    return F.struct(u(0, 1).alias("precision"), u(1, 2).alias("height"), u(3, 2).alias("width"), F.transform(F.sequence(F.lit(0), u(5, 1) - 1), comp).alias("components"))


def sos(p: Column) -> Column:
    """SOS: struct(tables array of (dc, ac), start, end, entropy-coded bytes)."""
    u = lambda at, n: bits.be_uint(p, at, n).cast("int")
    n = u(0, 1)
    pair = lambda i: F.struct(F.floor(u(2 + 2 * i, 1) / 16).cast("int").alias("dc"), (u(2 + 2 * i, 1) % 16).alias("ac"))
    return F.struct(F.transform(F.sequence(F.lit(0), n - 1), pair).alias("tables"), u(1 + 2 * n, 1).alias("start"), u(2 + 2 * n, 1).alias("end"), (F.length(p) - 4 - 2 * n).alias("n_bytes"))


def dqt(p: Column) -> Column:
    """DQT: array of struct(index, values) of its 8-bit tables."""
    one = lambda t: F.struct((bits.be_uint(p, t * 65, 1) % 16).cast("int").alias("index"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: bits.be_uint(p, t * 65 + k, 1).cast("int")).alias("values"))
    return F.when(F.length(p) % 65 == 0, F.transform(F.sequence(F.lit(0), (F.length(p) / 65).cast("int") - 1), one))


def dht(p: Column) -> Column:
    """DHT with one table: struct(class, index, counts, symbols)."""
    counts = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: bits.be_uint(p, k, 1).cast("int"))
    symbols = F.transform(F.sequence(F.lit(17), F.length(p) - 1), lambda k: bits.be_uint(p, k, 1).cast("int"))
    head = bits.be_uint(p, 0, 1).cast("int")
    return F.struct(F.floor(head / 16).cast("int").alias("class"), (head % 16).alias("index"), counts.alias("counts"), symbols.alias("symbols"))


def app1_kind(p: Column) -> Column:
    """exif, xmp or other."""
    return F.when(F.hex(F.substring(p, 1, 6)) == "457869660000", "exif").when(text_of(F.substring(p, 1, 28)) == "http://ns.adobe.com/xap/1.0/", "xmp").otherwise("other")


def xmp(p: Column) -> Column:
    """The XMP text after the namespace and its zero byte."""
    return F.when(app1_kind(p) == "xmp", text_of(F.substring(p, F.lit(30), F.length(p) - 29)))


def app2_kind(p: Column) -> Column:
    """icc or other."""
    return F.when(text_of(F.substring(p, 1, 11)) == "ICC_PROFILE", "icc").otherwise("other")


def comment(p: Column) -> Column:
    """A comment without its last byte."""
    return text_of(F.substring(p, F.lit(1), F.length(p) - 1))


def ihdr(p: Column) -> Column:
    """IHDR: struct(width, height, bit_depth, colour_type, channels, row_size, interlace)."""
    u = lambda at, n: bits.be_uint(p, at, n)
    colour = u(9, 1)
    channels = F.when(colour.isin(0, 3), 1).when(colour == 2, 3).when(colour == 4, 2).when(colour == 6, 4)
    row = F.floor((u(0, 4) * channels * u(8, 1) + 7) / 8).cast("long")
    fields = F.struct(u(0, 4).alias("width"), u(4, 4).alias("height"), u(8, 1).cast("int").alias("bit_depth"), colour.cast("int").alias("colour_type"), channels.alias("channels"), row.alias("row_size"), u(12, 1).cast("int").alias("interlace"))
    return F.when((F.length(p) == 13) & channels.isNotNull() & u(8, 1).isin(1, 2, 4, 8, 16), fields)


def plte(p: Column) -> Column:
    """PLTE: array of struct(r, g, b)."""
    u = lambda at: bits.be_uint(p, at, 1).cast("int")
    return F.when(F.length(p) % 3 == 0, F.transform(F.sequence(F.lit(0), (F.length(p) / 3).cast("int") - 1), lambda i: F.struct(u(i * 3).alias("r"), u(i * 3 + 1).alias("g"), u(i * 3 + 2).alias("b"))))


def chrm(p: Column) -> Column:
    """cHRM: the eight numbers of 32 bytes."""
    return F.when(F.length(p) == 32, F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: bits.be_uint(p, i * 4, 4)))


def gama(p: Column) -> Column:
    """gAMA as a number."""
    return bits.be_uint(p, 0, 4) / 100000


def bkgd(p: Column) -> Column:
    """bKGD: struct(kind, values) by length."""
    u = lambda at: bits.be_uint(p, at, 2).cast("int")
    return (
        F.when(F.length(p) == 1, F.struct(F.lit("palette").alias("kind"), F.array(bits.be_uint(p, 0, 1).cast("int")).alias("values")))
        .when(F.length(p) == 2, F.struct(F.lit("grey").alias("kind"), F.array(u(0)).alias("values")))
        .when(F.length(p) == 6, F.struct(F.lit("rgb").alias("kind"), F.array(u(0), u(2), u(4)).alias("values")))
    )


def time_of(p: Column) -> Column:
    """tIME as a TIMESTAMP_NTZ; null for a moment that doesn't exist."""
    u = lambda at, n: bits.be_uint(p, at, n).cast("int")
    return F.when(F.length(p) == 7, F.call_function("try_make_timestamp_ntz", u(0, 2), u(2, 1), u(3, 1), u(4, 1), u(5, 1), u(6, 1)))


def zlib_header(p: Column) -> Column:
    """The zlib header: struct(method, window, fcheck, fdict, level)."""
    a, b = bits.be_uint(p, 0, 1).cast("int"), bits.be_uint(p, 1, 1).cast("int")
    level = F.element_at(F.array(*[F.lit(x) for x in ("Fastest", "Fast", "Default", "Maximum")]), F.floor(b / 64).cast("int") + 1)
    return F.struct(F.when(a % 16 == 8, "Deflate").otherwise("Unknown").alias("method"), F.call_function("shiftleft", F.lit(1), F.floor(a / 16).cast("int") + 8).alias("window"), (b % 32).alias("fcheck"), (F.floor(b / 32) % 2 == 1).alias("fdict"), level.alias("level"))


def four_cc(data: Column, at: Column | int) -> Column:
    """Four bytes as text."""
    at = F.lit(at) if isinstance(at, int) else at
    return text_of(F.substring(data, at + 1, F.lit(4)))


def ftyp(content: Column) -> Column:
    """The ftyp box a file begins with: struct(size, major, minor, brands); null for another box."""
    size = bits.be_uint(content, 0, 4)
    n = F.floor((F.least(size, F.length(content)) - 16) / 4).cast("int")
    brands = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: four_cc(content, i * 4 + 16))).otherwise(F.array().cast("array<string>"))
    return F.when((four_cc(content, 4) == "ftyp") & (size >= 16), F.struct(size.alias("size"), four_cc(content, 8).alias("major"), bits.be_uint(content, 12, 4).alias("minor"), brands.alias("brands")))


def bmp_header(content: Column) -> Column:
    """File and DIB header of a BMP by expressions: all numbers little-endian."""
    names = ("dib_size", "width", "height")
    fields = [bits.le_uint(content, 14 + 4 * i, 4).alias(n) for i, n in enumerate(names)]
    fields += [bits.le_uint(content, 26, 2).cast("int").alias("planes"), bits.le_uint(content, 28, 2).cast("int").alias("bits_per_pixel")]
    fields += [bits.le_uint(content, 30 + 4 * i, 4).alias(n) for i, n in enumerate(("compression", "data_size", "resolution_horizontal", "resolution_vertical", "colors", "important_colors"))]
    return F.struct(text_of(F.substring(content, 1, 2)).alias("signature"), bits.le_uint(content, 2, 4).alias("file_size"), bits.le_uint(content, 10, 4).alias("data_offset"), *fields)


# ------------------------------------------------------------------ Matroska views


def children(el: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Elements of a name below a parent of a name, with the parent's seq as ``up``."""
    a = el.where(F.col("name") == parent).select(key, F.col("seq").alias("up"))
    b = el.where(F.col("name") == name)
    return b.join(a, (b[key] == a[key]) & (b["parent_seq"] == a["up"])).drop(a[key])


def fields_of(el: DataFrame, key: str, owner: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per element named ``owner`` with its children's values: alias -> (name, v_column).

    A later child of a name wins. Owner and children meet in one aggregation, without a join.
    """
    names = [n for n, _ in fields.values()]
    mine = el.where((F.col("name") == owner) | F.col("name").isin(*names)).withColumn("own", F.when(F.col("name") == owner, F.col("seq")).otherwise(F.col("parent_seq")))
    aggs = [F.max_by(F.col(v), F.when(F.col("name") == n, F.col("seq"))).alias(a) for a, (n, v) in fields.items()]
    return mine.groupBy(key, "own").agg(F.max((F.col("name") == owner).cast("int")).alias("is_owner"), *aggs).where("is_owner = 1").drop("is_owner")


def info(el: DataFrame, key: str) -> DataFrame:
    """Info: scale (1,000,000 if not given), apps, UUID, duration, and what is missing as error."""
    rows = fields_of(el, key, "Info", {"scale": ("TimestampScale", "v_int"), "muxing_app": ("MuxingApp", "v_text"), "writing_app": ("WritingApp", "v_text"), "segment_uuid": ("SegmentUuid", "v_bin"), "duration": ("Duration", "v_float")})
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing_element: {n}")) for c, n in (("muxing_app", "MuxingApp"), ("writing_app", "WritingApp"), ("segment_uuid", "SegmentUuid"), ("duration", "Duration"))])
    return rows.withColumn("scale", F.coalesce("scale", F.lit(1000000))).withColumn("error", missing)


TRACK_TYPES = {1: "Video", 2: "Audio", 3: "Complex", 16: "Logo", 17: "Subtitle", 18: "Buttons", 32: "Control", 33: "Metadata"}


def tracks(el: DataFrame, key: str) -> DataFrame:
    """TrackEntry rows with video size; lacing is on and the language eng unless said otherwise."""
    t = fields_of(el, key, "TrackEntry", {"number": ("TrackNumber", "v_int"), "uid": ("TrackUID", "v_int"), "type": ("TrackType", "v_int"), "lacing": ("FlagLacing", "v_int"), "language": ("Language", "v_text"), "codec_id": ("CodecID", "v_text"), "video_seq": ("Video", "seq")})
    v = fields_of(el, key, "Video", {"width": ("PixelWidth", "v_int"), "height": ("PixelHeight", "v_int")}).select(F.col(key).alias("_k"), F.col("own").alias("_o"), "width", "height")
    kind = F.coalesce(*[F.when(F.col("type") == n, F.lit(s)) for n, s in TRACK_TYPES.items()])
    rows = t.join(v, (F.col(key) == F.col("_k")) & (F.col("video_seq") == F.col("_o")), "left").drop("_k", "_o", "video_seq")
    return rows.withColumn("type", kind).withColumn("lacing", F.coalesce(F.col("lacing") != 0, F.lit(True))).withColumn("language", F.coalesce("language", F.lit("eng")))


def codec_configs(df: DataFrame, key: str, content: str, el: DataFrame) -> DataFrame:
    """(key, number, codec_id, raw, avc): codec private data of the tracks that have any, cut out of
    the file by position; AVC tracks have it read as a configuration record, others only as bytes."""
    t = fields_of(el, key, "TrackEntry", {"number": ("TrackNumber", "v_int"), "codec_id": ("CodecID", "v_text"), "at": ("CodecPrivate", "position"), "offset": ("CodecPrivate", "data_offset"), "size": ("CodecPrivate", "size")})
    files = df.select(F.col(key).alias("_k"), F.col(content).alias("_c"))
    t = t.where("at is not null").join(files, t[key] == F.col("_k")).withColumn("raw", F.expr("substring(_c, int(at + offset) + 1, int(size))"))
    config = avcc(F.when(F.col("codec_id") == "V_MPEG4/ISO/AVC", F.col("raw")))
    return t.select(key, "number", "codec_id", "raw", config.alias("p")).select(key, "number", "codec_id", "raw", F.col("p.value").alias("avc"), F.col("p.error").alias("error"))


#: Blocks, and MB of their bytes, that are sent on at once.
BLOCK_ROWS, BLOCK_MB = 10_000, 16


def blocks(df: DataFrame, key: str, content: str, raw: bool = True) -> DataFrame:
    """SimpleBlocks with their cluster's timestamp: (key, cluster_seq, seq, cluster_ts, raw, track, ...).

    A file is read where it lies and its blocks are sent on in parts, so no row holds a file beside a
    block and nothing is shuffled. A file whose tree can't be read has no blocks.

    :param raw: False leaves the blocks' bytes out.
    """
    fields = [f.split(":") for f in BLOCK.removeprefix("struct<").removesuffix(">").split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    whole = StructType.fromDDL(f"cluster_seq int, seq int, cluster_ts decimal(20,0), raw binary, {', '.join(' '.join(f) for f in fields)}, error string")
    types = [pa.int32(), pa.int32(), pa.decimal128(20, 0), pa.binary(), *(kinds[k] for _, k in fields), pa.string()]
    schema = StructType([df.schema[key], *(f for f in whole if raw or f.name != "raw")])
    blank = (None,) * len(fields)

    def table_of(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        at, *columns = zip(*rows)
        arrays = [pa.array(c, t) for c, t, f in zip(columns, types, whole) if raw or f.name != "raw"]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *arrays], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, held = batch.column(0), [], 0
            for k, file in enumerate(batch.column(1)):
                data = file.as_py()
                for cluster, seq, stamp, at, size in attempt(ebml.blocks, data)[0] or ():
                    cut = data[at : at + size]
                    b, error = attempt(ebml.simple_block, cut)
                    rows.append((k, cluster, seq, None if stamp is None else Decimal(stamp), cut if raw else None, *(b.values() if b else blank), error))
                    held += size * raw
                    if len(rows) >= BLOCK_ROWS or held >= BLOCK_MB << 20:
                        yield table_of(keys, rows)
                        rows, held = [], 0
            if rows:
                yield table_of(keys, rows)

    return df.select(key, content).mapInArrow(run, schema)


def tags(el: DataFrame, key: str) -> DataFrame:
    """(key, target, name, text, bin): of global tags only the last Tag counts, those of a track are
    merged and the last value of a name wins. SimpleTags inside others describe those and aren't given."""
    simple = fields_of(el, key, "SimpleTag", {"name": ("TagName", "v_text"), "text": ("TagString", "v_text"), "bin": ("TagBinary", "v_bin")}).withColumnRenamed("own", "s")
    up = children(el, key, "Tag", "SimpleTag").select(F.col(key).alias("_k"), F.col("seq").alias("s"), F.col("parent_seq").alias("tag"))
    simple = simple.join(up, (simple[key] == up["_k"]) & (simple["s"] == up["s"])).drop("_k").drop(up["s"])
    targets = el.where("name = 'Targets'").select(F.col(key).alias("_k"), F.col("seq").alias("t"), F.col("parent_seq").alias("tag2"))
    uids = el.where("name = 'TagTrackUID'").select(F.col(key).alias("_k2"), F.col("parent_seq").alias("t2"), F.col("v_int").alias("uid"))
    owner = targets.join(uids, (F.col("_k") == F.col("_k2")) & (F.col("t") == F.col("t2"))).select("_k", "tag2", "uid")
    rows = simple.join(owner, (F.col(key) == F.col("_k")) & (F.col("tag") == F.col("tag2")), "left")
    rows = rows.withColumn("target", F.coalesce(F.col("uid").cast("string"), F.lit("global")))
    last = F.max("tag").over(Window.partitionBy(key, "target"))
    rows = rows.withColumn("last", last).where("target <> 'global' or tag = last")
    return rows.groupBy(key, "target", F.col("name")).agg(F.max_by(F.struct("text", "bin"), "s").alias("v")).select(key, "target", "name", "v.text", "v.bin")


def paths(elements: Column) -> Column:
    """The array of elements with each one's path of names, worked out inside the row, however deep."""

    def path(e: Column) -> Column:
        start = F.struct(e["name"].alias("path"), e["parent_seq"].alias("up"))
        climb = lambda p, _: F.struct(F.concat(elements[p["up"]]["name"], F.lit("/"), p["path"]).alias("path"), elements[p["up"]]["parent_seq"].alias("up"))
        return F.when(e["depth"] > 0, F.aggregate(F.sequence(F.lit(1), e["depth"]), start, climb)["path"]).otherwise(e["name"])

    return F.transform(elements, lambda e: F.struct(e["seq"].alias("seq"), path(e).alias("path")))
