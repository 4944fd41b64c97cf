"""Queries of the container operators over files made from the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import media as M
from ..session import table
from ..sources import fixtures as X
from .pixels import IMAGE, images


def files(spark: SparkSession, d: str) -> DataFrame:
    return X.image_files(images(spark, d))


def _sum(data: Column, weight: int = 1009) -> Column:
    """A sum of all bytes weighted by place: says whether two byte strings are equal."""
    run = F.pandas_udf(lambda s: pd.Series([None if b is None else sum(v * (i % weight + 1) for i, v in enumerate(bytes(b))) for b in s], dtype="Int64"), "long")
    return run(data)


# ------------------------------------------------------------------ JPEG


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return X.customer_jpegs(spark, d).select("custkey", F.explode(M.jpeg_segments(F.col("content"))["value"]).alias("s")).select("custkey", "s.*")


def jpeg_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of every JPEG in order."""
    return _segments(spark, d).select("custkey", "seq", "marker", "name")


def jpeg_frame_info(spark: SparkSession, d: str) -> DataFrame:
    """Frame and JFIF headers, one row a file."""
    s = _segments(spark, d)
    one = s.groupBy("custkey").agg(F.max_by("payload", F.when(F.col("name") == "SOF0", F.col("seq"))).alias("sof"), F.max_by("payload", F.when(F.col("name") == "APP0", F.col("seq"))).alias("app0"), F.max_by("payload", F.when(F.col("name") == "SOS", F.col("seq"))).alias("sos"))
    f = one.select("custkey", M.sof0(F.col("sof")).alias("f"), M.jfif(F.col("app0")).alias("j"), M.sos(F.col("sos")).alias("s"))
    return f.select("custkey", "f.precision", "f.width", "f.height", F.size("f.components").alias("components"), F.col("f.components")[0]["h"].alias("h"), F.col("f.components")[0]["v"].alias("v"), "j.density_unit", "j.x_density", "j.y_density", F.col("s.end").alias("spectral_end"), F.col("s.n_bytes").alias("scan_bytes"))


def jpeg_quant_tables(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the quantisation tables of every file, summed by table."""
    t = _segments(spark, d).where("name = 'DQT'").select("custkey", F.explode(M.dqt(F.col("payload"))).alias("t"))
    return t.select("custkey", F.col("t.index").alias("table_index"), F.aggregate("t.values", F.lit(0), lambda a, v: a + v).alias("total"), F.col("t.values")[5].alias("fifth"))


def jpeg_huffman_tables(spark: SparkSession, d: str) -> DataFrame:
    """Huffman tables of every file: number and sum of symbols by class and index."""
    t = _segments(spark, d).where("name = 'DHT'").select("custkey", M.dht(F.col("payload")).alias("t"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)
    return t.select("custkey", F.col("t.class").alias("table_class"), F.col("t.index").alias("table_index"), total("t.counts").alias("n_codes"), total("t.symbols").alias("symbol_sum"))


def _app1(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return _segments(spark, d).where("name = 'APP1'").where(M.app1_kind(F.col("payload")) == kind)


def exif_tags(spark: SparkSession, d: str) -> DataFrame:
    """EXIF tags of every file, without the links between directories."""
    t = _app1(spark, d, "exif").select("custkey", F.explode(M.exif_tags(F.col("payload"))["value"]).alias("t")).select("custkey", "t.*")
    return t.where("name not in ('ExifOffset', 'GPSInfo')").select("custkey", "ifd", "tag_id", "name", "format", "count", F.array_join(F.col("ints").cast("array<string>"), "/").alias("ints"), "text")


def exif_enums(spark: SparkSession, d: str) -> DataFrame:
    """Orientation and resolution unit by name."""
    from ..sources.exif import ORIENTATIONS, UNITS

    t = _app1(spark, d, "exif").select("custkey", F.explode(M.exif_tags(F.col("payload"))["value"]).alias("t")).select("custkey", "t.name", F.col("t.ints")[0].cast("int").alias("v"))
    say = lambda names: F.coalesce(*[F.when(F.col("v") == k, F.lit(n)) for k, n in names.items()], F.lit("Unknown"))
    return t.groupBy("custkey").agg(F.max(F.when(F.col("name") == "Orientation", say(ORIENTATIONS))).alias("orientation"), F.max(F.when(F.col("name") == "ResolutionUnit", say(UNITS))).alias("unit"))


def xmp_text(spark: SparkSession, d: str) -> DataFrame:
    """XMP texts."""
    return _app1(spark, d, "xmp").select("custkey", M.xmp(F.col("payload")).alias("xmp"))


def jpeg_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments and the kind of APP2."""
    s = _segments(spark, d).where("name in ('COM', 'APP2')")
    return s.groupBy("custkey").agg(F.max(F.when(F.col("name") == "COM", M.comment(F.col("payload")))).alias("comment"), F.max(F.when(F.col("name") == "APP2", M.app2_kind(F.col("payload")))).alias("app2"))


def jpeg_encode(spark: SparkSession, d: str) -> DataFrame:
    """Size and number of segments of every encoded image."""
    f = files(spark, d)
    return f.select("image_id", F.length("jpeg").alias("n_bytes"), F.size(M.jpeg_segments(F.col("jpeg"))["value"]).alias("n_segments"))


def jpeg_decode(spark: SparkSession, d: str) -> DataFrame:
    """Mean difference of every decoded image to its original."""
    f = files(spark, d).join(images(spark, d).select("image_id", "data"), "image_id").withColumn("im", M.jpeg_decode(F.col("jpeg"))["value"])
    gap = F.pandas_udf(lambda a, b: pd.Series([float(sum(abs(int(x) - int(y)) for x, y in zip(bytes(p), q)) / len(q)) for p, q in zip(a, b)]), "double")
    return f.select("image_id", "im.width", "im.height", gap("im.data", "data").alias("mean_gap"))


# ------------------------------------------------------------------ PNG


def _chunks(spark: SparkSession, d: str, column: str = "png") -> DataFrame:
    return files(spark, d).select("image_id", F.explode(M.png_chunks(F.col(column))["value"]).alias("c")).select("image_id", "c.*")


def png_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every PNG in order."""
    return _chunks(spark, d).select("image_id", "seq", "type", "crc_ok", (F.call_function("crc32", F.concat(F.encode("type", "UTF-8"), "payload")) == F.col("crc")).alias("crc_again"))


def png_ihdr(spark: SparkSession, d: str) -> DataFrame:
    """Headers of both PNGs of every image."""
    rows = [_chunks(spark, d, c).where("type = 'IHDR'").select("image_id", F.lit(c).alias("file"), M.ihdr(F.col("payload")).alias("h")).select("image_id", "file", "h.*") for c in ("png", "palette_png")]
    return rows[0].unionByName(rows[1])


def png_ancillary(spark: SparkSession, d: str) -> DataFrame:
    """Gamma, chromaticities, background, time and text of every PNG."""
    c = _chunks(spark, d)
    p = F.col("payload")
    pick = lambda kind, value: F.max(F.when(F.col("type") == kind, value))
    when = F.date_format(M.time_of(p), "yyyy-MM-dd HH:mm:ss")
    return c.groupBy("image_id").agg(pick("gAMA", M.gama(p)).alias("gamma"), pick("cHRM", F.array_join(M.chrm(p).cast("array<string>"), " ")).alias("chrm"), pick("bKGD", F.array_join(M.bkgd(p)["values"].cast("array<string>"), " ")).alias("background"), pick("tIME", when).alias("changed"), pick("tEXt", F.replace(M.text_of(p), F.lit("\0"), F.lit("="))).alias("note"), F.sum(F.when(F.col("type") == "IDAT", 1).otherwise(0)).alias("n_idat"))


def png_palette(spark: SparkSession, d: str) -> DataFrame:
    """Palette entries of every palette PNG."""
    c = _chunks(spark, d, "palette_png").where("type = 'PLTE'").select("image_id", F.posexplode(M.plte(F.col("payload"))).alias("entry", "p"))
    return c.select("image_id", "entry", "p.r", "p.g", "p.b")


def png_palette_decode(spark: SparkSession, d: str) -> DataFrame:
    """Palette images decoded to RGB."""
    return _pixel_rows(files(spark, d).select("image_id", M.png_decode(F.col("palette_png"))["value"].alias("im")))


def _pixel_rows(df: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b) of decoded images, cut from the bytes by place."""
    byte = lambda at: F.conv(F.hex(F.substring("data", at + 1, F.lit(1))), 16, 10).cast("int")
    rows = df.select("image_id", "im.*").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    return rows.select("image_id", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), *[byte(F.col("p") * 3 + k).alias(c) for k, c in enumerate("rgb")])


def png_decode(spark: SparkSession, d: str) -> DataFrame:
    """Every PNG decoded, pixel by pixel."""
    return _pixel_rows(files(spark, d).select("image_id", M.png_decode(F.col("png"))["value"].alias("im")))


def zlib_header(spark: SparkSession, d: str) -> DataFrame:
    """Zlib header of every PNG's image data."""
    c = _chunks(spark, d).where("type = 'IDAT'").groupBy("image_id").agg(F.min_by("payload", "seq").alias("p"))
    return c.select("image_id", M.zlib_header(F.col("p")).alias("z")).select("image_id", "z.method", "z.window", "z.fdict", "z.level")


# ------------------------------------------------------------------ BMP, PNM, MP4


def bmp_parse(spark: SparkSession, d: str) -> DataFrame:
    """Headers of every BMP by expressions, and the sum of its pixel bytes."""
    f = files(spark, d).select("image_id", M.bmp_header(F.col("bmp")).alias("h"), M.bmp(F.col("bmp"))["value"]["data"].alias("data"))
    return f.select("image_id", "h.signature", "h.file_size", "h.data_offset", "h.width", "h.height", "h.bits_per_pixel", "h.resolution_horizontal", F.length("data").alias("n_bytes"), _sum(F.col("data")).alias("weighted"))


def pnm_parse(spark: SparkSession, d: str) -> DataFrame:
    """Both PNM files of every image."""
    rows = [files(spark, d).select("image_id", M.pnm(F.col(c))["value"].alias("p")).select("image_id", "p.format", "p.encoding", "p.width", "p.height", "p.max", _sum(F.col("p.data")).alias("weighted")) for c in ("ppm", "pgm_ascii")]
    return rows[0].unionByName(rows[1])


def pnm_write(spark: SparkSession, d: str) -> DataFrame:
    """Head and size of every PNM written."""
    f = files(spark, d)
    return f.select("image_id", M.text_of(F.substring("ppm", 1, 9)).alias("head"), F.length("ppm").alias("n_bytes"), F.substring(M.text_of(F.col("pgm_ascii")), 1, 9).alias("ascii_head"), (F.size(F.split(M.text_of(F.col("pgm_ascii")), "\n")) - 1).alias("n_lines"))


def convert(spark: SparkSession, d: str) -> DataFrame:
    """Every PNG converted to PPM, PGM and JPEG and read again."""
    f = files(spark, d).select("image_id", M.decode_file(F.lit("a.png"), F.col("png"))["value"].alias("im"))
    to = lambda ext: M.encode_file(F.lit(f"b.{ext}"), F.col("im.width"), F.col("im.height"), F.col("im.data"))["value"]
    f = f.select("image_id", to("ppm").alias("ppm"), to("pgm").alias("pgm"), to("jpg").alias("jpg"))
    again = M.decode_file(F.lit("b.ppm"), F.col("ppm"))["value"]
    return f.select("image_id", _sum(again["data"]).alias("ppm_weighted"), _sum(M.pnm(F.col("pgm"))["value"]["data"]).alias("pgm_weighted"), M.decode_file(F.lit("b.JPG"), F.col("jpg"))["value"]["width"].alias("jpg_width"))


def ftyp_parse(spark: SparkSession, d: str) -> DataFrame:
    """The ftyp box of every MP4."""
    f = X.mp4_files(spark, d).select("nationkey", M.ftyp(F.col("content")).alias("f"))
    return f.select("nationkey", "f.size", "f.major", "f.minor", F.array_join("f.brands", " ").alias("brands"))


# ------------------------------------------------------------------ Matroska and H.264


def _elements(spark: SparkSession, d: str, payload: bool = True) -> DataFrame:
    return X.mkv_files(spark, d).select("file_id", F.explode(M.ebml_elements(F.col("content"), payload=payload)["value"]).alias("e")).select("file_id", "e.*")


def ebml_header(spark: SparkSession, d: str) -> DataFrame:
    """EBML header of every file."""
    h = M.fields_of(_elements(spark, d).where("depth <= 1"), "file_id", "Ebml", {"doc_type": ("DocType", "v_text"), "version": ("EbmlVersion", "v_int"), "max_id_length": ("EbmlMaxIDLength", "v_int"), "doc_type_version": ("DocTypeVersion", "v_int")})
    return h.select("file_id", "doc_type", *[F.col(c).cast("long").alias(c) for c in ("version", "max_id_length", "doc_type_version")])


def ebml_tree(spark: SparkSession, d: str) -> DataFrame:
    """Elements of every file by depth, name and kind; only the structure is read."""
    return _elements(spark, d, payload=False).groupBy("file_id", "depth", "name", "kind").agg(F.count("*").alias("n"))


def ebml_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths of all elements with how often they occur in all files."""
    trees = X.mkv_files(spark, d).select(M.ebml_elements(F.col("content"), payload=False).alias("p")).select(F.col("p.value").alias("tree"))
    e = trees.select(F.explode(M.paths(F.col("tree"))).alias("e"))
    return e.groupBy(F.col("e.path").alias("path")).agg(F.count("*").alias("n"))


def mkv_info(spark: SparkSession, d: str) -> DataFrame:
    """Info of every file."""
    return M.info(_elements(spark, d), "file_id").select("file_id", F.col("scale").cast("long").alias("scale"), "muxing_app", "writing_app", F.hex("segment_uuid").alias("segment_uuid"), "duration", "error")


def mkv_duration(spark: SparkSession, d: str) -> DataFrame:
    """Duration of every file in seconds."""
    return M.info(_elements(spark, d), "file_id").select("file_id", (F.col("duration") * F.col("scale").cast("double") / 1e9).alias("seconds"))


def mkv_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of every file."""
    t = M.tracks(_elements(spark, d), "file_id")
    return t.select("file_id", F.col("number").cast("long").alias("number"), F.col("uid").cast("string").alias("uid"), "type", "lacing", "language", "codec_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


def mkv_codec_private(spark: SparkSession, d: str) -> DataFrame:
    """Codec configuration of the AVC tracks of every file."""
    f = X.mkv_files(spark, d)
    el = f.select("file_id", F.explode(M.ebml_elements(F.col("content"))["value"]).alias("e")).select("file_id", "e.*")
    c = M.codec_configs(f, "file_id", "content", el)
    return c.select("file_id", F.col("number").cast("long").alias("number"), "avc.profile", "avc.level", "avc.nal_length_size", F.col("avc.sps")[0]["pic_width_in_mbs_minus1"].alias("pic_width_in_mbs_minus1"))


def mkv_top_level(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the top level of every file and how many bytes each has; masters aren't entered."""
    e = X.mkv_files(spark, d).select("file_id", F.length("content").alias("whole"), F.explode(M.ebml_elements(F.col("content"), descend=set(), payload=False)["value"]).alias("e"))
    return e.groupBy("file_id", "whole").agg(F.array_join(F.array_sort(F.collect_set("e.name")), " ").alias("names"), F.sum(F.col("e.data_offset") + F.col("e.size")).alias("total")).select("file_id", "names", (F.col("total") == F.col("whole")).alias("complete"))


def mkv_seek(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the seek heads, with the element each one points to."""
    from ..sources.ebml import REGISTRY

    s = M.fields_of(_elements(spark, d), "file_id", "Seek", {"target": ("SeekId", "v_bin"), "position": ("SeekPosition", "v_int")})
    names = F.create_map(*[x for i, (n, _) in REGISTRY.items() for x in (F.lit(f"{i:X}"), F.lit(n))])
    return s.select("file_id", names[F.hex("target")].alias("target"), F.col("position").cast("long").alias("position"))


def mkv_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of every file and track."""
    return M.tags(_elements(spark, d), "file_id").select("file_id", "target", "name", "text", F.hex("bin").alias("bin"))


def _blocks(spark: SparkSession, d: str, raw: bool = True) -> DataFrame:
    return M.blocks(X.mkv_files(spark, d), "file_id", "content", raw)


def mkv_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every file with their time in seconds."""
    seconds = (F.col("cluster_ts").cast("double") + F.col("ts_rel")) * 0.25
    b = _blocks(spark, d, raw=False)
    return b.groupBy("file_id", seconds.alias("seconds"), "track", "keyframe", "lacing").agg(F.count("*").alias("n"), F.sum("frame_size").alias("frame_bytes"))


def mkv_framerate(spark: SparkSession, d: str) -> DataFrame:
    """Blocks per second of every file, over all tracks."""
    e = _elements(spark, d)
    one = e.groupBy("file_id").agg(F.sum((F.col("name") == "SimpleBlock").cast("int")).alias("n"), F.max(F.when(F.col("name") == "Duration", F.col("v_float"))).alias("t"), F.max(F.when(F.col("name") == "TimestampScale", F.col("v_int"))).alias("s"))
    return one.select("file_id", (F.col("n") / (F.col("t") * F.col("s").cast("double") / 1e9)).alias("framerate"))


def nal_units(spark: SparkSession, d: str) -> DataFrame:
    """NAL units of all blocks by file, track and kind."""
    b = _blocks(spark, d)
    frame = F.expr("substring(raw, frame_offset + 1, int(frame_size))")
    u = b.select("file_id", "track", F.explode(M.nal_units(frame)["value"]).alias("u"))
    return u.groupBy("file_id", "track", F.col("u.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum("u.size").alias("n_bytes"))


def avcc_config(spark: SparkSession, d: str) -> DataFrame:
    """AVC configuration records."""
    a = X.avcc_records(spark, d).select("partkey", M.avcc(F.col("content"))["value"].alias("a"))
    return a.select("partkey", "a.level", "a.nal_length_size", "a.n_sps", "a.n_pps")


def sps_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of all sequence parameter sets of each record."""
    a = X.avcc_records(spark, d).select("partkey", F.posexplode(M.avcc(F.col("content"))["value"]["sps"]).alias("seq", "s"))
    return a.select("partkey", "seq", "s.profile_idc", "s.level", "s.chroma_format", "s.bit_depth_chroma_minus8", "s.max_num_ref_frames", "s.gaps_in_frame_num_value_allowed", "s.pic_width_in_mbs_minus1", "s.pic_height_in_map_units_minus1", "s.direct_8x8_inference", "s.crop_right", "s.crop_bottom")


def h264_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile names."""
    return X.avcc_records(spark, d).select("partkey", M.avcc(F.col("content"))["value"]["profile"].alias("profile"))


# ------------------------------------------------------------------ dumps and errors


def jpeg_inspect(spark: SparkSession, d: str) -> DataFrame:
    """A line of text per segment."""
    return _segments(spark, d).select("custkey", "seq", F.format_string("%s [ %d bytes ]", "name", "length").alias("line"))


def png_inspect(spark: SparkSession, d: str) -> DataFrame:
    """A line of text per chunk."""
    return _chunks(spark, d).select("image_id", "seq", F.format_string("%s [ %d bytes ] crc %08x", "type", "length", "crc").alias("line"))


def bmp_inspect(spark: SparkSession, d: str) -> DataFrame:
    """Headers of every BMP as JSON."""
    return files(spark, d).select("image_id", F.to_json(M.bmp_header(F.col("bmp"))).alias("line"))


def mp4_inspect(spark: SparkSession, d: str) -> DataFrame:
    """The ftyp box of every MP4 as JSON."""
    return X.mp4_files(spark, d).select("nationkey", F.to_json(M.ftyp(F.col("content"))).alias("line"))


def mkv_inspect(spark: SparkSession, d: str) -> DataFrame:
    """An indented line of text per element; long binary values are told by size."""
    value = F.coalesce(F.col("v_int").cast("string"), F.col("v_float").cast("string"), F.col("v_text"), F.lower(F.hex("v_bin")), F.format_string(" [ %d bytes ] ", "size"))
    line = F.when(F.col("kind") == "Master", F.format_string("<%s>", "name")).otherwise(F.concat(F.lit("<"), "name", F.lit(">"), value, F.lit("</"), "name", F.lit(">")))
    return _elements(spark, d).select("file_id", "seq", F.concat(F.expr("repeat(' ', depth * 2)"), line).alias("line"))


def _broken(kind: Column, good: Column) -> Column:
    """A file with one of eight faults."""
    n = F.length(good)
    return (
        F.when(kind == 0, F.unhex(F.lit("00")))
        .when(kind == 1, F.expr("substring(content, 1, int(length(content) - 20))"))
        .when(kind == 2, F.overlay(good, F.unhex(F.lit("49484458")), 13))
        .when(kind == 3, F.overlay(good, F.unhex(F.lit("07")), 26))
        .when(kind == 4, F.overlay(good, F.unhex(F.lit("01")), 29))
        .when(kind == 5, F.lit(None).cast("binary"))
        .when(kind == 6, F.expr("substring(content, 1, int(length(content) - 12))"))
        .otherwise(F.when(n > 0, good))
    )


def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """The kind of error of PNG files with one fault each (eight faults in turn)."""
    f = files(spark, d).select("image_id", (F.col("image_id") % 8).alias("fault"), F.col("png").alias("content"))
    r = f.select("image_id", "fault", M.png_decode(_broken(F.col("fault"), F.col("content")))["error"].alias("error"))
    return r.select("image_id", F.split("error", ":")[0].alias("error"))


QUERIES = {
    f.__name__: f
    for f in (
        jpeg_segments, jpeg_frame_info, jpeg_quant_tables, jpeg_huffman_tables, exif_tags, exif_enums, xmp_text, jpeg_comments, jpeg_encode, jpeg_decode,
        png_chunks, png_ihdr, png_ancillary, png_palette, png_palette_decode, png_decode, zlib_header, bmp_parse, pnm_parse, pnm_write, convert, ftyp_parse,
        ebml_header, ebml_tree, ebml_path, mkv_info, mkv_duration, mkv_tracks, mkv_codec_private, mkv_top_level, mkv_seek, mkv_tags, mkv_blocks, mkv_framerate, nal_units, avcc_config,
        sps_fields, h264_profile, jpeg_inspect, png_inspect, bmp_inspect, mp4_inspect, mkv_inspect, parse_errors,
    )
}

# ---------------------------------------------------------------- SQL

_IMG = f"{IMAGE}, ids as (select distinct image_id from samples)"
_C = "select c_custkey as custkey, c_name as name, c_mktsegment as segment, c_nationkey as nation, c_custkey as k from customer"
_Q = "(case when k % 100 + 1 < 50 then 5000 // (k % 100 + 1) else 200 - 2 * (k % 100 + 1) end)"
_NAMES = "[(224,'APP0'),(225,'APP1'),(225,'APP1'),(226,'APP2'),(254,'COM'),(219,'DQT'),(219,'DQT'),(192,'SOF0'),(196,'DHT'),(196,'DHT'),(196,'DHT'),(196,'DHT'),(218,'SOS'),(217,'EOI')]"


def _base_list(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _tag(ifd: str, tag: int, name: str, fmt: str, count: str, ints: str, text: str) -> str:
    return f"select custkey, '{ifd}' as ifd, {tag} as tag_id, '{name}' as name, '{fmt}' as format, cast({count} as bigint) as count, {ints} as ints, {text} as text from c"


_EXIF = " union all ".join([
    _tag("ifd0", 0x10F, "Make", "Ascii", "length(segment) + 1", "null", "segment"),
    _tag("ifd0", 0x110, "Model", "Ascii", "length(name) + 1", "null", "name"),
    _tag("ifd0", 0x112, "Orientation", "UnsignedShort", "1", "[1, 3, 6, 8][k % 4 + 1]::varchar", "null"),
    _tag("ifd0", 0x11A, "XResolution", "UnsignedRational", "1", "(k + 1) || '/10'", "null"),
    _tag("ifd0", 0x128, "ResolutionUnit", "UnsignedShort", "1", "(2 + k % 2)::varchar", "null"),
    _tag("sub", 0x9204, "ExposureBiasValue", "SignedRational", "1", "(-k) || '/3'", "null"),
    _tag("sub", 0xA002, "ExifImageWidth", "UnsignedLong", "1", "k::varchar", "null"),
    _tag("sub", 0xA300, "FileSource", "UnsignedByte", "1", "'3'", "null"),
    _tag("gps", 0x1, "LatitudeRef", "Ascii", "2", "null", "'N'"),
    _tag("gps", 0x6, "Altitude", "UnsignedRational", "1", "nation || '/1'", "null"),
])
_EV = """ev as (select event_id, user_id, event_type, day, slot, day * 50 + slot as file_id, cast((epoch_us(ts) % 86400000000) // 250000 as int) as q
  from (select *, date_diff('day', date '2024-01-01', ts::date) as day, cast(user_id % 50 as int) as slot from events)),
  f as (select file_id, day, slot, count(*) as n, max(q) as last, count(distinct q // 14400) as hours from ev group by 1, 2, 3)"""
_TREE = """t(depth, name, kind, n, path) as (values
  (0, 'Ebml', 'Master', 1, 'Ebml'), (1, 'EbmlVersion', 'UnsignedInteger', 1, 'Ebml/EbmlVersion'), (1, 'EbmlReadVersion', 'UnsignedInteger', 1, 'Ebml/EbmlReadVersion'),
  (1, 'EbmlMaxIDLength', 'UnsignedInteger', 1, 'Ebml/EbmlMaxIDLength'), (1, 'EbmlMaxSizeLength', 'UnsignedInteger', 1, 'Ebml/EbmlMaxSizeLength'), (1, 'DocType', 'String', 1, 'Ebml/DocType'),
  (1, 'DocTypeVersion', 'UnsignedInteger', 1, 'Ebml/DocTypeVersion'), (1, 'DocTypeReadVersion', 'UnsignedInteger', 1, 'Ebml/DocTypeReadVersion'), (0, 'Segment', 'Master', 1, 'Segment'),
  (1, 'SeekHead', 'Master', 1, 'Segment/SeekHead'), (2, 'Seek', 'Master', 2, 'Segment/SeekHead/Seek'), (3, 'SeekId', 'Binary', 2, 'Segment/SeekHead/Seek/SeekId'),
  (3, 'SeekPosition', 'UnsignedInteger', 2, 'Segment/SeekHead/Seek/SeekPosition'), (1, 'Void', 'Binary', 1, 'Segment/Void'), (1, 'Info', 'Master', 1, 'Segment/Info'),
  (2, 'TimestampScale', 'UnsignedInteger', 1, 'Segment/Info/TimestampScale'), (2, 'MuxingApp', 'Utf8', 1, 'Segment/Info/MuxingApp'), (2, 'WritingApp', 'Utf8', 1, 'Segment/Info/WritingApp'),
  (2, 'SegmentUuid', 'Binary', 1, 'Segment/Info/SegmentUuid'), (2, 'Duration', 'Float', 1, 'Segment/Info/Duration'), (1, 'Tracks', 'Master', 1, 'Segment/Tracks'),
  (2, 'TrackEntry', 'Master', 3, 'Segment/Tracks/TrackEntry'), (3, 'TrackNumber', 'UnsignedInteger', 3, 'Segment/Tracks/TrackEntry/TrackNumber'), (3, 'TrackUID', 'UnsignedInteger', 3, 'Segment/Tracks/TrackEntry/TrackUID'),
  (3, 'TrackType', 'UnsignedInteger', 3, 'Segment/Tracks/TrackEntry/TrackType'), (3, 'CodecID', 'String', 3, 'Segment/Tracks/TrackEntry/CodecID'), (3, 'CodecPrivate', 'Binary', 1, 'Segment/Tracks/TrackEntry/CodecPrivate'), (3, 'Video', 'Master', 1, 'Segment/Tracks/TrackEntry/Video'),
  (4, 'PixelWidth', 'UnsignedInteger', 1, 'Segment/Tracks/TrackEntry/Video/PixelWidth'), (4, 'PixelHeight', 'UnsignedInteger', 1, 'Segment/Tracks/TrackEntry/Video/PixelHeight'),
  (3, 'Language', 'String', 1, 'Segment/Tracks/TrackEntry/Language'), (3, 'FlagLacing', 'UnsignedInteger', 1, 'Segment/Tracks/TrackEntry/FlagLacing'), (1, 'Tags', 'Master', 1, 'Segment/Tags'),
  (2, 'Tag', 'Master', 4, 'Segment/Tags/Tag'), (3, 'Targets', 'Master', 4, 'Segment/Tags/Tag/Targets'), (4, 'TagTrackUID', 'UnsignedInteger', 2, 'Segment/Tags/Tag/Targets/TagTrackUID'),
  (3, 'SimpleTag', 'Master', 7, 'Segment/Tags/Tag/SimpleTag'), (4, 'TagName', 'Utf8', 7, 'Segment/Tags/Tag/SimpleTag/TagName'), (4, 'TagString', 'Utf8', 6, 'Segment/Tags/Tag/SimpleTag/TagString'),
  (4, 'TagBinary', 'Binary', 1, 'Segment/Tags/Tag/SimpleTag/TagBinary'), (1, 'Cluster', 'Master', -1, 'Segment/Cluster'), (2, 'Timestamp', 'UnsignedInteger', -1, 'Segment/Cluster/Timestamp'),
  (2, 'SimpleBlock', 'Binary', -2, 'Segment/Cluster/SimpleBlock')),
  tree as (select file_id, depth, name, kind, path, case t.n when -1 then hours when -2 then f.n else t.n end as n from f, t)"""
_UID = "(9223372036854775808::hugeint + file_id * 10"
_SPS = "select p_partkey as partkey, p_partkey as k, p_size as s, [66, 77, 88, 100][p_partkey % 4 + 1] as profile from part"
SQL: dict[str, str] = {
    "jpeg_segments": f"select c_custkey as custkey, cast(seq as int) as seq, {_NAMES}[seq + 1][1] as marker, {_NAMES}[seq + 1][2] as name from customer, (select unnest(range(14)) as seq)",
    "jpeg_frame_info": f"with c as ({_C}) select custkey, 8 as precision, cast(16 * (1 + nation % 3) as int) as width, cast(16 * (1 + k % 5) as int) as height, 3 as components, 2 as h, 2 as v, cast(nation % 3 as int) as density_unit, cast(k % 1000 + 1 as int) as x_density, cast(nation + 1 as int) as y_density, 63 as spectral_end, 4 as scan_bytes from c",
    "jpeg_quant_tables": f"with c as ({_C}), b as (select 0 as table_index, {_base_list(tables.LUMA_QUANT)} as t union all select 1, {_base_list(tables.CHROMA_QUANT)}) select custkey, table_index, cast(list_sum(list_transform(t, lambda x: greatest(1, least(255, (x * {_Q} + 50) // 100)))) as int) as total, cast(greatest(1, least(255, (t[6] * {_Q} + 50) // 100)) as int) as fifth from c, b",
    "jpeg_huffman_tables": "select c_custkey as custkey, t.* from customer, (values (0, 0, 12, 66), (0, 1, 12, 66), (1, 0, 162, 20320), (1, 1, 162, 20320)) t(table_class, table_index, n_codes, symbol_sum)",
    "exif_tags": f"with c as ({_C}) {_EXIF}",
    "exif_enums": f"with c as ({_C}) select custkey, ['Normal', 'Rotated180', 'Rotated90', 'Rotated270'][k % 4 + 1] as orientation, ['Inch', 'Centimeter'][k % 2 + 1] as unit from c",
    "xmp_text": f"with c as ({_C}) select custkey, '<x:xmpmeta><name>' || name || '</name></x:xmpmeta>' as xmp from c",
    "jpeg_comments": f"with c as ({_C}) select custkey, segment || ' of ' || name as comment, 'icc' as app2 from c",
    "png_chunks": f"with {_IMG} select image_id, cast(seq as int) as seq, ['IHDR', 'cHRM', 'gAMA', 'bKGD', 'tIME', 'tEXt', 'prVt', 'IDAT', 'IDAT', 'IEND'][seq + 1] as type, true as crc_ok, true as crc_again from ids, (select unnest(range(10)) as seq)",
    "png_ihdr": f"with {_IMG} select image_id, h.* from ids, (values ('png', 16::bigint, 16::bigint, 8, 2, 3, 48::bigint, 0), ('palette_png', 16, 16, 4, 3, 1, 8, 0)) h(file, width, height, bit_depth, colour_type, channels, row_size, interlace)",
    "png_ancillary": f"with {_IMG} select image_id, (45455 + image_id) / 100000 as gamma, array_to_string(list_transform(range(8), lambda k: (image_id + k)::varchar), ' ') as chrm, (image_id % 256) || ' 1 2' as background, case when image_id % 14 < 12 then strftime(make_timestamp(2020 + image_id % 5, 1 + image_id % 14, 1 + image_id % 28, image_id % 24, image_id % 60, (image_id % 60)::double), '%Y-%m-%d %H:%M:%S') end as changed, 'Title=Image ' || image_id as note, 2::bigint as n_idat from ids",
    "png_palette": f"with {_IMG} select image_id, cast(e as int) as entry, cast(e * 16 as int) as r, cast(255 - e * 16 as int) as g, cast((e + image_id) % 256 as int) as b from ids, (select unnest(range(16)) as e)",
    "png_palette_decode": f"with {IMAGE} select image_id, x, y, cast(r // 16 * 16 as int) as r, cast(255 - r // 16 * 16 as int) as g, cast((r // 16 + image_id) % 256 as int) as b from rgb",
    "png_decode": f"with {IMAGE} select image_id, x, y, r, g, b from rgb",
    "zlib_header": f"with {_IMG} select image_id, 'Deflate' as method, 32768 as window, false as fdict, 'Default' as level from ids",
    "bmp_parse": f"with {IMAGE}, p as (select image_id, (15 - y) * 45 + x * 3 as pos, r, g, b from rgb where x < 15) select image_id, 'BM' as signature, 822::bigint as file_size, 54::bigint as data_offset, 15::bigint as width, 16::bigint as height, 24 as bits_per_pixel, 2835::bigint as resolution_horizontal, 720 as n_bytes, cast(sum(b * (pos % 1009 + 1) + g * ((pos + 1) % 1009 + 1) + r * ((pos + 2) % 1009 + 1)) as bigint) as weighted from p group by image_id",
    "pnm_parse": f"with {IMAGE} select image_id, 'P6' as format, 'Binary' as encoding, 16 as width, 16 as height, max(px) as max, cast(sum(px * (n % 1009 + 1)) as bigint) as weighted from samples group by image_id union all select image_id, 'P2', 'Ascii', 16, 16, max(g), cast(sum(g * (y * 16 + x + 1)) as bigint) from rgb group by image_id",
    "pnm_write": f"with {IMAGE}, m as (select image_id, max(px) as m from samples group by 1), a as (select image_id, max(g) as g from rgb group by 1) select image_id, 'P6' || chr(10) || '16 16' || chr(10) as head, cast(9 + length(m::varchar) + 1 + 768 as int) as n_bytes, 'P2' || chr(10) || '16 16' || chr(10) as ascii_head, 19 as n_lines from m join a using (image_id)",
    "convert": f"with {IMAGE}, p as (select image_id, cast(sum(px * (n % 1009 + 1)) as bigint) as ppm_weighted from samples group by 1), g as (select image_id, cast(sum(cast(trunc(0.299::float * r::float + 0.587::float * g::float + 0.114::float * b::float) as int) * (y * 16 + x + 1)) as bigint) as pgm_weighted from rgb group by 1) select image_id, ppm_weighted, pgm_weighted, 16 as jpg_width from p join g using (image_id)",
    "ftyp_parse": "select n_nationkey::bigint as nationkey, 24::bigint as size, substr(rpad(n_name, 8, '_'), 1, 4) as major, n_nationkey::bigint as minor, substr(rpad(n_name, 8, '_'), 1, 4) || ' ' || substr(rpad(n_name, 8, '_'), 5, 4) as brands from nation",
    "ebml_header": f"with {_EV} select file_id, 'matroska' as doc_type, 1::bigint as version, 4::bigint as max_id_length, 4::bigint as doc_type_version from f",
    "ebml_tree": f"with {_EV}, {_TREE} select file_id, depth, name, kind, cast(n as bigint) as n from tree",
    "ebml_path": f"with {_EV}, {_TREE} select path, cast(sum(n) as bigint) as n from tree group by path",
    "mkv_info": f"with {_EV} select file_id, 250000000::bigint as scale, 'lumaspark' as muxing_app, 'day ' || day as writing_app, printf('%016X%016X', day, slot) as segment_uuid, (last + 1)::double as duration, null::varchar as error from f",
    "mkv_duration": f"with {_EV} select file_id, (last + 1)::double * 250000000 / 1e9 as seconds from f",
    "mkv_tracks": f"with {_EV} select file_id, n.number::bigint as number, ({_UID} + n.number))::varchar as uid, n.type, n.lacing, n.language, n.codec_id, case when n.number = 1 then 640 + slot end::bigint as width, case when n.number = 1 then 480 end::bigint as height from f, (values (1, 'Video', true, 'eng', 'V_MPEG4/ISO/AVC'), (2, 'Audio', false, 'de', 'A_OPUS'), (3, 'Subtitle', true, 'eng', 'S_TEXT/UTF8')) n(number, type, lacing, language, codec_id)",
    "mkv_codec_private": f"with {_EV}, s as (select *, slot + 1 as size from f) select file_id, 1::bigint as number, case slot % 4 when 0 then case when size % 2 = 1 then 'ConstrainedBaseline' else 'Baseline' end when 1 then 'Main' when 2 then 'Extended' else 'High' end as profile, cast(10 + size as int) as level, cast(size % 4 + 1 as int) as nal_length_size, (slot % 120)::bigint as pic_width_in_mbs_minus1 from s",
    "mkv_top_level": f"with {_EV} select file_id, 'Ebml Segment' as names, true as complete from f",
    "mkv_seek": f"with {_EV} select file_id, 'Info' as target, (1000 + slot)::bigint as position from f union all select file_id, 'Tracks', (2000 + slot)::bigint from f",
    "mkv_tags": f"with {_EV} select file_id, 'global' as target, 'TITLE' as name, 'Day ' || day as text, null as bin from f union all select file_id, 'global', 'COUNT', n::varchar, null from f union all select file_id, ({_UID} + 1))::varchar, 'BPS', slot::varchar, null from f union all select file_id, ({_UID} + 1))::varchar, 'KEEP', null, repeat('0102', 12) from f",
    "mkv_blocks": f"with {_EV} select file_id, q * 0.25::double as seconds, (user_id % 3 + 1)::bigint as track, event_type = 'purchase' as keyframe, 'None' as lacing, count(*) as n, cast(sum(23 + event_id % 7) as bigint) as frame_bytes from ev group by 1, 2, 3, 4",
    "mkv_framerate": f"with {_EV} select file_id, n / ((last + 1)::double * 250000000 / 1e9) as framerate from f",
    "nal_units": f"with {_EV} select file_id, (user_id % 3 + 1)::bigint as track, 'Sei' as kind, count(*) as n, cast(sum(6) as bigint) as n_bytes from ev group by 1, 2 union all select file_id, (user_id % 3 + 1)::bigint, case when event_type = 'purchase' then 'IdrSlice' else 'Slice' end, count(*), cast(sum(9 + event_id % 7) as bigint) from ev group by 1, 2, 3",
    "avcc_config": f"with s as ({_SPS}) select partkey, cast(10 + s as int) as level, cast(s % 4 + 1 as int) as nal_length_size, cast(1 + k % 3 as int) as n_sps, 2 as n_pps from s",
    "sps_fields": f"with s as (select *, unnest(range(1 + k % 3)) as i from ({_SPS})) select partkey, cast(i as int) as seq, profile as profile_idc, cast(10 + s as int) as level, case when profile = 100 then 1 end::bigint as chroma_format, case when profile = 100 then 2 end::bigint as bit_depth_chroma_minus8, s::bigint as max_num_ref_frames, true as gaps_in_frame_num_value_allowed, (k % 120)::bigint as pic_width_in_mbs_minus1, (s % 60)::bigint as pic_height_in_map_units_minus1, s % 3 = 0 as direct_8x8_inference, case when s % 2 = 1 then s end::bigint as crop_right, case when s % 2 = 1 then 2 end::bigint as crop_bottom from s",
    "h264_profile": f"with s as ({_SPS}) select partkey, case profile when 66 then case when s % 2 = 1 then 'ConstrainedBaseline' else 'Baseline' end when 77 then 'Main' when 88 then 'Extended' else 'High' end as profile from s",
    "parse_errors": f"with {_IMG} select image_id, [ 'invalid_value', 'unexpected_end', 'unknown_chunk', 'invalid_value', 'invalid_value', null, 'missing_chunk', null ][image_id % 8 + 1] as error from ids",
}
