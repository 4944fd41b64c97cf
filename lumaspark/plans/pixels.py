"""Queries of the block, image and colour operators, over the embeddings as pixels.

Each embedding is an 8x8 block of samples; twelve of them in a row are one 16x16 RGB image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, tables
from ..operators import blocks as B
from ..operators import images as I
from ..session import table

QUALITIES = [10, 50, 75, 95]


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(block_id, px ARRAY<INT>)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("block_id"), B.samples(F.col("embedding")).alias("px"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """Complete 16x16 RGB images (image_id, width, height, channels, data ARRAY<INT>)."""
    part = blocks(spark, d).select(F.floor(F.col("block_id") / 12).alias("image_id"), (F.col("block_id") % 12).alias("n"), "px")
    whole = part.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("n", "px"))).alias("p")).where(F.size("p") == 12)
    return whole.select("image_id", F.lit(16).alias("width"), F.lit(16).alias("height"), F.lit(3).alias("channels"), F.flatten(F.col("p.px")).alias("data"))


def coefs(spark: SparkSession, d: str) -> DataFrame:
    """(block_id, coef ARRAY<INT>) row by row."""
    return blocks(spark, d).select("block_id", B.fdct(F.col("px")).alias("coef"))


def levels(spark: SparkSession, d: str, quality: int = 75) -> DataFrame:
    """(block_id, image_id, level ARRAY<INT>) in zig-zag order."""
    q = tables.scaled(tables.LUMA_QUANT, quality)
    return coefs(spark, d).select("block_id", F.floor(F.col("block_id") / 12).alias("image_id"), B.quantise(F.col("coef"), q).alias("level"))


def fdct_8x8(spark: SparkSession, d: str) -> DataFrame:
    """Forward DCT of every block."""
    c = coefs(spark, d).select("block_id", F.posexplode("coef").alias("k", "coef"))
    return c.select("block_id", (F.col("k") % 8).alias("u"), F.floor(F.col("k") / 8).cast("int").alias("v"), "coef")


def _exploded(spark: SparkSession, d: str) -> DataFrame:
    return coefs(spark, d).select("block_id", F.posexplode("coef").alias("k", "coef"))


def _xy(df: DataFrame) -> DataFrame:
    return df.select("block_id", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "px")


def idct_naive(spark: SparkSession, d: str) -> DataFrame:
    """Inverse DCT with inline cosines."""
    return _xy(B.idct_naive(_exploded(spark, d), "block_id"))


def idct_precomputed(spark: SparkSession, d: str) -> DataFrame:
    """Inverse DCT by the precomputed basis."""
    return _xy(B.idct_precomputed(_exploded(spark, d), "block_id"))


def idct_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """Inverse DCT by rows and columns, in place."""
    return _xy(coefs(spark, d).select("block_id", F.posexplode(B.idct_two_pass(F.col("coef"))).alias("i", "px")))


def quant_table_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Quantisation tables scaled to several qualities."""
    return tables.quant_df(spark, QUALITIES)


def quantize_zigzag(spark: SparkSession, d: str) -> DataFrame:
    """Quantised levels of every block in zig-zag order, at several qualities."""
    c = coefs(spark, d)
    each = F.array(*[F.struct(F.lit(q).alias("quality"), B.quantise(F.col("coef"), tables.scaled(tables.LUMA_QUANT, q)).alias("level")) for q in QUALITIES])
    rows = c.select("block_id", F.explode(each).alias("e")).select("block_id", "e.quality", F.posexplode("e.level").alias("k", "level"))
    return rows.select("block_id", "quality", "k", "level")


def dequantize_unzigzag(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients restored from the levels, row by row, at several qualities."""
    c = coefs(spark, d)
    one = lambda q, t: F.struct(F.lit(q).alias("quality"), B.dequantise(B.quantise(F.col("coef"), t), t).alias("coef"))
    each = F.array(*[one(q, tables.scaled(tables.LUMA_QUANT, q)) for q in QUALITIES])
    rows = c.select("block_id", F.explode(each).alias("e")).select("block_id", "e.quality", F.posexplode("e.coef").alias("pos", "coef"))
    return rows.select("block_id", "quality", "pos", "coef")


def dc_delta(spark: SparkSession, d: str) -> DataFrame:
    """DC differences within each image."""
    dc = levels(spark, d).select("image_id", "block_id", F.col("level")[0].alias("dc"))
    return B.dc_delta(dc, ["image_id"], "block_id", "dc").select("image_id", "block_id", "delta")


def dc_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """DC values summed up from their differences."""
    return B.dc_sum(dc_delta(spark, d), ["image_id"], "block_id", "delta").select("image_id", "block_id", "dc")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d).select("block_id", F.posexplode(B.ac_runs(F.col("level"))).alias("n", "e")).select("block_id", "n", "e.*")


def ac_run_length(spark: SparkSession, d: str) -> DataFrame:
    """Run-length entries of the non-zero AC levels."""
    return _runs(spark, d).where("value <> 0").select("block_id", "k", "run", "value")


def coef_bitcode(spark: SparkSession, d: str) -> DataFrame:
    """Size class and code bits of every level."""
    rows = levels(spark, d).select("block_id", F.posexplode("level").alias("k", "level"))
    return rows.select("block_id", "k", bits.magnitude_size(F.col("level")).alias("size"), bits.magnitude_code(F.col("level")).alias("code"))


def receive_extend(spark: SparkSession, d: str) -> DataFrame:
    """Levels read back from size class and code bits."""
    return coef_bitcode(spark, d).select("block_id", "k", bits.receive_extend(F.col("code").cast("long"), F.col("size")).alias("level"))


def px_table(spark: SparkSession, d: str) -> DataFrame:
    return I.pixels(images(spark, d))


def rgb_to_yuv420(spark: SparkSession, d: str) -> DataFrame:
    """Luma of every pixel and chroma of every 2x2 square, as rows (plane, x, y, v)."""
    y, c = I.to_yuv420(px_table(spark, d))
    out = y.select("image_id", F.lit("y").alias("plane"), "x", "y", F.col("luma").alias("v"))
    for p in ("cb", "cr"):
        out = out.unionByName(c.select("image_id", F.lit(p).alias("plane"), "x", "y", F.col(p).alias("v")))
    return out


def ycbcr_to_rgb(spark: SparkSession, d: str) -> DataFrame:
    """Pixels read as (y, cb, cr) and converted to RGB."""
    r, g, b = I.to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return px_table(spark, d).select("image_id", "x", "y", r.alias("red"), g.alias("green"), b.alias("blue"))


def yuv_pixel_read(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel of the 4:2:0 image with the chroma of its square."""
    y, c = I.to_yuv420(px_table(spark, d))
    c = c.withColumnRenamed("x", "cx").withColumnRenamed("y", "cy")
    at = (y["image_id"] == c["image_id"]) & (F.floor(y["x"] / 2) == c["cx"]) & (F.floor(y["y"] / 2) == c["cy"])
    return y.join(c.hint("shuffle_hash"), at).select(y["image_id"], "x", "y", "luma", "cb", "cr")


def mcu_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """RGB of every pixel restored from the 4:2:0 planes."""
    r, g, b = I.to_rgb(F.col("luma"), F.col("cb"), F.col("cr"))
    return yuv_pixel_read(spark, d).select("image_id", "x", "y", r.alias("red"), g.alias("green"), b.alias("blue"))


def image_crop(spark: SparkSession, d: str) -> DataFrame:
    """A view on a view: 8x8 from (3, 2) of the 12x12 view from (1, 1)."""
    return I.crop(I.crop(px_table(spark, d), 1, 1, 12, 12, F.lit(16), F.lit(16)), 3, 2, 8, 8, F.lit(12), F.lit(12))


def image_upscale(spark: SparkSession, d: str) -> DataFrame:
    """Images scaled up by 2 and 3."""
    return I.upscale(px_table(spark, d), 2, 3)


def image_downscale(spark: SparkSession, d: str) -> DataFrame:
    """Images scaled down by 3 and 2."""
    return I.downscale(px_table(spark, d), 3, 2, F.lit(16), F.lit(16))


def image_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every image as text."""
    im = images(spark, d).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return im.select("image_id", "y", F.array_join(I.row_at(F.col("data"), F.col("width"), F.col("height"), 3, F.col("y")).cast("array<string>"), " ").alias("samples"))


def planar_split(spark: SparkSession, d: str) -> DataFrame:
    """Planes of every image as text."""
    p = images(spark, d).select("image_id", I.planes(F.col("data")).alias("p"))
    return p.select("image_id", *[F.array_join(F.col(f"p.{c}").cast("array<string>"), " ").alias(c) for c in "rgb"])


def planar_merge(spark: SparkSession, d: str) -> DataFrame:
    """Interleaved data merged from the planes, as text."""
    p = images(spark, d).select("image_id", I.planes(F.col("data")).alias("p"))
    return p.select("image_id", F.array_join(I.interleaved(F.col("p.r"), F.col("p.g"), F.col("p.b")).cast("array<string>"), " ").alias("data"))


def pixel_read(spark: SparkSession, d: str) -> DataFrame:
    """One pixel of each image, at a place that lies outside for some."""
    at = [(F.col("image_id") % 18).cast("int"), (F.col("image_id") % 5).cast("int")]
    im = images(spark, d).withColumn("p", I.pixel_at(F.col("data"), F.col("width"), F.col("height"), 3, *at))
    return im.select("image_id", *[F.col("p")[k].alias(c) for k, c in enumerate("rgb")])


def pixel_write(spark: SparkSession, d: str) -> DataFrame:
    """Sum of all samples, weighted by place, after one pixel of each image was replaced."""
    at = [(F.col("image_id") % 18).cast("int"), (F.col("image_id") % 5).cast("int")]
    new = I.with_pixel(F.col("data"), F.col("width"), F.col("height"), 3, *at, F.array(F.lit(1), F.lit(2), F.lit(3)))
    rows = images(spark, d).select("image_id", F.posexplode(new).alias("i", "v"))
    return rows.groupBy("image_id").agg(F.sum(F.col("v") * (F.col("i") + 1)).cast("long").alias("weighted"))


def view_to_vec(spark: SparkSession, d: str) -> DataFrame:
    """The green samples of a view in row-major order, as text."""
    v = I.crop(px_table(spark, d), 4, 6, 5, 3)
    return v.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "g"))).alias("s")).select("image_id", F.array_join(F.col("s.g").cast("array<string>"), " ").alias("vec"))


def shape_check(spark: SparkSession, d: str) -> DataFrame:
    """Which of several shapes fit the data of each block of samples."""
    b = blocks(spark, d)
    shapes = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(c).alias("channels")) for w, h, c in ((8, 8, 1), (4, 4, 3), (16, 4, 1), (5, 5, 3))])
    rows = b.select("block_id", "px", F.explode(shapes).alias("s"))
    return rows.select("block_id", "s.width", "s.height", "s.channels", I.shape_ok(F.col("px"), F.col("s.width"), F.col("s.height"), F.col("s.channels")).alias("ok"))


QUERIES = {
    f.__name__: f
    for f in (
        fdct_8x8, idct_naive, idct_precomputed, idct_two_pass, quant_table_scaled, quantize_zigzag, dequantize_unzigzag, dc_delta, dc_reconstruct,
        ac_run_length, coef_bitcode, receive_extend, rgb_to_yuv420, ycbcr_to_rgb, yuv_pixel_read, mcu_reconstruct, image_crop, image_upscale,
        image_downscale, image_rows, planar_split, planar_merge, pixel_read, pixel_write, view_to_vec, shape_check,
    )
}

# ---------------------------------------------------------------- SQL

BLOCK = """block8 as (select vec_id as block_id, i, cast(greatest(0, least(255, round(128 + embedding[i + 1]::double * 256))) as int) as px
  from embeddings, (select unnest(range(64)) as i))"""
_COS = """ax as (select n, k, cos((2 * n + 1) * k * pi() / 16) * case when k = 0 then sqrt(0.5) else 1.0 end as w
  from (select unnest(range(8)) as n) a, (select unnest(range(8)) as k) b)"""
COEF = f"""{BLOCK}, {_COS},
  coef as (select block_id, u.k as u, v.k as v, cast(greatest(-32768, least(32767, round(round(0.25 * sum((px - 128) * u.w * v.w), 6)))) as int) as coef
  from block8 join ax u on u.n = i % 8 join ax v on v.n = i // 8 group by block_id, u.k, v.k)"""
_ZIG = """zig as (select row_number() over (order by s, case when s % 2 = 1 then r else c end) - 1 as k, r * 8 + c as pos
  from (select i // 8 as r, i % 8 as c, i // 8 + i % 8 as s from (select unnest(range(64)) as i)))"""


def _list(values: list[int]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


_QUANT = f"""base as (select 'luma' as comp, {_list(tables.LUMA_QUANT)} as t union all select 'chroma', {_list(tables.CHROMA_QUANT)}),
  quant as (select quality, comp, k, greatest(1, least(255, (t[k + 1] * case when quality < 50 then 5000 // quality else 200 - 2 * quality end + 50) // 100)) as v
  from base, (select unnest({_list(QUALITIES)}) as quality) q, (select unnest(range(64)) as k) i)"""
_LEVEL = f"""{COEF}, {_ZIG}, {_QUANT},
  level as (select block_id, block_id // 12 as image_id, quality, cast(z.k as int) as k, pos, cast(trunc(coef / q.v) as int) as level, q.v
  from coef join zig z on z.pos = v * 8 + u join quant q on q.k = z.k and q.comp = 'luma')"""
IMAGE = f"""{BLOCK}, samples as (select block_id // 12 as image_id, (block_id % 12) * 64 + i as n, px from block8
  where block_id // 12 in (select vec_id // 12 from embeddings group by 1 having count(*) = 12)),
  rgb as (select image_id, cast(n // 3 % 16 as int) as x, cast(n // 48 as int) as y, max(case when n % 3 = 0 then px end) as r, max(case when n % 3 = 1 then px end) as g, max(case when n % 3 = 2 then px end) as b
  from samples group by 1, 2, 3)"""
_Y = "cast(trunc(0.299::float * r::float + 0.587::float * g::float + 0.114::float * b::float) as int)"
_YUV = f"""{IMAGE}, luma as (select image_id, x, y, {_Y} as luma from rgb),
  quad as (select image_id, x // 2 as x, y // 2 as y, sum(r)::float / 4::float as r, sum(g)::float / 4::float as g, sum(b)::float / 4::float as b from rgb group by 1, 2, 3),
  chroma as (select image_id, x, y, cast(trunc((-0.168736)::float * r - 0.331264::float * g + 0.5::float * b + 128::float) as int) as cb,
  cast(trunc(0.5::float * r - 0.418688::float * g - 0.081312::float * b + 128::float) as int) as cr from quad)"""


def _rgb_sql(y: str, cb: str, cr: str) -> str:
    fy, fb, fr = f"{y}::float", f"({cb}::float - 128::float)", f"({cr}::float - 128::float)"
    done = lambda e: f"cast(greatest(0, least(255, round(({e})::double))) as int)"
    return f"{done(f'{fy} + 1.402::float * {fr}')} as red, {done(f'{fy} - 0.344136::float * {fb} - 0.714136::float * {fr}')} as green, {done(f'{fy} + 1.772::float * {fb}')} as blue"


_IDCT = f"""with {COEF} select block_id, cast(x.n as int) as x, cast(y.n as int) as y,
  cast(greatest(0, least(255, round(round(0.25 * sum(coef * x.w * y.w), 6)) + 128)) as int) as px
  from coef join ax x on x.k = u join ax y on y.k = v group by block_id, x.n, y.n"""
_SIZE = "case when level = 0 then 0 else length(bin(abs(level))) end"

SQL = {
    "fdct_8x8": f"with {COEF} select block_id, cast(u as int) as u, cast(v as int) as v, coef from coef",
    "idct_naive": _IDCT,
    "idct_precomputed": _IDCT,
    "idct_two_pass": _IDCT,
    "quant_table_scaled": f"with {_QUANT} select quality, comp, cast(k as int) as k, cast(v as int) as v from quant",
    "quantize_zigzag": f"with {_LEVEL} select block_id, quality, k, level from level",
    "dequantize_unzigzag": f"with {_LEVEL} select block_id, quality, cast(pos as int) as pos, cast(level * v as int) as coef from level",
    "dc_delta": f"with {_LEVEL} select image_id, block_id, cast(level - lag(level, 1, 0) over (partition by image_id order by block_id) as int) as delta from level where k = 0 and quality = 75",
    "dc_reconstruct": f"with {_LEVEL} select image_id, block_id, level as dc from level where k = 0 and quality = 75",
    "ac_run_length": f"with {_LEVEL} select block_id, k, cast((k - coalesce(lag(k) over (partition by block_id order by k), 0) - 1) % 16 as int) as run, level as value from level where k > 0 and level <> 0 and quality = 75",
    "coef_bitcode": f"with {_LEVEL} select block_id, k, cast({_SIZE} as int) as size, cast(case when level >= 0 then level else level - 1 + (1 << ({_SIZE})) end as int) as code from level where quality = 75",
    "receive_extend": f"with {_LEVEL} select block_id, k, level from level where quality = 75",
    "rgb_to_yuv420": f"with {_YUV} select image_id, 'y' as plane, x, y, luma as v from luma union all select image_id, 'cb', x, y, cb from chroma union all select image_id, 'cr', x, y, cr from chroma",
    "ycbcr_to_rgb": f"with {IMAGE} select image_id, x, y, {_rgb_sql('r', 'g', 'b')} from rgb",
    "yuv_pixel_read": f"with {_YUV} select l.image_id, l.x, l.y, luma, cb, cr from luma l join chroma c on l.image_id = c.image_id and l.x // 2 = c.x and l.y // 2 = c.y",
    "mcu_reconstruct": f"with {_YUV} select l.image_id, l.x, l.y, {_rgb_sql('luma', 'cb', 'cr')} from luma l join chroma c on l.image_id = c.image_id and l.x // 2 = c.x and l.y // 2 = c.y",
    "image_crop": f"with {IMAGE} select image_id, x - 4 as x, y - 3 as y, r, g, b from rgb where x between 4 and 11 and y between 3 and 10",
    "image_upscale": f"with {IMAGE} select image_id, cast(nx as int) as x, cast(ny as int) as y, r, g, b from (select unnest(range(32)) as nx) a, (select unnest(range(48)) as ny) c join rgb on x = nx // 2 and y = ny // 3",
    "image_downscale": f"with {IMAGE} select image_id, cast(nx as int) as x, cast(ny as int) as y, r, g, b from (select unnest(range(5)) as nx) a, (select unnest(range(8)) as ny) c join rgb on x = nx * 3 and y = ny * 2",
    "image_rows": f"with {IMAGE} select image_id, cast(n // 48 as int) as y, string_agg(px::varchar, ' ' order by n) as samples from samples group by 1, 2",
    "planar_split": f"with {IMAGE} select image_id, string_agg(r::varchar, ' ' order by y, x) as r, string_agg(g::varchar, ' ' order by y, x) as g, string_agg(b::varchar, ' ' order by y, x) as b from rgb group by 1",
    "planar_merge": f"with {IMAGE} select image_id, string_agg(px::varchar, ' ' order by n) as data from samples group by 1",
    "pixel_read": f"with {IMAGE} select i.image_id, r, g, b from (select distinct image_id from samples) i left join rgb on rgb.image_id = i.image_id and x = i.image_id % 18 and y = i.image_id % 5",
    "pixel_write": f"with {IMAGE} select image_id, cast(sum((n + 1) * case when n // 3 % 16 = image_id % 18 and n // 48 = image_id % 5 then n % 3 + 1 else px end) as bigint) as weighted from samples group by 1",
    "view_to_vec": f"with {IMAGE} select image_id, string_agg(g::varchar, ' ' order by y, x) as vec from rgb where x between 4 and 8 and y between 6 and 8 group by 1",
    "shape_check": "select vec_id as block_id, width, height, channels, len(embedding) = width * height * channels as ok from embeddings, (values (8, 8, 1), (4, 4, 3), (16, 4, 1), (5, 5, 3)) s(width, height, channels)",
}
