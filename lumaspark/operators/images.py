"""Images: the container, views, scaling, planes and colour.

An image is a row (image_id, width, height, channels, data) with data an ARRAY<INT> in row-major,
interleaved order, or the exploded pixel table (image_id, x, y, ...). Views and scalings of the
pixel table are filters and arithmetic on x and y, which Catalyst folds into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import clamp


def shape_ok(data: Column, width: Column, height: Column, channels: Column) -> Column:
    """Whether the data have the size that the shape asks for; null data never have."""
    return F.coalesce(F.size(data) == width * height * channels, F.lit(False))


def pixel_at(data: Column, width: Column, height: Column, channels: int, x: Column, y: Column) -> Column:
    """The channels of one pixel as an array, or null outside the image."""
    return F.when((x >= 0) & (y >= 0) & (x < width) & (y < height), F.slice(data, (y * width + x) * channels + 1, F.lit(channels)))


def row_at(data: Column, width: Column, height: Column, channels: int, y: Column) -> Column:
    """All samples of one row, or null outside the image."""
    return F.when((y >= 0) & (y < height), F.slice(data, y * width * channels + 1, width * channels))


def with_pixel(data: Column, width: Column, height: Column, channels: int, x: Column, y: Column, value: Column) -> Column:
    """The data with one pixel replaced; unchanged where the pixel lies outside."""
    at = (y * width + x) * channels
    inside = (x >= 0) & (y >= 0) & (x < width) & (y < height)
    new = F.concat(F.slice(data, F.lit(1), at), value, F.slice(data, at + channels + 1, F.size(data)))
    return F.when(inside, new).otherwise(data)


def pixels(images: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b) of RGB images; the image row is exploded where it lies."""
    rgb = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda p: F.struct((p % F.col("width")).alias("x"), F.floor(p / F.col("width")).cast("int").alias("y"), F.col("data")[p * 3].alias("r"), F.col("data")[p * 3 + 1].alias("g"), F.col("data")[p * 3 + 2].alias("b")))
    return images.select("image_id", F.explode(rgb).alias("p")).select("image_id", "p.*")


def crop(px: DataFrame, x: int, y: int, width: int, height: int, image_width: Column | None = None, image_height: Column | None = None) -> DataFrame:
    """A view on a pixel table; with the image's size given, views that exceed it are empty."""
    out = px.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    if image_width is not None and image_height is not None:
        out = out.where((F.lit(x + width) <= image_width) & (F.lit(y + height) <= image_height))
    return out.withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def upscale(px: DataFrame, fx: int, fy: int) -> DataFrame:
    """Nearest-neighbour upscaling: each pixel becomes fx by fy pixels."""
    out = px.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(fx - 1)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(fy - 1))))
    return out.withColumn("x", F.col("x") * fx + F.col("dx")).withColumn("y", F.col("y") * fy + F.col("dy")).drop("dx", "dy")


def downscale(px: DataFrame, fx: int, fy: int, width: Column, height: Column) -> DataFrame:
    """Every fx-th and fy-th pixel; a last column or row that isn't whole is left out."""
    keep = (F.col("x") % fx == 0) & (F.col("y") % fy == 0) & (F.col("x") / fx < F.floor(width / fx)) & (F.col("y") / fy < F.floor(height / fy))
    return px.where(keep).withColumn("x", (F.col("x") / fx).cast("int")).withColumn("y", (F.col("y") / fy).cast("int"))


def planes(data: Column) -> Column:
    """struct(r, g, b) of arrays from interleaved data."""
    one = lambda c: F.transform(F.sequence(F.lit(0), (F.size(data) / 3).cast("int") - 1), lambda p: data[p * 3 + c])
    return F.struct(one(0).alias("r"), one(1).alias("g"), one(2).alias("b"))


def interleaved(r: Column, g: Column, b: Column) -> Column:
    """Interleaved data from three planes of equal length; null if their lengths differ."""
    zipped = F.flatten(F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: F.array(p["r"], p["g"], p["b"])))
    return F.when((F.size(r) == F.size(g)) & (F.size(g) == F.size(b)), zipped)


def _f(x: Column | float) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("float")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Luma in single precision, cut to an integer."""
    return (_f(0.299) * _f(r) + _f(0.587) * _f(g) + _f(0.114) * _f(b)).cast("int")


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """(cb, cr) of a mean colour in single precision, cut to integers."""
    cb = (_f(-0.168736) * r - _f(0.331264) * g + _f(0.5) * b + _f(128.0)).cast("int")
    cr = (_f(0.5) * r - _f(0.418688) * g - _f(0.081312) * b + _f(128.0)).cast("int")
    return cb, cr


def to_yuv420(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(luma rows, chroma rows) of a pixel table; chroma is the mean of each whole 2x2 square."""
    y = px.select("image_id", "x", "y", luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))
    quads = px.groupBy("image_id", F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(*[F.sum(c).alias(c) for c in "rgb"], F.count("*").alias("n")).where("n = 4")
    mean = [_f(F.col(c)) / _f(4.0) for c in "rgb"]
    cb, cr = chroma(*mean)
    return y, quads.select("image_id", "x", "y", cb.alias("cb"), cr.alias("cr"))


def to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """(r, g, b) in single precision, rounded half away from zero, from 0 to 255."""
    fy, fb, fr = _f(y), _f(cb) - _f(128.0), _f(cr) - _f(128.0)
    done = lambda v: clamp(F.round(v.cast("double"), 0).cast("int"), 0, 255)
    return done(fy + _f(1.402) * fr), done(fy - _f(0.344136) * fb - _f(0.714136) * fr), done(fy + _f(1.772) * fb)
