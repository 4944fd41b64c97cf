"""Queries of problems 3 and 4 over the media tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, sized, table
from .moments import normalise_moments
from .units import DENSITY, dpi_of, number_in, reference_units, unit_aliases, unit_in

DATE_TAGS = ("DateTime", "DateTimeOriginal", "DateTimeDigitized")
#: Rows of one moment that meet all others of it in one task.
PAIR_PART = 2_000


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, jfif_dpi, exif_dpi, bmp_dpi, least): an image's horizontal resolution in dpi as each of
    the three states it, and the least of all statements. Of several statements of one kind (tags of two
    directories) the largest is given; a number without a unit of its own is taken in every unit stated.

    All three tables meet in one aggregation by image, so there is one shuffle, of a few numbers a
    row and after partial aggregation; a row delivered again changes nothing. A statement that
    states nothing is null.
    """
    exif = table(spark, sf_dir, "exif_tag").where(F.col("tag_name").isin("XResolution", "ResolutionUnit")).where("image_id is not null")
    is_x = F.col("tag_name") == "XResolution"
    named = F.when(is_x, unit_in(F.col("text"))).otherwise(F.trim("text"))
    texts = exif.where("text is not null").select(named.alias("spelling"))
    # a unit as one number: dots per inch of a density of 1, or less than 0 for a pitch
    signed = F.when(F.col("kind") == DENSITY, F.col("factor")).otherwise(-F.col("factor"))
    alias = sized(unit_aliases(texts, "spelling", reference_units(spark)).select(F.col("spelling").alias("key"), signed.alias("named_unit")))
    # rows without a spelling get keys of their own, so that they don't meet in one task
    key = F.coalesce(named, F.concat(F.lit("\0"), F.col("image_id").cast("string")))
    tags = exif.withColumn("key", key).join(alias, "key", "left")
    ratio = F.when(F.col("ints")[1] > 0, F.col("ints")[0].cast("double") / F.col("ints")[1].cast("double"))
    x = F.when(is_x, F.when(F.col("text").isNotNull(), number_in(F.col("text"))).otherwise(ratio))
    code = F.col("ints")[0].cast("int")
    bare = is_x & ((F.col("text").isNull()) | (named == ""))
    from_exif = tags.select(
        "image_id",
        dpi_of(F.when(is_x & ~bare, x), F.col("named_unit")).alias("own"),
        F.when(bare & (x > 0), x).alias("x"),
        F.when(~is_x, F.when(F.col("text").isNotNull(), F.col("named_unit")).when(code == 2, 1.0).when(code == 3, 2.54)).alias("unit"),
    )
    jfif = table(spark, sf_dir, "raw_jpeg").select("image_id", (F.col("jfif.x_density") * F.when(F.col("jfif.density_unit") == 1, 1.0).when(F.col("jfif.density_unit") == 2, 2.54)).alias("jfif"))
    origin = sized(table(spark, sf_dir, "origin").groupBy("origin").agg(F.first("bmp_res_unit").alias("unit")))
    per = F.when(F.col("unit") == "m", 0.0254).when(F.col("unit") == "cm", 2.54).when(F.col("unit") == "inch", 1.0)
    bmp = table(spark, sf_dir, "dib_header").join(origin, "origin").select("image_id", (F.col("resolution_horizontal") * per).alias("bmp"))
    names = ("own", "x", "unit", "jfif", "bmp")
    every = from_exif.unionByName(jfif.where("jfif > 0"), allowMissingColumns=True).unionByName(bmp.where("bmp > 0"), allowMissingColumns=True)
    one = every.where("image_id is not null").groupBy("image_id").agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in (("most", F.max), ("least", F.min))])
    exif_dpi = [F.col("own_most"), F.col("own_least"), *[dpi_of(F.col(f"x_{a}"), F.col(f"unit_{b}")) for a in ("most", "least") for b in ("most", "least")]]
    return one.select(
        "image_id",
        F.col("jfif_most").alias("jfif_dpi"),
        F.greatest(*exif_dpi).alias("exif_dpi"),
        F.col("bmp_most").alias("bmp_dpi"),
        F.least("jfif_least", "bmp_least", *exif_dpi).alias("least"),
    )


def p3_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image that states a horizontal resolution, all statements in dots per inch."""
    return statements(spark, sf_dir).where("least is not null").drop("least")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose statements of horizontal resolution differ by more than 5 percent."""
    return statements(spark, sf_dir).where(F.greatest("jfif_dpi", "exif_dpi", "bmp_dpi") > 1.05 * F.col("least")).select("image_id")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date tags with the struct ``moment``."""
    rows = table(spark, sf_dir, "exif_tag").where(F.col("tag_name").isin(*DATE_TAGS)).select("exif_row_id", "image_id", "tag_name", "origin", "text")
    return normalise_moments(rows, "text", "origin", table(spark, sf_dir, "origin"))


def p4_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date tag once, with its UTC moment or the reason why it has none."""
    utc = F.date_format(F.timestamp_seconds("moment.s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return moments(spark, sf_dir).groupBy("exif_row_id").agg(F.first(utc).alias("utc"), F.first("moment.format").alias("format"), F.first("moment.state").alias("state"))


MOMENT_KEY = ["tag_name", "body_serial", "s"]


def _of_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag_name, body_serial, s, exif_row_id, image_id) of all dated tags of known cameras, once each and
    computed once."""
    cameras = table(spark, sf_dir, "raw_jpeg").where("body_serial is not null").select("image_id", "body_serial").distinct()
    dated = moments(spark, sf_dir).where("moment.s is not null").select("exif_row_id", "image_id", "tag_name", F.col("moment.s").alias("s"))
    return checkpointed(dated.join(cameras, "image_id").select(*MOMENT_KEY, "exif_row_id", "image_id").distinct())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of date tags of one camera and one tag name, in different images, of the same second.

    Only rows of moments that occur twice meet. The pairs of a hot moment (a stuck clock) are made in
    parts: its rows are dealt out, and each part meets a copy of all of them.
    """
    rows = _of_cameras(spark, sf_dir)
    several = rows.join(rows.groupBy(*MOMENT_KEY).agg(F.count("*").alias("n")).where("n > 1"), MOMENT_KEY).withColumn("parts", F.ceil(F.col("n") / PAIR_PART).cast("int"))
    a = several.select(*MOMENT_KEY, F.pmod(F.xxhash64("exif_row_id"), F.col("parts").cast("long")).cast("int").alias("part"), F.col("exif_row_id").alias("exif_row_a"), F.col("image_id").alias("image_a"))
    b = several.select(*MOMENT_KEY, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("exif_row_id").alias("exif_row_b"), F.col("image_id").alias("image_b"))
    pairs = a.join(b, [*MOMENT_KEY, "part"])
    return pairs.where((F.col("exif_row_a") < F.col("exif_row_b")) & (F.col("image_a") != F.col("image_b"))).select("exif_row_a", "exif_row_b").distinct()


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date tag that shares its moment: the class (its least row) and the number of rows of the class
    in other images, that is, its pairs in ``p4_found``, without making them."""
    rows = _of_cameras(spark, sf_dir)
    whole = rows.groupBy(*MOMENT_KEY).agg(F.count("*").alias("n"), F.min("exif_row_id").alias("class_id")).where("n > 1")
    image = rows.groupBy(*MOMENT_KEY, "image_id").agg(F.count("*").alias("own"))
    links = rows.join(whole, MOMENT_KEY).join(image, [*MOMENT_KEY, "image_id"])
    return links.select("exif_row_id", "class_id", (F.col("n") - F.col("own")).alias("n_links")).where("n_links > 0")


QUERIES = {"p3_found": p3_found, "p3_dpi": p3_dpi, "p4_found": p4_found, "p4_moments": p4_moments, "p4_classes": p4_classes}

_UNIT_SQL = """
  case when u in ('inch','inches','in','"','zoll','polegada','per inch','dpi','ppi','dots per inch','pixels per inch','px/in') then 1.0
       when u in ('cm','centimeter','centimetre','per cm','dpcm','dots per cm','pixel/cm','px/cm') then 2.54
       when u in ('mm','millimetre','per mm','dots/mm','px/mm','lines per mm') then 25.4
       when u in ('m','metre','per meter','px/m','pixels per metre','ppm (per meter)') then 0.0254 end"""
_P3_SQL = f"""
with e as (select distinct image_id, tag_name, fmt, ints, trim(text) as t from exif_tag where tag_name in ('XResolution','ResolutionUnit')),
x as (select image_id, case when t is null then ints[1]::double / nullif(ints[2], 0)::double else replace(regexp_extract(t, '^([0-9]+([.,][0-9]+)?)', 1), ',', '.')::double end as v,
      lower(trim(regexp_replace(coalesce(t, ''), '^[0-9]+([.,][0-9]+)?', ''))) as u from e where tag_name = 'XResolution'),
xo as (select image_id, v, u, u like '%micron%' or u like 'um %' or u like '%m/px' as pitch, {_UNIT_SQL} as f from x),
r as (select image_id, lower(t) as u, case when t is null then case ints[1] when 2 then 1.0 when 3 then 2.54 end end as n from e where tag_name = 'ResolutionUnit'),
rf as (select image_id, coalesce(n, {_UNIT_SQL}) as f from r),
exif as (select xo.image_id, case when xo.pitch then case when v > 0 then 25400.0 / v end when xo.u <> '' then case when v > 0 then v * xo.f end when v > 0 then v * rf.f end as dpi from xo left join rf using (image_id)),
jf as (select distinct image_id, case jfif.density_unit when 1 then jfif.x_density * 1.0 when 2 then jfif.x_density * 2.54 end as dpi from raw_jpeg where jfif.x_density > 0),
bm as (select distinct image_id, resolution_horizontal * case bmp_res_unit when 'm' then 0.0254 when 'cm' then 2.54 else 1.0 end as dpi from dib_header join origin using (origin) where resolution_horizontal > 0),
s as (select image_id, max(case when k = 1 then dpi end)::double as jfif_dpi, max(case when k = 2 then dpi end)::double as exif_dpi, max(case when k = 3 then dpi end)::double as bmp_dpi
      from (select 1 as k, * from jf union all select 2, * from exif union all select 3, * from bm) group by image_id)
"""
SQL = {
    "p3_found": _P3_SQL + "select image_id from s where greatest(jfif_dpi, exif_dpi, bmp_dpi) > 1.05 * least(jfif_dpi, exif_dpi, bmp_dpi)",
}
