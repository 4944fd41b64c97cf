"""Problem 3: one quantity recorded in many units, sometimes named only in text.

Unit spellings are few next to rows, so the fuzzy work is done on distinct spellings: an inverted
index of character n-grams proposes reference spellings, a weighted edit distance verifies them,
and the resulting alias dictionary is joined to all rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reference spellings. A density counts dots per unit: dots per inch = value * factor.
# A pitch is the size of a dot: dots per inch = factor / value.
DENSITY, PITCH = "density", "pitch"
REFERENCE = [
    (DENSITY, 1.0, "inch, inches, in, zoll, polegada, polegadas, pouce, pulgada, per inch, per in, dpi, ppi, dots per inch, pixels per inch, pixel per inch, lines per inch, px/in, dots/in, pixel/inch"),
    (DENSITY, 2.54, "cm, centimeter, centimetre, centimeters, zentimeter, per cm, per centimeter, per centimetre, dpcm, ppcm, dots per cm, pixels per cm, pixel/cm, px/cm, dots/cm, lines per cm, pixels per centimetre"),
    (DENSITY, 25.4, "mm, millimeter, millimetre, per mm, per millimetre, per millimeter, dots/mm, px/mm, pixel/mm, dots per mm, pixels per mm, lines per mm, lines/mm"),
    (DENSITY, 0.0254, "m, meter, metre, meters, per meter, per metre, per m, px/m, pixels per metre, pixels per meter, dots per metre, dots/m, ppm, ppm (per meter), pixel/m"),
    (PITCH, 25400.0, "micron, micron pitch, microns, micron per pixel, um, um per pixel, um/px, um pitch, micrometre, micrometer, micrometre per pixel, mu per pixel"),
    (PITCH, 25.4, "mm per pixel, mm/px, mm pitch, millimetre per pixel"),
    (PITCH, 2.54, "cm per pixel, cm/px, cm pitch"),
    (PITCH, 1.0, "inch per pixel, in/px, inch pitch"),
]
#: Characters of an n-gram; spellings are padded, so that one letter has n-grams too.
N = 2
#: Largest weighted distance accepted, per character of the longer spelling. Short names must agree.
REACH = 0.25


def reference_units(spark: SparkSession) -> DataFrame:
    """The reference list as rows (name, kind, factor); fixed and small."""
    rows = [(squeeze(n), k, f) for k, f, names in REFERENCE for n in names.split(", ")]
    return spark.createDataFrame(sorted(set(rows)), "name string, kind string, factor double")


def squeeze(text: str) -> str:
    """The spelling as compared: lower case, micro sign as u, inch mark as word, single spaces."""
    text = text.strip().replace('"', " inch ").replace("″", " inch ").lower().replace("µ", "u").replace("μ", "u")
    return " ".join(text.replace("(", " ( ").replace(")", " ) ").replace(".", " ").split())


def squeezed(text: Column) -> Column:
    """``squeeze`` as a column expression."""
    x = F.lower(F.regexp_replace(F.trim(text), '["″]', " inch "))
    x = F.regexp_replace(F.translate(x, "µμ", "uu"), r"([()])", " $1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\.", " "), r"\s+", " "))


#: Weights of an edit. Letters that only mark number or language cost little, a slash or the word
#: "per" stand for each other, and letters that tell units apart cost in full.
CHEAP = {"s": 0.4, " ": 0.2, "e": 0.5}


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with cheap plural and spacing edits and cheap neighbour swaps."""
    w = lambda c: CHEAP.get(c, 1.0)
    prev2: list[float] = []
    prev = [0.0]
    for y in b:
        prev.append(prev[-1] + w(y))
    for i, x in enumerate(a):
        row = [prev[0] + w(x)]
        for j, y in enumerate(b):
            best = min(prev[j] + (0.0 if x == y else 1.0), prev[j + 1] + w(x), row[j] + w(y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, prev2[j - 1] + 0.6)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")


def _grams(name: Column) -> Column:
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (N - 1)), lambda i: F.substring(padded, i, F.lit(N))))


def unit_aliases(spellings: DataFrame, spelling: str, reference: DataFrame) -> DataFrame:
    """Alias dictionary (spelling, name, kind, factor, distance) for the distinct spellings.

    Spellings that no reference comes near to are left out; null and empty ones too. A tie goes to
    the nearest, then to the alphabetically first name. Two names of different units at the same
    distance give no alias, since the spelling doesn't tell them apart.
    """
    asked = (
        spellings.select(F.col(spelling).alias("spelling")).where("spelling is not null").distinct()
        .withColumn("asked", squeezed(F.col("spelling"))).where("asked <> ''")
    )
    names = asked.select("asked").distinct().withColumn("gram", F.explode(_grams(F.col("asked"))))
    index = reference.withColumn("gram", F.explode(_grams(F.col("name"))))
    near = (
        names.join(F.broadcast(index), "gram").groupBy("asked", "name", "kind", "factor").agg(F.count("*").alias("shared"))
        .where(F.col("shared") * 3 >= F.greatest(F.length("asked"), F.length("name")))
        .withColumn("distance", F.when(F.col("asked") == F.col("name"), F.lit(0.0)).otherwise(F.pandas_udf(_verify, "double")("asked", "name")))
        .where(F.col("distance") <= F.when(F.least(F.length("asked"), F.length("name")) < 4, 0.0).otherwise(REACH * F.greatest(F.length("asked"), F.length("name"))))
    )
    best = near.groupBy("asked").agg(F.min_by(F.struct("name", "kind", "factor", "distance"), F.struct("distance", "name")).alias("b"), F.collect_set(F.struct("distance", "kind", "factor")).alias("all"))
    rival = F.exists("all", lambda x: (x["distance"] == F.col("b.distance")) & ((x["kind"] != F.col("b.kind")) | (x["factor"] != F.col("b.factor"))))
    best = best.where(~rival).select("asked", "b.*")
    return asked.join(best, "asked").select("spelling", "name", "kind", "factor", "distance")


_NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def number_in(text: Column) -> Column:
    """The first number in a text, point or comma before the decimals; null if there is none."""
    found = F.regexp_extract(text, f"({_NUMBER})", 1)
    return F.when(found != "", F.translate(found, ",", ".").try_cast("double"))


def unit_in(text: Column) -> Column:
    """What stands before and after the first number of a text; empty if nothing does."""
    return F.trim(F.regexp_replace(text, f"^([^0-9]*){_NUMBER}", "$1"))


def dpi_of(value: Column, unit: Column) -> Column:
    """Dots per inch of a value in a unit (dots per inch of 1, or less than 0: a pitch of 1 in inches to
    the power -1), or null where value or unit are missing, zero or negative."""
    return F.when((value > 0) & (unit > 0), value * unit).when((value > 0) & (unit < 0), -unit / value)
