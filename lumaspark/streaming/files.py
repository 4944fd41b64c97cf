"""Folders of media files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import media as M

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: What each format's parser gives, by extension.
PARSERS = {"jpg": M.jpeg_segments, "jpeg": M.jpeg_segments, "png": M.png_chunks, "mkv": M.ebml_elements, "webm": M.ebml_elements}


def new_files(spark: SparkSession, folder: str, glob: str = "*", most: int = 1000) -> DataFrame:
    """Files as they arrive in a folder, at most ``most`` in a batch."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).load(folder)


def parts(files: DataFrame, kind: str) -> DataFrame:
    """Rows of the parser of a format for each file, with the file's error if it can't be read."""
    parsed = files.withColumn("p", PARSERS[kind](F.col("content")))
    return parsed.select("path", "modificationTime", F.col("p.error").alias("error"), F.explode_outer("p.value").alias("part")).select("path", "modificationTime", "error", "part.*")


def counts(files: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by arrival time; files later than ``late`` are left out of closed windows."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
