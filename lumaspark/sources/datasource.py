"""Files as tables and tables as files: sources, an image sink and conversion of folders."""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..operators import media as M
from . import convert
from .errors import MediaError

READABLE = ("jpeg", "jpg", "png", "pnm", "ppm")
WRITABLE = ("jpeg", "jpg", "pbm", "pgm", "ppm", "pnm")


def extension(path: Column) -> Column:
    """Extension of a path in lower case, or an empty text."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder; ``content`` isn't read
    where it isn't selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _ImageWriter(DataSourceWriter):
    """One file per row (name, width, height, data); names may have folders, rows without data give
    none. Files of a task are written under another name and renamed on commit, so a task that is run
    again or a job that fails leaves nothing behind. Two rows of one name make the job fail."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.ext = options.get("extension", "ppm").lower()
        if self.ext not in WRITABLE:
            raise MediaError("invalid_format", f"can't write .{self.ext}")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        files = []
        for row in rows:
            if row["data"] is None:
                continue
            name = str(row["name"])
            if name.startswith("/") or ".." in name.split("/"):
                raise MediaError("invalid_value", f"{name} isn't below the target")
            final = os.path.join(self.path, os.path.normpath(f"{name}.{self.ext}"))
            part = os.path.join(self.path, f"{uuid.uuid4().hex}.part")
            with open(part, "wb") as f:
                f.write(convert.encode(final, row["width"], row["height"], bytes(row["data"])))
            files.append((part, final))
        return _Written(files)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        twice = sorted(f for f, n in Counter(final for _, final in files).items() if n > 1)
        if twice:
            raise MediaError("invalid_value", f"{len(twice)} names stand for several images: {', '.join(twice[:5])}")
        for part, final in files:
            os.makedirs(os.path.dirname(final), exist_ok=True)
            os.replace(part, final)

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.files if m else ():
                if os.path.exists(part):
                    os.remove(part)


class ImageFiles(DataSource):
    """Sink ``image_files``: options path and extension (jpg, ppm, pgm, pbm)."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "name string, width int, height int, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ImageWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the sink known to a session."""
    spark.dataSource.register(ImageFiles)


def decoded(files: DataFrame) -> DataFrame:
    """(path, name, width, height, data, error) of image files; names lose their extension."""
    rows = files.where(extension(F.col("path")).isin(*READABLE)).withColumn("im", M.decode_file(F.col("path"), F.col("content")))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]+$", "")
    return rows.select("path", name.alias("name"), "im.value.width", "im.value.height", "im.value.data", F.col("im.error").alias("error"))


def below(spark: SparkSession, source: str, path: Column) -> Column:
    """A file's path below ``source`` (below its fixed folders, if it is a pattern) without extension."""
    fixed = re.split(r"/[^/]*[*?\[{]", source, maxsplit=1)[0] or "/"
    root = spark._jvm.org.apache.hadoop.fs.Path(fixed)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    rest = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(F.regexp_extract(path, r"([^/]+)$", 1))
    return F.regexp_replace(rest, r"\.[^./]+$", "")


def convert_files(spark: SparkSession, source: str, target: str, to: str) -> DataFrame:
    """Convert every image below ``source`` into a file of the extension ``to`` in ``target``.

    Folders below ``source`` are kept. Two images that differ in their extension only make the
    conversion fail before any file gets its name. Returns (path, error) of the images that can't be
    decoded; they are read again when that is asked for.
    """
    register(spark)
    rows = decoded(media_files(spark, source))
    named = rows.select(below(spark, source, F.col("path")).alias("name"), "width", "height", "data")
    named.write.format("image_files").mode("append").option("extension", to).save(target)
    return rows.where("error is not null").select("path", "error")
