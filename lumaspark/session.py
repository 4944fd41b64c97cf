"""Session helpers shared by tests, bench and the entry module."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from functools import cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "lumaspark") -> SparkSession:
    """A local session with the settings the library expects (UTC, Arrow, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the parquet tables of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan whose rows are dealt out to all cores if its files give fewer partitions than that.

    For operators that spend far more on a row than a shuffle does; large tables stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@cache
def _own_folder() -> str:
    """A checkpoint folder for a local session, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="lumaspark-checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows computed once, for use in several places.

    They are written to the shared checkpoint folder that the session has or names in
    ``spark.checkpoint.dir``. Where it names none, a local session gets a folder of its own; on a
    cluster, whose machines don't share folders, the rows are kept by the executors and those of a
    lost one are computed again.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        sc.setCheckpointDir(named or _own_folder())
    return df.checkpoint(eager=True)


#: Rows of a side that is broadcast, at most.
BROADCAST_ROWS = 50_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows computed once and marked for broadcast, or the plan as it is if they are more than ``most``."""
    rows = df.limit(most + 1).repartition(1).collect()  # all partitions at once, not a few at a time
    return df if len(rows) > most else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
