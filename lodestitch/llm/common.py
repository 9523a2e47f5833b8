"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = getattr(shared_dir, "own", "") or "file://" + tempfile.mkdtemp(prefix="lodestitch-")
        shared_dir.own = found
    return found.rstrip("/")


#: Where this Spark has it, the shuffle files of a job go as soon as its output is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage with a copy that outlives executors, so later steps neither recompute ``df`` nor
    depend on the disks of the executors that made it; the shuffles behind it are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestitch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(staged: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``staged``, marked for broadcast if it has at most ``most`` rows; the caller keeps them narrow."""
    return F.broadcast(staged) if staged.limit(most + 1).count() <= most else staged


def unit31(h: Column) -> Column:
    """The upper 31 bits of a 64-bit hash as a long in [0, 2**31): monotone in the unsigned hash."""
    return F.shiftrightunsigned(h, 33)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
