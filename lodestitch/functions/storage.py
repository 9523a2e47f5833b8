"""Copies of intermediate tables that outlive executors, and small files beside them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it; a local one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lodestitch-checkpoint-")
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names; a local folder only where it is unset."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


class Folder:
    """A folder of any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, sorted; nothing where there is none."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def write(self, name: str, text: str) -> None:
        """A small file; it appears whole or, if another run made it first, not at all."""
        part = self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(name) or not self._fs.rename(part, self._at(name)):
            self._fs.delete(part, False)

    def text(self, name: str) -> str:
        found = self._fs.open(self._at(name))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


class Scratch:
    """Tables of one run in the shared folder; all are deleted at its end, superseded ones as soon as they are dropped.

    Unlike a checkpoint, a written table keeps its statistics, so Spark knows how large it is.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.folder = Folder(spark, f"{shared_dir(spark)}/lodestitch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
        self._names: dict[int, str] = {}
        self._kept = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        name, self._kept = f"{self._kept}-{name}", self._kept + 1
        df.write.parquet(f"{self.folder.path}/{name}")
        out = df.sparkSession.read.schema(df.schema).parquet(f"{self.folder.path}/{name}")
        self._names[id(out)] = name
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if id(df) in self._names:
                self.folder.delete(self._names[id(df)])
