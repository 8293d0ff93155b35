"""Where intermediate results and state live: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    Where neither is set, a session in local mode (tests) gets a temporary folder, which
    goes when the process ends. On a cluster that is an error: executors would write to
    their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at and not (_MADE and at.startswith(_MADE[0])):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _MADE:
        at = tempfile.mkdtemp(prefix="factorloom-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        _MADE.append(f"file://{at}")
    spark.sparkContext.setCheckpointDir(_MADE[0])
    return _MADE[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back, in folders by a column if one is named.

    This cuts lineage and survives the loss of executors, and later steps keep
    column and partition pruning.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stored`` made and that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class VersionedState:
    """Frames by version: version n is written from version n - 1, and written anew if its batch runs again."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: int = 3):
        self.spark, self.path, self.keep = spark, path or scratch(spark, "state"), keep

    def at(self, version: int, name: str = "state") -> str:
        return f"{self.path}/{name}/v={version}"

    def newest(self, version: int, name: str = "state") -> int | None:
        """The newest version that was written whole, up to this one."""
        tried = range(version, max(-2, version - self.keep - 1), -1)
        return next((v for v in tried if exists(self.spark, f"{self.at(v, name)}/_SUCCESS")), None)

    def read(self, version: int, name: str = "state") -> DataFrame | None:
        found = self.newest(version, name)
        return None if found is None else self.spark.read.parquet(self.at(found, name))

    def write(self, df: DataFrame, version: int, name: str = "state") -> DataFrame:
        """Write a version and drop the one that no restart can need any more."""
        df.write.mode("overwrite").parquet(self.at(version, name))
        delete(self.spark, self.at(version - self.keep, name))
        return self.spark.read.schema(df.schema).parquet(self.at(version, name))


class History:
    """Append-only table of all batches; a batch that runs again replaces its own part."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "history")

    def append(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def upto(self, batch: int) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.where(df["batch"] <= batch).drop("batch")


def write_factors(df: DataFrame, path: str) -> None:
    """Sink of final vectors."""
    df.write.mode("overwrite").parquet(path)
