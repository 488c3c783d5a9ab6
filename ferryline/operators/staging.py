"""Results written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster,
    whose machines could not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ferryline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this application's written tables lie."""
    return f"{shared_folder(spark)}/ferryline/{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Remove all tables that this application has written so far. Frames that read them no longer work: write results out first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` from a table in the shared folder: lineage ends there, and what was computed stays as it is."""
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Appended:
    """A table that rounds add rows to: what is there stays as it is, each round writes its own rows."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema = like.sparkSession, like.schema
        self.path, self.parts = f"{run_folder(self.spark)}/rounds-{uuid.uuid4().hex}", 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Write ``rows`` and return them from there."""
        path, self.parts = f"{self.path}/round={self.parts}", self.parts + 1
        rows.select(*self.schema.names).write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        """All rows so far, as one scan."""
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={k}" for k in range(self.parts)])
