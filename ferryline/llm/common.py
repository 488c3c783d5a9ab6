"""What the training-data operators share: staging, table reading, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: anything but the six ASCII white-space characters.
#: ``bytes.split()`` without arguments cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ferryline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Rows of an Arrow batch: texts are long, and a task and its Python process hold several batches at once.
BATCH = 250


def small_batches(spark: SparkSession) -> None:
    """Lets tasks hand texts to Python in batches of at most ``BATCH`` rows, unless the session asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and survives lost executors."""
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/ferryline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key that more than one in so many rows have is hot.
HOT = 1000


def met_by_count(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``facts``, whose column n says how many rows have its key.

    A key of over a ``HOT``-th of all rows would meet in one task. There are at
    most ``HOT`` such keys, so they travel to the rows instead. Keys aren't null.
    """
    hot = facts.filter(F.col("n") > total / HOT)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter(F.col("n") <= total / HOT), on)
    return rest.unionByName(rows.join(F.broadcast(hot), on)).drop("n")


def words_of(text: Column) -> Column:
    """All words of a text, in order; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
