"""A stream merged into a keyed table, each batch once.

The table lies in buckets of keys. A batch reads and rewrites only the buckets
it touches, each into a folder of its own that bears the batch's number; what is
current is listed in one small manifest for each batch, put in place by a rename.
A batch whose manifest exists was merged already: it is left alone when it is
replayed. A batch that was cut short has no manifest: its folders are written
again, from the same state as before.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshot:
    """``folder``, in storage that driver and executors share; ``keys`` name a row; of several rows of a batch with one key the last by ``order`` counts."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), schema, keys, order, buckets

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches that are merged."""
        path, fs = self._path("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> dict[int, int]:
        """Of each bucket, the batch that wrote it last."""
        done = self.batches()
        if not done:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifest/{done[-1]}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def _commit(self, batch: int, at: dict[int, int]) -> None:
        (new, fs), (final, _) = self._path(f"manifest/.{batch}.tmp"), self._path(f"manifest/{batch}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(at).encode()))
        out.close()
        if not fs.rename(new, final):
            raise RuntimeError(f"batch {batch} could not be committed")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the last merged batch, or some buckets of it."""
        paths = [f"{self.folder}/data/{b}/{at}" for b, at in sorted(self.current().items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int, deleted: str | None = None) -> bool:
        """Rows of ``batch`` replace those of their keys, or are added; where ``deleted`` is true they go. False if the batch was merged before.

        For ``foreachBatch``. A null key is a key like any.
        """
        if number in self.batches():
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        values = F.struct(*[F.col(c) for c in names])
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        last = batch.groupBy(self.bucket().alias("_b"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.max_by(F.struct(gone.alias("gone"), values.alias("row")), F.struct(self.order, F.xxhash64(*names))).alias("new"))
        touched = [r._b for r in last.select("_b").distinct().collect()]  # as many as there are buckets, at most
        if touched:
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)])
            old = self.read(touched).join(last, same, "left_anti").withColumn("_b", self.bucket())
            new = last.filter("not new.gone").select("new.row.*", "_b")
            rows = old.select(*names, "_b").unionByName(new.select(*names, "_b"))
            path = f"{self.folder}/batch/{number}"
            rows.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(path)
            for b in touched:
                (source, fs), (target, _) = self._path(f"batch/{number}/_b={b}"), self._path(f"data/{b}/{number}")
                fs.delete(target, True)
                fs.mkdirs(target.getParent())
                if not fs.exists(source):  # all of its rows are gone
                    fs.mkdirs(target)
                elif not fs.rename(source, target):
                    raise RuntimeError(f"bucket {b} of batch {number} could not be put in place")
        self._commit(number, self.current() | {b: number for b in touched})
        return True

    def follow(self, stream: DataFrame, checkpoint: str, deleted: str | None = None):
        """A writer that merges each batch of a stream."""
        return stream.writeStream.foreachBatch(lambda df, n: self.merge(df, n, deleted)).option("checkpointLocation", checkpoint)
