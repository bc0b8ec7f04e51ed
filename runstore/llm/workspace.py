"""Shared storage for intermediate tables, and helpers for keys."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_folder
from ..ship import ship


class Workspace:
    """Tables written below the shared folder, to cut lineage and to read a result more than once.

    They live in reliable shared storage, so a lost executor never loses them. ``drop`` frees one
    early; the rest goes when Python exits, since a returned DataFrame may still read them.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/runstore-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: nothing is left to free it with
            pass

    def cut(self, df: DataFrame, free_shuffles: bool = False) -> DataFrame:
        """Write ``df`` and return a reader of it. ``free_shuffles``: let Spark delete unused shuffle files now."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        if free_shuffles:
            self.free()
        return out

    def free(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, df._workspace_path = getattr(df, "_workspace_path", None), None
            if path:
                self._remove(path)


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """Rows with a key, one for each: of rows that share a key the smallest (by all values) stays.

    Only the keys are counted first; the rows are dealt anew only if some key does repeat.
    """
    df = df.where(F.col(key).isNotNull())
    if not df.groupBy(key).count().where("count > 1").limit(1).take(1):
        return df
    rest = [F.col(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
