"""Tables in the folder that the driver and all executors share, and small Spark helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; set to a folder under the warehouse only where it is unset."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Tables not dropped yet, by name.
_tables: dict[str, Table] = {}


def live_tables() -> list[Table]:
    return list(_tables.values())


def drop_tables(*keep: Table) -> None:
    """Drop every table that is left but those to keep: for callers who have read, or written elsewhere, what operators returned."""
    for table in [t for t in _tables.values() if t not in keep]:
        table.drop()


class Table:
    """A DataFrame written as Parquet in the shared folder: it cuts lineage, and survives lost executors.

    With `bucket`, it is a table in the warehouse, bucketed by that column: joins on it
    leave its rows where they are and shuffle the other side alone.
    """

    def __init__(self, df: DataFrame, name: str, bucket: str | None = None):
        self.spark, self.schema = df.sparkSession, df.schema
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.bucketed = bucket is not None
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        _tables[self.name] = self
        if self.bucketed:
            n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
            df.write.format("parquet").bucketBy(n, bucket).saveAsTable(self.name)
        else:
            df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name) if self.bucketed else self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing that is still to run reads them."""
        _tables.pop(self.name, None)
        if self.bucketed:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that Spark's cleaner deletes those shuffles' files now."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run in this block hand Python batches of at most so many bytes (or one row)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
