"""Intermediate tables in the shared folder, so that no result hangs on one executor's disk.

``spark.checkpoint.dir`` names a folder that driver and executors share; it is read from the
session. Where it is unset, a session on a cluster is refused, and local mode gets a folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
ROWS_KEY, ROWS_DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are bounded by rows alone: 1,000 in the place of Spark's default. Another setting of the session stays."""
    if spark.conf.get(ROWS_KEY) == ROWS_DEFAULT:
        spark.conf.set(ROWS_KEY, ROWS)


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get(KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set(KEY, root)
    return root.rstrip("/")


class Store:
    """Tables of one run, written once as Parquet and read back: this cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        self.tables.add(table)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def folder(self, name: str) -> str:
        """The URI of a new, empty folder beside the tables."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(target)
        return self.path(name)

    def drop(self, *tables: str) -> None:
        """Removes tables that nothing lazy reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            self.tables.discard(table)
            target = jvm.org.apache.hadoop.fs.Path(self.path(table))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def keep_only(self, *tables: str) -> None:
        """Removes all other tables: what an operator returns must not read them."""
        self.drop(*sorted(self.tables - set(tables)))

    def release(self) -> None:
        """Lets go of finished shuffles: their files stay until the driver collects the handles, which it does not do of itself while its heap is roomy."""
        gc.collect()
        self.spark._jvm.System.gc()
