"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that a task passes to its Python worker, unless one row has more.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where a session names none, a local session (one machine) gets a folder of its own; on a cluster that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='spark-shared-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it again: what follows doesn't recompute it."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Makes Spark hand Python workers a few MB at a time: texts and sets differ in size by orders of magnitude, so rows are no measure."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more, ahead of the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scope:
    """Tables of the shared folder that a job needs for itself; all are deleted when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.paths.values():
            dropped(self.spark, path)
        self.paths.clear()

    def saved(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """As the function saved; the table lives until the scope ends or the table is dropped."""
        path = new_path(self.spark, name)
        out = saved(df, name, path, codec)
        self.paths[id(out)] = (out, path)
        return out

    def dropped(self, table: DataFrame) -> None:
        """Deletes one of the scope's tables before the scope ends."""
        dropped(self.spark, self.paths.pop(id(table))[1])
