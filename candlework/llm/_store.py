"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a temporary folder if all runs on this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="candlework-")
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Names tables below one folder of their own.

    A written table cuts lineage as a checkpoint does: a lost executor costs the files nothing, and plans that read it
    again don't run what made it again. Unlike a checkpoint it keeps columns, compression and size statistics, so joins
    on it are planned from its real size.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/candlework/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write frame as a table and return the table."""
        frame.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def release(self) -> None:
        """Have shuffle files deleted that no plan can read any more.

        Spark does that when the driver collects its garbage, which may be long after the next step needs the disk.
        """
        for _ in range(2):  # what the first round gives back lets go of more
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete what all operators have written, once no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/candlework")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
