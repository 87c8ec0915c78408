"""Written tables in the folder that all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only for a local master that names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


class Scratch:
    """Intermediate tables of one operator call, cut off from their lineage by a write.

    A lost executor costs only the tasks of the table being written: everything
    before it is read back from the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, codec: str = "zstd", dictionary: bool = True) -> DataFrame:
        """``df``, written and to be read back; columns of hashes are better written without ``dictionary``."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished writes.

        It does so once their plans are garbage; without a collection on the
        driver, which may not need one for a long time, they pile up on the
        executors' disks.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``save`` that nothing lazy still reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
