"""Tables written to the shared folder, which cut the lineage and survive lost executors."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ebbtide.shared import shared_dir


#: Folders of the workspaces that were opened and not released.
_opened: list[str] = []


class Workspace:
    """Written tables of one run, below the folder that spark.checkpoint.dir names."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_dir(spark, name)
        _opened.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df, computed once and reread from Parquet."""
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def write(self, df: DataFrame) -> str:
        path = f"{self.root}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return path

    def drop(self, path: str) -> None:
        """Delete a table that nothing will read any more."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def opened() -> int:
    """A mark for `release`: the workspaces opened from now on."""
    return len(_opened)


def taken(mark: int) -> list[str]:
    """The folders opened since the mark; whoever takes them releases them."""
    found = _opened[mark:]
    del _opened[mark:]
    return found


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders whose tables nothing will read any more, and let Spark clear the shuffles that nothing refers to."""
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    # Shuffle files are cleared when the JVM has collected what refers to them.
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
