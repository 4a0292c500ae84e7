"""Tables that outlive the executors which computed them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names.

    Only a local session may do without the setting: there one machine is the
    whole cluster and a temporary folder is as good.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="ebbtide-")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/ebbtide/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the session's reliable checkpoint folder.

    For a table that is read several times and costs more to compute than to store.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
