"""The folder that driver and executors share: where lineage is cut and streams keep their state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; an own folder only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_USED: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet; ``release`` removes what is there."""
    _USED.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _USED[-1]


def release(spark: SparkSession) -> int:
    """Remove all that this session has put into the shared folder; to be called when results are written. How many paths there were."""
    n = len(_USED)
    while _USED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_USED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage: write to the shared folder, read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
