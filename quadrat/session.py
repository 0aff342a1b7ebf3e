"""Session helpers: shared scratch space, lineage cuts and bounded counts.

A lineage cut is a Parquet table in the folder that ``spark.checkpoint.dir``
names, so every executor and the driver can read it again after a loss.
Hadoop removes the tables when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and all runs in one process."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-quadrat-")
    context.setCheckpointDir("file://" + root)
    return "file://" + root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
