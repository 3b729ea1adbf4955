"""Tables in the cluster's shared folder, for steps that need a written result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    home = f"{root.rstrip('/')}/tracemill-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)  # only notes what is there already
    return f"{home}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: later uses neither recompute it nor depend on an executor's disk."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracemill_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a written table that nothing unevaluated reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tracemill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
