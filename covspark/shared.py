"""Written tables that several branches of a plan read, in the folder which the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a temporary one, which a cluster can't share."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="covspark-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, written once, so that branches don't each compute it; a stream, or a table made on the driver, stays as it is.

    The table goes with the application. Losing an executor costs its tasks alone.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    at = f"{folder(spark)}/written-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)
