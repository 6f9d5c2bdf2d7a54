"""Written tables that cut lineage, in the folder which the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship


BATCH_BYTES = 8 << 20  # of rows sent to a Python worker at once, in place of 10,000 rows of any length


def prepare(spark: SparkSession) -> None:
    """The package on executors, and batches of bounded bytes."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def sweep(spark: SparkSession) -> None:
    """Executors collect their garbage and hand back heap and buffers that what ran before has left: a JVM doesn't by itself.

    As many tasks as there are cores reach every executor that is idle; of collections asked for at once a JVM does one.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").collect()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a temporary one, which a cluster can't share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="covspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Store:
    """One run's intermediate tables, as Parquet under the shared folder.

    Every executor and the driver can read them, so losing an executor costs
    only the tasks it was running. Tables go when dropped, or with the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path)
        self.fs.deleteOnExit(self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a reader of what was written."""
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark delete the shuffle files of jobs that are over: it does when the driver's heap is swept."""
        for name in names:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrow rows that may be broadcast, after they were counted; beyond it a join is shuffled.
BROADCAST_ROWS = 1 << 20


def narrow(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a stored table of a few numbers a row, with a hint to broadcast it if its rows are few enough."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df
