"""What operators need from the session: the shared folder, written tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or, where that is unset (as in tests), one of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "marrow-shared")


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/marrow/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has written there; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: set[str] = set()


def until_exit(spark: SparkSession) -> None:
    """Have the file system delete this application's part of the shared folder when the application ends."""
    where = own_dir(spark)
    if where not in _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path):
            _kept.add(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    It cuts lineage, survives lost executors and gives the optimizer the real size, so that it broadcasts the table
    only if that is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark)
    return spark.read.schema(df.schema).parquet(path)


class Growing:
    """A table in the shared folder to which parts are added one after another, each a partition by number."""

    def __init__(self, spark: SparkSession, name: str, schema: str, by: str):
        self.spark, self.by, self.schema = spark, by, schema
        self.path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame, number: int) -> int:
        """Write a part and tell how many rows it has."""
        df.write.parquet(f"{self.path}/{self.by}={number}")
        until_exit(self.spark)
        return self.part(number).count()

    def part(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.by}={number}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {self.by} int").parquet(self.path)


#: Bytes of a partition of a bucketed table, as the optimizer estimates its input.
BUCKET_BYTES = 128 << 20


def buckets_for(df: DataFrame) -> int:
    """How many partitions a bucketed table of about the rows of ``df`` should have; results do not depend on it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // BUCKET_BYTES) if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))  # beyond: not known
    return min(max(spark.sparkContext.defaultParallelism, wanted), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


def bucketed(df: DataFrame, name: str, by: list[str], n: int) -> DataFrame:
    """Like ``written``, but rows lie in ``n`` buckets by the hash of ``by``, so joins and groups on these columns need no shuffle.

    The table leaves the catalog at once; its files stay, like those of ``written``.
    """
    spark = df.sparkSession
    unique = uuid.uuid4().hex
    table = f"marrow_{unique}"
    df.write.format("parquet").bucketBy(n, *by).option("path", f"{own_dir(spark)}/{name}-{unique}").saveAsTable(table)
    until_exit(spark)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
