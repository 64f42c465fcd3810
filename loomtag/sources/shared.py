"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, on a local master only: on a cluster
    executors would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomtag-"))
    return jsc.getCheckpointDir().get()


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan of files dealt to all cores, if it has fewer partitions than these: what little it then holds
    is soon moved, while one task would parse it all."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: later uses neither make it again nor need the executor
    that made it."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
