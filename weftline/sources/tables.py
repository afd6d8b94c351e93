"""Tables in the folder that driver and executors share, which cut the lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of fewer bytes than this for each core, in fewer parts than there are cores, are dealt out to all of them as they are read.
SMALL = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and all runs on one machine."""
    key = "spark.checkpoint.dir"
    at = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set(key, at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    The files outlive lost executors. They go with the shared folder, or with drop_tables().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Removes every table that materialize() has left in the shared folder; no result may still need them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftline-tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is a small table; a file of one row group is else read and worked on by one core.

    Tables of SMALL bytes a core or more have row groups enough and aren't shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores and df.rdd.getNumPartitions() < cores else df
