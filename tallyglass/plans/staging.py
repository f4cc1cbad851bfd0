"""Write an intermediate table once to the shared folder and read it back.

Operators that look at their input several times would otherwise recompute its joins each time. A
written table keeps column pruning and filter pushdown, and it survives the loss of executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode alone one in the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tallyglass/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Materialise `df` as Parquet in the shared folder; select the needed columns first."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything this application staged."""
    folder = f"{shared_folder(spark)}/tallyglass/{spark.sparkContext.applicationId}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
