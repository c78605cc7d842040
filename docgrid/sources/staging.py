"""Relations written in the folder that all executors share and read again, so that lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a temporary folder, for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_docgrid_staging"):
        spark.sparkContext._docgrid_staging = "file://" + tempfile.mkdtemp(prefix="docgrid-")
    return spark.sparkContext._docgrid_staging


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: what follows is planned by itself and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
