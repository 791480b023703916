"""Tables written to the shared folder, so that lineage ends there and a lost executor costs a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Only a local session may lack that setting."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{conf.rstrip('/')}/panel-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
