"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in a local run without that setting, a temporary one."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{KEY} has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="memlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(KEY, found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/memlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: what follows neither recomputes it nor keeps its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
