"""Tables that several plans read, made once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is held on the driver and broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which the driver and all executors share; unset, a temporary folder in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and it outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixed(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df computed once: as a local table marked for broadcast if it has at most `rows` rows, else written."""
    held = df.limit(rows + 1).toArrow()
    if held.num_rows > rows:
        return written(df, name)
    return F.broadcast(df.sparkSession.createDataFrame(held, schema=df.schema))
