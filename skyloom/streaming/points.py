"""Points placed as they arrive: a file source of point tables, each micro-batch joined to the static pieces of a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_points(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def placed_stream(view, stream: DataFrame, pieces: DataFrame, **options) -> DataFrame:
    """The same plan as a batch: a stream-static join, a projection and a filter; it holds no state."""
    return view.place(stream, pieces, **options)


def run(placed: DataFrame, path: str, checkpoint: str):
    """Everything that is there now, written exactly once to a Parquet folder."""
    query = placed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
