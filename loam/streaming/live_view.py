"""Newest version per key over a stream of log files; duplicates and late versions change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def log_stream(spark: SparkSession, path: str, schema: StructType, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def newest(stream: DataFrame) -> DataFrame:
    """A streaming aggregation with one state row a key (update mode); tombstones are kept for the sink."""
    return stream.groupBy("user_key").agg(F.max_by("vtype", "seq").alias("vtype"), F.max_by("val", "seq").alias("val"), F.max("seq").alias("seq"))


def run_available(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Process what is there and return the view, read from target.

    Each batch appends the keys that changed to a folder of its own, which a repeated batch overwrites, so that nothing
    passes the driver and a batch that is run again adds nothing; the view is the newest row a key of all folders.
    """

    def written(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = newest(stream).writeStream.outputMode("update").foreachBatch(written).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(target)
    return newest(rows).where("vtype = 1").select("user_key", "seq", "val")
