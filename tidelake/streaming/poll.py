"""The scheduled poll: each run loads whatever landed since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def poll_landing(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, files_per_batch: int | None = None
) -> int:
    """Append the files that are new since the last run, and return how many batches ran.

    Every batch writes its own folder ``batch=<id>`` in overwrite mode, so a
    batch that is run again after a failure replaces itself.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    ran: set[int] = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        ran.add(batch_id)

    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(ran)


def read_polled(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")
