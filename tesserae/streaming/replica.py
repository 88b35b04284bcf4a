"""A standby that follows a collection's log by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import LOG, replay


def follow(spark: SparkSession, log_path: str, target: str, checkpoint: str, once: bool = True, files_a_batch: int = 100) -> StreamingQuery:
    """Append every committed mutation of ``log_path`` to ``target``, micro-batch by micro-batch.

    The checkpoint makes a restart go on where it ended. A batch that is written again overwrites its own folder, so no
    mutation is lost or doubled.
    """
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(log_path)

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def state(spark: SparkSession, target: str) -> DataFrame:
    """The documents of the standby: the fold of what it has applied."""
    return replay(spark.read.schema(LOG + ", batch int").parquet(target).drop("batch"))
