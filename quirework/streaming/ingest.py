"""The batch functions over streams: folders of files as they come, converted and written once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import catalog, convert


def arriving(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """Rows of files as they arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def arriving_files(spark: SparkSession, path: str, per_trigger: int = 64) -> DataFrame:
    """Whole files as they arrive: (doc_id = path, format, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return found.select(F.col("path").alias("doc_id"), catalog.format_of(F.element_at(F.split("path", "/"), -1)).alias("format"), "content")


def convert_stream(docs: DataFrame, source: str, target: str, out: str, checkpoint: str, content: str = "content") -> StreamingQuery:
    """Convert each micro-batch with the batch code and append the result; the checkpoint makes a retry go on where it stopped.

    A batch writes to a folder of its own number, so one that runs again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        convert.convert(batch, source, target, content).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by window and key with a watermark, for statuses or warnings as they come. An extension: batch engines of this kind have no event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def apply(docs: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Any batch operator over micro-batches."""
    return docs.writeStream.foreachBatch(lambda b, k: step(b).write.mode("overwrite").parquet(f"{out}/batch={k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
