"""The usage ledger as a stream; the memory ledger is in streaming.memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.sources.readers import USAGE, usage_key


def usage_stream(spark: SparkSession, path: str, schema: str = USAGE, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def counts(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """(projectId, paperId, count) with each key counted once.

    Without a horizon the state holds every key ever seen, as the ledger does. With one, events need a timestamp `ts`,
    and a key that returns after the horizon counts again: another result, for ledgers that may not grow forever.
    """
    keyed = events.withColumn("key", usage_key()) if "key" not in events.columns else events
    once = keyed.dropDuplicates(["key"]) if horizon is None else keyed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["key"])
    return once.groupBy("projectId", "paperId").agg(F.count("*").alias("count"))


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there and return the table that it makes."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
