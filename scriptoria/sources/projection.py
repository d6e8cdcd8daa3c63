"""Sinks of foreachBatch that a batch may reach twice: a log with a folder for each batch, and a table of latest rows of
which only the touched parts are written anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.sources.readers import _exists


def append_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Append rows to a log under the batch's number; the same batch once more takes its own place."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def project_batch(rows: DataFrame, batch: int, path: str, part: str, key: list[str], revision: str = "revision") -> list:
    """Bring a table of latest rows, partitioned by `part`, up to date with a batch's rows; returns the parts written.

    Of the rows of a key that of the greatest revision stays. Parts that the batch does not touch are not read or
    written, and neither are those that this batch, or a later one, has been written to already: `batch`, a column of the
    table, says so. So a batch that comes twice, or once more after a failure between two parts, does what is left.
    """
    spark = rows.sparkSession
    touched = rows.select(part).distinct()
    old = None
    if _exists(spark, f"{path}/{part}=*"):
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema if f.name != part)}, batch long, `{part}` {rows.schema[part].dataType.simpleString()}"
        old = spark.read.schema(schema).parquet(path)
        done = old.where(F.col("batch") >= batch).select(part).distinct()
        touched = touched.join(done, part, "left_anti")
    parts = [r[0] for r in touched.collect()]  # a batch's projects, as many as its files can name
    if not parts:
        return []
    new = rows.join(touched, part, "left_semi").withColumn("batch", F.lit(batch).cast("long"))
    if old is not None:
        kept = old.where(F.col(part).isin(parts)) if len(parts) <= 1_000 else old.join(touched, part, "left_semi")
        new = new.unionByName(kept)
    others = [c for c in new.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(revision, "batch")).alias("r"))
    flat = last.select(*key, *(F.col(f"r.{c}").alias(c) for c in others)).withColumn("batch", F.lit(batch).cast("long"))
    flat.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return parts


def run_to(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Give what is there to a sink, batch by batch; a restart goes on after the last batch of the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def projected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
