"""What the operators share: table access, the shared folder for cut lineage, checked broadcasts."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder for cut lineage of sessions on one machine that name none, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints/scriptoria"

#: Bytes of rows that a batch to a Python worker aims at; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20

#: Rows of a side table that may be broadcast. Every caller counts first and joins by shuffle beyond it.
BROADCAST_ROWS = 20_000

#: Body of a character class: the six ASCII white space characters, tab to carriage return and the space.
SPACES = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table over all cores: where it has fewer files than there are cores, and its rows lie in fewer partitions, it is
    dealt out once more. Only so few files are looked into."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the session was started, and bound batches to
    them by bytes, as texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session on one machine (a local master) has its own
    in the warehouse, and any other is refused: executors would each write to a disk of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or OWN_FOLDER).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, columns can
    still be pruned, and any executor can be lost afterwards."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no later step reads."""
    path = getattr(df, "_materialized_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df, which must be cheap to count, has at most `rows` rows; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(doc_id: str, modulus: int):
    """crc32 of the id's text modulo `modulus`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def word_count(text: str):
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    bare = F.trim(F.col(text), F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(
        F.size(F.split(bare, f"[{SPACES}]+"))
    ).cast("long")


def with_fields(schema: T.StructType, **fields: str) -> T.StructType:
    """A copy of schema with more fields, given as name=type."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items())])
