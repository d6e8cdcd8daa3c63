"""Harness tables in the shapes that the engine's plans take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files have fewer splits than there are cores; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a session on one machine may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints/scriptoria").rstrip("/")


def first_line(text):
    return F.substring_index(text, "\n", 1)


def papers(spark, sf_dir) -> DataFrame:
    """documents as papers: the first line as title, the source as tag."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("paperId"), first_line("text").alias("title"), F.col("lang").alias("authors"), F.col("source").alias("tags"), F.col("text").alias("body"))


def statuses(spark, sf_dir) -> DataFrame:
    """(paperId, verificationStatus): good and clean documents are verified, good and toxic ones need attention."""
    lab = table(spark, sf_dir, "labels")
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "evidence_verified").when(F.col("quality") == 1, "needs_attention").otherwise("card_draft")
    return lab.select(F.col("doc_id").alias("paperId"), status.alias("verificationStatus"))


def usage(spark, sf_dir) -> DataFrame:
    """events as a usage ledger: the user is the task, the event type the project, props.k the paper."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.col("event_type").alias("projectId"), k.alias("paperId"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type", k.cast("string")).alias("key"), "ts")


def memory_events(spark, sf_dir) -> DataFrame:
    """conversations as a memory ledger: each turn records an item that supersedes the role's turn before it."""
    c = table(spark, sf_dir, "conversations")
    from pyspark.sql import Window

    name = F.concat(F.lit("mem-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    before = F.lag(name).over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    none = F.array().cast("array<string>")
    memory = F.struct(
        name.alias("memoryId"), F.lit("finding").alias("type"), F.col("role").alias("title"), F.col("text").alias("content"), F.lit("active").alias("state"), F.lit("provisional").alias("evidenceState"),
        F.lit("aiInference").alias("provenance"), F.when(before.isNotNull(), F.array(before)).otherwise(none).alias("supersedes"), none.alias("contradicts"),
    )
    return c.select(F.col("conv_id").cast("string").alias("projectId"), (F.col("turn") + 1).alias("revision"), F.lit("memory_recorded").alias("type"), name.alias("eventId"), F.lit(None).cast("string").alias("memoryId"), F.lit(None).cast("string").alias("taskHash"), memory.alias("memory"))


def relations(spark, sf_dir) -> DataFrame:
    """lineitem as relations of customers and suppliers; quantities and discounts stand for scores."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o.select("o_orderkey", "o_custkey"), li["l_orderkey"] == F.col("o_orderkey"))
    status = F.when(F.col("l_returnflag") == "R", "suggestion").when(F.col("l_linestatus") == "F", "verified").otherwise("candidate")
    return rows.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), status.alias("status"),
        (F.col("l_quantity") * 2).alias("strength"), F.round(100 - F.col("l_discount") * 400, 3).alias("confidence"), (F.col("l_tax") < 0.08).alias("formalEligible"),
    )


def pages(spark, sf_dir) -> DataFrame:
    """The lines of documents as pages."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
