"""Writers. A new version is written beside the old one and published by one small numbered pointer at the end, so a
reader sees the old or the new state. A pointer's file is only ever created, never replaced: of two writers that go for
the same number one succeeds. Appends are idempotent by key."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions.scalar import fingerprint
from scriptoria.sources.pointers import create_once, delete, names, numbers, read_text
from scriptoria.sources.readers import _exists, published

#: Times that publish() lets other writers be first.
RETRIES = 50


def canonical(df: DataFrame) -> DataFrame:
    """(json, sha256) with the columns in name order."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(text.alias("json")).withColumn("sha256", F.sha2("json", 256))


def point(spark: SparkSession, path: str, number: int, mark: str, version: str) -> bool:
    """Create the pointer of this number; False if another writer was first. It is there whole or not at all."""
    return create_once(spark, f"{path}/current/{number:010d}.json", json.dumps({"fingerprint": mark, "version": version}))


def next_number(spark: SparkSession, path: str) -> int:
    """The number after the highest that has a file, one that a writer left empty too: nobody fills it later."""
    return max(numbers(spark, f"{path}/current"), default=0) + 1


def stage(tables: dict[str, DataFrame], path: str, version: str | None = None) -> str:
    """Write tables as a version that nothing points to yet. Returns the version."""
    version = version or f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    return version


def publish(tables: dict[str, DataFrame], path: str, mark: str, version: str | None = None) -> str:
    """Write tables as a new version below path (or into a staged one) and point to it last, whoever else has published
    meanwhile. Returns the version."""
    version = stage(tables, path, version)
    announce(next(iter(tables.values())).sparkSession, path, mark, version)
    return version


def announce(spark: SparkSession, path: str, mark: str, version: str) -> None:
    """Point to a staged version, after whatever others have published."""
    for _ in range(RETRIES):
        if point(spark, path, next_number(spark, path), mark, version):
            return
    raise RuntimeError(f"other writers were first {RETRIES} times")


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the versions of all but the newest `keep` pointers; returns them. Versions that nothing has pointed to yet
    stay, as a writer may be about to."""
    seen = [json.loads(t)["version"] for n in numbers(spark, f"{path}/current") if (t := read_text(spark, f"{path}/current/{n:010d}.json")) and t.endswith("}")]
    old = sorted(set(seen[:-keep]) - set(seen[-keep:])) if keep else []
    here = set(names(spark, path))
    gone = [v for v in old if v in here]
    for v in gone:
        delete(spark, f"{path}/{v}")
    return gone


def append_once(events: DataFrame, path: str, key: str) -> DataFrame:
    """Append the events whose key the table lacks, once each, and return them."""
    spark = events.sparkSession
    new = events.dropDuplicates([key])
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def overwrite_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def artifact_revisions(known: DataFrame, found: DataFrame) -> DataFrame:
    """Rows to append: found (paperId, cardSha256, fulltextSha256, sourceSha256) whose fingerprint is not the paper's
    latest, with the next revision."""
    latest = known.groupBy("paperId").agg(F.max("revision").alias("last"), F.max_by("artifactSha256", "revision").alias("was"))
    now = found.withColumn("artifactSha256", fingerprint("cardSha256", "fulltextSha256", "sourceSha256"))
    both = now.join(latest, "paperId", "left").where(~F.col("artifactSha256").eqNullSafe(F.col("was")))
    return both.withColumn("revision", F.coalesce("last", F.lit(0)) + 1).drop("last", "was")


def commit(path: str, tables: dict[str, DataFrame], base: str | None, mark: str) -> str:
    """Publish if the current fingerprint is `base` and no one else publishes first; a writer that comes second fails and
    changes nothing that readers see."""
    spark = next(iter(tables.values())).sparkSession
    version = stage(tables, path)
    swap(spark, path, base, mark, version)
    return version


def swap(spark: SparkSession, path: str, base: str | None, mark: str, version: str) -> None:
    """Point to a staged version if the current fingerprint is `base`, else fail. The number is chosen before the state
    is read, so a writer that publishes in between takes the number."""
    number = next_number(spark, path)
    _, now, _ = published(spark, path) or (0, None, None)
    if now != base:
        raise RuntimeError(f"the current state is {now}, not {base}")
    if not point(spark, path, number, mark, version):
        raise RuntimeError(f"another writer has published after {base}")


def markdown(pages: DataFrame, path: str, text: str = "markdown") -> None:
    pages.select(F.col(text).alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")


def annotation_mirror(notes: DataFrame) -> DataFrame:
    """(paperId, markdown): a paper's notes in order of creation as one text."""
    line = F.concat(F.lit("## "), "id", F.lit("\n\n"), "text", F.lit("\n\nStatus: "), "status")
    return notes.groupBy("paperId").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("createdAt", "id", line.alias("line")))), lambda n: n["line"]), "\n\n").alias("markdown"))


def backup_manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) in order of the path, of allowed paths only."""
    from scriptoria.operators.predicates import allowed_backup_path

    return files.where(allowed_backup_path(F.col("path"))).select("path", "bytes", "sha256").orderBy("path")


def backup_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(F.substring_index("path", "/", 1).alias("component")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
