"""Snapshots in two phases: staged with a manifest of their files, promoted once every file still has what it had.

Below a path lie staged/<id>/<table>, the manifest beside them, pending/<number>.json, which says that a snapshot waits,
and the pointers of what is current. A reader sees the version before or after a promotion. A snapshot that was damaged
meanwhile, or was made from another version than the current one, is not promoted.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.operators.joins import snapshot_diff
from scriptoria.sources.pointers import create_once, delete, names, numbers, read_text
from scriptoria.sources.readers import published
from scriptoria.sources.writers import swap


class Damaged(RuntimeError):
    """Staged files differ from their manifest; problems lists up to twenty of them."""

    def __init__(self, problems: list[tuple[str, str, str]]):
        super().__init__(f"staged files differ from their manifest: {problems}")
        self.problems = problems


def file_digests(spark: SparkSession, path: str, tables: dict[str, str]) -> DataFrame:
    """(table, file, bytes, rows, digest) of the Parquet files of these tables (name: schema as JSON) below path.

    A file's digest is the sum of two hashes of each of its rows, so it is added up where the rows are read and no file
    is held whole. Files that are gone or cannot be read have no row here.
    """
    parts = []
    for t, schema in tables.items():
        rows = spark.read.schema(T.StructType.fromJson(json.loads(schema))).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{path}/{t}")
        body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
        rows = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.xxhash64(body).alias("a"), F.crc32(body.cast("binary")).alias("b"))
        per = rows.groupBy("file", "bytes").agg(F.count("*").alias("rows"), F.concat_ws(":", F.sum(F.col("a").cast("decimal(38,0)")).cast("string"), F.sum("b").cast("string")).alias("digest"))
        parts.append(per.select(F.lit(t).alias("table"), "file", "bytes", "rows", "digest"))
    return reduce(DataFrame.unionByName, parts)


def stage(spark: SparkSession, path: str, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, replace: bool = False) -> str:
    """Write tables as a staged snapshot with its manifest and, for tables that keys names a key of, the rows that it
    adds, changes and removes; then let it wait for its promotion. Returns its id.

    One snapshot waits at a time; another is refused, or with replace takes its place.
    """
    waits = pending(spark, path)
    if waits and not replace:
        raise RuntimeError(f"{waits['id']} waits already")
    name, base = f"s-{uuid.uuid4().hex}", published(spark, path)
    folder = f"{path}/staged/{name}"
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}")
    for t, key in (keys or {}).items():
        now = spark.read.parquet(f"{folder}/{t}")
        before = load(spark, path, t) if base else now.limit(0)
        snapshot_diff(before, now, key).write.parquet(f"{folder}/changes/{t}")
    schemas = {t: df.schema.json() for t, df in tables.items()}
    file_digests(spark, folder, schemas).coalesce(1).write.json(f"{folder}/manifest")
    if waits:
        withdraw(spark, path)
    number = max(numbers(spark, f"{path}/pending"), default=0) + 1
    body = {"id": name, "base": base[1] if base else None, "tables": schemas, "manifest": _manifest_mark(spark, folder)}
    if not create_once(spark, f"{path}/pending/{number:010d}.json", json.dumps(body)):
        raise RuntimeError("another snapshot was staged first")
    return name


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("table string, file string, bytes long, rows long, digest string").json(f"{folder}/manifest")


def _manifest_mark(spark: SparkSession, folder: str) -> str:
    rows = _manifest(spark, folder)
    row = rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
    return f"{row['n']}:{row['s']}"


def pending(spark: SparkSession, path: str) -> dict | None:
    """What waits for its promotion: number, id, base, tables, manifest."""
    last = max(numbers(spark, f"{path}/pending"), default=None)
    if last is None or read_text(spark, f"{path}/pending/{last:010d}.over") is not None:
        return None
    return json.loads(read_text(spark, f"{path}/pending/{last:010d}.json")) | {"number": last}


def damages(spark: SparkSession, path: str, waiting: dict) -> DataFrame:
    """(table, file, problem): missing, unknown and changed files of a waiting snapshot, and its manifest if that changed."""
    folder = f"{path}/staged/{waiting['id']}"
    said = _manifest(spark, folder).withColumnsRenamed({"bytes": "b0", "rows": "r0", "digest": "d0"})
    both = said.join(file_digests(spark, folder, waiting["tables"]), ["table", "file"], "full_outer")
    problem = F.when(F.col("digest").isNull(), "missing").when(F.col("d0").isNull(), "unknown").when(
        (F.col("b0") != F.col("bytes")) | (F.col("r0") != F.col("rows")) | (F.col("d0") != F.col("digest")), "changed")
    found = both.select("table", "file", problem.alias("problem")).where("problem is not null")
    if _manifest_mark(spark, folder) != waiting["manifest"]:
        found = found.unionByName(spark.createDataFrame([("manifest", "", "changed")], "table string, file string, problem string"))
    return found


def promote(spark: SparkSession, path: str) -> str:
    """Make the waiting snapshot current and return its id; readers keep the version before if that fails."""
    waiting = pending(spark, path)
    if waiting is None:
        raise RuntimeError("no snapshot waits")
    now = published(spark, path)
    if now and now[2] == f"staged/{waiting['id']}":
        _settle(spark, path, waiting, "promoted")  # a writer died between the two steps
        return waiting["id"]
    problems = damages(spark, path, waiting).limit(20).collect()
    if problems:
        raise Damaged([tuple(r) for r in problems])
    swap(spark, path, waiting["base"], waiting["id"], f"staged/{waiting['id']}")
    _settle(spark, path, waiting, "promoted")
    return waiting["id"]


def withdraw(spark: SparkSession, path: str) -> None:
    """Let the waiting snapshot wait no longer and delete it."""
    waiting = pending(spark, path)
    now = published(spark, path)
    if waiting and not (now and now[2] == f"staged/{waiting['id']}"):
        _settle(spark, path, waiting, "withdrawn")
        delete(spark, f"{path}/staged/{waiting['id']}")


def _settle(spark: SparkSession, path: str, waiting: dict, how: str) -> None:
    create_once(spark, f"{path}/pending/{waiting['number']:010d}.over", how)


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the current snapshot."""
    return spark.read.parquet(f"{path}/{published(spark, path)[2]}/{table}")


def changes(spark: SparkSession, path: str, name: str, table: str) -> DataFrame:
    """(key, change) of a staged or promoted snapshot's table against the version that it was made from."""
    return spark.read.parquet(f"{path}/staged/{name}/changes/{table}")


def leftovers(spark: SparkSession, path: str) -> list[str]:
    """Staged snapshots that neither wait nor were ever current, as a writer leaves that dies while it stages."""
    seen = {json.loads(read_text(spark, f"{path}/current/{n:010d}.json"))["version"].removeprefix("staged/") for n in numbers(spark, f"{path}/current")}
    waiting = pending(spark, path)
    return [n for n in names(spark, f"{path}/staged") if n not in seen and not (waiting and waiting["id"] == n)]
