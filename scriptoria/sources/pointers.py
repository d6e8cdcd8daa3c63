"""Small files that are created once and whole, which is all that publishing and journals rest on.

A text is written under a hidden name first and then given its name, if nothing has that name yet. So a file that is
there is complete, a writer that dies leaves nothing that others wait for, and of two writers one succeeds. On a disk
of this machine the name is given by a hard link, elsewhere by a rename that does not overwrite, which HDFS does in one
step. A store without either needs a committer that puts conditionally.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _local(fs, p) -> str | None:
    """The path on this machine's disk, if it is there."""
    whole = fs.makeQualified(p).toUri()
    return unquote(whole.getPath()) if whole.getScheme() == "file" else None


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text; False if the name is taken."""
    folder, name = path.rsplit("/", 1)
    hidden, fs = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(hidden, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _at(spark, path)
    disk = _local(fs, target)
    try:
        if disk is not None:
            os.link(_local(fs, hidden), disk)
            return True
        jvm = spark.sparkContext._jvm
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(hidden, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(hidden, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; none if it is not there."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, without hidden ones, sorted; none if there is no folder."""
    p, fs = _at(spark, folder)
    return sorted(n for n in (x.getPath().getName() for x in fs.listStatus(p)) if n[0] not in "._") if fs.exists(p) else []


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the numbered JSON files of a folder, filled or not, ascending."""
    return [int(n.removesuffix(".json")) for n in names(spark, folder) if n.endswith(".json") and n.removesuffix(".json").isdigit()]


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def files_mark(spark: SparkSession, files: list[str]) -> str:
    """A hash of the files' names, sizes and times, from one listing of each folder; nothing is read."""
    import hashlib

    digest, by_folder = hashlib.sha256(), {}
    for f in files:
        by_folder.setdefault(f.rsplit("/", 1)[0], set()).add(f.rsplit("/", 1)[1])
    for folder in sorted(by_folder):
        p, fs = _at(spark, folder)
        wanted = {unquote(n) for n in by_folder[folder]}
        for x in sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p) if s.getPath().getName() in wanted):
            digest.update(f"{folder}/{x}\n".encode())
    return digest.hexdigest()
