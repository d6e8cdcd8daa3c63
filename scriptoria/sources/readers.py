"""Readers. Schemas are explicit and reading fails on what does not fit, unless a reader says otherwise."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.sources.pointers import numbers, read_text

USAGE = "schemaVersion int, eventId string, type string, timestamp string, taskHash string, projectId string, paperId string, key string, artifactRevision int, artifactSha256 string, claimIds array<string>, evidenceIds array<string>"
ANNOTATIONS = "id string, paperId string, text string, status string, revision int, createdAt string"
ATOM = "entry array<struct<id: string, title: string, summary: string, published: string, updated: string, author: array<struct<name: string>>>>"
MOST_FILES = 10_000


def json_document(spark: SparkSession, path: str, schema: str | T.StructType, optional: bool = False) -> DataFrame:
    """Whole-file JSON documents; a missing optional one is an empty table."""
    if optional and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    statuses = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(statuses)


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, content) of files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def usage_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, damaged lines) of JSON lines files. Only a file's last line without a line end may be torn: it is left
    out; any other bad line is reported in the second table, which callers require to be empty.

    Files are read in splits. (block, n) orders a file's lines. A file has no last line end if its lines, each with
    one, come to more bytes than it has.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("line"))
    parsed = lines.where("trim(line) <> ''").withColumn("e", F.from_json("line", USAGE + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("e").isNull() | F.col("e._corrupt_record").isNotNull() | F.col("e.paperId").isNull()
    events = parsed.where(~bad).select("path", "block", "n", "e.*").drop("_corrupt_record")
    ends = lines.groupBy("path").agg(F.max(F.struct("block", "n")).alias("last"), (F.sum(F.octet_length("line") + 1) > F.max("bytes")).alias("torn"))
    rows = parsed.where(bad).select("path", "block", "n", "line").join(ends, "path")
    excused = F.col("torn") & (F.struct("block", "n") == F.col("last"))
    return events, rows.where(~excused).select("path", "block", "n", "line")


def usage_key():
    """taskHash:projectId:paperId, without the project where there is none."""
    return F.when(F.coalesce("projectId", F.lit("")) != "", F.concat_ws(":", "taskHash", "projectId", "paperId")).otherwise(F.concat_ws(":", "taskHash", "paperId"))


def memory_ledger(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of which every one must be an event; a blank or bad line fails the read."""
    lines = spark.read.text(path)
    checked = lines.withColumn("value", F.when(F.trim("value") == "", F.raise_error(F.lit("blank ledger line"))).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """(card_id, text) of Markdown cards, by file name, in order of the name."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"([^/]+)\.md$", 1).alias("card_id"), F.col("value").alias("text")).orderBy("card_id")


def discovered(spark: SparkSession, root: str, most: int = MOST_FILES) -> DataFrame:
    """(relativePath, bytes) of PDF files below a folder, hidden ones and hidden folders left out, in order of the
    path; more than `most` is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path", F.col("length").alias("bytes"))
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.split(":")[-1].rstrip("/")) + "/", "")
    found = files.select(relative.alias("relativePath"), "bytes").where(~F.col("relativePath").rlike(r"(^|/)\."))
    n = found.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} files below {root}")
    return found.orderBy("relativePath")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def pages(text: DataFrame) -> DataFrame:
    """(doc_id, page, text) of full texts (doc_id, text) with <!-- page: N --> marks, else on form feeds."""
    mark = r"<!-- page:\s*(\d+)\s*-->"
    marked = F.col("text").rlike(mark)
    split = F.when(marked, F.split("text", r"(?=<!-- page:\s*\d+\s*-->)")).otherwise(F.split("text", "\f"))
    parts = text.select("doc_id", marked.alias("marked"), F.posexplode(split).alias("k", "text"))
    number = F.when(F.col("marked"), F.expr(r"try_cast(regexp_extract(text, '<!-- page:\\s*(\\d+)', 1) as int)")).otherwise(F.col("k") + 1)
    return parts.select("doc_id", number.alias("page"), F.regexp_replace("text", mark, "").alias("text")).where("page is not null")


def extracted_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text) of PDF files with whichever extractor the workers have, tried in order; a file that none
    reads gives one page without text, so that it is seen by the recognition gate."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import io

        import pandas as pd

        def with_pdfplumber(data: bytes) -> list[str]:
            import pdfplumber

            with pdfplumber.open(io.BytesIO(data)) as pdf:
                return [p.extract_text() or "" for p in pdf.pages]

        def with_pypdf(data: bytes) -> list[str]:
            import pypdf

            return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]

        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                texts = [""]
                for way in (with_pdfplumber, with_pypdf):
                    try:
                        texts = way(data)
                        break
                    except Exception:  # noqa: BLE001 - the next extractor may read it
                        continue
                rows += [(name, k, t) for k, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text"])

    return files.mapInPandas(run, "doc_id string, page int, text string")


def atom(feeds: DataFrame) -> DataFrame:
    """(id, title, summary, published, updated, authors) of Atom feeds (xml string)."""
    e = feeds.select(F.explode(F.from_xml("xml", ATOM)["entry"]).alias("e"))
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return e.select(F.regexp_extract("e.id", r"abs/(.+)$", 1).alias("id"), squeeze("e.title").alias("title"), squeeze("e.summary").alias("summary"), "e.published", "e.updated", F.transform("e.author", lambda a: a["name"]).alias("authors"))


def external_catalog(spark: SparkSession, url: str | None = None, folder: str | None = None, tables=("items", "itemAttachments", "itemData", "itemDataValues", "fields", "itemCreators", "creators", "creatorTypes", "deletedItems")) -> dict[str, DataFrame]:
    """The tables of an external reference manager, by JDBC or from an export in Parquet."""
    if folder:
        return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}
    return {t: spark.read.format("jdbc").option("url", url).option("dbtable", t).load() for t in tables}


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return json_document(spark, path, ANNOTATIONS)


def context_packs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("packId string, projectId string, query string, createdAt string").option("recursiveFileLookup", True).option("pathGlobFilter", "context-*.json").json(root, multiLine=True)


def legacy_text(spark: SparkSession, path: str) -> DataFrame:
    """(content) of one file of older research notes: a field of a JSON document, or the text itself."""
    whole = spark.read.text(path, wholetext=True)
    content = F.coalesce(F.get_json_object("value", "$.content"), F.get_json_object("value", "$.text"), F.get_json_object("value", "$.notes"), F.col("value"))
    return whole.select(F.trim(content).alias("content"))


def decision(spark: SparkSession, path: str, decision_id: str) -> DataFrame:
    """The ledger line of a decision with its hash; there must be exactly one."""
    lines = spark.read.text(path).where(F.get_json_object("value", "$.decisionId") == decision_id)
    n = lines.count()
    if n != 1:
        raise ValueError(f"{n} ledger lines for {decision_id}")
    return lines.select(F.lit(decision_id).alias("decisionId"), "value", F.sha2("value", 256).alias("sha256"))


def latest_notes(notes: DataFrame, k: int = 20) -> DataFrame:
    return notes.orderBy(F.desc("createdAt"), F.desc("id")).limit(k)


#: The tables of a full-text index, for its writer and its readers.
INDEX_TABLES = ("postings", "lexicon", "totals")


def published(spark: SparkSession, path: str) -> tuple[int, str, str] | None:
    """(number, fingerprint, version) of the newest pointer below path/current; none if nothing is published. One that a
    dead writer of an earlier kind left empty or torn does not count."""
    for number in reversed(numbers(spark, f"{path}/current")):
        text = read_text(spark, f"{path}/current/{number:010d}.json") or ""
        if text.endswith("}"):
            row = json.loads(text)
            return number, row["fingerprint"], row["version"]
    return None


def index_tables(spark: SparkSession, path: str, fingerprint: str) -> dict[str, DataFrame] | None:
    """A published index, if it was built from the catalog with this fingerprint; else none."""
    now = published(spark, path)
    if now is None or now[1] != fingerprint:
        return None
    return {t: spark.read.parquet(f"{path}/{now[2]}/{t}") for t in INDEX_TABLES}
