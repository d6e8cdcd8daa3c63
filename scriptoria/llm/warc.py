"""WARC archives compressed with a shared Zstandard dictionary, written and read by Spark.

An archive is a sequence of Zstandard frames. The first is a skippable frame that holds the dictionary; then each
record is a frame of its own, compressed with it, so that one record can be read alone. The dictionary is trained on
a bounded sample of the records. Records with equal payloads are stored once: the one with the largest page id is a
response, the others are revisits that name it.

Files are written by Spark's text writer, so they go through the committer to any file system that Spark can write,
and a lost executor's tasks are simply run again: a row's bytes are some frames, and the line separator is an empty
skippable frame, which readers pass over. The writer begins a new file after so many rows, each of bounded size but for
one large record, and the first row of each file has the dictionary. They are read back with the binaryFile source.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.shared import new_path, prepare, table

#: Fixed values of the formats: the magic numbers of skippable frames, that of the dictionary frame, line ends.
SKIPPABLE, DICTIONARY = 0x184D2A50, 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0)
END = b"\r\n"
#: Records that train the dictionary at most, the longest of them in bytes, and the dictionary's size in bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 32_768, 65_536
LEVEL = 3
#: Bytes of frames that a row aims at, and rows of a file: 512 MB.
ROW_BYTES, FILE_ROWS = 1 << 20, 512
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url: str | None, kind: str, digest: str, length: int, payload: bytes | None, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    head = END.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=UTF-8", b"Content-Length: %d" % length, b"", b""])
    block = head + (payload or b"" if kind == "response" else b"")
    page_id = "" if page_id is None else page_id
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + END + block + END + END


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def resolved(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, kind, refers_to): pages with the role of their record.

    Payloads are compared by SHA-1 and length. The winner per payload is pre-aggregated; the join back is the only
    shuffle of payloads, and adaptive execution splits a payload that very many pages share. A null html is an empty
    payload, equal to any other. Rows that share the winner's id are all responses. Null ids win only against each
    other. Other columns are not read. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("length", F.length("payload"))
    winners = keyed.select("page_id", "sha", "length").groupBy("sha", "length").agg(F.max("page_id").alias("winner"))
    both = keyed.join(winners, ["sha", "length"])
    first = F.col("page_id").eqNullSafe(F.col("winner"))
    return both.select(
        "page_id", "url", "payload", F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("winner")).alias("refers_to")
    )


def train(pages: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most SAMPLE_RECORDS records of at most SAMPLE_BYTES bytes, chosen by a hash of the id;
    empty if they are too few to train on."""
    payload = F.encode("html", "UTF-8")
    fit = pages.where(F.length(payload).between(1, SAMPLE_BYTES))
    # Ids are chosen without their payloads, so that tasks do not each send a sample of their own to the driver.
    ids = fit.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_RECORDS).collect()
    chosen = pages.sparkSession.createDataFrame(ids, fit.select("page_id").schema).distinct()
    sample = fit.join(F.broadcast(chosen), "page_id", "left_semi").select("page_id", "url", payload.alias("payload"))
    samples = []
    for row in sample.limit(SAMPLE_RECORDS).collect() if ids else ():
        data = bytes(row["payload"])
        samples.append(record(row["page_id"], row["url"], "response", base32_sha1(data), len(data), data, None))
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, dictionary: bytes | None = None) -> None:
    """Archive pages (page_id, url, html) under path, in files of about FILE_ROWS * ROW_BYTES at most. Roles as in
    resolved(); a null url is stated as the page's urn. Payloads are kept whole, of any length. An empty table gives no
    record."""
    spark = pages.sparkSession
    prepare(spark)
    trained = spark.sparkContext.broadcast(train(pages) if dictionary is None else dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = trained.value
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY, len(raw)) + raw
        parts, size, written = [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal parts, size, written
            data = b"".join([lead, *parts] if written % FILE_ROWS == 0 else parts)
            parts, size, written = [], 0, written + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["frame"])

        for b in batches:
            for page_id, url, payload, kind, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.append(packer.compress(record(page_id, url, kind, base32_sha1(payload), len(payload), payload, refers_to)))
                size += len(parts[-1])
                if size >= ROW_BYTES:
                    yield row()
        if parts:
            yield row()

    frames = resolved(pages).mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).text(path, lineSep=EMPTY_FRAME.decode("latin-1"))


def frames(data: bytes) -> Iterator[bytes]:
    """The records of one archive, in order; the leading frame's dictionary is used for all."""
    at, unpacker = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if magic == DICTIONARY and size:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        one = unpacker.decompressobj()
        out = one.decompress(data[at:] if len(data) - at < 1 << 16 else data[at : at + (1 << 16)])
        fed = min(len(data), at + (1 << 16))
        while not one.eof:
            out += one.decompress(data[fed : fed + (1 << 20)])
            fed = min(len(data), fed + (1 << 20))
        at = fed - len(one.unused_data)
        yield out


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names lower-cased) and body of a record."""
    head, _, rest = raw.partition(END + END)
    warc = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    if rest[len(block) :] != END + END:
        raise ValueError("a record's length is wrong")
    http, _, body = block.partition(END + END)
    return {k.lower(): v for k, v in warc.items()}, {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}, body


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all archives under path.

    A response's payload is hashed again and must fit its digest and length, else reading fails. A revisit's payload
    is null; its length and digest are those of the record that it refers to. Ids are cast from text to id_type.
    """
    prepare(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if keep_payload else [])]

    def named(x: str | None) -> str | None:
        return (x or "")[len("<urn:page:") : -1] or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0):
                rows = []
                for raw in frames(file.as_py()):
                    warc, http, body = parse(raw)
                    digest, length = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    kind = warc["warc-type"]
                    if kind == "response" and (len(body) != length or base32_sha1(body) != digest):
                        raise ValueError(f"the payload of {warc['warc-record-id']} is damaged")
                    row = (named(warc["warc-record-id"]), warc["warc-target-uri"], length, digest, kind, named(warc.get("warc-refers-to")))
                    rows.append((*row, body if kind == "response" else None) if keep_payload else row)
                    if len(rows) == 2_000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + (", payload binary" if keep_payload else "")
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op3_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Bare base32 has no SQL function: it is spelled out five bits at a time over the digest's bits.
OP3_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM page),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda k: right('0000' || bin(strpos('0123456789abcdef', substr(hex, k, 1)) - 1), 4)), '') AS b FROM sized),
named AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS winner,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (1 + 16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT + 4 * substr(b, 5 * k + 3, 1)::INT
        + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest
  FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM named
"""
