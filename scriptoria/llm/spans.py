"""Substring dedup by sliding sentence spans.

Every run of a few consecutive sentences is hashed (more of them where they are short), and shorter runs too where
they are long in words; a run that
occurs more than once anywhere keeps its first occurrence, in the order of doc_id and position, and the sentences
under all others are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.shared import materialize, prepare, table, with_fields

#: Sentences in a span, words that a span has at least, and words that make a span of fewer sentences.
RUN, LEAST_WORDS, LONG_WORDS = 2, 12, 20

#: A sentence ends behind ., ! or ? before white space, or at a line's end.
SENTENCE = re.compile(rb"[^\n]+?(?:[.!?]+(?=[\x20\x09-\x0D]|\Z)|(?=\n)|\Z)")


def sentences(text: bytes | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, normal form) of each sentence with a word, as byte offsets; the normal form is the words
    joined by single spaces."""
    out = []
    for m in SENTENCE.finditer(text or b""):
        words = m[0].split()
        if words:
            out.append((m.start(), m.end(), len(words), b" ".join(words)))
    return out


def span_hashes(parts: list, run: int = RUN, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(position, sentences, 64 bits of the hash, 32 more) for each span: the shortest run of `run` sentences or more
    that has `least` words, and runs of fewer sentences with LONG_WORDS words or more."""
    for k in range(len(parts)):
        words, group = 0, []
        for r, part in enumerate(parts[k : k + max(run, least)], 1):
            words += part[2]
            group.append(part[3])
            whole = r >= run and words >= least
            if whole or (r < run and words >= LONG_WORDS):
                h = xxhash.xxh3_128_intdigest(b"\n".join(group))
                yield k, r, h >> 64, h & 0xFFFFFFFF
            if whole:
                break


def named(docs: DataFrame):
    """What stands for a document: its doc_id, and for a null id a value made of a hash of the text, which comes after all
    ids (whole numbers from 2^62 on, or a string that starts with the last code point)."""
    h = F.xxhash64(F.lit("text"), "text")
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col("doc_id").cast("long"), h.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(chr(0x10FFFF)), F.hex(h)))


def _spans(docs: DataFrame, run: int, least: int) -> DataFrame:
    """(doc_id, pos, h1, h2, again): again marks a span that stood earlier in the same text; doc_id is named()'s."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, high, low, again = [], [], [], [], []
            for row, t in enumerate(b.column(1)):
                seen = set()
                for k, _, x, y in span_hashes(sentences(t.as_py()), run, least):
                    at.append(row)
                    pos.append(k)
                    high.append(x)
                    low.append(y)
                    again.append((x, y) in seen)
                    seen.add((x, y))
            h1, h2 = pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint32).view(np.int32))
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), h1, h2, pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "pos", "h1", "h2", "again"])

    docs = docs.select(named(docs).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(go, f"doc_id {kind}, pos int, h1 long, h2 int, again boolean")


def repeated_spans(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, pos, h1): the spans that are no first occurrence, wherever they stand; doc_id is named()'s.

    Within a text the first occurrence is the earliest; among texts it is that of the smallest doc_id, so a hash's
    owner is a minimum over plain numbers, pre-aggregated before the shuffle: a passage that a third of all documents
    share moves a row a task. The join back splits where a hash is frequent. Hashes have 96 bits.
    """
    prepare(docs.sparkSession)
    spans = materialize(_spans(docs, run, least), "spans")
    first = spans.where("not again")
    owners = first.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("doc_id").alias("owner")).where("times > 1")
    found = first.select("doc_id", "pos", "h1", "h2").join(owners, ["h1", "h2"])
    later = found.where("doc_id <> owner").select("doc_id", "pos", "h1")
    return later.unionByName(spans.where("again").select("doc_id", "pos", "h1"))


def dedup_substrings(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """docs' columns with the repeated sentences taken out of text, and n_sentences, n_removed, removed_chars.

    A sentence goes if any span over it is a repetition; the white space behind it, up to the next sentence, goes too,
    but for a line's end, which stays. Rows that share a doc_id count as one document and are no repetition of each
    other; rows of a null id come after all others, in the order of a hash of the text, and equal ones count as one
    document. Null texts stay null and empty ones empty, with no sentence; texts of any length are read whole. An empty table gives an empty result.
    Columns of docs with the three added names are replaced; n_chars, if docs have it, follows the new text.
    """
    docs = docs.drop("n_sentences", "n_removed", "removed_chars")
    hits = repeated_spans(docs, run, least).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "h1"))).alias("__hits"))
    both = docs.withColumn("__doc", named(docs)).join(hits.withColumnRenamed("doc_id", "__doc"), "__doc", "left").drop("__doc")
    chars = "n_chars" in docs.columns

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, hits = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("__hits"))
            out, total, gone, chars_gone = [], [], [], []
            for t, h in zip(text, hits, strict=True):
                t = t.as_py()
                new, n, lost = cut(t, [(x["pos"], x["h1"]) for x in h.as_py()], run, least) if h.is_valid and t is not None else (t, len(sentences((t or "").encode())), 0)
                out.append(new)
                total.append(n)
                gone.append(lost)
                chars_gone.append(len(t or "") - len(new or ""))
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            del cols["__hits"]
            cols["text"] = pa.array(out, pa.string())
            if chars:
                was, now = cols["n_chars"], pa.array([None if x is None else len(x) for x in out])
                cols["n_chars"] = now.cast(was.type)
            cols |= {"n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed_chars": pa.array(chars_gone, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = with_fields(docs.schema, n_sentences="long", n_removed="long", removed_chars="long")
    return both.select(*docs.columns, "__hits").mapInArrow(go, schema)


def cut(text: str, hits: list[tuple[int, int]], run: int, least: int) -> tuple[str, int, int]:
    """(text without the sentences that the hits cover, number of sentences, number removed). A hit counts only where
    the text's own span at that position has that hash."""
    data = text.encode()
    parts = sentences(data)
    own = {(k, x - (1 << 64) if x >> 63 else x): r for k, r, x, _ in span_hashes(parts, run, least)}
    gone = {k + j for k, h in hits for j in range(own.get((k, h), 0))}
    keep, at = [], 0
    for k in sorted(gone):
        start, end = parts[k][:2]
        after = parts[k + 1][0] if k + 1 < len(parts) else len(data)
        keep += [data[at:start], b"\n" if b"\n" in data[end:after] else b""]
        at = after
    return (b"".join(keep) + data[at:]).decode(), len(parts), len(gone)


def op9_substring_dedup(spark, sf_dir):
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", "removed_chars", "text")
