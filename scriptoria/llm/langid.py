"""Language identification of mixed-language text.

A model holds, for every language, log probabilities of letter trigrams (word borders included) and the scripts that
its texts use. Script ranges narrow a word's candidates to the languages that use its script; a candidate's score for
the word is the sum over its trigrams. Viterbi over the words of a text, with a penalty for every switch of language,
labels spans; the language with most letters in its spans is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.shared import materialize, prepare, remainder, small, table
from scriptoria.llm.textscan import SCRIPT_NAMES, Scan, chunks, mixed, pure_letters, tables

#: Labelled rows that the model is fitted on: this many a language at most, chosen by a hash of the id.
SAMPLE_A_LANGUAGE = 1_500
#: Bits of the trigram table, and the share of a language's letters that makes a script one of its own.
BITS, SCRIPT_SHARE = 16, 0.002
#: What a switch of language costs, and the factor on word scores, in nats. Trigrams of a word are not independent.
SWITCH, WEIGHT = 8.0, 0.5
UNKNOWN = "und"


def trigrams(scan: Scan) -> np.ndarray:
    """A bucket for the trigram around each letter; borders of words are zeros."""
    z = np.concatenate([[0], scan.low, [0]]).astype(np.uint64)
    at = scan.letters + 1
    return mixed((z[at - 1] << np.uint64(42)) | (z[at] << np.uint64(21)) | z[at + 1], BITS)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", bound: int = SAMPLE_A_LANGUAGE) -> dict:
    """Fit on rows with a language: {"languages": [...], "logp": trigrams x languages, "scripts": languages x scripts}.

    Counts come from executors as one row per (bucket, language); their number is bounded by the table's size.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang")).where("lang is not null and doc_id is not null")
    # Ids first: a share of each language by hash, a fifth more than needed, then exactly `bound`, so that the window
    # only ever sees a bounded number of rows a language. The texts are not shuffled unless languages are very many.
    sizes = small(materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "languages"))
    key, whole = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), float(1 << 30)
    drawn = known.join(sizes, "lang").where(key < whole * 1.2 * (bound + 50) / F.col("n"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= bound).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    chosen = small(materialize(chosen.distinct(), "chosen"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, script, _ = tables()
        size = 2**BITS + len(SCRIPT_NAMES)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in set(langs):
                mine = sums.setdefault(name, np.zeros(size, np.int64))
                for _, part in chunks([t for x, t in zip(langs, texts, strict=True) if x == name]):
                    scan = Scan(part)
                    mine[: 2**BITS] += np.bincount(trigrams(scan), minlength=2**BITS)
                    mine[2**BITS :] += np.bincount(script[scan.points[scan.letters]], minlength=len(SCRIPT_NAMES))
        for name, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    if not names:
        return {"languages": [], "logp": np.zeros((2**BITS, 0), np.float32), "uses": np.zeros((len(SCRIPT_NAMES), 0), bool), "letters": np.zeros(0)}
    n = np.zeros((2**BITS + len(SCRIPT_NAMES), len(names)))
    n[counts["bucket"], [names.index(x) for x in counts["lang"]]] = counts["n"]
    grams, scripts = n[: 2**BITS], n[2**BITS :]
    logp = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * 2**BITS))
    # Only differences between languages matter; centred scores make an unseen trigram neutral.
    logp -= logp.mean(axis=1, keepdims=True)
    uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    return {"languages": names, "logp": logp.astype(np.float32), "uses": uses, "letters": scripts.sum(axis=0)}


def viterbi(scores: np.ndarray, texts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; texts has the text's number of each word, ascending. Texts go in step: all
    first words, then all second words, and so on, longest texts first, so each step works on a prefix."""
    n, k = scores.shape
    kinds, start, length = np.unique(texts, return_index=True, return_counts=True)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), "left")
    best = scores[start].copy()
    back = np.zeros((n, k), np.uint8 if k < 256 else np.int32)
    back[start] = np.arange(k)
    own = np.arange(k)
    for t in range(1, steps):
        m = active[t]
        now = best[:m]
        top = now.argmax(axis=1)
        most = now[np.arange(m), top] - penalty
        stay = now >= most[:, None]
        back[start[:m] + t] = np.where(stay, own, top[:, None])
        best[:m] = np.where(stay, now, most[:, None]) + scores[start[:m] + t]
    out = np.zeros(n, np.int64)
    now = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        out[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return out


def label(texts: list[str], model: dict, penalty: float = SWITCH) -> tuple[list, list, list]:
    """(language, score, spans) of each text; a span is (start, end, language), end exclusive, in code points."""
    _, script, _ = tables()
    names, n = model["languages"], len(model["languages"])
    scan = Scan(texts, by_script=True)
    weights, letters = np.zeros((len(texts), max(1, n))), np.zeros(len(texts))
    spans: list[list] = [[] for _ in texts]
    if len(scan.word_start) and n:
        scores = np.add.reduceat(model["logp"][trigrams(scan)], scan.first, axis=0).astype(np.float64) * WEIGHT
        allowed = model["uses"][script[scan.points[scan.word_start]]]
        # A script that no language uses narrows nothing.
        scores = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, -1e6)
        best = viterbi(scores, scan.word_text, penalty)
        # Letters of a script that no language uses speak for none.
        np.add.at(weights, (scan.word_text, best), scan.word_len * allowed.any(axis=1))
        letters = np.bincount(scan.word_text, scan.word_len, len(texts))
        new = np.concatenate([[True], (np.diff(best) != 0) | (np.diff(scan.word_text) != 0)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(best)) - 1
        offset = scan.starts[scan.word_text[first]]
        begin, end = scan.word_start[first] - offset, scan.word_start[last] + scan.word_len[last] - offset
        for t, a, e, g in zip(scan.word_text[first].tolist(), begin.tolist(), end.tolist(), best[first].tolist(), strict=True):
            spans[t].append((a, e, names[g]))
    # A word of marks alone has no letter; a text of such words only is no text of a language.
    true = scan.letters[pure_letters()[scan.points[scan.letters]]]
    lettered = np.bincount(np.searchsorted(scan.starts, true, "right") - 1, minlength=len(texts)) > 0
    weights[~lettered] = 0
    spans = [s if ok else [] for s, ok in zip(spans, lettered.tolist(), strict=True)]
    winner = weights.argmax(axis=1)
    langs = [names[w] if n and ok else UNKNOWN for w, ok in zip(winner.tolist(), lettered.tolist(), strict=True)]
    score = weights.max(axis=1) / np.maximum(letters, 1)
    return langs, score.tolist(), spans


def identify(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, spans array<struct<start, end, lang>>), a row a document.

    score is the share of letters in spans of lang_pred, words being cut where the script changes; letters of a script that
    no language uses speak for none, so a text of them alone has the first language and score 0. Null, empty and letterless texts (marks, digits and signs are no
    letters) are `und` with score 0 and no span, and so is everything under a model without languages. Equal shares go to the language first in the alphabet. Texts
    are scanned whole, of any length. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, spans = [], [], []
            for _, part in chunks(b.column(1).to_pylist()):
                x, y, z = label(part, shared.value)
                langs += x
                scores += y
                spans += [[{"start": a, "end": e, "lang": g} for a, e, g in s] for s in z]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    )


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
