"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag has a label. A sentence's probability is logistic in its
features, which are hashes of its words and of the words' beginnings; a document's is the noisy-or of its sentences:
one minus the product of their complements. The weights are fitted to document labels through the noisy-or, so the
gradient finds the sentences that explain a label, and the fitted sentence scores locate the offending ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.shared import materialize, prepare, remainder, table, with_fields
from scriptoria.llm.textscan import Scan, chunks, mixed, tables

#: Labelled rows that the model is fitted on at most, chosen by a hash of the id.
SAMPLE = 12_000
#: Bits of a feature's hash and of the filter that finds kept ones, and beginnings' lengths in letters.
BITS, FILTER_BITS, BEGINNINGS = 62, 20, (4, 5, 6, 7)
#: Features that are counted in clean documents, and that the model keeps, at most.
CANDIDATES, FEATURES = 131_072, 4_096
#: Documents of the sample that a feature occurs in at least, and its least lift in the share of toxic ones.
LEAST_DOCS, LEAST_LIFT = 4, 2.0
#: Gradient steps, step size and the penalty on squared weights.
STEPS, RATE, RIDGE = 400, 0.15, 3e-5
THRESHOLD = 0.7


def features(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, word) pairs as two arrays, and the sentence's number of each word, ascending over all texts."""
    _, _, ends = tables()
    kind = ends[scan.points]
    # A full stop ends a sentence before white space; a line's end always does.
    after = np.concatenate([scan.points[1:], [10]])
    ending = (kind == 1) | ((kind == 2) & ((after == 32) | ((after >= 9) & (after <= 13))))
    sentence = np.searchsorted(np.flatnonzero(ending), scan.word_start)
    z = scan.low[scan.letters].astype(np.uint64)
    place = np.arange(len(z)) - np.repeat(scan.first, scan.word_len)
    power = np.uint64(0x100000001B3) ** np.arange(64, dtype=np.uint64)
    one = (z + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * power[place % 64]
    upto = np.cumsum(one, dtype=np.uint64)
    before = np.where(scan.first > 0, upto[scan.first - 1], np.uint64(0)) if len(z) else np.zeros(0, np.uint64)
    words = np.arange(len(scan.first))
    found, of = [mixed(upto[scan.first + scan.word_len - 1] - before, BITS)], [words]
    for k in BEGINNINGS:
        long = words[scan.word_len >= k]
        found.append(mixed(upto[scan.first[long] + k - 1] - before[long] + np.uint64(k), BITS))
        of.append(long)
    return np.concatenate(found), np.concatenate(of), sentence


def sample(labelled: DataFrame, bound: int) -> DataFrame:
    """At most `bound` documents of (doc_id, text, label), chosen by a hash of the id. Ids are chosen without their
    texts and broadcast, which `bound` limits; no text is shuffled."""
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("_id"))
    return labelled.join(F.broadcast(materialize(chosen, "sampled")), F.col("doc_id") == F.col("_id")).drop("_id")


def train(labelled: DataFrame, bound: int = SAMPLE) -> dict:
    """Fit on (doc_id, text, label 0 or 1): {"ids": kept features, "weights": theirs, "bias": b}.

    Features are counted per document on the executors and the most telling ones are kept; then the sample's
    sentences, as kept features only, are fitted on the driver. Both are bounded by `bound` and FEATURES.
    """
    spark = labelled.sparkSession
    prepare(spark)
    rows = materialize(sample(labelled.where("label is not null and doc_id is not null and text is not null"), bound), "labelled")

    n1, n = rows.where("label = 1").count(), rows.count()
    if not n1 or n1 == n:
        return {"ids": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -20.0 if not n1 else 0.0}
    rate = n1 / n

    def in_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in chunks(b.column(0).to_pylist()):
                scan = Scan(part)
                found, word, _ = features(scan)
                yield pa.RecordBatch.from_arrays([pa.array(once(found, scan.word_text[word])[0])], names=["feature"])

    seen = rows.where("label = 1").select("text").mapInArrow(in_toxic, "feature long").groupBy("feature").agg(F.count("*").alias("n"))
    seen = seen.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "feature").limit(CANDIDATES).orderBy("feature").toPandas()
    known, toxic = seen["feature"].to_numpy(np.int64), seen["n"].to_numpy(np.int64)
    candidates = spark.sparkContext.broadcast(Kept(known))

    def in_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(candidates.value.ids), np.int64)
        for b in batches:
            for _, part in chunks(b.column(0).to_pylist()):
                scan = Scan(part)
                found, word, _ = features(scan)
                hit, at = candidates.value.find(found)
                sums += np.bincount(once(at, scan.word_text[word[hit]])[0], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["at", "n"])

    there = rows.where("label = 0").select("text").mapInArrow(in_clean, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    clean = np.zeros(len(known))
    clean[there["at"]] = there["n"]
    share = (toxic + rate) / (clean + toxic + 1)
    gain = np.where(share >= min(LEAST_LIFT * rate, (1 + rate) / 2), toxic * np.log(share / rate), -1.0)
    best = np.lexsort((known, -gain))[:FEATURES]
    ids = np.sort(known[best[gain[best] > 0]])
    kept = spark.sparkContext.broadcast(Kept(ids))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, out, totals = b.column(1).to_pylist(), [], []
            for _, part in chunks(b.column(0).to_pylist()):
                scan = Scan(part)
                for _, sentences, pairs in by_text(scan, kept.value, len(part)):
                    out.append(pairs.astype("<i4").tobytes())
                    totals.append(sentences)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(totals, pa.int32()), pa.array(out, pa.binary())], names=["label", "n", "pairs"])

    got = rows.select("text", F.col("label").cast("int").alias("label")).mapInArrow(bags, "label int, n int, pairs binary").collect()
    weights, bias = fit([r[0] for r in got], [r[1] for r in got], [np.frombuffer(r[2], "<i4").reshape(-1, 2) for r in got], len(ids))
    return {"ids": ids, "weights": weights, "bias": bias}


class Kept:
    """Sorted features and a filter on their last bits, which spares most others the search."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.filter = ids, np.zeros(2**FILTER_BITS, bool)
        self.filter[ids & (2**FILTER_BITS - 1)] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in found, index into ids) of those that are kept."""
        hit = np.flatnonzero(self.filter[found & (2**FILTER_BITS - 1)])
        at = np.searchsorted(self.ids, found[hit])
        same = self.ids[np.minimum(at, len(self.ids) - 1)] == found[hit] if len(self.ids) else np.zeros(0, bool)
        return hit[same], at[same]


def once(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (value, group) pairs."""
    order = np.lexsort((groups, values))
    v, g = values[order], groups[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return v[new], g[new]


def by_text(scan: Scan, kept: Kept, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, number of sentences, (sentence, index of kept feature) pairs) for each of n texts, in order."""
    found, word, sentence = features(scan)
    hit, feature = kept.find(found)
    text_of = scan.word_text[word[hit]]
    bounds = np.searchsorted(scan.word_text, np.arange(n + 1))
    order = np.argsort(text_of, kind="stable")
    limits = np.searchsorted(text_of[order], np.arange(n + 1))
    in_sentence = sentence[word[hit]]
    for t in range(n):
        own = sentence[bounds[t] : bounds[t + 1]]
        names = np.unique(own)
        pick = order[limits[t] : limits[t + 1]]
        pairs = np.stack([np.searchsorted(names, in_sentence[pick]), feature[pick]], axis=1)
        yield t, len(names), np.unique(pairs, axis=0) if len(pairs) else pairs


def fit(labels, sentences, pairs, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of the labels, by Adam steps on the whole sample.

    A sentence without kept features has the bias's probability; such sentences only enter by their number.
    """
    y = np.array(labels, float)
    sentence_of, feature_of, doc_of, n_plain = [], [], [], np.zeros(len(y))
    base = 0
    for d, (n, p) in enumerate(zip(sentences, pairs, strict=True)):
        kept, where = np.unique(p[:, 0], return_inverse=True)
        sentence_of.append(where + base)
        feature_of.append(p[:, 1])
        doc_of += [d] * len(kept)
        n_plain[d] = n - len(kept)
        base += len(kept)
    s = np.concatenate(sentence_of).astype(np.int64) if base else np.zeros(0, np.int64)
    f = np.concatenate(feature_of).astype(np.int64) if base else np.zeros(0, np.int64)
    doc = np.array(doc_of, np.int64)
    w, b = np.full(n_features, 1.0), -6.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        x = np.clip(b + np.bincount(s, w[f], minlength=base), -30, 30)
        p, p0 = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(-b))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + n_plain * np.log1p(-p0)
        any_ = np.maximum(-np.expm1(none), 1e-9)
        # The derivative of a document's log likelihood by its sum of log complements.
        d = np.where(y == 1, -np.exp(none) / any_, 1.0)
        gx = d[doc] * -p
        g = np.append(np.bincount(f, gx[s], minlength=n_features), gx.sum() + (d * n_plain * -p0).sum()) / len(y)
        g[:-1] -= RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w + move[:-1], b + move[-1]
    return w, float(b)


def score_documents(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (by default all) and score, predicted, n_sentences, offending array<int>, worst.

    score is the noisy-or over all sentences; offending has the numbers, from 0, of sentences whose own score is the
    threshold or more, and worst the highest. Null, empty and wordless texts have no sentence and score 0. Texts are
    read whole, of any length. Repeated rows keep a row each; an empty table gives an empty result. Columns of docs
    with the added names are replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"score": "double", "predicted": "int", "n_sentences": "int", "offending": "array<int>", "worst": "double"}
    kept_columns = [c for c in keep or docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kept, weights = Kept(m["ids"]), np.asarray(m["weights"])
        kinds = [pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.float64()]
        for b in batches:
            cols: list[list] = [[] for _ in added]
            for _, part in chunks(b.column(b.num_columns - 1).to_pylist()):
                for values, col in zip(scored(part, kept, weights, m["bias"]), cols, strict=True):
                    col += values
            new = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*kept_columns, *added])

    rows = docs.select(*kept_columns, F.col(text).alias("_text"))
    return rows.mapInArrow(run, with_fields(docs.select(*kept_columns).schema, **added))


def scored(texts: list[str], kept: Kept, weights: np.ndarray, bias: float) -> tuple[list, list, list, list, list]:
    """Scores, predictions, sentence counts, offending sentences and worst scores of some texts."""
    scan = Scan(texts)
    found, word, sentence = features(scan)
    hit, at = kept.find(found)
    # A feature counts once a sentence, as in training.
    at, of = once(at, sentence[word[hit]])
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    names = sentence[first]
    x = np.clip(bias + np.bincount(np.searchsorted(names, of), weights[at], minlength=len(names)), -30, 30)
    p = 1 / (1 + np.exp(-x))
    doc = scan.word_text[first]
    none = np.bincount(doc, np.log1p(-p), minlength=len(texts))
    score = np.clip(-np.expm1(none), 0.0, 1.0)
    count = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(count) - count
    worst, offending = np.zeros(len(texts)), [[] for _ in texts]
    np.maximum.at(worst, doc, p)
    for k in np.flatnonzero(p >= THRESHOLD):
        offending[doc[k]].append(int(k - start[doc[k]]))
    return score.tolist(), (score >= THRESHOLD).astype(int).tolist(), count.tolist(), offending, worst.tolist()


def labelled_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most `bound` documents that labels.toxic marks and that are not held out (crc32 of
    the id's text modulo 3 is not 1). Ids meet first; their sample is broadcast to the texts."""
    marks = labels.where((remainder("doc_id", 3) != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    there = marks.join(docs.select("doc_id").distinct(), "doc_id")
    chosen = materialize(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select(F.col("doc_id").alias("_id"), "label"), "marks")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_documents(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(True))
    return score_documents(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted", "n_sentences", "offending")
