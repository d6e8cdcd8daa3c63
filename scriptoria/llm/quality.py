"""Quality rules: base statistics, and multivariate outliers by the minimum covariance determinant.

Base statistics are counted per whole text. The outlier rule takes a transformed statistic vector and estimates, per
language and source, the centre and covariance of the most concentrated share of the rows (Rousseeuw's minimum
covariance determinant). Three starts, medians and quartiles, all rows, and the rows within a box around the medians,
each go through concentration steps, which keep the rows with the smallest Mahalanobis distances and estimate again; of
a group's results the one with the smallest determinant stays. A step is one aggregation over all rows for all starts:
sums per group, start and distance bin, so a group of any size is pre-aggregated on the map side, and the bins that
hold the kept share give the next estimate. Vectors are fixed-point numbers, so sums are exact (up to about 10^11 rows of
a group) and a rerun gives the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.shared import discard, materialize, prepare, small, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 5

#: Fixed-point unit of the statistic vectors.
UNIT = 256
#: Quartile ranges beyond the quartiles that the box of the third start reaches.
BOX = 1.5
#: Standard deviations below which a statistic's spread is never taken, one a statistic: words, word length, symbols,
#: repeated lines (all logarithms), repeated words (tenths). They keep a constant statistic from rejecting every other
#: value.
FLOOR = (0.5, 0.1, 0.5, 0.5, 1.0)
#: Share of a group that an estimate keeps, concentration steps, and rows below which a group has no estimate of its own.
KEEP, STEPS, LEAST_ROWS = 0.75, 4, 50
#: Squared distance beyond which a document is rejected: the chi-squared quantile of 5 degrees of freedom at 1 - 2e-7.
CUTOFF = 41.0
#: Median of the chi-squared distribution with 5 degrees of freedom.
MEDIAN = 4.351
DIM = len(FLOOR)
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
#: Distance bins: BINS_PER_DOUBLING for each doubling of 1 + squared distance.
BINS_PER_DOUBLING, MAX_BIN = 16, 512


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more in the sequence; exact."""
    n = len(ids) - window + 1
    if n < 2 or distinct == len(ids):
        return 0
    key, bound = ids[:n], distinct
    for k in range(1, window):
        if bound * distinct >= 1 << 62:
            kept, key = np.unique(key, return_inverse=True)
            bound = len(kept)
        key, bound = key * distinct + ids[k : n + k], bound * distinct
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] >= 2)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = text or b""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(seen)),
    )


def base_statistics(docs: DataFrame, text: str = "text", keys=("doc_id", "lang", "source")) -> DataFrame:
    """The key columns, the five counts, and base_failed, a row a document. Null texts count as empty."""
    prepare(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([base_counts(t.as_py()) for t in b.column(len(keys))], np.int64).reshape(-1, len(names))
            cols = [*b.columns[: len(keys)], *(pa.array(rows[:, k]) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *names])

    schema = ", ".join([*(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} long" for n in names)])
    out = docs.select(*keys, F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def statistic_vector() -> list:
    """The transformed statistics in fixed point: logarithms of counts, of the mean word length and of the symbols in
    a thousand characters, and tenths of repeated words."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    values = (
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(per("word_chars", "n_words")),
        F.log1p(1000 * per("n_symbols", "word_chars")),
        F.log1p(F.col("n_dup_lines").cast("double")),
        10 * per("n_repeat_words", "n_words"),
    )
    return [F.round(v * UNIT).cast("long").alias(f"x{k}") for k, v in enumerate(values)]


def _distance():
    """Squared Mahalanobis distance of x0.. from the joined centre and precision."""
    out = F.lit(0.0)
    for i, j in PAIRS:
        term = (F.col(f"x{i}") / UNIT - F.col("center")[i]) * (F.col(f"x{j}") / UNIT - F.col("center")[j]) * F.col("precision")[i * DIM + j]
        out = out + (term if i == j else 2 * term)
    return F.greatest(out, F.lit(0.0))


def _estimate(pdf: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of one group and start from its sums per bin (MAX_BIN + 1 rows at most)."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy(np.int64)
    upto = np.cumsum(n)
    last = int(np.searchsorted(upto, KEEP * upto[-1]))
    middle = int(pdf["bin"].iloc[int(np.searchsorted(upto, 0.5 * upto[-1]))])
    kept = n[: last + 1].sum()
    total = [float(sum(map(int, pdf[f"s{k}"].iloc[: last + 1]))) / UNIT for k in range(DIM)]
    center = np.array(total) / kept
    cov = np.zeros((DIM, DIM))
    for i, j in PAIRS:
        square = float(sum(map(int, pdf[f"p{i}_{j}"].iloc[: last + 1]))) / UNIT**2
        cov[i, j] = cov[j, i] = square / kept - center[i] * center[j]
    cov += np.diag(np.square(FLOOR))
    spread = 2.0 ** ((middle + 0.5) / BINS_PER_DOUBLING) - 1
    out = {"grp": pdf["grp"].iloc[0], "start": pdf["start"].iloc[0], "center": center.tolist(), "precision": np.linalg.inv(cov).ravel().tolist(), "spread": spread, "logdet": np.linalg.slogdet(cov)[1]}
    return pd.DataFrame([out])


def robust_distances(stats: DataFrame) -> DataFrame:
    """stats (lang, source, counts ...) with d2: the scaled squared distance from the group's robust centre. Groups are
    (lang, source), null being a value. Rows of a group with fewer rows than LEAST_ROWS are judged by an estimate over
    all rows of their language, large sources included; where the language is as small, by one over all rows; d2 is
    null where these are fewer than LEAST_ROWS too."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    counts = materialize(stats.groupBy("lang", "source").agg(F.count("*").alias("rows")), "counts")
    langs = counts.groupBy(F.col("lang").alias("of")).agg(F.sum("rows").alias("all"), F.min("rows").alias("fewest"))
    total, fewest = langs.agg(F.sum("all"), F.min("all")).first()
    whole = F.when(F.lit((total or 0) >= LEAST_ROWS and fewest < LEAST_ROWS), F.lit("2"))
    own = F.when(F.col("rows") >= LEAST_ROWS, F.concat(F.lit("0"), name("lang"), F.lit("\x01"), name("source")))
    pool = F.when((F.col("all") >= LEAST_ROWS) & (F.col("fewest") < LEAST_ROWS), F.concat(F.lit("1"), name("lang")))
    judged = counts.join(langs, F.col("lang").eqNullSafe(F.col("of")))
    judged = judged.select(F.col("lang").alias("l"), F.col("source").alias("s"), F.coalesce(own, pool, whole).alias("grp"), F.array_compact(F.array(own, pool, whole)).alias("feeds"))
    named = small(materialize(judged, "groups"))
    x = [f"x{k}" for k in range(DIM)]
    rows = stats.join(named, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
    rows = materialize(rows.select("*", *statistic_vector()), "vectors")
    sound = rows.select(F.explode("feeds").alias("grp"), *x)
    # The start: medians and quartiles of values rounded to a tenth, which are few, so the aggregation is small and exact.
    coarse = [F.percentile(F.round(F.col(c) / UNIT, 1), [0.25, 0.5, 0.75]).alias(c) for c in x]
    start = sound.groupBy("grp").agg(*coarse)
    start = small(materialize(start, "quartiles"))
    spread = [F.pow((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(2.0)) + FLOOR[k] ** 2 for k, c in enumerate(x)]
    matrix = [1 / spread[i] if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)]
    medians = start.select(
        "grp", F.lit(0).alias("start"), F.array(*(F.col(c)[1] for c in x)).alias("center"), F.array(*matrix).alias("precision"), F.lit(0.0).alias("spread"), F.lit(0.0).alias("logdet")
    )
    kind = medians.schema.simpleString()[7:-1]
    sums = [F.sum(c).alias(f"s{k}") for k, c in enumerate(x)] + [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"p{i}_{j}") for i, j in PAIRS]
    box, inside = start.withColumnsRenamed({c: f"q{c}" for c in x}), F.lit(True)
    for k, c in enumerate(x):
        q, value = F.col(f"q{c}"), F.col(c) / UNIT
        reach = BOX * (q[2] - q[0]) + FLOOR[k]
        inside = inside & value.between(q[0] - reach, q[2] + reach)
    per = sound.join(box, "grp").select("grp", F.explode(F.array_compact(F.array(F.lit(1), F.when(inside, 2)))).alias("start"), F.lit(0).alias("bin"), *x)
    per = per.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *sums)
    state = materialize(medians.unionByName(per.groupBy("grp", "start").applyInPandas(_estimate, kind)), "mcd")
    binned = F.least(F.floor(F.log2(1 + _distance()) * BINS_PER_DOUBLING), F.lit(MAX_BIN)).cast("int").alias("bin")
    for _ in range(STEPS):
        per = sound.join(small(state), "grp").select("grp", "start", binned, *x).groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *sums)
        after = materialize(per.groupBy("grp", "start").applyInPandas(_estimate, kind), "mcd")
        discard(state)
        state = after
    least = state.groupBy("grp").agg(F.min_by(F.struct("center", "precision"), F.struct("logdet", "start")).alias("e"))
    state = materialize(least.select("grp", "e.center", "e.precision"), "mcd")
    # The last estimate's scale: its own median distance against that of a normal sample; it only ever widens.
    per = sound.join(small(state), "grp").select("grp", binned).groupBy("grp", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = per.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy("grp")))
    middle = per.where("2 * upto >= all").groupBy("grp").agg(F.min("bin").alias("middle"))
    scale = F.greatest(F.lit(1.0), (F.pow(F.lit(2.0), (F.col("middle") + 0.5) / BINS_PER_DOUBLING) - 1) / MEDIAN)
    final = small(materialize(state.join(middle, "grp").select("grp", "center", "precision", scale.alias("scale")), "mcd"))
    return rows.join(final, "grp", "left").withColumn("d2", _distance() / F.col("scale")).drop("grp", "feeds", "center", "precision", "scale", *x)


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) to the base statistics, base_failed, d2 and kept, a row a document.

    kept is false for a document that fails the base rules, and for one whose d2 is above CUTOFF; a document of a
    small source is judged by its language's rows, of a small language by all rows, and by the base rules alone where
    all rows are too few for an estimate. Null, empty and wordless texts fail
    the base rules. Null languages and sources are groups of their own. Repeated rows count as often as they occur.
    An empty table gives an empty result.
    """
    stats = materialize(base_statistics(docs), "statistics")
    out = robust_distances(stats)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))


def op8_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2"
    )
