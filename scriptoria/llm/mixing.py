"""Mixing sources to target weights.

Native: DataFrame functions only. Each document gets a hash-random key that depends on its id and text. Within a source
documents are ordered by the key and cut into ranges of the key; as keys are uniform, equal ranges hold about equally
many rows, and a source has as many ranges as its row count asks for, so one source with most of the rows is spread
over many tasks. Prefix sums of sizes run within ranges and are shifted by the sums of the ranges before. The mix
takes whole epochs of a source while its target lasts, and of the last epoch the documents up to the exact budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.shared import SPACES, SPACE_CHARS, materialize, small, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Rows that a range of keys aims at.
RANGE_ROWS = 4_096
#: Keys are the first 13 hexadecimal digits of an MD5 digest.
KEY_DIGITS = 13


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn and divide `share` of the total by weight. A
    target stops at `cap` times its source's size and the excess goes to the rest by weight, until none is above:
    the level at which that ends is found by sorting sources by the level at which each one stops.
    """
    everything = Window.partitionBy(F.lit(0))
    turn = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    order = everything.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0)))
    ranked = ranked.withColumn("open", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("pot", share * F.sum("source_size").over(everything))
    # The level if the sources before this one are full and no other: it holds for the first source that stays under it.
    level = (F.col("pot") - F.col("full")) / F.col("open")
    held = F.when(level * F.col("w") <= F.col("most"), F.struct(F.col("place"), level.alias("level")))
    ranked = ranked.withColumn("place", F.row_number().over(order))
    ranked = ranked.withColumn("level", F.min(held).over(everything)["level"])
    full = F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("most"))
    return ranked.select("source", "source_size", F.when(full, F.col("most").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def key_of():
    """The first digits of the MD5 of id and text, as a number."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix:"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, KEY_DIGITS), 16, 10).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs (doc_id, text, source) to (doc_id, source, key, size, source_size, target, taken), a row a document.

    size is the number of words, 0 for null and empty texts; such documents take nothing. taken counts the words that
    the mix takes, repeats included: it is size times the whole epochs of the source, and in the last epoch size again
    for documents before the cut, what is left of the budget for the one at the cut, and 0 after it. The taken words of
    a source thus add up to its target, rounded down. Equal keys are ordered by id and size; only rows that share both id and text
    have them. A null source is a source; null ids are told apart by their texts. Texts of any length are read whole.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), key_of().alias("key"))
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = materialize(sizes, "sources")
    per = targets(sizes.select("source", "source_size"), weights, share, cap)
    per = per.join(sizes.select(F.col("source").alias("s"), F.ceil(F.col("n") / RANGE_ROWS).alias("ranges")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = per.withColumnsRenamed({"source": "s"})
    budget = F.floor(F.col("target")).cast("long")
    per = per.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0))
    per = small(materialize(per.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "targets"))
    # A range of keys: keys are uniform below 16 ** KEY_DIGITS.
    bucket = F.floor(F.col("key") / F.lit(float(16**KEY_DIGITS)) * F.col("ranges"))
    dealt = rows.join(per, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", bucket)
    totals = dealt.groupBy("s", "range").agg(F.sum("size").alias("words"))
    offset = F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("s").alias("s2"), F.col("range").alias("r2"), offset.alias("offset"))
    within = Window.partitionBy("s", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumn("upto", F.sum("size").over(within))
    totals = small(materialize(totals, "offsets"))
    joined = summed.join(totals, F.col("s").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    before = F.col("offset") + F.col("upto") - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    return joined.select("doc_id", "source", "key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix itself: docs' columns, a row for every time a document is taken; the last may be cut to fewer words.

    taken is mix()'s result, best written before. A cut text keeps its first words, joined by single spaces; it occurs
    once a source. Documents of size 0 (null, empty and wordless texts) are never taken. Rows that share id, text and
    source are taken together, with the other columns of one of them: as often as the mix takes them all.
    """
    per = taken.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__key")).agg(
        F.max("size").alias("__size"), F.sum("taken").alias("__taken"), F.count("*").alias("__rows")
    )
    per = per.where("__taken > 0")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__mix") == F.col("__key"))
    both = docs.withColumn("__mix", key_of()).join(per, same)
    if not per.where("__rows > 1").isEmpty():
        plain = [c for c, kind in docs.dtypes if "map<" not in kind]
        extra = ["__size", "__taken"]
        once = both.where("__rows > 1").groupBy("__id", "__source", "__key").agg(F.min_by(F.struct(*docs.columns, *extra), F.xxhash64(*plain)).alias("d"))
        both = both.where("__rows = 1").select(*docs.columns, *extra).unionByName(once.select("d.*"))
    times = F.ceil(F.col("__taken") / F.col("__size")).cast("int")
    both = both.withColumn("__turn", F.explode(F.sequence(F.lit(1), times)))
    left = F.least(F.col("__size"), F.col("__taken") - (F.col("__turn") - 1) * F.col("__size"))
    words = F.split(F.trim(F.col("text"), F.lit(SPACE_CHARS)), f"[{SPACES}]+")
    cut = F.when(left < F.col("__size"), F.array_join(F.slice(words, F.lit(1), left.cast("int")), " ")).otherwise(F.col("text"))
    out = both.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix:' || coalesce(text, '')), 1, 13) AS key
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM doc GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS most FROM src),
ranked AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
    row_number() OVER (ORDER BY most / w, source NULLS LAST) AS place, 1.5::DOUBLE * sum(source_size) OVER () AS pot FROM weighed),
leveled AS (
  SELECT *, arg_min((pot - used) / open, place) FILTER ((pot - used) / open * w <= most) OVER () AS level FROM ranked),
aimed AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR level * w > most THEN most::DOUBLE ELSE level * w END AS target FROM leveled),
run AS (
  SELECT d.doc_id, d.size, a.source_size, a.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM doc d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size
    + greatest(0, least(size, floor(target)::BIGINT % source_size - before)) END)::BIGINT AS taken
FROM run
"""
