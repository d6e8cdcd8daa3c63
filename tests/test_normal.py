"""NFKC as expressions against the library."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from scriptoria.functions import normal


def differ(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    return [(r["t"], r["n"]) for r in df.select("t", normal.nfkc(F.col("t")).alias("n")).collect() if unicodedata.normalize("NFKC", r["t"]) != r["n"]]


def test_every_assigned_code_point(spark):
    points = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    assert differ(spark, points) == []
    # The same within a text, where they can meet what is before and behind them.
    assert differ(spark, [f"a{c}̣́b{c}" for c in points if normal._decomposed(ord(c)) or ord(c) in normal.followers()]) == []


def test_sequences_of_marks_and_jamo(spark):
    rng = random.Random(4)
    follow, odd = sorted(normal.followers()), [0x9C7, 0x9BE, 0x9D7, 0xB47, 0xB56, 0x1F80, 0x3B1, 0x345, 0x313, 0xAC00, 0xAC1C, 0xAC01, 0x212B, 0xFB01, 0x2126]
    jamo = [*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0x3131, 0x3164)]
    one = lambda: chr(rng.choice([rng.choice(follow), rng.choice(follow), rng.choice(jamo), rng.choice(odd), ord(rng.choice("aeiouAEO c")), 0x2014, 0x1F600]))
    assert differ(spark, ["".join(one() for _ in range(rng.randint(0, 9))) for _ in range(8_000)] + ["", "plain", "é" * 500, "́" * 40, "ﬁne — “ok”"]) == []


def test_null_and_safe_texts(spark):
    df = spark.createDataFrame([(None,), ("Große Äpfel",)], "t string").select(normal.nfkc(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [None, "Große Äpfel"]
