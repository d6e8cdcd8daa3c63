"""Hash, number, geometry, array and date functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a over 32 bits: offset basis, prime and mask.
FNV_BASIS, FNV_PRIME, MASK = 2166136261, 16777619, 4294967295

#: Rings of cluster positions (capacity, radius, depth), the ellipse's ratio and the radius tolerance.
RING_CAPACITY, RING_RADIUS, RING_DEPTH = (4, 8), (1.72, 2.8), (0.28, 0.46)
ORBIT_RATIO, RING_TOLERANCE, SEPARATION = 0.72, 0.025, 0.98


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the characters' codes, as a long; characters of the basic plane are one unit each."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(None).cast("long")).otherwise(F.ascii(c).cast("long")))
    step = lambda a, c: F.when(c.isNull(), a).otherwise((a.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(MASK)))
    return F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), step)


def fnv_token(text: Column, salt: str) -> Column:
    """Sixteen hexadecimal digits: the hash of the text, and of the salt and the text reversed."""
    eight = lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))
    return F.concat(eight(fnv1a(text)), eight(fnv1a(F.concat(F.lit(salt), F.reverse(text)))))


def unit_interval(h: Column) -> Column:
    return h / F.lit(float(MASK))


def percent(x: Column) -> Column:
    """A share or a percentage as a percentage from 0 to 100; null for null and NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(x <= 1, x * 100.0).otherwise(x.cast("double")))))


def rounded(x: Column) -> Column:
    """Half up, as floor(x + 0.5)."""
    return F.floor(x + 0.5)


def score100(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), rounded(x * 100)))


def heat(count: Column) -> Column:
    """Usage as a heat from 0 to 1: log(1 + count) / log(33), at most 1."""
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0), F.coalesce(count, F.lit(0))).cast("double")) / F.log1p(F.lit(32.0)))


def target_clusters(papers: Column, most: int = 12) -> Column:
    """None for no papers, one up to three, else a fifth of them, at least two and at most `most`."""
    return F.when(papers == 0, 0).when(papers <= 3, 1).otherwise(F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(papers / 5)))).cast("int")


def display_state(status: Column, strength: Column, confidence: Column, eligible: Column) -> Column:
    """How a relation is shown: verified, candidate, suggestion or unscored."""
    s, c = percent(strength), percent(confidence)
    formal, candidate = (s >= 60) & (c >= 75), (s >= 40) & (c >= 50)
    return (
        F.when(s.isNull() | c.isNull(), "unscored")
        .when((F.coalesce(eligible, F.lit(True)) == F.lit(False)) | (F.coalesce(status, F.lit("")) == "suggestion"), "suggestion")
        .when(status == "verified", F.when(formal, "verified").otherwise("suggestion"))
        .when(status == "candidate", F.when(candidate, "candidate").otherwise("suggestion"))
        .when(formal, "verified")
        .when(candidate, "candidate")
        .otherwise("suggestion")
    )


def orbit_position(origin: Column, slot: Column, ring: int, phase: Column, depth_phase: Column) -> Column:
    """A slot's place on a ring around the origin, as array<double>."""
    n = RING_CAPACITY[ring]
    angle = phase * 2 * math.pi + F.lit(0.0 if ring == 0 else math.pi / n) + slot / F.lit(float(n)) * 2 * math.pi
    return F.array(
        origin[0] + F.cos(angle) * RING_RADIUS[ring],
        origin[1] + F.sin(angle) * RING_RADIUS[ring] * ORBIT_RATIO,
        origin[2] + F.sin(angle * 2 + depth_phase * 2 * math.pi) * RING_DEPTH[ring],
    )


def clearance(position: Column, origin: Column) -> Column:
    return F.hypot(position[0] - origin[0], (position[1] - origin[1]) / ORBIT_RATIO)


def ring_index(position: Column, origin: Column) -> Column:
    """The nearest ring, or -1 if none is within the tolerance."""
    d = clearance(position, origin)
    best = F.array_min(F.array(*(F.struct(F.abs(d - r).alias("d"), F.lit(k).alias("k")) for k, r in enumerate(RING_RADIUS))))
    return F.when(best["d"] <= RING_TOLERANCE, best["k"]).otherwise(-1)


def inside_ellipse(x: Column, y: Column, rx: Column, ry: Column) -> Column:
    return F.pow(x / rx, F.lit(2.0)) + F.pow(y / ry, F.lit(2.0)) <= 1


def sphere_point(index: Column, count: Column, radius: Column) -> Column:
    """The index-th of count points of a Fibonacci sphere, rounded to six digits."""
    y = 1 - 2 * (index + 0.5) / count
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    a = index * F.lit(math.pi * (3 - math.sqrt(5)))
    return F.array(*(F.round(v * radius, 6) for v in (F.cos(a) * r, y, F.sin(a) * r)))


def digest_position(digest: Column) -> Column:
    """Three coordinates from -1 to 1 from the first twelve digits of a hexadecimal digest."""
    part = lambda k: F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("double") / 65535.0 * 2 - 1
    return F.array(part(0), part(1), part(2))


def fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the columns' text, with the unit separator between them and null as empty."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def same_value(left: Column, right: Column) -> Column:
    """Deep equality of two structs with the same fields, nulls equal."""
    return F.to_json(left).eqNullSafe(F.to_json(right))


def valid_timestamp(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text).isNotNull(), F.lit(False))


def dated(text: Column) -> Column:
    """A date alone is midnight at +08:00; other texts are read as timestamps."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00+08:00"))).otherwise(text))


def first_text(*columns: Column) -> Column:
    """The first that is not null or blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def author_list(text: Column) -> Column:
    """Names between semicolons, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), F.trim), lambda a: a != "")
