"""Compatibility normalization (NFKC) as Column expressions, from tables that the Unicode database gives.

A text is cut into code points, each is replaced by its decomposition, marks are put in canonical order, and what composes
is composed. Only texts with a code point outside the ranges that normalization leaves alone go that way.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block of the decomposition table.
BLOCK = 128
#: Least length of a range of code points that is left alone without a closer look.
WIDE = 48
#: Dashes and quotation marks, whose ranges are left alone however short they are.
PUNCTUATION = range(0x2010, 0x2024)
#: Code points before U+0132 that are left alone, as a class.
LATIN = r"\x{00}-\x{9f}\x{a1}-\x{a7}\x{ab}\x{bb}\x{c0}-\x{131}"
# The algorithm's places of Hangul syllables and their parts.
S_BASE, L_BASE, V_BASE, T_BASE, L_COUNT, V_COUNT, T_COUNT = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28


def _points() -> list[int]:
    return [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


@lru_cache
def pairs() -> dict[str, str]:
    """Two code points that compose, and what to."""
    out = {}
    for c in _points():
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            two = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", two) == chr(c):
                out[two] = chr(c)
    return out


@lru_cache
def followers() -> frozenset[int]:
    """Code points that can move or compose with what is before them."""
    jamo = [*range(V_BASE, V_BASE + V_COUNT), *range(T_BASE + 1, T_BASE + T_COUNT)]
    return frozenset([c for c in _points() if unicodedata.combining(chr(c))] + [ord(two[1]) for two in pairs()] + jamo)


def _decomposed(c: int) -> str:
    """The full compatibility decomposition, empty where it is the code point itself; syllables stay composed."""
    full = chr(c) if S_BASE <= c < S_BASE + L_COUNT * V_COUNT * T_COUNT else unicodedata.normalize("NFKD", chr(c))
    return "" if full == chr(c) else full


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [tuple(r) for r in out]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


@lru_cache
def _tables() -> dict[str, str | bytes]:
    """The tables as texts and bytes, single values that plans carry at little cost.

    starts has two bytes for a block of code points, the number of its entries' block; an entry is three bytes for a place
    in decomposed and one for a length in bytes. pairs has records of two code points and what they compose to, behind a
    NUL; a mark's class is the code point that classes has where marks has the mark.
    """
    blocks, starts, entries, texts = {}, b"", b"", b""
    for start in range(0, sys.maxunicode + 1, BLOCK):
        block = tuple("" if 0xD800 <= c <= 0xDFFF else _decomposed(c) for c in range(start, start + BLOCK))
        if block not in blocks:
            blocks[block] = len(blocks)
            for x in block:
                entries += len(texts).to_bytes(3, "big") + bytes([len(x.encode())])
                texts += x.encode()
        starts += blocks[block].to_bytes(2, "big")
    safe = [r for r in _ranges([c for c in _points() if not _decomposed(c) and c not in followers()]) if r[1] - r[0] >= WIDE or r[0] in PUNCTUATION]
    marks = [chr(c) for c in sorted(followers()) if unicodedata.combining(chr(c))]
    return {
        "starts": starts, "entries": entries, "decomposed": texts, "safe": _class(safe), "followers": _class(_ranges(sorted(followers()))),
        "pairs": "".join(f"\0{two}{one}" for two, one in pairs().items()), "marks": "".join(marks), "classes": "".join(chr(unicodedata.combining(c)) for c in marks),
    }


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(table: str, at: Column, width: int) -> Column:
    return F.conv(F.hex(F.substr(F.lit(_tables()[table]), at + 1, F.lit(width))), 16, 10).cast("int")


def _point(c: Column) -> Column:
    return F.ascii(c)


def _syllable(point: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def _composed(starter: Column, c: Column) -> Column:
    """What a starter and a code point compose to; null where they do not."""
    s, p = _point(starter), _point(c)
    lv = F.when(s.between(L_BASE, L_BASE + L_COUNT - 1) & p.between(V_BASE, V_BASE + V_COUNT - 1), _syllable(S_BASE + ((s - L_BASE) * V_COUNT + (p - V_BASE)) * T_COUNT))
    syllable = s.between(S_BASE, S_BASE + L_COUNT * V_COUNT * T_COUNT - 1) & ((s - S_BASE) % T_COUNT == 0)
    lvt = F.when(syllable & p.between(T_BASE + 1, T_BASE + T_COUNT - 1), _syllable(s + (p - T_BASE)))
    table = F.lit(_tables()["pairs"])
    pair = once(F.position(F.concat(F.lit("\0"), starter, c), table), lambda at: F.when(at > 0, F.substr(table, at + 3, F.lit(1))))
    return F.coalesce(lv, lvt, F.when(F.length(starter) > 0, pair))


def _class_of(c: Column) -> Column:
    """The canonical combining class; 0 for a starter."""
    return once(F.position(c, F.lit(_tables()["marks"])), lambda at: F.when(at > 0, F.ascii(F.substr(F.lit(_tables()["classes"]), at, F.lit(1)))).otherwise(0))


def _run(segment: Column) -> Column:
    """A code point with all that may move or compose behind it, in order and composed."""
    chars = F.split(segment, "")
    known = F.transform(chars, lambda c: F.struct(c.alias("c"), _class_of(c).alias("k")))
    # Marks sort by class between starters, stably.
    starters = lambda i: F.size(F.filter(F.slice(known, F.lit(1), i + 1), lambda x: x["k"] == 0))
    placed = F.array_sort(F.transform(known, lambda x, i: F.struct(starters(i).alias("s"), x["k"].alias("k"), i.alias("i"), x["c"].alias("c"))))
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        free = (a["starter"] != "") & F.when(a["marks"] == "", True).otherwise((x["k"] > a["last"]) & (x["k"] > 0))

        def after(one: Column) -> Column:
            fresh = one.isNull() & (x["k"] == 0)
            return F.struct(
                F.when(fresh, F.concat(a["done"], a["starter"], a["marks"])).otherwise(a["done"]).alias("done"),
                F.when(fresh, x["c"]).otherwise(F.coalesce(one, a["starter"])).alias("starter"),
                F.when(fresh, "").when(one.isNotNull(), a["marks"]).otherwise(F.concat(a["marks"], x["c"])).alias("marks"),
                F.when(fresh, 0).when(one.isNotNull(), a["last"]).otherwise(x["k"]).alias("last"),
            )

        return once(F.when(free, _composed(a["starter"], x["c"])), after)

    return F.aggregate(placed, begin, step, lambda a: F.concat(a["done"], a["starter"], a["marks"]))


def nfkc(text: Column) -> Column:
    """A text in NFKC, of the Unicode version that this Python has."""
    t = _tables()

    def full(c: Column) -> Column:
        p = _point(c)
        entry = lambda p: 4 * (_number("starts", 2 * (p / BLOCK).cast("int"), 2) * BLOCK + p % BLOCK)
        text_at = lambda e: F.when(_number("entries", e + 3, 1) > 0, F.decode(F.substr(F.lit(t["decomposed"]), _number("entries", e, 3) + 1, _number("entries", e + 3, 1)), "UTF-8"))
        return F.when(p < 160, c).otherwise(F.coalesce(once(once(p, entry), text_at), c))

    apart = F.array_join(F.transform(F.split(text, ""), full), "")
    followed = F.lit(f"(?s)([^{t['followers']}]?[{t['followers']}]+|[^{t['followers']}]+(?![{t['followers']}]))")
    runs = F.regexp_extract_all(apart, followed, F.lit(1))
    joined = F.array_join(F.transform(runs, lambda r: F.when(F.length(r) == 1, r).when(r.rlike(f"[{t['followers']}]"), _run(r)).otherwise(r)), "")
    # Most texts have Latin letters only, which a small class tells.
    close = F.when(text.rlike(f"[^{t['safe']}]"), joined).otherwise(text)
    return F.when(text.rlike(f"[^{LATIN}]"), close).otherwise(text)
