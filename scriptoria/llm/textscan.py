"""Words and letters of many texts at once, as arrays of code points."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points of texts that are scanned together; a longer text is scanned alone.
CHUNK = 1 << 19

#: Script ranges, as (first code point, last code point, script); what lies in none is script 0, "other".
SCRIPTS = (
    (0x0041, 0x024F, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0531, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"),
    (0xAC00, 0xD7AF, "Hangul"),
    (0x20000, 0x2FA1F, "Han"),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for _, _, s in SCRIPTS))


@lru_cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its lower case if it is a letter or a mark, else 0; its script; whether it is white space
    or ends a sentence (1 for a line's end, 2 for . ! ?)."""
    lower = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    script = np.zeros(len(lower), np.uint8)
    for first, last, name in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    script[lower == 0] = 0
    ends = np.zeros(len(lower), np.uint8)
    ends[ord("\n")] = 1
    ends[[ord(c) for c in ".!?"]] = 2
    ends[[0x3002, 0xFF01, 0xFF1F]] = 2
    return lower, script, ends


class Scan:
    """The code points of some texts, each text closed by a line's end, and where their words are. With by_script a word
    ends where its letters' script changes; marks have the script of what they follow."""

    def __init__(self, texts: list[str], by_script: bool = False):
        lower, script, _ = tables()
        self.points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in texts], np.int64) + 1
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.low = lower[self.points]
        letter = self.low != 0
        before = np.concatenate([[False], letter[:-1]])
        self.letters = np.flatnonzero(letter)
        starts = letter & ~before
        if by_script:
            place, own = np.arange(len(letter)), np.where(letter, script[self.points], 0)
            begun = np.maximum.accumulate(np.where(starts, place, -1))
            last = np.concatenate([[-1], np.maximum.accumulate(np.where(own > 0, place, -1))[:-1]])
            starts |= (own > 0) & (last >= np.maximum(begun, 0)) & (own != own[last])
        self.word_start = np.flatnonzero(starts)
        #: Index into letters of each word's first letter.
        self.first = np.searchsorted(self.letters, self.word_start)
        self.word_len = np.diff(np.append(self.first, len(self.letters)))
        self.word_text = np.searchsorted(self.starts, self.word_start, "right") - 1


@lru_cache
def pure_letters() -> np.ndarray:
    """For every code point: whether it is a letter (category L); marks are none."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for c in np.flatnonzero(tables()[0]).tolist():
        out[c] = unicodedata.category(chr(c))[0] == "L"
    return out


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in order, each chunk of CHUNK code points or a single text; null as empty."""
    part, size, first = [], 0, 0
    for k, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > CHUNK:
            yield first, part
            part, size, first = [], 0, k
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    """The top `bits` bits of a multiplicative hash of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
