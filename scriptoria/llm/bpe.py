"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last of the prefix's BPE encoding: the one that is a
suffix of the prefix, stands next to the last token of what comes before it, and forms with it a pair that BPE
itself would leave apart. Storing that token for each prefix gives an encoder that works from left to right: the
encoding is read off backwards, an append only adds entries, and an edit recomputes entries until they agree with
the old ones over the longest token's length. Prefixes keeps the entries of one string; the many short strings of a
corpus are worked out together, in bpe_bulk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.bpe_bulk import Bulk
from scriptoria.llm.shared import prepare, table, with_fields
from scriptoria.llm.textscan import chunks

#: Matches up to this length in bytes are worked out together; longer ones one by one.
SHORT_BYTES = 64
#: Matches (in each of two generations) and pairs that are remembered, which only saves work.
PIECES, PAIRS = 70_000, 60_000

#: The characters with the property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: The last code point of the basic plane, in which the re module keeps classes as bitmaps.
BASIC = 0xFFFF
beyond_basic = re.compile("[\U00010000-\U0010ffff]").search


@lru_cache
def category(initial: str, top: int) -> str:
    """The body of a character class: every code point up to `top` whose general category starts with `initial`."""
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == initial
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def compiled(pattern: str, top: int) -> re.Pattern:
    """A pattern with \\p{L}, \\p{N}, \\s and \\S, in classes or outside, for texts of code points up to `top`."""
    bodies = {r"\p{L}": category("L", top), r"\p{N}": category("N", top), r"\s": WHITE}

    def inside(m: re.Match) -> str:
        return re.sub(r"\\p\{.\}|\\s", lambda x: bodies[x[0]], m[0])

    out = re.sub(r"\[[^\]]*\]", inside, pattern)
    for name, body in bodies.items():
        out = out.replace(name, f"[{body}]")
    return re.compile(out.replace(r"\S", f"[^{WHITE}]"))


def splitter(pattern: str):
    """A function from a text to the list of the pattern's matches."""
    basic, full = compiled(pattern, BASIC).findall, compiled(pattern, sys.maxunicode).findall
    return lambda text: (full if beyond_basic(text) else basic)(text)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = splitter(pattern)
        self.spines: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}

    @cached_property
    def names(self) -> dict[int, str]:
        return {t: str(t) for t in self.bytes_of}

    @cached_property
    def bulk(self) -> Bulk:
        return Bulk(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> Encoder:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        return cls(ranks, pattern)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token that no merge reaches."""
        parts = [self.bytes_of[token][k : k + 1] for k in range(len(self.bytes_of[token]))]
        ranks = self.ranks
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: (ranks.get(parts[k] + parts[k + 1], sys.maxsize), k))
            if ranks.get(parts[best] + parts[best + 1], sys.maxsize) >= token:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None

    def spine(self, token: int) -> tuple[list, list, bool]:
        """The tokens at the left and at the right end while merges make this one, from a byte up, and whether they do."""
        if token not in self.spines:
            left = right = (token,)
            made = len(self.bytes_of[token]) == 1
            if not made and (two := self.halves(token)):
                (a, _, ok), (_, b, well) = self.spine(two[0]), self.spine(two[1])
                left, right, made = (*a, token), (*b, token), ok and well
            self.spines[token] = left, right, made
        return self.spines[token]

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: no merge across the border comes before those that make them.

        The border's neighbours grow along a's right spine and b's left one, always by the merge of lower rank; of
        equal ranks the one further left comes first.
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        right, left = self.spine(a)[1], self.spine(b)[0]
        i = j = 0
        ranks, text = self.ranks, self.bytes_of
        out = None
        while out is None:
            across = ranks.get(text[right[i]] + text[left[j]], sys.maxsize)
            x = right[i + 1] if i + 1 < len(right) else sys.maxsize
            y = left[j + 1] if j + 1 < len(left) else sys.maxsize
            if across < x and across <= y and across < sys.maxsize:
                out = False
            elif x == y == sys.maxsize:
                out = True
            elif x <= y:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def last_of(self, data: bytes, end: int, last) -> int:
        """The last token of data[:end], given last(k) for shorter prefixes."""
        ranks, pairs = self.ranks, self.pairs
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(data[start:end])
            if token is None:
                continue
            if not start:
                if self.spine(token)[2]:
                    return token
            elif (known := pairs.get(last(start) << 32 | token)) or (known is None and self.spine(token)[2] and self.apart(last(start), token)):
                return token
        raise ValueError("a byte without a token")

    def pieces(self, found: list[bytes]) -> list[list[int]]:
        """The tokens of each match of the pattern."""
        out = [[self.ranks[x]] if x in self.ranks else None for x in found]
        short = [k for k, x in enumerate(found) if out[k] is None and len(x) <= SHORT_BYTES]
        for k, ids in zip(short, self.bulk.tokens([found[k] for k in short]), strict=True):
            out[k] = ids
        return [Prefixes(self, x).tokens() if ids is None else ids for x, ids in zip(found, out, strict=True)]

    def encode(self, text: str) -> list[int]:
        return [t for ids in self.pieces([p.encode() for p in self.split(text)]) for t in ids]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The entries of one byte string: last[k] is the last token of its first k bytes (last[0] is none)."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: entries of earlier prefixes stay as they are."""
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.encoder.last_of(self.data, end, self.last.__getitem__))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns the number of entries computed again.

        An entry depends on the bytes and entries of the longest token's length before it, so once that many in a
        row agree with the old ones behind the edit, the rest are as before.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        agree = done = 0
        for k in range(start + 1, len(self.data) + 1):
            if agree > self.encoder.longest:
                self.last += old[k - shift :]
                break
            self.last.append(self.encoder.last_of(self.data, k, self.last.__getitem__))
            done += 1
            agree = agree + 1 if k > start + len(new) and self.last[k] == old[k - shift] else 0
        return done

    def tokens(self) -> list[int]:
        out, k = [], len(self.data)
        while k:
            out.append(self.last[k])
            k -= len(self.encoder.bytes_of[self.last[k]])
        return out[::-1]


class Pieces:
    """What is kept of each match: its tokens packed, or, as a digest needs them, their decimal text and the bytes that
    they decode to; a dictionary each. Two generations: when the young one is full it becomes the old one, and what is
    still in use comes back from there."""

    def __init__(self, encoder: Encoder, digest: bool):
        self.encoder, self.digest = encoder, digest
        self.known, self.old = self._empty(), self._empty()

    def _empty(self) -> tuple[dict, ...]:
        return ({}, {}) if self.digest else ({},)

    def split(self, texts: list[str]) -> list[list[str]]:
        """The matches of each text, all of them in `known` until the next call."""
        found = list(map(self.encoder.split, texts))
        if len(self.known[0]) > PIECES:
            self.known, self.old = self._empty(), self.known
        new = []
        for x in set(chain.from_iterable(found)).difference(self.known[0]):
            if x in self.old[0]:
                for young, old in zip(self.known, self.old, strict=True):
                    young[x] = old[x]
            else:
                new.append(x)
        made = self.encoder.pieces([x.encode() for x in new])
        if self.digest:
            name = self.encoder.names.__getitem__
            self.known[0].update(zip(new, [",".join(map(name, ids)) for ids in made], strict=True))
            self.known[1].update(zip(new, map(self.encoder.decode, made), strict=True))
        else:
            self.known[0].update(zip(new, [struct.pack(f"={len(ids)}i", *ids) for ids in made], strict=True))
        return found


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    return Encoder.load(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, verify: bool = False) -> DataFrame:
    """The columns `keep` of docs (by default all) and ids array<int>, n_tokens long: the whole text's tokens, without
    special ones. With verify=True also exact: whether the ids decode to the text's bytes again.

    A null text counts as an empty one; both have no tokens, and ids is empty. Texts are read whole, of any length.
    There are no ties to break: a text has one encoding. Repeated rows keep a row each; an empty table gives an empty
    result. Columns of docs of the added names are replaced.
    """
    prepare(docs.sparkSession)
    added = {"ids": "array<int>", "n_tokens": "long", **({"exact": "boolean"} if verify else {})}
    kept = [c for c in keep or docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(encoder_of(path, pattern), digest=False)
        decode = pieces.encoder.decode
        for whole in batches:
            for at, texts in chunks(whole.column(whole.num_columns - 1).to_pylist()):
                packed = [b"".join(map(pieces.known[0].__getitem__, found)) for found in pieces.split(texts)]
                n = np.array([len(x) // 4 for x in packed], np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))), pa.array(n)]
                if verify:
                    exact = [decode(np.frombuffer(x, np.int32).tolist()) == t.encode() for x, t in zip(packed, texts, strict=True)]
                    new.append(pa.array(exact, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*whole.slice(at, len(texts)).columns[:-1], *new], names=[*kept, *added])

    rows = docs.select(*kept, F.col(text).alias("__text"))
    return rows.mapInArrow(run, with_fields(docs.select(*kept).schema, **added))


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded's columns and decoded binary: the bytes of the tokens; empty for null or no tokens. Repeated rows keep a
    row each, lists may be of any length, an empty table gives an empty result, and a column `decoded` is replaced."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, pattern)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            out = pa.array([encoder.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in column], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    rest = encoded.drop("decoded")
    return rest.mapInArrow(run, with_fields(rest.schema, decoded="binary"))


def digest_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: encode_documents() and decode_documents() in one
    pass, without moving the ids. Null and empty texts have no tokens and the digests of nothing. Texts are read whole,
    of any length; repeated rows and null ids keep a row each; an empty table gives an empty result. No other column of
    docs is read."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(encoder_of(path, pattern), digest=True)
        for b in batches:
            n, ids, decoded = [], [], []
            for _, texts in chunks(b.column(1).to_pylist()):
                for matches in pieces.split(texts):
                    names, data = pieces.known
                    joined = ",".join(map(names.__getitem__, matches))
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(data.__getitem__, matches))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_bpe(spark, sf_dir):
    return digest_documents(table(spark, sf_dir, "documents"), *vocabulary())
