"""Text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions import vocabulary as V
from scriptoria.functions.normal import nfkc, once


@lru_cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks and their base letters, from the decompositions of the Latin blocks."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base != chr(c) and base.isascii():
            pairs.append((chr(c), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters; only texts that have one are translated."""
    low, (marked, bare) = F.lower(text), _accents()
    return F.when(low.rlike(r"[\u00C0-\u024F\u1E00-\u1EFF]"), F.translate(low, marked, bare)).otherwise(low)


def squeeze(text: Column) -> Column:
    """White space runs become single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_text(text: Column) -> Column:
    """Search normalization: NFKC, lower case, Greek letters as names, everything but letters, digits and _ as one space."""
    out = F.lower(nfkc(text))
    for letter, name in V.GREEK_NAMES:
        out = F.replace(out, F.lit(letter), F.lit(f" {name} "))
    return F.trim(F.regexp_replace(F.coalesce(out, F.lit("")), r"[^\p{L}\p{N}_]+", " "))


def tokens(text: Column) -> Column:
    """Full-text tokens: accents folded, runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def cjk_bigrams(text: Column) -> Column:
    """Overlapping pairs of characters in runs of U+3400 to U+9FFF."""
    runs = F.regexp_extract_all(text, F.lit("([\\u3400-\\u9fff]{2,})"), F.lit(1))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.flatten(pairs)


def expand_aliases(normalized: Column) -> Column:
    """A normalized text with bigrams and, where a key stands as a word or a word of its expansion occurs anywhere,
    that key and expansion appended."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    more = []
    for key, expansion in V.SEARCH_ALIASES:
        hit = F.contains(padded, F.lit(f" {key} "))
        for word in expansion.split(" "):
            hit = hit | F.contains(normalized, F.lit(word))
        more.append(F.when(hit, F.lit(f"{key} {expansion}")))
    pairs = F.array_join(cjk_bigrams(normalized), " ")
    return F.concat_ws(" ", normalized, F.when(pairs != "", pairs), *more)


def query_tokens(query: Column, most: int = 48) -> Column:
    """The first distinct tokens of an expanded query."""
    return once(search_text(query), lambda n: F.slice(F.array_distinct(F.filter(F.split(expand_aliases(n), " "), lambda t: t != "")), 1, most))


def slug(text: Column, most: int = 72, default: str = "paper") -> Column:
    """Lower-case ASCII letters and digits, everything else as single hyphens; at most `most` characters."""
    out = F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), F.lit("-"))
    out = F.trim(F.substring(out, 1, most), F.lit("-"))
    return F.when(out == "", default).otherwise(out)


def doi(text: Column) -> Column:
    """A DOI without its resolver, in lower case; null if it has not the form of one."""
    out = F.lower(F.regexp_replace(F.trim(text), V.DOI_PREFIX, ""))
    return F.when(out.rlike(V.DOI), out)


def arxiv_id(text: Column) -> Column:
    """The identifier in an arXiv id or address, its version kept; null if there is none."""
    out = F.regexp_extract(F.trim(text), V.ARXIV, 1)
    return F.when(out != "", out)


def arxiv_base(text: Column) -> Column:
    """An arXiv id without its version, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?i)v\d+$", ""))


def arxiv_input(text: Column) -> Column:
    """What a user typed or pasted, without address, query string and .pdf."""
    out = F.regexp_replace(F.trim(text), r"(?i)^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/", "")
    return F.regexp_replace(F.regexp_replace(out, r"[?#].*$", ""), r"(?i)\.pdf$", "")


def identity(text: Column) -> Column:
    """Case and accents folded, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def title_author_key(title: Column, authors: Column) -> Column:
    """`title::author|author` of identities, authors sorted; null if either is empty."""
    names = F.array_sort(F.filter(F.transform(authors, identity), lambda a: a != ""))
    return F.when((identity(title) != "") & (F.size(names) > 0), F.concat(identity(title), F.lit("::"), F.array_join(names, "|")))


def truncated(text: Column, most: int, mark: str = "\n\n[text truncated]", room: int = 22) -> Column:
    """Texts longer than `most` are cut to `most - room` characters, without white space at the end, plus the mark."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, max(0, most - room)), r"\s+$", ""), F.lit(mark)))


def clipped(text: Column, most: int) -> Column:
    """White space squeezed; longer texts end in an ellipsis."""
    out = squeeze(text)
    return F.when(F.length(out) <= most, out).otherwise(F.concat(F.rtrim(F.substring(out, 1, most - 1)), F.lit("…")))


def occurrences(text: Column, term: Column) -> Column:
    """Number of times that a non-empty term stands in the text, without overlap."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")).otherwise(0)


def snippet(text: Column, terms: Column, most: int = 280, before: int = 80) -> Column:
    """`most` characters from shortly before the first occurrence of any term, else from the start, with an ellipsis
    where text was left out; heading marks are dropped."""
    compact = squeeze(F.regexp_replace(text, r"(?m)^#+\s+", ""))
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, F.lower(compact))), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - before)
    lead, tail = F.when(start > 1, "…").otherwise(""), F.when(F.length(compact) >= start + most, "…").otherwise("")
    return F.when(compact == "", "").otherwise(F.concat(lead, F.substr(compact, start, F.lit(most)), tail))


def marked_snippet(text: Column, terms: Column, words: int = 36) -> Column:
    """`words` tokens around the first matching one, matches in ⟦ ⟧, left-out text as an ellipsis."""
    parts = F.split(squeeze(text), " ")
    bare = lambda w: F.array_join(tokens(w), "")
    hit = F.array_position(F.transform(parts, lambda w: F.array_contains(terms, bare(w))), F.lit(True))
    start = F.greatest(F.lit(1), F.coalesce(hit, F.lit(1)) - words // 2).cast("int")
    shown = F.transform(F.slice(parts, start, F.lit(words)), lambda w: F.when(F.array_contains(terms, bare(w)), F.concat(F.lit("⟦"), w, F.lit("⟧"))).otherwise(w))
    return F.concat(F.when(start > 1, " … ").otherwise(""), F.array_join(shown, " "), F.when(F.size(parts) >= start + words, " … ").otherwise(""))


def card_score(paper_id: Column, title: Column, authors: Column, tags: Column, body: Column, terms: list[str]) -> Column:
    """The fallback score of a card: per term 8 for the id, 12 for the title, 6 for authors, 5 for tags and up to 5
    occurrences in the body; 5 more if title, tags and body hold every term. Fields and terms are normalized already."""
    everywhere, total, every = F.concat_ws(" ", title, tags, body), F.lit(0), F.lit(bool(terms))
    for term in terms:
        t = F.lit(term)
        total = total + F.least(F.lit(5), occurrences(body, t))
        for n, field in ((8, paper_id), (12, title), (6, authors), (5, tags)):
            total = total + F.when(F.contains(field, t), n).otherwise(0)
        every = every & F.contains(everywhere, t)
    return total + F.when(every, 5).otherwise(0)


def memory_terms(query: Column) -> Column:
    """The whole lower-case query and its words, distinct."""
    q = F.lower(squeeze(query))
    return F.array_distinct(F.array_union(F.array(q), F.split(q, " ")))


def memory_score(title: Column, kind: Column, content: Column, terms: Column, *more: Column) -> Column:
    """Per term 6 for the title, 3 for the type and up to 8 occurrences in title, content, type and further fields; 1
    for every item if there is no term."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    text = F.lower(F.concat_ws("\n", *(F.when(c != "", c) for c in (title, content, kind, *more))))
    per_term = F.transform(
        terms,
        lambda t: F.when(F.contains(low(title), t), 6).otherwise(0) + F.when(F.contains(low(kind), t), 3).otherwise(0) + F.least(F.lit(8), occurrences(text, t)),
    )
    return F.when(F.size(terms) == 0, 1).otherwise(F.aggregate(per_term, F.lit(0), lambda a, x: a + x))


def screening_tokens(text: Column) -> Column:
    """Classifier tokens: groups of letters and digits of two characters or more, or of digits; groups of Han and Kana
    characters give each character and each pair."""
    groups = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    east = lambda g: g.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+$")

    def parts(g: Column) -> Column:
        ones = F.transform(F.sequence(F.lit(1), F.length(g)), lambda i: F.substr(g, i, F.lit(1)))
        twos = F.when(F.length(g) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(g) - 1)), lambda i: F.substr(g, i, F.lit(2))))
        return F.concat(ones, F.coalesce(twos, F.array().cast("array<string>")))

    plain = lambda g: F.when((F.length(g) >= 2) | g.rlike(r"^\p{Nd}+$"), F.array(g)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(groups, lambda g: F.when(east(g), parts(g)).otherwise(plain(g))))


def title_case(text: Column) -> Column:
    """A tag as a name: its words, which white space, slashes and hyphens part, begin with a capital; acronyms are capitals."""
    parts = F.regexp_extract_all(text, F.lit(r"([^\s/-]+|[\s/-]+)"), F.lit(1))
    word = lambda w: F.when(F.lower(w).isin(*V.ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(F.transform(parts, word), "")


def tag(text: Column) -> Column:
    """A tag for comparison: dashes and underscores alike, white space squeezed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(text), "[_–—]+", "-"), r"\s+", " "))


def region_words(text: Column) -> Column:
    """Words of four ASCII letters or digits or more, distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 4))


def has_han(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{IsHan}"), F.lit(False))


def evidence_ids(statement: Column) -> Column:
    """The distinct ids E1, E2 ... in square brackets, in order."""
    return F.array_distinct(F.regexp_extract_all(statement, F.lit(r"\[(E\d+)\]"), F.lit(1)))


def bare_statement(statement: Column) -> Column:
    """A statement without the evidence marks at its end."""
    return F.trim(F.regexp_replace(statement, r"(?:\s*\[E\d+\])+\s*$", ""))


def evidence_lines(evidence: Column) -> Column:
    """Lines `id (field value, ...): paraphrase` of an array of evidence structs."""
    fields = ("page", "section", "equation", "figure", "table")
    where = lambda e: F.concat_ws(", ", *(F.when(e["locator"][f].isNotNull(), F.concat(F.lit(f"{f} "), e["locator"][f])) for f in fields))
    return F.array_join(F.transform(evidence, lambda e: F.concat(e["id"], F.lit(" ("), where(e), F.lit("): "), e["paraphrase"])), "\n")


def segments(text: Column) -> Column:
    """array<struct<kind, value, block>>: prose, code and formulas of a text, in order; bare formulas such as x_1 too."""

    @F.pandas_udf("array<struct<kind:string,value:string,block:boolean>>")
    def run(s: pd.Series) -> pd.Series:
        marked, bare = re.compile(V.MARKED_SEGMENT), re.compile(V.BARE_FORMULA)

        def prose(value: str) -> list[tuple]:
            out, at = [], 0
            for m in bare.finditer(value):
                if m.start(2) > at:
                    out.append(("text", value[at : m.start(2)], False))
                out.append(("math", m[2], False))
                at = m.end(2)
            return out + ([("text", value[at:], False)] if at < len(value) or not out else [])

        def split(value: str | None) -> list[tuple] | None:
            if value is None:
                return None
            out, at = [], 0
            for m in marked.finditer(value):
                if m.start() > at:
                    out += prose(value[at : m.start()])
                token = m[0]
                wide = token.startswith(("$$", "\\[", "\\("))
                edge = 2 if wide else 1
                out.append(("code", token[1:-1], False) if token[0] == "`" else ("math", token[edge:-edge], token.startswith(("$$", "\\["))))
                at = m.end()
            return out + (prose(value[at:]) if at < len(value) or not out else [])

        return s.map(split)

    return run(text)


def region_name(text: Column) -> Column:
    """A region's name for use between backticks."""
    return F.trim(F.translate(text, "`“”", "'"))


def rewritten_role(role: Column, primary: Column, secondary: Column) -> Column:
    """A generated role text with its statements of regions, at the start and at the end, for the present regions."""
    name = r"(?:`[^`\n]+`|“[^”\n]+”|\"[^\"\n]+\"|[^;.\n]+)"
    prefix = rf"(?i)^Primary region:\s*{name}\s*(?:;\s*secondary region:\s*{name}\s*)?\."
    tail = r"(?i)\s*Classification:\s*primary\s+`[^`\n]+`[\s\S]*$"
    one, two = region_name(primary), region_name(secondary)
    head = F.when(secondary.isNull(), F.concat(F.lit("Primary region: `"), one, F.lit("`."))).otherwise(F.concat(F.lit("Primary region: `"), one, F.lit("`; secondary region: `"), two, F.lit("`.")))
    out = F.when(role.rlike(prefix), F.concat(head, F.regexp_replace(role, prefix, ""))).otherwise(role)
    end = F.when(secondary.isNull(), F.concat(F.lit("Classification: primary `"), one, F.lit("`; no secondary region."))).otherwise(F.concat(F.lit("Classification: primary `"), one, F.lit("`; secondary `"), two, F.lit("`.")))
    body = F.rtrim(F.regexp_replace(out, tail, ""))
    return F.when(out.rlike(tail), F.when(body == "", end).otherwise(F.concat(body, F.when(body.rlike(r"[.!?]$"), " ").otherwise(". "), end))).otherwise(out)


def with_front_matter(text: Column, key: str, value: Column) -> Column:
    """A card with a field of its front matter set: in place if it is there, else as the last one."""
    line, front = rf"(?m)^{key}:.*$", r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"
    block, body = F.regexp_extract(text, front, 1), F.regexp_replace(text, front, "")
    new = F.concat(F.lit(f"{key}: "), value)
    set_ = F.when(block.rlike(line), F.regexp_replace(block, F.lit(line), F.regexp_replace(new, r"([\\$])", r"\\$1"))).otherwise(F.concat_ws("\n", F.when(block != "", block), new))
    return F.concat(F.lit("---\n"), set_, F.lit("\n---\n"), body)


def cut_at_mark(text: Column, most: int) -> Column:
    """The first `most` characters, less a last one whose combining marks would be left behind."""
    head = F.substring(text, 1, most)
    split_ = F.regexp_extract(F.substring(text, most + 1, 1), r"^\p{M}", 0) != ""
    return F.when(split_, F.regexp_replace(head, r"\P{M}\p{M}*$", "")).otherwise(head)


def provenance_marks(text: Column) -> Column:
    """The JSON objects in HTML comments of an annotation."""
    return F.regexp_extract_all(text, F.lit(r"<!--\s*(\{.*?\})\s*-->"), F.lit(1))
