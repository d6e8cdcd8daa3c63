"""Secrets in texts, by a trigram inverted index and regular expressions.

From each rule's expression comes a Boolean query of trigrams: every run of its mandatory strings must occur, a run as
one of its alternatives, an alternative with all of its trigrams. The index holds a posting (trigram, row) for every
trigram that a text has. Intersected postings give the candidates of each rule, and only those are matched with its
expression; a rule without mandatory trigrams scans every text. Case is folded in the index, so a candidate may fail, but
no match is missed. Everything is DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as token
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.shared import BROADCAST_ROWS, materialize, table

#: Strings of a run and letters of a class that are spelled out; beyond them a run ends.
MOST_STRINGS, MOST_LETTERS = 64, 8


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and without overlaps; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules. A run of 20 or 24 characters, asked for as such, gives the matches that are left
# when shorter runs are dropped, as no match begins within a run of the same characters.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds that have a form of their own.
MORE = (
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,256}:[^\x20\x09-\x0D/:@]{1,256}@"),
)


def _strings(op, value) -> set[str] | None:
    """All strings that a part of an expression matches, if they are few; else None."""
    if op is token.LITERAL:
        return {chr(value)}
    if op is token.IN:
        letters: set[str] = set()
        for kind, x in value:
            if kind is token.RANGE and x[1] - x[0] < MOST_LETTERS:
                letters |= {chr(c) for c in range(x[0], x[1] + 1)}
            elif kind is token.LITERAL:
                letters.add(chr(x))
            else:
                return None
        return letters if len(letters) <= MOST_LETTERS else None
    if op is token.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op is token.SUBPATTERN:
        return _sequence(value[-1])
    if op is token.MAX_REPEAT and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence(parsed) -> set[str] | None:
    out = {""}
    for op, value in parsed:
        more = _strings(op, value)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _runs(parsed) -> list[set[str]]:
    """Sets of strings of which every match has one each."""
    runs, now = [], {""}
    for op, value in parsed:
        more = _strings(op, value)
        if more is not None and len(now) * len(more) <= MOST_STRINGS:
            now = {a + b for a in now for b in more}
            continue
        runs.append(now)
        now = {""} if more is None else more
        if op is token.SUBPATTERN and more is None:
            runs += _runs(value[-1])
        elif op is token.MAX_REPEAT and value[0] >= 1 and more is None:
            runs += _runs(value[2])
    return [*runs, now]


def trigrams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[k : k + 3] for k in range(len(low) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of: any of: all of these trigrams. Empty where no trigram is mandatory.

    An alternative that has all trigrams of another one is implied by it and left out.
    """
    query = []
    for run in _runs(parser.parse(re.compile(pattern).pattern)):
        if min(map(len, run)) >= 3:
            sets = {trigrams(s) for s in run}
            query.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))
    return query


def index_pattern(wanted: set[str]) -> str:
    """An expression that captures, at every place of a text, the wanted trigram that begins there."""
    heads: dict[str, dict[str, set[str]]] = {}
    for a, b, c in sorted(wanted):
        heads.setdefault(a, {}).setdefault(b, set()).add(c)
    tail = lambda third: f"[{''.join(map(_in_class, sorted(third)))}]"
    branch = lambda second: "|".join(f"{re.escape(b)}{tail(third)}" for b, third in second.items())
    return "(?i)(?=(" + "|".join(f"{re.escape(a)}(?:{branch(second)})" for a, second in heads.items()) + "))"


def _in_class(c: str) -> str:
    return "\\" + c if c in r"\]^[-&" else c


def row_key(doc_id: str, text: str) -> Column:
    """A row's name in the index. Rows that share one are candidates together, which matching then tells apart."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def postings(docs: DataFrame, wanted: set[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index: (trigram, row), sorted by trigram in ranges that split a frequent one; all trigrams, or those wanted.

    An index of the trigrams that rules name is as good for them as one of all and takes little room. Null and short
    texts have no postings; texts are read whole.
    """
    pattern = index_pattern(wanted) if wanted is not None else "(?s)(?=(...))"
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), F.lower))
    rows = docs.select(row_key(doc_id, text).alias("row"), F.explode(found).alias("trigram"))
    held = materialize(rows.select("trigram", "row"), "postings")
    return materialize(held.repartitionByRange("trigram", "row").sortWithinPartitions("trigram", "row"), "trigram-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, rules array<string>): the rules whose trigram query a row's postings satisfy.

    Sums of bits, which are combined before they are shuffled: of an alternative's trigrams, then of a rule's runs.
    """
    spark = index.sparkSession
    asked, all_of, runs_of, wanted = [], [], [], set()
    for rule in rules:
        query = trigram_query(rule.pattern)
        if query:
            runs_of.append((rule.kind, (1 << len(query)) - 1))
        for r, run in enumerate(query):
            for a, alternative in enumerate(run):
                all_of.append((rule.kind, r, a, (1 << len(alternative)) - 1))
                asked += [(t, rule.kind, r, a, 1 << k) for k, t in enumerate(sorted(alternative))]
                wanted |= alternative
    # These tables are as long as the rules, whatever the documents are.
    terms = F.broadcast(spark.createDataFrame(asked, "trigram string, kind string, run int, alternative int, bit long"))
    wholes = F.broadcast(spark.createDataFrame(all_of, "kind string, run int, alternative int, whole long"))
    rows = index.where(F.col("trigram").isin(sorted(wanted))).join(terms, "trigram")
    rows = rows.groupBy("row", "kind", "run", "alternative").agg(F.bit_or("bit").alias("bits"))
    rows = rows.join(wholes, ["kind", "run", "alternative"]).where(F.col("bits") == F.col("whole"))
    runs = F.broadcast(spark.createDataFrame(runs_of, "kind string, runs long"))
    rows = rows.groupBy("row", "kind").agg(F.bit_or(F.expr("shiftleft(1L, run)")).alias("bits"))
    rows = rows.join(runs, "kind").where(F.col("bits") == F.col("runs"))
    return rows.groupBy("row").agg(F.collect_set("kind").alias("rules"))


def matches(text: Column, rule: Rule) -> Column:
    """A rule's matches in a text, as strings."""
    return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))


def spans(text: Column, found: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> in code points, from matches(): between them lie the pieces that a split
    leaves, so lengths added up are places."""
    pieces = F.split(text, rule.pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    step = lambda acc, k: F.struct(
        (acc["at"] + F.length(pieces[k - 1]) + F.length(found[k - 1])).cast("long").alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(pieces[k - 1])).cast("long").alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
            (acc["at"] + F.length(pieces[k - 1]) + F.length(found[k - 1])).cast("long").alias("end"),
        ))).alias("out"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    out = F.aggregate(F.sequence(F.lit(1), F.size(found)), start, step)["out"]
    if rule.least:
        long_enough = F.transform(found, lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)
        out = F.transform(F.filter(F.arrays_zip(out.alias("span"), long_enough.alias("ok")), lambda x: x["ok"]), lambda x: x["span"])
    return F.when(F.size(found) > 0, out).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with secrets, array<struct<start, order, kind, end>> of all rules' matches by start, then by rule.

    Places count code points, ends are exclusive; matches of different kinds may overlap. Null and empty texts have
    none; texts are matched whole, of any length. Rows that share an id, or are equal, or have none, are each scanned. An
    empty table gives an empty result. A column named secrets is replaced.

    Candidates are joined to the documents' texts; they are broadcast where BROADCAST_ROWS holds them, else both sides
    are shuffled by the row's hash, where adaptive execution splits rows that are equal and frequent.
    """
    full = [r for r in rules if not trigram_query(r.pattern)]
    wanted = {t for r in rules for run in trigram_query(r.pattern) for a in run for t in a}
    rows = docs.select(*(F.col(c) for c in docs.columns if c != "secrets"))
    own = {c: f"__own_{n}" for n, c in enumerate(rows.columns)}
    rows = rows.withColumnsRenamed(own)
    t, i = own[text], own[doc_id]
    if wanted:
        asked = candidates(postings(rows.where(F.length(t) >= 3), wanted, t, i), tuple(r for r in rules if r not in full))
        asked = materialize(asked, "candidates")
        few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        rows = rows.withColumn("__row", row_key(i, t)).join(F.broadcast(asked) if few else asked, F.col("__row") == F.col("row"), "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    none, body = F.array().cast("array<string>"), F.coalesce(F.col(t), F.lit(""))
    named = {r: f"__found_{n}" for n, r in enumerate(rules)}
    for r, c in named.items():
        rows = rows.withColumn(c, matches(body, r) if r in full else F.when(F.array_contains("rules", r.kind), matches(body, r)).otherwise(none))
    every = F.array_sort(F.concat(*(spans(body, F.col(c), r, n) for n, (r, c) in enumerate(named.items()))))
    return rows.select(*(F.col(x).alias(c) for c, x in own.items()), every.alias("secrets"))


def listed(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("secrets", lambda s: s["order"] == n)).cast("long")
    base = listed(F.filter("secrets", lambda s: s["order"] < len(BASE)))
    return found.select(
        "doc_id", *(count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)), F.sha2(base, 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans")
    )


def _rule_sql(order: int, rule: Rule) -> str:
    """The matches of every text, each between two pieces of a split, and places from the lengths before it."""
    p = rule.pattern.replace("'", "''")
    kept = f"WHERE length(regexp_extract(m, '{p}', {rule.group})) >= {rule.least}" if rule.least else ""
    return f"""
  SELECT row, {order} AS n, '{rule.kind}' AS kind, past + before AS start, past + before + length(m) AS finish FROM (
    SELECT row, m, length(piece) AS before, coalesce(sum(length(piece) + length(m)) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past
    FROM (SELECT row, unnest(ms) AS m, unnest(ps[:len(ms)]) AS piece, unnest(range(len(ms))) AS k FROM (
      SELECT row, regexp_extract_all(body, '{p}', 0) AS ms, string_split_regex(body, '{p}') AS ps FROM d))) {kept}"""


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
span AS ({" UNION ALL ".join(_rule_sql(n, r) for n, r in enumerate(BASE + MORE))}),
joined AS (
  SELECT row, {", ".join(f"count(*) FILTER (n = {n}) AS n_{r.kind}" for n, r in enumerate(BASE))},
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, n) FILTER (n < {len(BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, n) AS spans
  FROM span GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (row)
"""
