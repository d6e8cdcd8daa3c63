"""Structure repair of conversations by signature.

Every turn becomes one letter for its role and its fault, and a conversation the string of its letters. Each distinct
string is solved once: recursion over its halves, memoised by substring, gives for every pair of states (nothing yet,
after system, after user, after assistant) the cheapest edits that lead from one to the other. Answers are joined back
to the conversations, and the edits are replayed over the turns as they stream by.

A conversation's letters are gathered in pieces, its texts never: where one conversation holds much of the table, its
turns pass through one task in order, as a digest of the whole asks for, and only its letters (a byte a turn) are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.shared import SPACE_CHARS, materialize, prepare, table

#: Letters of a turn: role u, a, s or another (x), each without fault, truncated, blank and as a duplicate.
ROLES, LETTERS = "uasx", "uasxUASX01234567"
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Costs of the edits; a truncated turn that stays adds its own.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
#: States after the turns so far: none, a system turn, a user turn, an assistant turn. A conversation may end in the
#: first and the last, and the next role of each pair is fixed.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Letters of a piece, distinct substrings remembered and their greatest length.
PIECE, REMEMBERED, SHORT = 4_096, 8_192, 64
#: A signature of more than this part of all conversations is broadcast: there are at most as many as its inverse.
OFTEN = 1e-4


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): turns damaged by crc32 of `conv_id:turn` modulo 20, for tests of repairs.

    Nulls read as one space, in the key too, but turns stay null. 0 drops a turn (present is false, so that its
    conversation is still named), 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("case") != 0).alias("present"), copies.alias("copy")).drop("copy")


def read_turns(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, digest, present), nulls of role and text as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    there = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), there.alias("present"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def order(conv: str = "conv_id") -> list[Column]:
    """Order of turns: turns of one number by role, then by the digest of their texts."""
    return [F.asc_nulls_first(conv), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, letters) of read_turns(): the letters of equal turns, which follow each other.

    Equal turns are counted before they are shuffled, and a text's first turn is found by a sum and a join, both of
    which split a text that one conversation repeats very often.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    last = F.substring(bare, -1, 1)
    lines = rows.where("present").groupBy("conv_id", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length(bare) == 0).alias("blank"), F.max(~last.isin(".", "!", "?")).alias("truncated")
    )
    lines = materialize(lines, "turn-lines")
    first = lines.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("from_null"))
    same = F.col("l.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("l.role") == F.col("f.role")) & (F.col("l.digest") == F.col("f.digest"))
    lines = lines.alias("l").join(first.alias("f"), same).select("l.*", "first_turn", "from_null")
    is_first = F.when(F.col("from_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "u", 1).when(initial == "a", 2).when(initial == "s", 3).otherwise(4)
    letter = lambda fault: F.substring(F.lit(LETTERS), fault * 4 + role, F.lit(1))
    again = letter(F.when(F.col("blank"), BLANK).otherwise(DUPLICATE))
    fault = F.when(F.col("blank"), BLANK).when(~is_first, DUPLICATE).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    return lines.select("conv_id", "turn", "role", "digest", F.concat(letter(fault), F.repeat(again, (F.col("n") - 1).cast("int"))).alias("letters"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature) of every conversation of read_turns(), the empty string where none of its turns is present.

    Letters are sorted over ranges and joined to pieces within a task; a conversation's pieces, not its turns, meet.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, now = TaskContext.get().partitionId(), 0, [], 0, None
        for b in batches:
            out = []
            for c, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (c != now or size >= PIECE):
                    out.append((now, part, number, "".join(held)))
                    number, held, size = number + 1, [], 0
                now, size = c, size + len(letters)
                held.append(letters)
            kind = b.schema.field(0).type
            if out:
                yield piece_batch(out, kind)
        if held:
            yield piece_batch([(now, part, number, "".join(held))], kind)

    def piece_batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3])], names=["conv_id", "part", "number", "piece"])

    letters = materialize(coded(rows), "letters").repartitionByRange(*order()).sortWithinPartitions(*order())
    cut = letters.select("conv_id", "letters").mapInArrow(pieces, f"conv_id {conv}, part int, number long, piece string")
    named = rows.groupBy("conv_id").agg(F.lit(-1).alias("part")).select("conv_id", "part", F.lit(0).cast("long").alias("number"), F.lit("").alias("piece"))
    gathered = cut.unionByName(named).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "number", "piece"))).alias("pieces"))
    return gathered.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("signature"))


def _better(a, b):
    return b if a is None or (b is not None and b < a) else a


def _after(a, b):
    return None if a is None or b is None else (a[0] + b[0], a[1] + b[1])


def _joined(left: tuple, right: tuple) -> tuple:
    """Cheapest edits of two runs of turns, one after the other: for each pair of states the least (cost, edits).

    The least of each part gives the least of the whole: of two strings of edits of one cost for the same turns neither
    begins with the other, as every further insertion costs.
    """
    out = []
    for i in range(4):
        for k in range(4):
            best = None
            for j in range(4):
                best = _better(best, _after(left[4 * i + j], right[4 * j + k]))
            out.append(best)
    return tuple(out)


def _insertions() -> tuple:
    """None, one or two insertions; a third would repeat a state."""
    out = [None] * 16
    for i in range(4):
        for n, to in enumerate((i, NEXT[i], NEXT[NEXT[i]])):
            out[4 * i + to] = _better(out[4 * i + to], (n * INSERT, "I" * n))
    return tuple(out)


INSERTIONS = _insertions()


def _turn(letter: str) -> tuple:
    fault, role = divmod(LETTERS.index(letter), 4)
    out = [None] * 16

    def edit(i: int, to: int, cost: int, name: str) -> None:
        out[4 * i + to] = _better(out[4 * i + to], (cost, name))

    for i in range(4):
        edit(i, i, DELETE, "D")
        if fault in (SOUND, TRUNCATED):
            more = STAYS_TRUNCATED if fault == TRUNCATED else 0
            edit(i, NEXT[i], REROLE + more, "R")
            if kept_state(i, ROLES[role]) is not None:
                edit(i, kept_state(i, ROLES[role]), more, "K")
    return tuple(out)


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn that keeps its role; None where it cannot stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def block(letters: str) -> tuple:
    """Cheapest edits of a run of turns, insertions before each of them included, by pairs of states."""
    return _remembered(letters) if len(letters) <= SHORT else _block(letters)


@lru_cache(REMEMBERED)
def _remembered(letters: str) -> tuple:
    return _block(letters)


def _block(letters: str) -> tuple:
    if len(letters) == 1:
        return _joined(INSERTIONS, _turn(letters))
    half = 1 << ((len(letters) - 1).bit_length() - 1)
    return _joined(block(letters[:half]), block(letters[half:]))


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the ASCII-least of equals."""
    whole = _joined(block(signature), INSERTIONS) if signature else INSERTIONS
    return min(x for x in (whole[4 * START + START], whole[4 * START + ASSISTANT]) if x is not None)


def illegal_pairs(signature: str) -> int:
    roles = [ROLES[LETTERS.index(c) % 4] for c in signature]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


SOLVED = "signature string, conversations long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(convs: DataFrame) -> DataFrame:
    """SOLVED of each distinct signature of (conv_id, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, counts = b.column(0).to_pylist(), b.column(1)
            faults = [[sum(s.count(c) for c in LETTERS[4 * f : 4 * f + 4]) for s in names] for f in (BLANK, DUPLICATE, TRUNCATED)]
            cost, audit = zip(*map(solve, names), strict=True) if names else ((), ())
            longs = [pa.array(x, pa.int64()) for x in (*faults, list(map(illegal_pairs, names)), cost)]
            yield pa.RecordBatch.from_arrays([b.column(0), counts, *longs, pa.array(audit, pa.string())], names=[x.split()[0] for x in SOLVED.split(", ")])

    return convs.groupBy("signature").agg(F.count(F.lit(1)).alias("conversations")).mapInArrow(run, SOLVED)


def audits(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit): a row per conversation, those without turns too.

    A turn's first fault counts: blank has no character but white space, duplicate repeats an earlier turn's role and
    text, truncated ends in none of .!? before white space. illegal counts adjacent roles other than su, ua, au. The
    audit has an initial per edit, of Keep, Rerole to user or assistant, Delete and Insert, in order, and gives roles
    (s?(ua)+)? at the least cost; of equals it is the ASCII-least.

    Nulls of role and text read as one space; null turns come first; turns of one number are ordered by role, then by
    the SHA-256 of their texts; a null conv_id is a conversation of its own. An empty role has no initial and can only
    be reroled or deleted. Texts are read whole, of any length; other columns are not read. An empty table gives an
    empty result. An audit is one cell, of a byte a turn.
    """
    prepare(turns.sparkSession)
    rows = read_turns(turns, present)
    convs = materialize(signatures(rows), "signatures")
    answers = materialize(solved(convs), "solved")
    total = answers.agg(F.sum("conversations")).first()[0] or 0
    often = answers.where(F.col("conversations") > total * OFTEN)
    seldom = answers.where(F.col("conversations") <= total * OFTEN)
    kept = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    near = convs.join(F.broadcast(often), "signature").select(kept)
    rest = convs.join(F.broadcast(often.select("signature")), "signature", "left_anti").join(seldom, "signature").select(kept)
    return near.unionByName(rest)


class Replay:
    """Plays an audit's edits over the turns of a conversation, in order, and says what is written."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def expected(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserted(self) -> Iterator[tuple]:
        """(edit, turn, role, text) of the insertions that come next."""
        while self.audit[self.at : self.at + 1] == "I":
            role, self.at, self.state = self.expected(), self.at + 1, NEXT[self.state]
            yield "I", None, role, ""

    def turn(self, turn, role: str, text: str) -> Iterator[tuple]:
        """(edit, turn, role, text) of a turn, after the insertions before it; of a deleted one as it was."""
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            role, self.state = self.expected(), NEXT[self.state]
        elif edit == "K":
            self.state = kept_state(self.state, role[:1])
        yield edit, turn, role, text


def _streamed(turns: DataFrame, audited: DataFrame, present: Column | None) -> DataFrame:
    """Each conversation's audit and then its turns, in order, in one partition; they stream and are not gathered."""
    rows = read_turns(turns, present).where("present")
    heads = audited.select("conv_id", F.lit(False).alias("is_turn"), "audit")
    rows = rows.select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", "text", "digest")
    both = heads.unionByName(rows, allowMissingColumns=True)
    by = [F.asc_nulls_first("conv_id"), F.asc("is_turn"), *order()[1:]]
    return both.repartition("conv_id").sortWithinPartitions(*by).select("conv_id", "is_turn", "audit", "turn", "role", "text")


def repaired_turns(turns: DataFrame, audited: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, number, edit, turn, role, text): every edit of audits() in order, with the role and text that it leaves.

    Deleted turns are listed as they were, with edit D; inserted ones have a null turn. Cases are as in audits().
    """
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, conv, number = None, None, 0
        conv_kind = turn_kind = None
        for b in batches:
            out: list[tuple] = []
            conv_kind, turn_kind = b.schema.field(0).type, b.schema.field(3).type
            for c, is_turn, audit, turn, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                edits = replay.turn(turn, role, text) if is_turn else replay.inserted() if replay else ()
                for e in edits:
                    out.append((conv, number, *e))
                    number += 1
                if not is_turn:
                    replay, conv, number = Replay(audit), c, 0
            yield edit_batch(out, conv_kind, turn_kind)
        if replay:
            yield edit_batch([(conv, number + k, *e) for k, e in enumerate(replay.inserted())], conv_kind, turn_kind)

    def edit_batch(out: list[tuple], conv_kind: pa.DataType, turn_kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        types = (conv_kind, pa.int64(), pa.string(), turn_kind, pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["conv_id", "number", "edit", "turn", "role", "text"])

    schema = f"conv_id {kinds['conv_id']}, number long, edit string, turn {kinds['turn']}, role string, text string"
    return _streamed(turns, audited, present).mapInArrow(run, schema)


def digests(turns: DataFrame, audited: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, gaps, repaired_sha256): per conversation of audits() the numbers missing between its turns, and the hash
    of its repaired `role:text` lines. Texts stream through the hash. Cases are as in audits()."""
    conv = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, now, kind = None, None, None
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for c, is_turn, audit, turn, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if is_turn:
                    now.turn(turn)
                    now.write(replay.turn(turn, role, text))
                    continue
                if replay:
                    out.append(now.close(replay))
                replay, now = Replay(audit), Digest(c)
            yield digest_batch(out, kind)
        if replay:
            yield digest_batch([now.close(replay)], kind)

    def digest_batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (kind, pa.int64(), pa.string()), strict=True)], names=["conv_id", "gaps", "repaired_sha256"])

    return _streamed(turns, audited, present).mapInArrow(run, f"conv_id {conv}, gaps long, repaired_sha256 string")


class Digest:
    """Hash of a conversation's repaired lines so far, and the numbers of its turns, which come sorted."""

    def __init__(self, conv):
        self.conv, self.sha, self.lines = conv, hashlib.sha256(), 0
        self.least = self.last = None
        self.distinct = 0

    def turn(self, turn) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last, self.distinct = turn if self.least is None else self.least, turn, self.distinct + 1

    def write(self, edits: Iterator[tuple]) -> None:
        for edit, _, role, text in edits:
            if edit != "D":
                self.sha.update(f"{chr(10) * bool(self.lines)}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.lines += 1

    def close(self, replay: Replay) -> tuple:
        self.write(replay.inserted())
        gaps = self.last - self.least + 1 - self.distinct if self.distinct else 0
        return self.conv, gaps, self.sha.hexdigest()


def op11_repair(spark, sf_dir):
    turns = damage(table(spark, sf_dir, "conversations"))
    found = materialize(audits(turns, F.col("present")), "audits")
    hashed = digests(turns, found, F.col("present"))
    same = F.col("a.conv_id").eqNullSafe(F.col("d.conv_id"))
    return found.alias("a").join(hashed.alias("d"), same).select("a.*", "gaps", "repaired_sha256")


# The damage, the order of turns and the faults in SQL; the cheapest edits by a backward walk over the turns that keeps,
# for each state, the cost in twelve digits followed by the edits, so that the least string is the answer. Hashes by
# CRC-32's own definition, bit by bit.
_CRC = (
    "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: "
    "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x // 2, 3988292384 * (x % 2))))"
)


def _plus(cost: int, edit: str, rest: str) -> str:
    return f"printf('%012d', substr({rest}, 1, 12)::BIGINT + {cost}) || '{edit}' || substr({rest}, 13)"


def _row_sql(state: int) -> str:
    """The least of deleting, reroling and keeping a turn in this state, given the answers s0 to s3 of the rest."""
    after = f"w.s{NEXT[state]}"
    kept = {START: "CASE initial WHEN 's' THEN w.s1 WHEN 'u' THEN w.s2 END", SYSTEM: "CASE initial WHEN 'u' THEN w.s2 END", USER: "CASE initial WHEN 'a' THEN w.s3 END", ASSISTANT: "CASE initial WHEN 'u' THEN w.s2 END"}[state]
    stays = lambda cost, edit, rest: f"CASE WHEN fault = 'truncated' THEN {_plus(cost + STAYS_TRUNCATED, edit, rest)} WHEN fault = 'sound' THEN {_plus(cost, edit, rest)} END"
    return f"least({_plus(DELETE, 'D', f'w.s{state}')}, {stays(REROLE, 'R', after)}, {stays(0, 'K', f'({kept})')})"


def _insert_sql(state: int) -> str:
    one, two = NEXT[state], NEXT[NEXT[state]]
    return f"least(b{state}, {_plus(INSERT, 'I', f'b{one}')}, {_plus(2 * INSERT, 'II', f'b{two}')})"


OP11_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}) % 20 AS h
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM named UNION ALL SELECT * FROM named WHERE h = 3) WHERE h <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial
  FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, pos, initial, CASE
    WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS previous
  FROM placed),
walk AS (
  SELECT conv_id, max(pos) + 1 AS pos, '000000000000' AS s0, '000000000010II' AS s1, '000000000005I' AS s2, '000000000000' AS s3
  FROM judged GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, {", ".join(f"{_insert_sql(i)} AS s{i}" for i in range(4))} FROM (
    SELECT w.conv_id, w.pos - 1 AS pos, {", ".join(f"{_row_sql(i)} AS b{i}" for i in range(4))}
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos - 1)),
answer AS (SELECT conv_id, substr(s0, 1, 12)::BIGINT AS cost, substr(s0, 13) AS audit FROM walk WHERE pos = 1),
edits AS (
  SELECT conv_id, n, substr(audit, n, 1) AS edit, n - length(regexp_replace(substr(audit, 1, n), '[^I]', '', 'g')) AS pos
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS n FROM answer)),
lines AS (
  SELECT e.conv_id, e.n, e.edit, j.role, CASE WHEN e.edit = 'I' THEN '' ELSE j.text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY e.n)
      - max(CASE WHEN e.edit = 'K' AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS place
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.pos = e.pos AND e.edit <> 'I'
  WHERE e.edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY n) AS body
  FROM lines GROUP BY conv_id),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN answer a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
