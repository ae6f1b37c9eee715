"""Repair of conversations whose turns are missing, blank, repeated, cut off or in the wrong role.

Rows of a conversation are taken by turn (nulls first, equal turns by the SHA-256 of role and text). Edits: Keep costs 0, Rerole to user
or assistant 2, Delete 3 (which blank and duplicate rows need), Insert an empty user or assistant turn 2; a truncated row that stays adds 1.
The result's roles are an optional system turn and then pairs of user and assistant, or nothing.

A dynamic program over the turns that stay finds the cheapest edits. Two turns that stay next to each other have a gap between them: its
deletions are a difference of prefix sums, its inserts follow from the two roles, and the best next turn for each role is a
running minimum, taken from the end. Rows are then read from the start: of equally cheap edits the one whose initials (D, I, K, R) come first is
made, so the audit is the least of all cheapest ones. This takes time and memory in proportion to the rows of a conversation, a few bytes each.

What decides (initials, faults, digests) is worked out by DataFrame functions and travels without texts; equal rows are counted before they
travel, and whether a text was seen earlier is a join with each text's first turn, which Spark can split where a text is hot. Texts are read once
more, in order, beside the edits of their conversation; only a row at a time is held. A digest of a whole conversation needs its
rows one after the other, so the longest conversation is one task's stream (sorted on disk by Spark), never one task's memory.

Defined results: null role or text count as one space; a null conv_id is a conversation like others; null turns come first and do not count for gaps;
repeated rows are duplicates; a role that begins with neither s, u nor a can be rerolled or deleted only; an empty table gives an empty result;
a conversation without rows has zeros, an empty audit and an empty text; only the four columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise

SPACE = " \t\n\x0b\x0c\r"
DELETE, CHANGE, INSERT, CUT = 3, 2, 2, 1
#: Faults of a row, and what it may begin with; a row's code is 4 * fault + place of its initial.
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
INITIALS = "?sua"
#: Inserts between a turn that stays (nothing, s, u, a) and the next one (s, u, a, the end); None where that can't follow.
_GAP = ((0, 0, 1, 0), (None, 0, 1, 2), (None, 1, 0, 1), (None, 0, 1, 0))
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
#: Codes of a conversation up to which its edits are remembered, and how many of them.
SHORT, REMEMBERED = 24, 1 << 14


def edits(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows with these codes, the ASCII-least ones."""
    return _short_edits(codes) if len(codes) <= SHORT else _edits(codes)


def _edits(codes: bytes) -> tuple[int, str]:
    n = len(codes)
    # least[x]: cost of all that follows a turn in role x (0: none), counted from the conversation's start: deletions up to j are DELETE * j.
    least = [DELETE * n + INSERT * row[3] for row in _GAP]
    chosen = bytearray(4 * n)  # by row and role before: 0 for a deletion, else 2 * the new role, + 1 if rerolled
    for j in range(n - 1, -1, -1):
        fault, own = divmod(codes[j], 4)
        if fault > TRUNCATED:
            continue
        stay = -DELETE + (CUT if fault == TRUNCATED else 0)
        options = [(least[y] + stay + (0 if y == own else CHANGE), y) for y in (1, 2, 3) if y == own or y > 1]
        new = least[:]
        for x, row in enumerate(_GAP):
            best, text, code = least[x], "D", 0
            for cost, y in options:
                m = row[y - 1]
                if m is None:
                    continue
                cost += INSERT * m
                if cost <= best:
                    way = "I" * m + ("K" if y == own else "R")
                    if cost < best or way < text:
                        best, text, code = cost, way, 2 * y + (y != own)
            new[x], chosen[4 * j + x] = best, code
        least = new
    audit, x = [], 0
    for j in range(n):
        code = chosen[4 * j + x]
        if not code:
            audit.append("D")
            continue
        y = code >> 1
        audit.append("I" * _GAP[x][y - 1] + ("R" if code & 1 else "K"))
        x = y
    audit.append("I" * _GAP[x][3])
    return least[0], "".join(audit)


_short_edits = functools.lru_cache(REMEMBERED)(_edits)


def release() -> None:
    _short_edits.cache_clear()


def repair(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that the edits of an audit leave of rows, one at a time."""
    last = "a"  # what an insert or a new role is to follow
    for op in audit:
        if op == "I":
            last = "u" if last == "a" else "a"
            yield {"u": "user", "a": "assistant"}[last], ""
            continue
        role, text = next(rows)
        if op == "K":
            last = "a" if role[:1] == "s" else role[:1]
            yield role, text
        elif op == "R":
            last = "u" if last == "a" else "a"
            yield {"u": "user", "a": "assistant"}[last], text


def _own(conversations: DataFrame) -> DataFrame:
    """Rows with nulls replaced, how often they stand there (times, 1 if there is no such column), and their digest."""
    times = F.col("times").cast("long") if "times" in conversations.columns else F.lit(1).cast("long")
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), times.alias("times"),
    )
    return own.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def plan(conversations: DataFrame) -> DataFrame:
    """The edits of each conversation (see PLAN) from conv_id, turn, role, text and, if there is such a column, times: 0 for a row that only names its
    conversation."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(stripped == "", BLANK).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    place = F.greatest(F.instr(F.lit(INITIALS[1:]), F.substring("role", 1, 1)), F.lit(0))
    code = F.when(F.col("role") == "", fault * 4).otherwise(fault * 4 + place)
    there = F.col("times") > 0
    light = _own(conversations).select("conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("digest")).alias("digest"), F.when(there, code).alias("code"), "times")
    light = materialise(light.groupBy("conv_id", "turn", "digest", "code").agg(F.sum("times").alias("times")), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = light.where("times > 0").groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(when).alias("_first"))
    seen = light.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    ordered = seen.select("conv_id", "turn", "digest", "code", "times", (when > F.col("_first")).alias("later")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")
    return map_arrow(ordered.drop("digest"), _plans, PLAN)


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[tuple] = []
    codes, turns, now = bytearray(), [None, None, 0], ()  # least and largest turn, and how many

    def close() -> None:
        cost, audit = edits(bytes(codes))
        faults = [0, 0, 0, 0]
        for c in range(16):
            faults[c >> 2] += codes.count(c)
        illegal = sum(1 for a, b in zip(codes, memoryview(codes)[1:]) if (a & 3, b & 3) not in ((1, 2), (2, 3), (3, 2)))
        done.append((now[0], turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, audit))

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _PLAN)], schema=_PLAN)
        done.clear()
        return batch

    size = 0
    for b in batches:
        for conv, turn, code, times, later in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "code", "times", "later"))):
            if now != (conv,):
                if now:
                    close()
                    size += len(codes)
                    if len(done) == 4096 or size > 1 << 24:
                        yield out()
                        size = 0
                codes, turns, now = bytearray(), [None, None, 0], (conv,)
            if not times:
                continue
            if turn is not None and turn != turns[1]:
                turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            again = code if code >> 2 == BLANK else 4 * DUPLICATE + (code & 3)
            codes.append(again if later else code)
            codes += bytes([again]) * (times - 1)
    if now:
        close()
    if done:
        yield out()


def _beside(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit, and behind it its rows in order."""
    rows = _own(conversations).where("times > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "digest", "role", "text", "times")
    heads = plans.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"))
    # The audit has no digest, so it comes before rows without a turn.
    both = rows.unionByName(heads).withColumn("_head", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_head", "turn", "digest").drop("_head", "turn", "digest")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """(conv_id, its repaired turns) of a sorted stream; the turns are to be read before the next conversation."""
    stream = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times"))))
    waiting: list[tuple] = []

    def rows() -> Iterator[tuple[str, str]]:
        for row in stream:
            if row[1] is not None:
                waiting.append(row)
                return
            for _ in range(row[4]):
                yield row[2], row[3]

    for first in stream:
        waiting.append(first)
        while waiting:
            conv, audit, *_ = waiting.pop()
            own = rows()
            yield conv, repair(audit, own)
            for _ in own:  # nothing is left here but what follows the last row
                pass


def repaired(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that a table of plan() leaves, in order from 0."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for conv, turns in _each(batches):
            for place, (role, text) in enumerate(turns):
                held.append((conv, place, role, text))
                size += len(text)
                if len(held) == 4096 or size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return map_arrow(_beside(conversations, plans), run, "conv_id long, place long, role string, text string")


def digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """plans with repaired_sha256: of the `role:text` of the repaired turns, joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for conv, turns in _each(batches):
            sha = hashlib.sha256()
            for place, (role, text) in enumerate(turns):
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            held.append((conv, sha.hexdigest()))
            if len(held) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held])], names=["_conv", "repaired_sha256"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held])], names=["_conv", "repaired_sha256"])

    found = map_arrow(_beside(conversations, plans), run, "_conv long, repaired_sha256 string")
    return plans.join(found, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of rows damaged by crc32(`conv_id:turn`) % 20: 0 drops a row (times 0), 1 empties its text, 2 removes its
    ends of sentences, 3 repeats it, 4 makes it the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    role, text = shown("role"), shown("text")
    return conversations.select(
        F.col("conv_id"), F.col("turn"), F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("times"),
    )
