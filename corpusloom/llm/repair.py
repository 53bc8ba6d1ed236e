"""Repair of conversation structure by Wagner-Fischer alignment with target strings.

A well-formed conversation has the role initials (s?(ua)+)?. Its turns are aligned to the grammar string of every
feasible length. The strings of all lengths that end alike share their suffixes, so one table holds the distances of all
of them: a row for each turn, a column for each number of letters that remain. Ukkonen's band leaves out cells that cost
more than a greedy alignment does. Of all lengths of least cost the audits are backtraced, letter by letter the smallest
that stays on a cheapest path, and compared.

Conversations may be of any length: Spark sorts all turns into ranges, a task aligns pieces of at most `PIECE` turns
from each state of the grammar to each, and the pieces of a conversation are joined in order. Of equally dear audits of
a piece none begins another one (it would lack only insertions, which cost), so the smallest of a whole conversation
is put together from the smallest of its pieces. Texts are read in order as a stream, and only their digest is kept.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import saved

# The costs of the edits, of a truncated turn that stays, and of what can't be.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
PIECE = 256
MARK = r"[^\x20\x09-\x0D]"
# Faults of a turn.
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
# States of the grammar: nothing yet, after s, after u, after a.
NONE, AFTER_S, AFTER_U, AFTER_A = range(4)
LEGAL = {"su", "ua", "au"}


# ---- alignment of a piece

Turn = tuple[str, int]  # a role's initial and a fault


def _greedy(turns: list[Turn], state: int, end: int) -> int:
    """The cost of an alignment that never looks ahead; every cheapest one costs no more."""
    cost = 0
    for initial, fault in turns:
        if fault in (BLANK, DUPLICATE):
            cost += DELETE
        elif state == NONE and initial == "s":
            cost, state = cost + TRUNCATED * (fault == CUT), AFTER_S
        else:
            wanted = "a" if state == AFTER_U else "u"
            cost += TRUNCATED * (fault == CUT) + REROLE * (initial != wanted)
            state = AFTER_U if wanted == "u" else AFTER_A
    return cost + INSERT * (end - 1 if state < AFTER_U else (end - state) % 2)


class Table:
    """Distances of turns i, i+1, … to the last r letters of the strings that end with u (end AFTER_U) or a (AFTER_A)."""

    def __init__(self, turns: list[Turn], end: int, most: int) -> None:
        self.turns, self.end = turns, end
        forced = [0]
        for _, fault in reversed(turns):
            forced.append(forced[-1] + (fault in (BLANK, DUPLICATE)))
        forced.reverse()
        spare = most - DELETE * forced[0]  # what a path may cost beyond the deletions that it can't avoid
        n = len(turns)
        after: dict[int, int] = {}
        self.rows: list[dict[int, int]] = [after] * (n + 1)
        for i in range(n, -1, -1):
            free = n - i - forced[i]
            row: dict[int, int] = {}
            stay = [self._stay(i, letter) for letter in "ua"] if i < n else [NEVER, NEVER]
            for r in range(max(0, free - spare // DELETE), free + spare // INSERT + 1):
                best = 0 if i == n and r == 0 else NEVER
                if i < n:
                    best = min(best, after.get(r, NEVER) + DELETE)
                    if r:
                        best = min(best, after.get(r - 1, NEVER) + stay[self._letter(r) == "a"])
                if r:
                    best = min(best, row.get(r - 1, NEVER) + INSERT)
                if best <= most:
                    row[r] = best
            self.rows[i] = after = row

    def _letter(self, r: int) -> str:
        """The first of the last r letters."""
        return "a" if (r % 2 == 1) == (self.end == AFTER_A) else "u"

    def _stay(self, i: int, letter: str) -> int:
        initial, fault = self.turns[i]
        return NEVER if fault in (BLANK, DUPLICATE) else TRUNCATED * (fault == CUT) + REROLE * (initial != letter)

    def lengths(self, i: int, state: int) -> list[int]:
        """The numbers of letters left that lead from a state before turn i to the end."""
        first = "a" if state == AFTER_U else "u"
        return [r for r in self.rows[i] if (r > 0 and self._letter(r) == first) or (r == 0 and state == self.end)]

    def audit(self, i: int, r: int) -> str:
        """The smallest audit among the cheapest of turns i, i+1, … and r letters."""
        out, n = [], len(self.turns)
        while i < n or r:
            cost = self.rows[i][r]
            if i < n and self.rows[i + 1].get(r, NEVER) + DELETE == cost:
                out.append("D")
                i += 1
            elif r and self.rows[i].get(r - 1, NEVER) + INSERT == cost:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[i][0] == self._letter(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(turns: list[Turn], state: int, end: int) -> tuple[int, str] | None:
    """The least cost and the smallest audit of that cost that lead from one state to another; None if nothing does."""
    n = len(turns)
    found: list[tuple[int, str]] = []
    systems = [i for i, (initial, fault) in enumerate(turns) if state == NONE and initial == "s" and fault not in (BLANK, DUPLICATE)]
    if end in (NONE, AFTER_S):
        if state == end:
            found.append((DELETE * n, "D" * n))
        found += [(DELETE * (n - 1) + TRUNCATED * (turns[i][1] == CUT), "D" * i + "K" + "D" * (n - 1 - i)) for i in systems if end == AFTER_S]
        return min(found, default=None)
    most = _greedy(turns, state, end)
    table = Table(turns, end, most)
    starts = [(0, state, 0, "")] + [(i + 1, AFTER_S, DELETE * i + TRUNCATED * (turns[i][1] == CUT), "D" * i + "K") for i in systems]
    costs = [(before + table.rows[i][r], i, r, head) for i, at, before, head in starts if before <= most for r in table.lengths(i, at)]
    least = min(cost for cost, *_ in costs)
    return least, min(head + table.audit(i, r) for cost, i, r, head in costs if cost == least)


# ---- pieces of a conversation

PATHS = "array<struct<start:int,end:int,cost:long,audit:string>>"
PIECE_COLUMNS = (
    "piece long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, different long, "
    f"paths {PATHS}"
)
AUDIT_COLUMNS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_ARROW = {
    "long": pa.int64(), "string": pa.string(),
    PATHS: pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}


def _piece(conv: object, number: int, turns: list[tuple], whole: bool) -> dict:
    """What a run of turns (turn, initial, fault) of a conversation adds to it. A whole conversation has one start."""
    numbers = [t for t, _, _ in turns if t is not None]
    codes = [(initial, fault) for _, initial, fault in turns]
    faults = [fault for _, fault in codes]
    paths = []
    if turns:
        for start in (NONE,) if whole else range(4):
            for end in (NONE, AFTER_A) if whole else range(4):
                if (found := align(codes, start, end)) is not None:
                    paths.append({"start": start, "end": end, "cost": found[0], "audit": found[1]})
    return {
        "conv": conv, "piece": number, "n": len(turns), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
        "illegal": sum(a[0] + b[0] not in LEGAL for a, b in zip(codes, codes[1:])), "first": codes[0][0] if codes else None, "last": codes[-1][0] if codes else None,
        "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "different": len(set(numbers)), "paths": paths,
    }


def _joined(pieces: Iterator[dict]) -> dict:
    """A conversation from its pieces in order. Held at a time: one piece, and an audit for each state of the grammar."""
    best: dict[int, tuple[int, list[str]]] = {NONE: (0, [])}
    totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    conv, low, high, different, last, any_turn = None, None, None, 0, None, False
    for piece in pieces:
        conv = piece["conv"]
        if not piece["n"]:
            continue
        for name in totals:
            totals[name] += piece[name]
        totals["illegal"] += any_turn and last + piece["first"] not in LEGAL
        last, any_turn = piece["last"], True
        if piece["low"] is not None:
            different += piece["different"] - (high == piece["low"])
            low, high = piece["low"] if low is None else low, piece["high"]
        steps: dict[int, tuple[int, list[str]]] = {}
        for path in piece["paths"]:
            if path["start"] in best:
                cost, audits = best[path["start"]]
                option = (cost + path["cost"], [*audits, path["audit"]])
                known = steps.get(path["end"])
                if known is None or option[0] < known[0] or option[0] == known[0] and "".join(option[1]) < "".join(known[1]):
                    steps[path["end"]] = option
        best = {state: (cost, ["".join(audits)]) for state, (cost, audits) in steps.items()}
    cost, audit = min((cost, "".join(audits)) for state, (cost, audits) in best.items() if state in (NONE, AFTER_A))
    return {"conv": conv, "gaps": high - low + 1 - different if low is not None else 0, **totals, "cost": cost, "audit": audit}


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Neighbouring rows that share their first value, as streams."""
    row = next(rows, None)

    def members(key: object) -> Iterator[tuple]:
        nonlocal row
        while row is not None and row[0] == key:
            yield row
            row = next(rows, None)

    while row is not None:
        key = row[0]
        group = members(key)
        yield key, group
        for _ in group:  # what the reader left
            pass


def _mapped(df: DataFrame, rows_of: Callable[[Iterator[tuple]], Iterator[dict]], name: str, columns: str, most: int = 1_000) -> DataFrame:
    """A mapInArrow from rows to rows: the first column, of any type, is called `name`; then come `columns`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fixed = (column.split(" ", 1) for column in columns.split(", "))
        schema = pa.schema([(name, first.schema.field(0).type), *((c, _ARROW[kind]) for c, kind in fixed)])
        rows = rows_of(row for batch in itertools.chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
        while batch := list(itertools.islice(rows, most)):
            yield pa.RecordBatch.from_pylist(batch, schema)

    return df.mapInArrow(run, f"{name} {df.schema[0].dataType.simpleString()}, {columns}")


# ---- the operators


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: the turns with planted faults, by the CRC-32 of `conv:turn` modulo 20.

    0 takes a turn away (its row stays, marked as gone), 1 empties its text, 2 takes its . ! ? away, 3 repeats it, 4
    makes it the user's. Null roles, texts and parts of the key are one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")), F.lit(20))
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), kind.alias("kind")
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), times.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def audits(turns: DataFrame) -> DataFrame:
    """From conv, turn, role, text, gone: one row for each conversation with its counts, cost and audit."""
    last = F.regexp_extract("text", rf"(?s)({MARK})[\x20\x09-\x0D]*$", 1)
    slim = _ordered(turns).select(
        "conv", "turn", "role", "digest", "gone",
        F.when(~F.col("text").rlike(MARK), BLANK).when(~last.rlike("[.!?]"), CUT).otherwise(FINE).alias("fault"),
    )
    seen = F.row_number().over(Window.partitionBy("conv", "role", "digest", "gone").orderBy("turn")) > 1
    slim = slim.withColumn("fault", F.when(seen & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")))
    slim = saved(slim.select("conv", "turn", "role", "digest", "gone", F.substring("role", 1, 1).alias("initial"), "fault"), "turns")
    order = ["conv", "turn", "role", "digest"]

    def cut(rows: Iterator[tuple]) -> Iterator[dict]:
        # The first and the last conversation of a range may go on in another task; any other in one piece is whole.
        number, held = TaskContext.get().partitionId() << 40, None
        for conv, members in _groups(rows):
            if held is not None:
                yield _piece(*held)
            part: list[tuple] = []
            whole = held is not None
            for _, turn, gone, initial, fault in members:
                if len(part) == PIECE:
                    yield _piece(conv, number, part, False)
                    number, part, whole = number + 1, [], False
                if not gone:
                    part.append((turn, initial, fault))
            held = (conv, number, part, whole)
            number += 1
        if held is not None:
            yield _piece(*held[:3], False)

    def join(rows: Iterator[tuple]) -> Iterator[dict]:
        for _, members in _groups(rows):
            yield _joined(dict(zip(names, row)) for row in members)

    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "gone", "initial", "fault")
    pieces = saved(_mapped(ranged, cut, "conv", PIECE_COLUMNS), "conversation-pieces")
    names = pieces.columns
    return _mapped(pieces.repartition("conv").sortWithinPartitions("conv", "piece"), join, "conv", AUDIT_COLUMNS)


def repaired_lines(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of each line that an audit leaves of the turns (role, text)."""
    state = NONE
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == AFTER_U else "user"
        yield role, text
        state = AFTER_S if state == NONE and role[:1] == "s" else AFTER_A if state == AFTER_U else AFTER_U


def repair(turns: DataFrame) -> DataFrame:
    """From conv, turn, role, text, gone: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row for each conversation, also for one whose turns are all gone. Turns are taken by number (null first), those
    of one number by role and then by the SHA-256 of their text. A null conversation is one of its own.
    """
    found = saved(audits(turns), "audits").withColumn("part", F.lit(0))
    bodies = _ordered(turns.where("not gone")).drop("gone").withColumn("part", F.lit(1))
    both = found.unionByName(bodies, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "digest")
    columns = ["conv", *(c.split(" ")[0] for c in AUDIT_COLUMNS.split(", "))]

    def digest(rows: Iterator[tuple]) -> Iterator[dict]:
        for conv, members in _groups(rows):
            head = dict(zip(columns, next(members)))
            sha, before = hashlib.sha256(), ""
            for role, text in repaired_lines(head["audit"], (row[-2:] for row in members)):
                sha.update(f"{before}{role}:{text}".encode())
                before = "\n"
            yield {**head, "conv_id": conv, "repaired_sha256": sha.hexdigest()}

    return _mapped(both.select(*columns, "role", "text"), digest, "conv_id", AUDIT_COLUMNS + ", repaired_sha256 string")


def damaged_and_repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`repair` of the conversations after `damage`. Other columns are ignored; an empty table gives no rows."""
    return repair(damage(conversations, conv_col, turn_col, role_col, text_col))
