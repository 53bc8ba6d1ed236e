"""Conversation repair against a search over the grammar's states that keeps the smallest audit of least cost."""

import hashlib
import random
import zlib

import pytest

from corpusloom.llm import repair as rp

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_audit(turns):
    """(initial, fault) pairs: cost and audit, by relaxing (turns read, letters written mod 2) with whole audits as labels."""
    step = {0: {"u": 2, "s": 1}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {(0, 0): (0, "")}
    for i in range(len(turns) + 1):
        for _ in range(3):  # two insertions in a row are enough to come back to a state
            for state in range(4):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    for letter, after in step[state].items():
                        if letter != "s":
                            best[i, after] = min(best.get((i, after), (9**9, "")), (cost + 3, audit + "I"))
        if i == len(turns):
            break
        initial, fault = turns[i]
        for state in range(4):
            if (i, state) not in best:
                continue
            cost, audit = best[i, state]
            options = [(state, cost + 4, audit + "D")]
            if fault not in (rp.BLANK, rp.DUPLICATE):
                for letter, after in step[state].items():
                    if letter == initial:
                        options.append((after, cost + 3 * (fault == rp.CUT), audit + "K"))
                    elif letter != "s":
                        options.append((after, cost + 3 + 3 * (fault == rp.CUT), audit + "R"))
            for after, *option in options:
                best[i + 1, after] = min(best.get((i + 1, after), (9**9, "")), tuple(option))
    return min(best[len(turns), s] for s in (0, 3) if (len(turns), s) in best)


def brute(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, codes = set(), []
        for _, _, role, text in mine:
            bare = text.strip(SPACE)
            fault = rp.BLANK if not bare else rp.DUPLICATE if (role, text) in seen else rp.CUT if bare[-1] not in ".!?" else rp.FINE
            seen.add((role, text))
            codes.append((role[:1], fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = brute_audit(codes)
        lines, at, state = [], 0, "a"
        for edit in audit:
            role, text = "", ""
            if edit != "I":
                _, _, role, text = mine[at]
                at += 1
            if edit == "D":
                continue
            if edit in "RI":
                role = "assistant" if state == "u" else "user"
            state = "a" if role[:1] == "s" else role[:1]
            lines.append(f"{role}:{text}")
        n = [sum(f == kind for _, f in codes) for kind in (rp.BLANK, rp.DUPLICATE, rp.CUT)]
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(df):
    return sorted((tuple(r) for r in rp.damaged_and_repaired(df).select(*COLUMNS).collect()), key=repr)


def random_turns(draw, n):
    return [(draw.choice("uuuaaasx"), draw.choices([rp.FINE, rp.BLANK, rp.DUPLICATE, rp.CUT], [6, 1, 1, 2])[0]) for _ in range(n)]


def test_alignment_equals_search_over_states():
    draw = random.Random(3)
    for n in [*range(9)] * 60 + [40] * 10:
        turns = random_turns(draw, n)
        cost, audit = brute_audit(turns)
        got = min(x for end in (rp.NONE, rp.AFTER_A) if (x := rp.align(turns, rp.NONE, end)) is not None)
        assert got == (cost, audit), turns


def test_pieces_join_to_the_whole():
    draw = random.Random(5)
    for n in [0, 1, 2, 5, 9, 30, 60] * 8:
        turns = [(i, *t) for i, t in enumerate(random_turns(draw, n))]
        cuts = sorted(draw.choices(range(n + 1), k=4))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        got = rp._joined(rp._piece(1, k, part, False) for k, part in enumerate(parts))
        assert (got["cost"], got["audit"]) == brute_audit([t[1:] for t in turns])
        assert got["gaps"] == 0 and got["illegal"] == rp._piece(1, 0, turns, True)["illegal"]


def test_long_conversation_in_pieces(spark):
    draw = random.Random(7)
    rows = [(1, t, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["Yes.", "no", "Why?", f"Point {t}.", f"{t}"])) for t in range(700)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in range(2, 30) for t in range(4)]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5)) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "A."), (None, None, None, None), (1, None, "user", "x."), (1, None, "user", "x."), (1, 3, "assistant", "y."), (1, 3, "assistant", "y."),
        (2, 1, "", "no role."), (2, 2, None, "z!"), (3, 5, "user", " "), (3, 9, "User", "Q?"), (4, 0, "user", "long " * 300_000), (5, 8, "system", "S."),
        (6, -4, "assistant", "é"), (6, 7, "assistant", "\x85."),
    ]
    rows += [(c, 0, "user", "gone?") for c in range(100, 160)]  # some lose their only turn
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute(rows), key=repr)
    assert any(w[7] == "" and w[0] is not None and w[0] >= 100 for w in want)
    assert run(df) == want
    assert run(df.selectExpr("*", "1 AS conv", "'x' AS gone", "2 AS part", "3 AS audit", "4 AS digest")) == want
    assert run(df.limit(0)) == []
    named = rp.damaged_and_repaired(df.selectExpr("cast(conv_id AS string) AS c", "turn AS t", "role AS r", "text AS x"), "c", "t", "r", "x")
    assert named.schema["conv_id"].dataType.simpleString() == "string" and named.count() == len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_table(spark, sf, seed):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert run(df.repartition(3 * seed)) == sorted(brute(rows), key=repr)
